"""Large quoted CSV files and JSON arrays read by many tasks.

Records of these formats hold newlines and commas, so a reader that starts in the
middle of a file cannot know whether it stands inside a quoted text. Spark
therefore gives such a file to one task. Here the file is scanned in pieces
(lines for CSV, texts between commas for JSON) by ordinary splittable scans:

1. every block is summed up to one small row: its number of quote marks, and for
   JSON the change of depth it makes if it starts outside a string, or inside;
2. prefix sums of these rows by file give each block its state at the start: a
   block starts inside a text when an odd number of quotes stands before it;
3. every task cuts its blocks into records, now knowing their state; the first
   and last part of a block, which may belong to a record across blocks, come out
   as fragments;
4. fragments (at most two a block) are put together by the block in which their
   record starts. Whole records never move.

Records are parsed by Spark's own ``from_csv`` and ``from_json``. Each has
``file_path``, ``block_start`` and ``record`` (its position among the records that
start in the block): the order of the file, from which ``scan_order.number_records``
makes numbers that depend neither on splits nor on how files are packed into tasks.

Required of a file: UTF-8, ``\\n`` or ``\\r\\n`` line ends; CSV by the usual rules (a
quote opens a field only at its start, a quote inside is doubled); JSON: one array.
What breaks these rules fails the job, as it does in Spark's whole-file reader.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .text import CONTEXT_ARTICLE

KEYS = ["file_path", "block_start"]
QUOTE, BACKSLASH = 34, 92


def _pieces(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(value, file_path, block_start) of every text between separators."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("lineSep", separator).text(paths)
    return df.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], dict]]:
    """(block, its next pieces, its row of states) for neighbours of one block."""
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column("file_path"), b.column("block_start").to_numpy(zero_copy_only=False)
        names = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (block[1:] != block[:-1])])
        extra = [c for c in b.schema.names if c not in ("value", *KEYS)]
        for lo, hi in zip(cut, np.r_[cut[1:], b.num_rows]):
            state = {c: b.column(c)[int(lo)].as_py() for c in extra}
            yield (file[int(lo)].as_py(), int(block[lo])), b.column("value").slice(int(lo), int(hi - lo)).to_pylist(), state


def _unescaped_quotes(raw: np.ndarray) -> np.ndarray:
    """Places of quotes that no odd run of backslashes precedes."""
    at = np.flatnonzero(raw == QUOTE)
    if not len(at):
        return at
    after_slash = (at > 0) & (raw[np.maximum(at - 1, 0)] == BACKSLASH)
    if not after_slash.any():
        return at
    keep = np.ones(len(at), bool)
    for i in np.flatnonzero(after_slash):
        n, p = 0, at[i] - 1
        while p >= 0 and raw[p] == BACKSLASH:
            n, p = n + 1, p - 1
        keep[i] = n % 2 == 0
    return at[keep]


def _depths(raw: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(inside a string?, change of depth at each byte, quotes) of JSON text that starts ``inside`` a string or not."""
    quotes = _unescaped_quotes(raw)
    toggles = np.zeros(len(raw), np.int8)
    toggles[quotes] = 1
    within = (np.cumsum(toggles) + int(inside)) % 2 == 1
    step = np.where((raw == 91) | (raw == 123), 1, np.where((raw == 93) | (raw == 125), -1, 0))
    return within, np.where(within, 0, step), len(quotes)


# --- step 1 and 2: the state of every block ---------------------------------------


def _summaries(pieces: DataFrame, is_json: bool) -> DataFrame:
    """One row a block: ``quotes``, and ``outside`` / ``inside``: change of depth if it starts so."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list[int]] = {}
        for key, values, _ in _groups(batches):
            t = total.setdefault(key, [0, 0, 0])
            text = ",".join(values) if is_json else "\n".join(values)
            if not is_json:
                t[0] += text.count('"')
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            # what started outside may be inside by now: each branch goes on from its own state
            odd = t[0] % 2 == 1
            _, step, n = _depths(raw, odd)
            _, other, _ = _depths(raw, not odd)
            t[1] += int(step.sum())
            t[2] += int(other.sum())
            t[0] += n
        rows = [(*k, *v) for k, v in total.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [*KEYS, "quotes", "outside", "inside"])

    parts = pieces.mapInArrow(task, "file_path string, block_start long, quotes long, outside long, inside long")
    # a block is read by one task; the sum only joins the rows of one block
    return parts.groupBy(*KEYS).agg(F.sum("quotes").alias("quotes"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))


def _states(pieces: DataFrame, is_json: bool) -> DataFrame:
    """(file_path, block_start, odd, depth): inside a text at the start of the block? how deep?"""
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    s = _summaries(pieces, is_json).withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    s = s.withColumn("step", F.when(F.col("odd") == 1, F.col("inside")).otherwise(F.col("outside")))
    return s.select(*KEYS, "odd", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"))


# --- step 3: records and fragments ------------------------------------------------


class _CsvCutter:
    """Lines to records: a record ends at a line end outside quotes."""

    def __init__(self, state: dict):
        self.inside, self.lines = state["odd"] == 1, []

    def add(self, values: list[str]) -> Iterator[str]:
        for v in values:
            if not self.inside and v in ("", "\r"):
                continue  # an empty line between records is none, and takes no number
            self.lines.append(v)
            if v.count('"') % 2:
                self.inside = not self.inside
            if not self.inside:
                yield "\n".join(self.lines)
                self.lines = []

    def rest(self) -> str | None:
        return "\n".join(self.lines) + "\n" if self.lines else None  # an open record goes on with the next block's first line


class _JsonCutter:
    """Texts between commas to the array's items: an item ends at a comma at depth 1 or where the array ends."""

    def __init__(self, state: dict):
        self.inside, self.depth, self.held = state["odd"] == 1, state["depth"], []

    def add(self, values: list[str]) -> Iterator[str]:
        raw = np.frombuffer((",".join(values) + ",").encode(), np.uint8)  # the file's last piece has no comma: it is past the array
        within, step, n = _depths(raw, self.inside)
        depth = self.depth + np.cumsum(step)
        opens = (step > 0) & (depth == 1)
        ends = ((raw == 44) & ~within & (depth == 1)) | ((step < 0) & (depth == 0))
        at = 0
        for i in np.flatnonzero(opens | ends):
            if ends[i]:
                yield "".join(self.held) + raw[at:i].tobytes().decode()
            self.held, at = [], int(i) + 1
        self.inside = self.inside != (n % 2 == 1)
        self.depth = int(depth[-1])
        if at < len(raw) and self.depth:
            self.held.append(raw[at:].tobytes().decode())

    def rest(self) -> str | None:
        return "".join(self.held) if self.held else None


def _records(pieces: DataFrame, is_json: bool) -> DataFrame:
    """(file_path, block_start, record, text) of all records in any order."""
    states = stored(_states(pieces, is_json))  # one row a block
    placed = pieces.join(F.broadcast(states), KEYS, "left") if states.count() <= 1_000_000 else pieces.join(states, KEYS, "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: a whole record; 1: the block's first part; 2: its open end; 3: a block without any end."""
        key, cutter, n, out, size = None, None, 0, [], 0

        def made():
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [*KEYS, "record", "kind", "text"])

        def close():
            rest = cutter.rest()
            if n == 0:
                out.append((*key, 0, 3, rest or ""))
            elif rest is not None:
                out.append((*key, n, 2, rest))

        for k, values, state in _groups(batches):
            if state["odd"] is None:
                raise ValueError("the scan was cut into other blocks than were summed up; run the job again")
            if k != key:
                if key is not None:
                    close()
                key, cutter, n = k, (_JsonCutter if is_json else _CsvCutter)(state), 0
            for text in cutter.add(values):
                out.append((*key, n, 0 if n else 1, text))
                n += 1
                size += len(text)
                if size > 8 << 20:
                    yield made()
                    out, size = [], 0
        if key is not None:
            close()
        yield made()

    cut = placed.mapInArrow(task, "file_path string, block_start long, record long, kind int, text string")
    # a record that ends in a later block than it starts: fragments only, at most two a block
    parts = stored(cut.where(F.col("kind") > 0))
    # a record across blocks is an open end or blocks without any end, then a first part: it ends with that part
    w = Window.partitionBy("file_path").orderBy("block_start", "record").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum((F.col("kind") == 1).cast("long")).over(w), F.lit(0))
    of = parts.select(*KEYS, "record", "kind").withColumn("whole", ended)
    whole = parts.join(of, [*KEYS, "record", "kind"]).groupBy("file_path", "whole").agg(F.array_sort(F.collect_list(F.struct("block_start", "record", "text"))).alias("p"))
    whole = whole.select("file_path", F.col("p")[0]["block_start"].alias("block_start"), F.col("p")[0]["record"].alias("record"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return cut.where(F.col("kind") == 0).select(*KEYS, "record", "text").unionByName(whole)


# --- step 4: parsed ----------------------------------------------------------------


def read_csv_records(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """S5 by header name, split over tasks: the named columns, cast, with ``file_path``, ``block_start``,
    ``record``. As in Spark's reader the first file's header names the columns of all."""
    first = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    records = _records(_pieces(spark, path, "\n"), False).withColumn("text", F.regexp_replace("text", "\\r\\z", ""))
    is_head = (F.col("block_start") == 0) & (F.col("record") == 0)
    fields = ", ".join(f"c{i} string" for i in range(len(first)))
    options = {"escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    rows = records.where(~is_head & (F.col("text") != "")).withColumn("r", F.from_csv("text", fields, options))
    return rows.select(*[F.col(f"r.c{first.index(c)}").cast(t).alias(c) for c, t in columns.items()], *KEYS, "record")


def read_article_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = CONTEXT_ARTICLE) -> DataFrame:
    """S6 split over tasks: the items of one JSON array a file, with ``file_path``, ``block_start``, ``record``."""
    records = _records(_pieces(spark, path, ","), True).withColumn("text", F.btrim("text", F.lit(" \t\r\n")))
    items = records.where(F.col("text") != "").select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("a"), *KEYS, "record")
    return items.select("a.*", *KEYS, "record")
