"""Numbers of rows in scan order, without sorting, shuffling or storing the rows.

A scan has an order already: files by path, blocks by offset, rows as they
stand. Counting rows by (file, block) gives one small row a block; prefix sums
over these give every block its first number; a row's number is that plus its
position in the block, which the scan task knows. Only the counts move: at most
one row for every 128 MB of input.

* Lines (``sources.text.read_lines``): the position comes from
  ``monotonically_increasing_id`` less the block's first one. Both passes scan the
  same plan; should a scan be cut into other blocks than were counted (small
  inputs while a cluster's size changes), a row finds no block and the job fails
  with a message instead of giving wrong numbers.
* Parquet: ``_metadata.row_index`` is the position in the file, so counts by file
  are enough, and the numbers do not depend on splits at all.

``pad_runs`` pads batches of neighbours to their longest row without bringing a
batch together by a shuffle: a batch that lies whole in one run of a task is
padded there; of those cut by a file or task end (at most two an end) the
longest rows are found first and broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Blocks up to which the table of offsets is broadcast (24 bytes a row and a hash of the path); beyond, it is joined.
BROADCAST_BLOCKS = 1_000_000


def _offsets(counts: DataFrame, keys: list[str], within: Sequence[str]) -> DataFrame:
    """One row a block with ``_off``: rows before it, among those alike in ``within``."""
    w = Window.partitionBy(*within).orderBy(*keys) if within else Window.orderBy(*keys)
    return counts.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).select(*keys, "_n", "_off", *[c for c in ["_first"] if c in counts.columns])


def _placed(rows: DataFrame, offsets: DataFrame, keys: list[str], position, name: str) -> DataFrame:
    side = stored(offsets)
    side = F.broadcast(side) if side.count() <= BROADCAST_BLOCKS else side
    joined = rows.join(side, keys, "left")
    at = position(joined)
    known = F.col("_n").isNotNull() & (at >= 0) & (at < F.col("_n"))
    wrong = F.raise_error(F.lit("the scan was cut into other blocks than were counted; run the job again")).cast("long")
    return joined.withColumn(name, F.when(known, F.col("_off") + at).otherwise(wrong))


def number_lines(lines: DataFrame, within: Sequence[str] = (), name: str = "row_index", file_col: str = "file_path", block_col: str = "block_start") -> DataFrame:
    """Lines of ``read_lines``, also filtered, with their number from 0 in (file, block, position) order. Rows
    that differ in ``within`` are counted apart; these columns must not change inside a file (the file itself,
    or its split)."""
    keys = [file_col, block_col]
    tagged = lines.withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy(*keys, *[c for c in within if c not in keys]).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    out = _placed(tagged, _offsets(counts, keys, within), keys, lambda d: F.col("_mid") - F.col("_first"), name)
    return out.drop("_mid", "_first", "_n", "_off")


def number_records(records: DataFrame, name: str = "row_index") -> DataFrame:
    """Records of ``sources.chunked`` with their number from 0 in file order. Blocks come from the scan, but a
    record's number does not: it counts the records before it."""
    keys = ["file_path", "block_start"]
    counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("record").alias("_first"))
    out = _placed(records, _offsets(counts, keys, ()), keys, lambda d: F.col("record") - F.col("_first"), name)
    return out.drop("_n", "_first", "_off", "record", *keys)


def read_numbered(spark: SparkSession, path: str, *cols: str, name: str = "row_index") -> DataFrame:
    """A parquet table's columns with every row's number from 0 in (file, position) order."""
    rows = spark.read.parquet(path).select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    out = _placed(rows, _offsets(counts, ["_file"], ()), ["_file"], lambda d: F.col("_row"), name)
    return out.drop("_file", "_row", "_n", "_off")


def with_batches(numbered: DataFrame, size: int, name: str = "row_index", batch: str = "batch_id") -> DataFrame:
    """E15 / E16 on numbered rows: batch number and position in it."""
    n = F.col(name)
    return numbered.withColumn(batch, F.floor(n / size).cast("long")).withColumn("pos_in_batch", F.pmod(n, F.lit(size)).cast("int"))


def _runs(batch_ids: np.ndarray) -> np.ndarray:
    """First places of runs of equal neighbours."""
    return np.flatnonzero(np.r_[True, batch_ids[1:] != batch_ids[:-1]]) if len(batch_ids) else np.empty(0, np.int64)


def pad_runs(df: DataFrame, ids: str, batch: str, size: int, pad_id: int, multiple: int | None = None, out: str = "padded") -> DataFrame:
    """``out`` = ``ids`` padded to the longest of its batch, rounded up to ``multiple``. Rows of a batch of
    ``size`` must be neighbours in the scan (numbered rows are); ``df`` is written once before its two passes."""
    rows = stored(df)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Longest row of every run shorter than a batch."""
        key, n, most, some = None, 0, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            at, lens = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            first = _runs(at)
            for k, c, m in zip(at[first].tolist(), np.diff(np.r_[first, len(at)]).tolist(), np.maximum.reduceat(lens, first).tolist()):
                if k == key:
                    n, most = n + c, max(most, m)
                else:
                    if key is not None and n < size:
                        some.append((key, most))
                    key, n, most = k, c, m
        if key is not None and n < size:
            some.append((key, most))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([m for _, m in some], pa.int32())], ["batch", "longest"])

    thin = rows.select(F.col(batch).cast("long").alias("batch"), F.size(ids).alias("n"))
    short = thin.mapInArrow(cut, "batch long, longest int").groupBy("batch").agg(F.max("longest").alias("longest"))
    table = {r["batch"]: r["longest"] for r in short.collect()}  # at most two a file or task end
    shared = df.sparkSession.sparkContext.broadcast(table)
    names = rows.columns

    def padded(part: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(part).combine_chunks()
        at = t.column(batch).to_numpy()
        first = _runs(at)
        end = len(at) if last else int(first[-1])  # the last run may go on in the next batch of rows
        if not end:
            return None, part
        done = t.slice(0, end)
        values = done.column(ids).chunk(0)
        lens = np.diff(values.offsets.to_numpy())
        first = first[first < end]
        longest = np.maximum.reduceat(lens, first)
        run = np.diff(np.r_[first, end])
        for i in np.flatnonzero(run < size):
            longest[i] = shared.value[int(at[first[i]])]
        width = np.repeat(longest, run).astype(np.int64)
        if multiple:
            width = -(-width // multiple) * multiple
        stops = np.cumsum(width)
        flat = np.full(int(stops[-1]), pad_id, np.int32)
        starts = stops - width
        where = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        flat[where] = values.flatten().to_numpy(zero_copy_only=False)
        column = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(flat))
        kept = [done.column(c).chunk(0) for c in names]
        return pa.RecordBatch.from_arrays([*kept, column], [*names, out]), t.slice(end).to_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                made, held = padded([*held, b], False)
                if made is not None:
                    yield made
        if held:
            yield padded(held, True)[0]

    return rows.mapInArrow(task, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))
