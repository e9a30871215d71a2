"""Best-fit packing by bulk-synchronous rounds.

A document is its token ids plus an end id. Documents longer than a sequence
are cut into full pieces; the remainder, the first piece, is packed like a
short document. Each round

1. range-sorts the unplaced pieces and the open gaps together, by size from
   large to small (a gap before a piece of its size);
2. sweeps every range for successors: the nearest larger gap not yet taken,
   as one matches brackets. What a range cannot match, it leaves over;
3. resolves left-overs across ranges by rank: of each range only two counts go
   to the driver (number of ranges x 3 numbers), which pairs runs of left-over
   gaps with runs of left-over pieces; rows then meet on (run, rank) in a join;
4. subtracts what was placed from the gaps and repeats. When no piece of the
   size band fits any gap, sequences are opened for the band's remaining pieces.

While the largest unplaced piece M is at most half a gap g, the gap takes part
as ``g // M`` equal slots, so the number of rounds grows with the logarithm of
the lengths, not with the number of pieces in a sequence. The matching of a
round does not depend on how rows are dealt over ranges.

Only (piece, length) rows are shuffled, never texts or ids. Ties go by piece
key. Null text is the empty text (one piece: the end id); repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slices import slices
from ..functions.text import PY_WS
from .common import discard, null_safe_text, stored, worker_cached

CAPACITY = 2048
ROWS_PER_RANGE = 200_000
#: Bytes of texts that are encoded at once, and words that are looked up at once.
SLICE_BYTES = 8 << 20
UNITS = 1 << 20
#: Lower bounds of the size bands, as parts of a sequence.
BANDS = (2, 3, 4, 8)
_AMBIGUOUS = PY_WS + " (?:" + PY_WS + "|\\z)"
_ODD = "\\A" + PY_WS + "|" + PY_WS + "\\z|\\A\\z"


def _vocabulary(path: str):
    """Ranks of a byte-level BPE file and its special strings, read through its own library."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}


def batch_encoder(path: str, pattern: str):
    """``(texts, end) -> (ids, stops)``: the unsigned 32-bit ids of an Arrow array of texts, each followed by the ids
    ``end``, in one row, and where each text stops in it; equal to the file's own tokenizer.

    A space between a non-space and a non-space always starts a pre-token, so a text splits there. Of the words behind
    a space each distinct one is encoded once, all in one call; among the ids, a word starts where a token starts with
    a space. Nothing is kept from array to array. Words that white space begins or ends, and first words, are encoded
    one by one; texts with longer white space around a space, or with a special string, whole.
    """
    import tiktoken

    vocab, special = _vocabulary(path)
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    ranks = {bytes(back[ch] for ch in piece): i for piece, i in vocab.items() if piece not in special}
    enc = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    spaced = np.zeros(enc.max_token_value + 1, dtype=bool)
    spaced[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def whole(text: str) -> np.ndarray:
        return enc.encode_to_numpy(text, allowed_special="all")

    def joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each behind a space, and the number of ids of each."""
        if not len(words):
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        ids = enc.encode_to_numpy(" " + pc.binary_join(row, pa.scalar(" ", words.type))[0].as_py(), disallowed_special=())
        return ids, np.diff(np.flatnonzero(spaced[ids]), append=len(ids))

    def encode(texts: pa.Array, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        hard = pc.match_substring_regex(texts, _AMBIGUOUS)
        for s in special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        parts = pc.split_pattern(pc.if_else(hard, pa.scalar("", texts.type), texts), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        behind = np.ones(len(parts.values), dtype=bool)
        behind[at[:-1]] = False
        words = parts.values.filter(pa.array(behind)).dictionary_encode()
        odd = pc.match_substring_regex(words.dictionary, _ODD)
        # units: the plain words, the odd ones, each text's first word (or all of the text), the end
        bulk, counts = joined(words.dictionary.filter(pc.invert(odd)))
        single = [whole(" " + w) for w in words.dictionary.filter(odd).to_pylist()]
        single += [whole(t) for t in pc.if_else(hard, texts, parts.values.take(pa.array(at[:-1]))).to_pylist()]
        single.append(np.asarray(end, dtype=np.uint32))
        flat = np.concatenate([bulk, *single])
        counts = np.concatenate([counts, [len(x) for x in single]])
        starts = np.cumsum(counts) - counts
        unit = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        # the units of the texts in a row
        first = at[:-1] + np.arange(len(texts))
        last = at[1:] + np.arange(len(texts))
        units = np.full(at[-1] + len(texts), len(counts) - 1)
        units[first] = len(unit) + np.arange(len(texts))
        inner = np.ones(len(units), dtype=bool)
        inner[first] = inner[last] = False
        units[inner] = unit[words.indices.to_numpy()]
        n = counts[units]
        stops = np.cumsum(n)
        out = np.empty(stops[-1], dtype="<u4")
        for a in range(0, len(units), UNITS):  # the places to copy from take several times the ids
            k, to = n[a : a + UNITS], stops[a : a + UNITS]
            lo, hi = to[0] - k[0], to[-1]
            out[lo:hi] = flat[np.repeat(starts[units[a : a + UNITS]] - (to - k), k) + np.arange(lo, hi)]
        return out, stops[last]

    return encode


def encoder(path: str, pattern: str):
    """``text -> little-endian uint32 ids`` equal to the file's own tokenizer."""
    encode = batch_encoder(path, pattern)
    return lambda text: encode(pa.array([text], pa.string()))[0].tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, in whole texts.

    ``pattern`` is the tokenizer's pre-token pattern. A remainder comes first; all
    other pieces are full. ``keep_ids=False`` leaves the ids out for callers that
    only need places and digests.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cached(("bpe", tokenizer, pattern), lambda: batch_encoder(tokenizer, pattern))
        for part in slices(batches, SLICE_BYTES):
            if not len(part):
                continue
            ids, stops = encode(part.column(1), (end_id,))
            n = np.diff(stops, prepend=0)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (n - (pieces - 1) * capacity)[row]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            ends = np.cumsum(length)  # pieces follow one another as the ids do
            crc = [zlib.crc32(ids[b - k : b]) for b, k in zip(ends.tolist(), length.tolist())]
            cols = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view("<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("text"))
    return src.mapInArrow(run, fields)


SWEEP = "kind int, id long, sub int, size long, range int, left long, gap long, gap_sub int"


def _match(kind: np.ndarray) -> np.ndarray:
    """Bracket matching of gaps (kind 0, opening) and pieces (kind 1, closing): for each closing row
    the row of its opening, else -1. Vectorised: rows of one level alternate."""
    step = np.where(kind == 0, 1, -1)
    after = np.cumsum(step)
    level = np.where(kind == 0, after, after + 1)
    order = np.argsort(level, kind="stable")
    out = np.full(len(kind), -1, dtype=np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        ok = (level[a] == level[b]) & (kind[a] == 0) & (kind[b] == 1)
        out[b[ok]] = a[ok]
    return out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: matched pieces with their gap, and left-overs with their rank in the range.
    Memory: the narrow rows of one range (``ROWS_PER_RANGE`` on average)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    kind, ident, sub, size, rng = (t.column(c).to_numpy() for c in ("kind", "id", "sub", "size", "range"))
    opening = _match(kind)
    hit = opening >= 0
    used = np.zeros(len(kind), dtype=bool)
    used[opening[hit]] = True
    left = np.full(len(kind), -1, dtype=np.int64)
    for k in (0, 1):
        rest = (kind == k) & ~hit & ~used
        left[rest] = np.arange(rest.sum())
    gap = np.where(hit, ident[opening], -1)
    gap_sub = np.where(hit, sub[opening], -1)
    out = hit | (left >= 0)
    cols = [kind, ident, sub, size, rng, left, gap, gap_sub]
    names = ["kind", "id", "sub", "size", "range", "left", "gap", "gap_sub"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c[out]).cast(k) for c, k in zip(cols, kinds)], names=names)


def _runs(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Pairs runs of left-overs: per range, in order, (range, left-over pieces, left-over gaps).
    In a range all left-over pieces come before all left-over gaps. Returns
    (gap range, its first rank, piece range, its first rank, length)."""
    stack: list[list[int]] = []  # [range, gaps left]; the last has the smallest gaps
    out = []
    for rng, pieces, gaps in counts:
        at = 0
        while at < pieces and stack:
            top = stack[-1]
            n = min(pieces - at, top[1])
            # the run of a stack is taken from its end: smallest gaps first
            out.append((top[0], top[1] - n, rng, at, n))
            top[1] -= n
            at += n
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([rng, gaps])
    return out


def _round(rest: DataFrame, gaps: DataFrame, least: int, most: int, rows: int, rows_per_range: int, number: int) -> tuple[DataFrame, DataFrame, int]:
    """One bulk-synchronous round: (placed rows, pieces left, number placed)."""
    spark = rest.sparkSession
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / F.lit(most))).cast("int")
    g = gaps.where(F.col("gap") >= least).withColumn("_k", slots).select(
        F.lit(0).alias("kind"), "id", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("sub"), F.floor(F.col("gap") / F.col("_k")).alias("size"))
    p = rest.select(F.lit(1).alias("kind"), "id", F.lit(0).alias("sub"), F.col("length").alias("size"))
    keys = [F.col("size").desc(), F.col("kind").asc(), F.col("id").asc(), F.col("sub").asc()]
    ranged = g.unionByName(p).repartitionByRange(1 + rows // rows_per_range, *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id())
    swept = stored(ranged.mapInArrow(_sweep, SWEEP))
    left = F.col("left") >= 0
    counts = swept.groupBy("range").agg(F.count_if(left & (F.col("kind") == 1)), F.count_if(left & (F.col("kind") == 0)), F.count_if(~left)).collect()
    runs = _runs(sorted((r[0], r[1], r[2]) for r in counts))
    hits = sum(r[3] for r in counts) + sum(r[4] for r in runs)
    placed = swept.where(~left).select("id", F.col("gap").alias("sequence_id"), F.lit(number).alias("round"), F.col("gap_sub").alias("sub"), F.col("size").alias("length"))
    still = swept.where(left & (F.col("kind") == 1))
    if runs:
        # two runs a range at most: the table is bounded by the number of ranges
        side = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "run int, gr int, g0 long, pr int, p0 long, n long"))
        in_gap = (F.col("range") == F.col("gr")) & (F.col("left") >= F.col("g0")) & (F.col("left") < F.col("g0") + F.col("n"))
        in_piece = (F.col("range") == F.col("pr")) & (F.col("left") >= F.col("p0")) & (F.col("left") < F.col("p0") + F.col("n"))
        of_gap = swept.where(left & (F.col("kind") == 0)).join(side, in_gap).select("run", (F.col("g0") + F.col("n") - 1 - F.col("left")).alias("rank"), F.col("id").alias("sequence_id"), F.col("sub").alias("gap_sub"))
        of_piece = still.join(side, in_piece).select("run", (F.col("left") - F.col("p0")).alias("rank"), "id", "size")
        crossed = of_piece.join(of_gap, ["run", "rank"]).select("id", "sequence_id", F.lit(number).alias("round"), F.col("gap_sub").alias("sub"), F.col("size").alias("length"))
        placed = stored(placed.unionByName(crossed))
        still = stored(still.join(side, in_piece, "left_anti"))
    return placed, still.select("id", F.col("size").alias("length")), hits


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Place (id, length) rows, 0 < length <= capacity and ids distinct and not negative, into sequences.

    Size bands go from large to small, as in best-fit decreasing: pieces over half a sequence open
    their own; each further band fills gaps round by round and opens sequences only for what fits
    no gap. Returns (id, sequence_id, offset): offsets are gapless from 0 in each sequence.
    """
    spark = pieces.sparkSession
    cuts = [capacity // d for d in BANDS] + [0]
    over = pieces.select("id", "length")
    large = over.where(F.col("length") > cuts[0])
    placed = [large.select("id", F.col("id").alias("sequence_id"), F.lit(0).alias("round"), F.lit(0).alias("sub"), "length")]
    gaps = stored(large.where(F.col("length") < capacity).select("id", (capacity - F.col("length")).alias("gap")))
    bands = list(zip(cuts, cuts[1:]))
    sizes = over.agg(*[f(F.when((F.col("length") <= hi) & (F.col("length") > lo), x)) for hi, lo in bands for f, x in ((F.count, F.col("length")), (F.sum, F.col("length")), (F.min, F.col("length")), (F.max, F.col("length")))]).first()
    opened = rounds = 0
    for i, (hi, lo) in enumerate(bands):
        n, total, least, most = (int(x or 0) for x in sizes[4 * i : 4 * i + 4])
        rest = over.where((F.col("length") <= hi) & (F.col("length") > lo))
        while n:
            rounds += 1
            rows, room = (int(x or 0) for x in gaps.where(F.col("gap") >= least).agg(F.sum(F.greatest(F.lit(1), F.floor(F.col("gap") / F.lit(most)))), F.max("gap")).first())
            if not rows:
                new = max(-(-total // capacity), -(-n // (capacity // least)))  # two lower bounds
                fresh = spark.range(opened, opened + new, 1, 1 + new // rows_per_range).select((-F.col("id") - 1).alias("id"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened, rows = gaps.unionByName(fresh), opened + new, new * (capacity // most)
            done, rest, hits = _round(rest, gaps, least, most, n + rows, rows_per_range, rounds)
            placed.append(done)
            taken = done.groupBy("sequence_id").agg(F.sum("length").alias("taken"))
            before = gaps
            gaps = stored(gaps.join(taken, gaps["id"] == taken["sequence_id"], "left").select(gaps["id"], (F.col("gap") - F.coalesce(F.col("taken"), F.lit(0))).alias("gap")).where(F.col("gap") > 0))
            discard(before)
            n -= hits
            if n:
                total, least, most = (int(x) for x in rest.agg(F.sum("length"), F.min("length"), F.max("length")).first())
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    w = Window.partitionBy("sequence_id").orderBy("round", "sub", "id")
    return out.select("id", "sequence_id", (F.sum("length").over(w) - F.col("length")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True, **cols: str) -> DataFrame:
    """Pieces of every document with their place: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    pieces = stored(token_pieces(docs, tokenizer, pattern, capacity, end_id, keep_ids=keep_ids, **cols).withColumn("id", F.monotonically_increasing_id()))
    places = best_fit(pieces.select("id", "length"), capacity)
    return pieces.join(places, "id").drop("id")
