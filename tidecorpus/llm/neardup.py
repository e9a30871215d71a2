"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints link at ``max_bits`` or fewer differing bits; the classes are the
connected components of all links.

1. Each text becomes a 64-bit SimHash of its word shingles, in SQL functions.
   Votes are counted four bits at a time in 16-bit lanes of sixteen longs.
2. Equal fingerprints are one node (copies never form pairs).
3. A node's embedding is its bit count in each of 32 two-bit segments. Bits
   that differ between two fingerprints are at least the Manhattan distance of
   their embeddings, so only points within ``max_bits`` can link.
4. Grid range-join: the 32 dimensions are dealt into G groups. Of two points
   within Manhattan distance ``max_bits``, at least ``G - max_bits`` groups
   agree, so every link is found in a cell of one of the C(G, max_bits)
   projections to ``G - max_bits`` groups. G follows from the number of nodes
   and only trades copies against cell size; it does not change a result.
5. In a cell, the Manhattan bound and then the exact distance are tested, and
   only the links of a spanning forest are given out: a search takes a node's
   neighbours out of the cell's unvisited rows, so a dense group costs about
   one pass for each few members and no pairs are made. A cell of more than ``cell_rows`` rows is
   cut into tiles and each pair of tiles is a unit of its own.
6. Components by alternating star contraction over the links.

Null text is the empty text, whose fingerprint is zero and which links like
any other. Null doc_id: its row gets its component's smallest id (null if the
component has none). Repeated rows are kept, with equal values. Empty table:
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, null_safe_text, stored

WS = " \t\n\x0b\x0c\r"
LANES = 0x0001000100010001
#: Votes of one lane sum; a lane holds 16 bits and the top one a sign.
CHUNK = 32_767
CELL_ROWS = 50_000
EVEN_BITS = 0x5555555555555555


def lane_sums(h: Column, prefix: str = "v", weight: Column | None = None) -> list[Column]:
    """Sixteen sums that count, over rows, the set bits of ``h``: sum j holds bits j, j+16, j+32, j+48."""
    votes = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) for j in range(16)]
    return [F.sum(v if weight is None else v * weight).alias(f"{prefix}{j}") for j, v in enumerate(votes)]


def lane_bit(i: int, prefix: str = "v") -> Column:
    """Votes for bit ``i`` in the lane sums."""
    return F.shiftrightunsigned(F.col(f"{prefix}{i % 16}"), 16 * (i // 16)).bitwiseAND(F.lit(0xFFFF))


def bit_or(bits: list[Column]) -> Column:
    """A long whose bit i is the condition ``bits[i]``."""
    out = None
    for i, b in enumerate(bits):
        one = F.when(b, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
        out = one if out is None else out.bitwiseOR(one)
    return out


def shingles(words: Column, k: int) -> Column:
    """Array of (i0 … i{k-1}) structs at every word; the tail has nulls."""
    return F.arrays_zip(*[(words if i == 0 else F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1)))).alias(f"i{i}") for i in range(k)])


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, fingerprint long) of every row; ``content`` is a hash of the text that tells
    rows of one id apart."""
    t = null_safe_text(text)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t, F.lit(7)).alias("content"), F.btrim(ascii_lower(t), F.lit(WS)).alias("_t")).withColumn("uid", F.monotonically_increasing_id())
    words = F.split("_t", r"[\x20\x09-\x0D]+")
    rows = src.select("uid", "doc_id", "content", (F.col("_t") == "").alias("_none"), F.posexplode(shingles(words, shingle)).alias("pos", "s"))
    # concat_ws leaves nulls out: the first row of a short text is its whole sequence
    rows = rows.where((F.col("pos") == 0) | F.col(f"s.i{shingle - 1}").isNotNull())
    h = F.xxhash64(F.concat_ws(" ", *[F.col(f"s.i{i}") for i in range(shingle)]))
    rows = rows.select("uid", "doc_id", "content", F.floor(F.col("pos") / CHUNK).alias("chunk"), F.when(F.col("_none"), F.lit(0).cast("long")).otherwise(h).alias("h"))
    part = rows.groupBy("uid", "doc_id", "content", "chunk").agg(F.count(F.lit(1)).alias("n"), *lane_sums(F.col("h")))
    total = part.groupBy("uid", "doc_id", "content").agg(F.sum("n").alias("n"), *[F.sum(lane_bit(i)).alias(f"b{i}") for i in range(64)])
    return total.select("doc_id", "content", bit_or([F.col(f"b{i}") * 2 > F.col("n") for i in range(64)]).alias("fingerprint"))


def groups_for(nodes: int, max_bits: int) -> int:
    """Number of groups whose copies and expected tests cost least. Two random two-bit counts agree with chance 3/8."""
    best = None
    for g in range(max_bits + 1, max_bits + 9):
        copies = comb(g, max_bits)
        tests = nodes * 0.375 ** (32 * (g - max_bits) / g)
        cost = copies * (20 + tests)
        best = min(best or (cost, g), (cost, g))
    return best[1]


def _masks(g: int, max_bits: int) -> list[int]:
    """Bit masks over the 32 two-bit counts, one for each projection."""
    groups = [0] * g
    for dim in range(32):
        groups[dim % g] |= 3 << (2 * dim)
    return [sum(groups[i] for i in keep) for keep in combinations(range(g), g - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp: Column) -> Column:
    """The 32 bit counts (0 to 2), two bits each, in one long."""
    low, high = fp.bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _counts(x: np.ndarray) -> np.ndarray:
    m = np.uint64(EVEN_BITS)
    return (x & m) + ((x >> np.uint64(1)) & m)


def _near(fp: np.ndarray, emb: np.ndarray, one: np.uint64, one_emb: np.uint64, max_bits: int) -> np.ndarray:
    """Rows within ``max_bits`` of one fingerprint: the Manhattan bound first, the exact distance for what passes it."""
    m = np.uint64(EVEN_BITS)
    # |a - b| of counts 0..2: the two-bit fields of x ^ y are 0 (equal), 1 or 3 (apart by 1) and 2 (0 against 2)
    x = emb ^ one_emb
    bound = np.bitwise_count(x & m) + 2 * np.bitwise_count((x >> np.uint64(1)) & ~x & m)
    at = np.flatnonzero(bound <= max_bits)
    return at[np.bitwise_count(fp[at] ^ one) <= max_bits]


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (as positions) of a spanning forest of the rows of one cell."""
    emb = _counts(fp)
    rest = np.arange(len(fp))
    links = []
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            hit = _near(fp[rest], emb[rest], fp[i], emb[i], max_bits)
            if len(hit):
                found = rest[hit]
                links += [(i, j) for j in found]
                stack += list(found)
                rest = np.delete(rest, hit)
    return links


def _cells(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def links_of(key: np.ndarray, tile: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """Rows sorted by (key, tile): short runs by shifted comparison, long ones by a search."""
            change = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
            starts = np.r_[0, np.flatnonzero(change) + 1, len(key)]
            size = np.diff(starts)
            a, b = [], []
            run_end = np.repeat(starts[1:], size)
            short = np.repeat(size <= 32, size)
            emb = _counts(fp)
            m = np.uint64(EVEN_BITS)
            at = np.flatnonzero(short & (np.arange(len(key)) + 1 < run_end))
            d = 1
            while len(at):
                x = emb[at] ^ emb[at + d]
                ok = at[np.bitwise_count(x & m) + 2 * np.bitwise_count((x >> np.uint64(1)) & ~x & m) <= max_bits]
                ok = ok[np.bitwise_count(fp[ok] ^ fp[ok + d]) <= max_bits]
                a.append(fp[ok])
                b.append(fp[ok + d])
                d += 1
                at = at[at + d < run_end[at]]
            for r in np.flatnonzero(size > 32):
                part = fp[starts[r] : starts[r + 1]]
                if links := _forest(part, max_bits):
                    i, j = np.array(links).T
                    a.append(part[i])
                    b.append(part[j])
            one = lambda x: np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(one(a)), pa.array(one(b))], names=["a", "b"])

        def split(t: pa.Table, last: bool):
            key, tile, fp = (t.column(c).to_numpy() for c in ("key", "tile", "fp"))
            n = len(key)
            if not last:  # the last cell may go on in the next batch
                while n and key[n - 1] == key[-1] and tile[n - 1] == tile[-1]:
                    step = np.flatnonzero((key[:n] != key[-1]) | (tile[:n] != tile[-1]))
                    n = int(step[-1]) + 1 if len(step) else 0
            return (links_of(key[:n], tile[:n], fp[:n].astype(np.int64).view(np.uint64)) if n else None), t.slice(n)

        pending, rows = [], 0
        for batch in batches:
            pending.append(batch)
            rows += batch.num_rows
            if rows >= 200_000:
                out, carry = split(pa.Table.from_batches(pending), False)
                pending, rows = carry.combine_chunks().to_batches(), 0
                if out is not None:
                    yield out
        if pending:
            t = pa.Table.from_batches(pending)
            if t.num_rows:
                yield split(t, True)[0]

    return run


def links(nodes: DataFrame, max_bits: int = 4, cell_rows: int = CELL_ROWS, groups: int | None = None) -> DataFrame:
    """(a, b) links whose components equal those of all pairs of distinct ``fp`` within ``max_bits``."""
    masks = _masks(groups or groups_for(nodes.count(), max_bits), max_bits)
    copies = nodes.select("fp", embedding(F.col("fp")).alias("emb")).select(
        "fp", F.posexplode(F.array(*[F.col("emb").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("p", "cell"))
    copies = copies.select("fp", F.xxhash64("p", "cell").alias("key"))
    # more than cell_rows rows: at most copies / cell_rows cells
    hot = copies.groupBy("key").count().where(F.col("count") > cell_rows).select("key", F.ceil(F.col("count") / cell_rows).cast("int").alias("k"))
    tiled = copies.join(hot, "key", "left").withColumn("t", F.when(F.col("k").isNotNull(), F.pmod(F.xxhash64("fp", F.lit(3)), F.col("k")).cast("int")))
    u = F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1)))
    units = tiled.select("fp", "key", "k", "t", u.alias("u")).select("key", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.least("t", "u") * F.col("k") + F.greatest("t", "u")).cast("int").alias("tile"), "fp")
    dealt = units.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(_cells(max_bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable over (a, b), for every id with a link; alternating star contraction."""
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        # small star: smaller neighbours and the node go to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        after = stored(small)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, cell_rows: int = CELL_ROWS, groups: int | None = None, **cols: str) -> DataFrame:
    """(doc_id, content, fingerprint long, component_id, links long) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable; ``links`` counts the other rows of the component.
    """
    return _rooted(docs, shingle, max_bits, cell_rows, groups, **cols).drop("root")


def _rooted(docs: DataFrame, shingle: int, max_bits: int, cell_rows: int = CELL_ROWS, groups: int | None = None, **cols: str) -> DataFrame:
    """``near_duplicates`` with each component's root fingerprint, which is its own where ids repeat or lack."""
    prints = stored(fingerprints(docs, shingle, **cols))
    nodes = stored(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(stored(links(nodes, max_bits, cell_rows, groups)))
    named = nodes.join(roots, nodes["fp"] == roots["id"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows"))
    of = named.join(ids, "root").select(F.col("fp").alias("fingerprint"), "component_id", (F.col("rows") - 1).alias("links"), "root")
    return prints.join(of, "fingerprint").select("doc_id", "content", "fingerprint", "component_id", "links", "root")


def hex64(c: Column) -> Column:
    """Sixteen lowercase hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def deduplicated(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """All columns of one row of each component: the row of its smallest doc_id (a component without
    ids keeps one row); of repeated rows, one stays."""
    found = _rooted(docs, shingle, max_bits)
    best = found.groupBy("root", "component_id").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("content"))).alias("c"))
    keep = best.select(F.col("component_id").alias("keep_id"), F.col("c.content").alias("keep_content"))
    # the caller's columns travel inside one struct, so none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(null_safe_text("text"), F.lit(7)).alias("content"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("content") == F.col("keep_content")), "left_semi")
    return kept.dropDuplicates(["id", "content"]).select("row.*")
