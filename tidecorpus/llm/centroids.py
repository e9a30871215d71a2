"""Operator 13: centroid clustering by Walsh–Hadamard progressive search.

Vectors become integers ``floor(scale * x)`` and pass once through the exact
integer Walsh–Hadamard transform, whose rows are put in order of sign changes:
the first coefficients are the coarse ones. The transform keeps squared
distances up to the factor ``dims``, so a search may add up squared coefficient
differences coarse to fine. After every step a centroid leaves when what it has
already, plus the least that the open coefficients can add, is strictly more
than the most that some other centroid can still reach (Cauchy–Schwarz on the
open energies, in integers). Whoever is left has all coefficients added; ties go
to the smaller number.

In Spark: the coefficients are written once as a table; a round is one pass that
assigns every vector in numpy and sums coefficients per (task, cluster), then a
hash aggregate over those partial sums. Only ``k × dims`` sums reach the driver,
and only ``k × dims`` numbers go out with the next pass, whatever the input. A
hot cluster is no hot key: its rows are summed where they are read.

Exactness: while every ``|floor(scale * x)|`` is under 2^24, nothing leaves 64
bits. Vectors beyond that ("wide") go through the same code on Python integers,
and their sums travel as 48-bit limbs, so that no size of component overflows.

Results in the corner cases: a null vector, another number of components, a null
or non-finite component: the row takes no part. A null id is kept and hashed as
the empty text. Repeated rows count as often as they stand; among rows of one
hash the smaller vector comes first as a starting centroid. Fewer than ``k``
vectors: as many centroids as vectors. Empty table: no rows. An empty cluster
keeps its centroid. A distance or a sum past 64 bits is null. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

NARROW = 1 << 24
LIMB = 48
LONG_MAX = (1 << 63) - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh–Hadamard transform of the rows (a power of two of integers), rows in order of sign changes."""
    n, d = x.shape
    y = x.copy()
    h = 1
    while h < d:
        v = y.reshape(n, d // (2 * h), 2, h)
        a, b = v[:, :, 0, :] + v[:, :, 1, :], v[:, :, 0, :] - v[:, :, 1, :]
        y = np.stack([a, b], axis=2).reshape(n, d)
        h *= 2
    return y[:, sign_order(d)]


def sign_order(d: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix from the fewest sign changes to the most."""
    i = np.arange(d)
    parity = np.array([[bin(a & b).count("1") & 1 for b in range(d)] for a in range(d)])
    return np.argsort((parity[:, 1:] != parity[:, :-1]).sum(axis=1), kind="stable").astype(i.dtype)


def unhadamard(y: np.ndarray) -> np.ndarray:
    """``dims`` times the vectors whose transform is ``y``."""
    d = y.shape[1]
    natural = np.empty_like(y)
    natural[:, sign_order(d)] = y
    out = hadamard(natural)
    back = np.empty_like(out)
    back[:, sign_order(d)] = out
    return back


def _steps(d: int) -> list[tuple[int, int]]:
    ends = [1]
    while ends[-1] < d:
        ends.append(ends[-1] * 2)
    return list(zip([0, *ends[:-1]], ends))


def _root_up(x: np.ndarray) -> np.ndarray:
    """Integers that are at least the square roots."""
    if x.dtype == object:
        return np.array([math.isqrt(int(v)) + 1 for v in x], dtype=object)
    return np.sqrt(x.astype(np.float64)).astype(np.int64) + 2


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row, ``dims`` times its squared distance, and how many coefficient
    differences were taken (all would be ``rows × centroids × dims``)."""
    n, d = x.shape
    k = len(c)
    row = np.repeat(np.arange(n), k)
    cen = np.tile(np.arange(k), n)
    part = np.zeros(n * k, dtype=x.dtype)
    open_x, open_c = (x * x).sum(axis=1), (c * c).sum(axis=1)
    taken = 0
    for lo, hi in _steps(d):
        diff = x[row, lo:hi] - c[cen, lo:hi]
        part = part + (diff * diff).sum(axis=1)
        taken += diff.size
        open_x = open_x - (x[:, lo:hi] * x[:, lo:hi]).sum(axis=1)
        open_c = open_c - (c[:, lo:hi] * c[:, lo:hi]).sum(axis=1)
        if hi == d:
            break
        ends = open_x[row] + open_c[cen]
        cross = 2 * _root_up(open_x)[row] * _root_up(open_c)[cen]
        least = part + np.maximum(ends - cross, ends * 0)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        reach = np.minimum.reduceat(part + ends + cross, starts)
        stay = (least <= reach[row]).astype(bool)
        row, cen, part = row[stay], cen[stay], part[stay]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.minimum.reduceat(part, starts)
    hit = np.flatnonzero((part == best[row]).astype(bool))
    first = hit[np.unique(row[hit], return_index=True)[1]]
    return cen[first], best, taken


def _whole(vec, scale: int) -> list[int]:
    """``floor(scale * x)`` of doubles as Python integers, exact for any finite x (scale a power of two)."""
    return [math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in vec]


def _decode(batch: pa.RecordBatch, scale: int, dims: int):
    """(row numbers, coefficients) of the narrow rows and of the wide ones."""
    narrow = np.array([v is not None for v in batch.column("coefs").to_pylist()], dtype=bool)
    raw = b"".join(v for v in batch.column("coefs").to_pylist() if v is not None)
    out = [(np.flatnonzero(narrow), np.frombuffer(raw, dtype="<i4").reshape(-1, dims).astype(np.int64))]
    if not narrow.all():
        at = np.flatnonzero(~narrow)
        vecs = batch.column("wide").to_pylist()
        out.append((at, hadamard(np.array([_whole(vecs[i], scale) for i in at], dtype=object))))
    return [(at, x) for at, x in out if len(at)]


def _centre_coefs(centroids: list[list[int]], wide_rows: bool) -> np.ndarray:
    wide = wide_rows or any(abs(v) >= NARROW for c in centroids for v in c)
    return hadamard(np.array(centroids, dtype=object if wide else np.int64))


def _assigned(at_x, centroids):
    for at, x in at_x:
        c = _centre_coefs(centroids, x.dtype == object)
        yield at, x, *nearest(x.astype(c.dtype), c)[:2]


def transformed(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, coefs, wide): 32-bit coefficients of the kept narrow vectors; the doubles of wide ones."""
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = pick(vectors, vec_id=id_col, _v=vec_col).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("_v")).where((F.size("_v") == dims) & finite)

    def task(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("_v").to_pylist(), dtype=np.float64)
            small = (np.abs(x) < NARROW / scale).all(axis=1)
            y = hadamard(np.floor(np.where(small[:, None], x, 0.0) * scale).astype(np.int64)).astype("<i4")
            coefs = [r.tobytes() if s else None for r, s in zip(y, small)]
            wide = [None if s else r.tolist() for r, s in zip(x, small)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(coefs, pa.binary()), pa.array(wide, pa.list_(pa.float64()))], names=["vec_id", "coefs", "wide"])

    return kept.mapInArrow(task, "vec_id long, coefs binary, wide array<double>")


def _limbs(value: int) -> list[int]:
    sign, value, out = (1 if value >= 0 else -1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out or [0]


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[tuple[int, list[int]]]:
    """Per centroid: (rows, sum of their transformed vectors). At most k × dims × limbs rows come back."""
    k = len(centroids)

    def task(batches: Iterator[pa.RecordBatch]):
        count, total = [0] * k, np.zeros((k, dims), dtype=object)
        for b in batches:
            for _, x, cen, _d in _assigned(_decode(b, scale, dims), centroids):
                for c in np.unique(cen):
                    mine = x[cen == c]
                    count[c] += len(mine)
                    total[c] += mine.sum(axis=0)
        rows = []
        for c in range(k):
            if count[c]:
                limbs = [_limbs(int(v)) for v in total[c]]
                for j in range(max(map(len, limbs))):
                    rows.append((c, j, count[c] if j == 0 else 0, [v[j] if j < len(v) else 0 for v in limbs]))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["cluster", "limb", "n", "total"])

    parts = vectors.mapInArrow(task, "cluster int, limb int, n long, total array<long>")
    flat = parts.select("cluster", "limb", "n", F.posexplode("total").alias("dim", "v"))
    got = flat.groupBy("cluster", "limb", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = [(0, [0] * dims) for _ in range(k)]
    for r in got:
        n, sums = out[r.cluster]
        sums[r.dim] += int(r.v) << (LIMB * r.limb)
        out[r.cluster] = (r.n if r.limb == 0 else n, sums)
    return out


def fit(coefs: DataFrame, start: list[list[int]], rounds: int, dims: int, scale: int) -> list[list[int]]:
    """Centroids (integers) after ``rounds`` of assignment and floored means."""
    centroids = [list(c) for c in start]
    for _ in range(rounds if centroids else 0):
        for i, (n, sums) in enumerate(_sums(coefs, centroids, dims, scale)):
            if n:
                back = unhadamard(np.array([sums], dtype=object))[0]
                centroids[i] = [int(v) // dims // n for v in back]  # exact: dims divides v
    return centroids


def assign(coefs: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every stored vector."""

    def task(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            cluster, dist = np.zeros(b.num_rows, dtype=np.int32), [None] * b.num_rows
            for at, _, cen, best in _assigned(_decode(b, scale, dims), centroids):
                cluster[at] = cen
                for i, v in zip(at, best):
                    exact = int(v) // dims
                    dist[i] = exact if exact <= LONG_MAX else None
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster), pa.array(dist, pa.int64())], names=["vec_id", "cluster", "distance"])

    return coefs.mapInArrow(task, "vec_id long, cluster int, distance long")


def first_vectors(vectors: DataFrame, coefs: DataFrame, k: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The ``k`` kept vectors of smallest ``sha256('<seed>:<id>')``, in ascending hash order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = coefs.withColumn("_h", h).orderBy("_h", "wide", "coefs").limit(k).collect()
    out = []
    for r in rows:
        if r.coefs is None:
            out.append(_whole(r.wide, scale))
        else:
            y = np.frombuffer(bytes(r.coefs), dtype="<i4").astype(np.int64).reshape(1, dims)
            out.append([int(v) // dims for v in unhadamard(y)[0]])
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), final centroids)."""
    if dims & (dims - 1) or scale & (scale - 1):
        raise ValueError("dims and scale must be powers of two")
    coefs = stored(transformed(vectors, id_col, vec_col, dims, scale))
    centroids = fit(coefs, first_vectors(vectors, coefs, k, seed, dims, scale), rounds, dims, scale)
    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty), centroids
    found = stored(assign(coefs, centroids, dims, scale))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: None if r.n != r.m else int(r.s) for r in found.groupBy("cluster").agg(total.alias("s"), F.count("distance").alias("n"), F.count(F.lit(1)).alias("m")).collect()}
    whole = None if any(v is None for v in sums.values()) else sum(sums.values())

    def as_long(v):
        return F.lit(None if v is None or v > LONG_MAX else v).cast("long")

    def of_cluster(values):
        out = F.lit(None)
        for i, v in values.items():
            out = F.when(F.col("cluster") == i, v).otherwise(out)
        return out

    digest = {i: F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)}
    return found.select(
        "vec_id", "cluster", "distance",
        of_cluster({i: as_long(v) for i, v in sums.items()}).cast("long").alias("cluster_inertia"),
        as_long(whole).alias("inertia"), of_cluster(digest).cast("string").alias("centroid_sha256"),
    ), centroids


def oracle_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """The same clustering in DuckDB, one chain of tables a round."""
    floored = "((s - (((s % n) + n) % n)) // n)"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v "
        f"FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        dist = "list_sum(list_transform(list_zip(kept.v, cc.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, kept.v AS v, cc.c AS c, CAST({dist} AS BIGINT) AS d FROM kept, c{i} cc "
            f"QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS MATERIALIZED (SELECT c, list(CAST({floored} AS BIGINT) ORDER BY j) AS v FROM "
                f"(SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) t(j) GROUP BY c, j) GROUP BY c)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)")
    a, c = f"a{rounds}", f"c{rounds}"
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, {a}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY {a}.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string({c}.v, ',')) AS centroid_sha256 FROM {a} JOIN {c} ON {a}.c = {c}.c"
    )
