"""Nearest neighbours by inner product: probed lists scanned dimension by dimension.

Index: vectors are rotated by a random orthogonal matrix and dealt to the list
of their nearest centroid. Centroids come from k-means on at most
``sample_rows`` vectors (smallest hash of the id); every vector is indexed.
Lists grow with the data up to ``max_lists``; a list is cut into blocks of about
``block_rows``, so a list that holds a third of all rows is many tasks.

Search: a query visits its nearest lists. In each block the rotated vectors are
read in column blocks. After d of D columns a candidate's squared distance is
estimated from its partial distance; the hypothesis that it is near enough to
beat the query's 20th best is rejected, and the candidate abandoned, when

    partial * D / d > (|q|^2 + |x|^2 - 2 * best20) * (1 + EPSILON / sqrt(d))^2

Survivors are scored exactly, in double precision, on the original vectors. The
first round visits the nearest list and gives each query its bound; the second
visits the other lists under that bound.

The number of lists to probe is measured, not assumed: the exact neighbours of
``probe_queries`` sampled queries, found by brute force over all rows, give the
smallest number that holds ``recall`` of them. A query whose lists hold fewer
than k other rows goes on to its next lists until they do, so it returns k rows,
or all candidates if there are fewer.

Vectors that are null, zero, or hold a null or non-finite component take no
part, nor do null ids and vectors of another dimension than the most frequent
one. Of rows with one id the smallest vector counts. Ties go to the smaller
vec_id. An empty table, or one without valid vectors, gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

EPSILON = 3.0
COLUMNS = 16
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """Stored rows (vec_id, list, vec, rot as bytes) with the small tables a search needs."""

    rows: DataFrame
    rotation: np.ndarray
    centroids: np.ndarray
    counts: dict[int, int]
    block_rows: int


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): one finite, non-zero vector of the most frequent dimension per id."""
    v = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))
    dim = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("v") == (dim[0]["d"] if dim else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _stack(column, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of bytes as a matrix."""
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, dim)


def _k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]))]), np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x)), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def build(df: DataFrame, list_rows: int = 1024, max_lists: int = 4096, sample_rows: int = 20_000, block_rows: int = 4096, seed: int = 8, **cols: str) -> Index | None:
    """Index of every valid vector; None if there is none."""
    vectors = stored(valid_vectors(df, **cols))
    n = vectors.count()
    if not n:
        return None
    # bounded by sample_rows
    sample = np.array([r["v"] for r in vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_rows).collect()])
    dim = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    centroids = _k_means(sample, max(1, min(max_lists, round(n / list_rows))), seed=seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 0.5 * (centroids * centroids).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten()).reshape(-1, dim)
            near = np.argmax(x @ centroids.T - half, axis=1)
            raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), raw(x), raw(x @ rotation)], names=["vec_id", "list", "vec", "rot"])

    rows = stored(vectors.mapInArrow(assign, "vec_id long, list int, vec binary, rot binary"))
    counts = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # at most max_lists
    return Index(rows, rotation, centroids, counts, block_rows)


def _exact(queries: pd.DataFrame, dim: int, k: int):
    """Brute force of a bounded query set over a partition: its k best rows per query."""
    q, ids = _stack(queries["vec"], dim), queries["vec_id"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for b in batches:
            if len(b):
                s = q @ _stack(b["vec"], dim).T
                s[ids[:, None] == b["vec_id"].to_numpy()[None, :]] = -np.inf
                take = np.argsort(-s, axis=1, kind="stable")[:, :k]
                new = pd.DataFrame({"query_id": np.repeat(ids, take.shape[1]), "vec_id": b["vec_id"].to_numpy()[take].ravel(), "list": b["list"].to_numpy()[take].ravel(), "score": np.take_along_axis(s, take, 1).ravel()})
                kept = pd.concat([kept, new]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if kept is not None:
            yield kept[np.isfinite(kept["score"])]

    return run


def probes(index: Index, queries: DataFrame, k: int, recall: float, probe_queries: int, seed: int = 8) -> int:
    """Lists to visit so that ``recall`` of the sampled queries' exact neighbours lie in them."""
    dim = len(index.rotation)
    sample = queries.orderBy(F.xxhash64(F.lit(seed + 1), "vec_id"), "vec_id").limit(probe_queries).select("vec_id", "vec").toPandas()
    if not len(sample):
        return 1
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = index.rows.select("vec_id", "list", "vec").mapInPandas(_exact(sample, dim, k), "query_id long, vec_id long, list int, score double")
    best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toPandas()  # probe_queries * k rows
    q = _stack(sample["vec"], dim)
    order = np.argsort(-(q @ index.centroids.T - 0.5 * (index.centroids**2).sum(1)), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
    at = {i: n for n, i in enumerate(sample["vec_id"])}
    need = np.sort([rank[at[r.query_id], r.list] for r in best.itertuples()])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1 if len(need) else 1


def _scan(rotation: np.ndarray, k: int):
    """One block of a list against the queries that probe it."""
    dim = len(rotation)

    def run(cand: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(cand) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        cand = cand.sort_values("vec_id")
        ids, x, r = cand["vec_id"].to_numpy(), _stack(cand["vec"], dim), _stack(cand["rot"], dim)
        xn = (r * r).sum(1)
        out = []
        for lo in range(0, len(asked), 256):
            part = asked.iloc[lo : lo + 256]
            q, qid = _stack(part["vec"], dim), part["vec_id"].to_numpy()
            p = q @ rotation
            qn = (p * p).sum(1)
            bound = part["bound"].to_numpy(dtype=float).copy()
            if np.isneginf(bound).any() and len(ids) > k:  # a first bound from the first rows
                first = p @ r[: 8 * k].T
                first[qid[:, None] == ids[None, : 8 * k]] = -np.inf
                bound = np.maximum(bound, -np.sort(-first, axis=1)[:, k - 1] - 1e-9)
            alive = qid[:, None] != ids[None, :]
            far = qn[:, None] + xn[None, :] - 2 * bound[:, None]
            dist = np.zeros_like(far)
            for c in range(0, dim, COLUMNS):
                a, b = p[:, c : c + COLUMNS], r[:, c : c + COLUMNS]
                d = min(dim, c + COLUMNS)
                if alive.mean() > 0.2:
                    dist += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                    slack = (1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-9
                    alive &= dist * (dim / d) <= far * slack + 1e-9
                else:
                    i, j = np.nonzero(alive)
                    dist[i, j] += ((a[i] - b[j]) ** 2).sum(1)
                    slack = (1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-9
                    alive[i, j] = dist[i, j] * (dim / d) <= far[i, j] * slack + 1e-9
            i, j = np.nonzero(alive)
            score = np.einsum("ij,ij->i", q[i], x[j])
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            start = np.searchsorted(i, np.arange(len(qid)))
            top = np.arange(len(i)) - start[i] < k
            out.append(pd.DataFrame({"query_id": qid[i[top]], "vec_id": ids[j[top]], "score": score[top]}))
        return pd.concat(out)

    return run


def search(index: Index, queries: DataFrame, k: int = 20, recall: float = 0.96, probe_queries: int = 128, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows of the index (``queries``: some of its rows)."""
    spark = queries.sparkSession
    dim = len(index.rotation)
    n = min(len(index.centroids), probes(index, queries, k, recall, probe_queries))
    centroids = index.centroids
    rows_of = np.array([index.counts.get(i, 0) for i in range(len(centroids))])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = 0.5 * (centroids * centroids).sum(1)
        for b in batches:
            if len(b):
                order = np.argsort(-(_stack(b["vec"], dim) @ centroids.T - half), axis=1, kind="stable")
                held = np.cumsum(rows_of[order], axis=1)  # further lists until k others are there
                most = np.maximum(n, np.minimum((held < k + 1).sum(axis=1) + 1, len(centroids)))
                at = np.repeat(np.arange(len(b)), most)
                visit = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most)
                yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[at], "vec": b["vec"].to_numpy()[at], "list": order[at, visit], "visit": visit})

    visits = queries.select("vec_id", "vec").mapInPandas(visit, "vec_id long, vec binary, list int, visit int")
    lists = len(centroids)
    cut = [-(-index.counts.get(i, 0) // index.block_rows) or 1 for i in range(lists)]
    blocks = F.element_at(F.array(*[F.lit(c) for c in cut]), F.col("list") + 1)  # one number a list

    def scan_round(asked: DataFrame) -> DataFrame:
        # queries of a list are cut like its rows, so that both sides of a unit are bounded
        many = asked.groupBy("list").count().select("list", F.ceil(F.col("count") / query_rows).cast("int").alias("parts"))
        q = asked.join(F.broadcast(many), "list").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("parts")).cast("int"))
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        c = index.rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(6)), blocks).cast("int")).join(F.broadcast(many), "list")
        c = c.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        unit = ["list", "block", "part"]
        return c.select(*unit, "vec_id", "vec", "rot").groupBy(*unit).cogroup(q.select(*unit, "vec_id", "vec", "bound").groupBy(*unit)).applyInPandas(_scan(index.rotation, k), FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = stored(scan_round(visits.where(F.col("visit") == 0).withColumn("bound", F.lit(float("-inf")))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    bounds = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("b"))
    rest = visits.where(F.col("visit") > 0).join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("b", F.lit(float("-inf"))))
    found = first.unionByName(scan_round(rest))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, k: int = 20, every: int = 20, **params) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``, against all rows."""
    index = build(df, **params)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.rows.where(F.col("vec_id") % every == 0), k)
