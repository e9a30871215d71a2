"""Operator 13 against plain k-means on Python integers, and its corner cases."""

import hashlib
import math

import numpy as np
import pytest

from tidecorpus.llm import centroids


def plain(rows, k=8, rounds=10, seed=3):
    """rows: (id, list of finite floats)."""
    ints = [(i, [math.floor(1024 * x) if abs(x) < 1e290 else int(x) * 1024 for x in v]) for i, v in rows]
    start = sorted(ints, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(),))[:k]
    cs = [list(v) for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        got = [near(v)[1] for _, v in ints]
        for j in range(len(cs)):
            mine = [v for (_, v), g in zip(ints, got) if g == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *reversed(near(v))) for i, v in ints]
    return out, cs


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, cs = centroids.cluster(df, **kw)
    return got.collect(), cs


def test_transform_is_exact_and_keeps_distances():
    r = np.random.default_rng(0)
    x = r.integers(-1000, 1000, (5, 64))
    y = centroids.hadamard(x)
    assert (centroids.unhadamard(y) == 64 * x).all()
    assert ((y[0] - y[1]) ** 2).sum() == 64 * ((x[0] - x[1]) ** 2).sum()
    signs = centroids.unhadamard(np.eye(64, dtype=np.int64))
    assert [(np.diff(np.sign(s)) != 0).sum() for s in signs] == list(range(64))


def test_search_equals_all_distances_and_skips_work():
    r = np.random.default_rng(1)
    c = r.integers(-500, 500, (8, 64))
    x = np.concatenate([c.repeat(40, axis=0) + r.integers(-40, 40, (320, 64)), r.integers(-500, 500, (50, 64)), c, np.zeros((1, 64), np.int64)])
    c = np.concatenate([c, c[2:3]])  # a tie: the smaller number wins
    cen, best, taken = centroids.nearest(centroids.hadamard(x), centroids.hadamard(c))
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cen == d.argmin(axis=1)).all() and (best == 64 * d.min(axis=1)).all()
    assert taken <= x.size * len(c)
    coarse = np.cumsum(r.integers(-60, 60, (400, 64)), axis=1)  # energy in the first coefficients, as in smooth data
    cen, best, taken = centroids.nearest(centroids.hadamard(coarse), centroids.hadamard(coarse[:8]))
    d = ((coarse[:, None] - coarse[None, :8]) ** 2).sum(axis=2)
    assert (cen == d.argmin(axis=1)).all() and (best == 64 * d.min(axis=1)).all()
    assert taken < 0.7 * coarse.size * 8


@pytest.mark.parametrize("scale", [0.2, 3.0])
def test_plain_kmeans(spark, scale):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.normal(0, scale, 64) + 4 * scale * (i % 3)]) for i in range(300)]
    rows += [(400, rows[0][1]), (400, rows[0][1]), (None, rows[1][1])]
    got, cs = run(spark, rows, rounds=4)
    want, want_cs = plain(rows, rounds=4)
    assert cs == want_cs
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(((g.vec_id, g.cluster, g.distance) for g in got), key=key) == sorted(want, key=key)
    assert {g.inertia for g in got} == {sum(w[2] for w in want)}
    for g in got:
        assert g.cluster_inertia == sum(w[2] for w in want if w[1] == g.cluster)
        assert g.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[g.cluster])).encode()).hexdigest()


def test_wide_components_stay_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(0, 10.0 ** (i % 7), 64)]) for i in range(60)]
    rows.append((99, [1e300] + [0.0] * 63))
    got, cs = run(spark, rows, rounds=3)
    want, want_cs = plain(rows, rounds=3)
    assert cs == want_cs
    assert sorted((g.vec_id, g.cluster, g.distance) for g in got if g.distance is not None) == sorted(w for w in want if w[2] < 2**63)


def test_rows_that_take_no_part(spark):
    bad = [(1, None), (2, [1.0] * 63), (3, [1.0] * 63 + [None]), (4, [1.0] * 63 + [float("nan")]), (5, [float("-inf")] * 64), (6, [])]
    assert run(spark, bad) == ([], [])
    got, cs = run(spark, [*bad, (7, [0.5] * 64), (8, [-0.5] * 64)])
    assert sorted((g.vec_id, g.distance) for g in got) == [(7, 0), (8, 0)] and len(cs) == 2
    assert run(spark, []) == ([], [])


def test_extra_columns(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64, "x", 1, b"q") for i in range(20)], "vec_id long, embedding array<float>, cluster string, distance int, coefs binary")
    got, _ = centroids.cluster(df, rounds=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 20
