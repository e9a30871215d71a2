"""First n rows by counting equal a full sort, for any n, type, tie and null."""

import random

import pytest

from tidecorpus.operators import selection
from tidecorpus.operators.splits import exact_sample, first_n


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(selection, "EXACT", 3)
    monkeypatch.setattr(selection, "BINS", 8)


def _key(v):
    return (v is not None, v.encode() if isinstance(v, str) else v)


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_sort(spark, small, seed):
    r = random.Random(seed)
    words = ["", "a", "ab", "abc", "abcde", "abcdé", "b", "漢字", "😀x", None, "zz" * 9]
    rows = [(r.choice(words), r.choice([None, -(2**62), 2**62, *range(-40, 40)]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "s string, k long, id int").repartition(3)
    for order in (["s", "k", "id"], ["k", "s", "id"], ["id"]):
        at = ["s k id".split().index(c) for c in order]
        want = sorted(rows, key=lambda t: tuple(_key(t[i]) for i in at))
        for n in (1, 7, 64, 149, 150):
            got = sorted(map(tuple, selection.first_rows(df, order, n).collect()), key=lambda t: t[2])
            assert got == sorted(want[:n], key=lambda t: t[2]), (order, n)


def test_ties_keep_the_size(spark, small):
    df = spark.createDataFrame([(1, "a")] * 30 + [(0, "b")] * 4 + [(2, "c")] * 5, "k int, s string")
    for n in (1, 4, 5, 20, 34, 36, 39):
        got = sorted(r.k for r in selection.first_rows(df, ["k"], n).collect())
        assert got == sorted([0] * 4 + [1] * 30 + [2] * 5)[:n]


def test_more_rows_than_exist(spark, small):
    df = spark.range(10).selectExpr("cast(id as int) AS id")
    assert first_n(df, ["id"], 50).count() == 10 and first_n(df, ["id"], None).count() == 10
    with pytest.raises(ValueError, match="only 10"):
        first_n(df, ["id"], 11, strict=True)
    assert selection.first_rows(df, ["id"], 0).count() == 0
    assert sorted(r.id for r in first_n(df, ["id"], 10, strict=True).collect()) == list(range(10))


def test_no_sort_and_no_single_task(spark):
    df = spark.range(50_000).selectExpr("id", "id % 7 AS v").repartition(6)
    got = exact_sample(df, "id", 20_000, seed=3)
    assert got.count() == 20_000 and got.select("id").distinct().count() == 20_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "rangepartitioning" not in plan
