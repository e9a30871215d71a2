"""Operator 8: a query in a tiny list still gets its k rows."""

import numpy as np

from tidecorpus.llm import ann


def test_small_lists_are_topped_up(spark):
    r = np.random.default_rng(0)
    centres = r.normal(0, 1, (4, 16)) * 20
    x = np.concatenate([centres[c] + r.normal(0, 0.1, (n, 16)) for c, n in ((0, 400), (1, 400), (2, 400), (3, 6))])
    ids = np.r_[np.arange(1, 1201), np.arange(6) * 20 + 100_000]  # every outlier is a query
    ids[:1200] = ids[:1200] * 7 + 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, 20, 20, list_rows=100).toPandas()
    n = got.groupby("query_id").size()
    assert set(n) == {20} and set(n.index) == {int(i) for i in ids if i % 20 == 0}
    few = df.where("vec_id >= 100000 or vec_id < 30")
    got = ann.neighbours(few, 20, 20, list_rows=2).toPandas()
    assert set(got.groupby("query_id").size()) == {few.count() - 1}
