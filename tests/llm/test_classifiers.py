import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecorpus.llm import quality, toxicity
from tidecorpus.llm.common import held_out
from helpers import SF01


def auc(s, y):
    order = np.argsort(np.argsort(s, kind="stable")) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no main effect
    m = quality.fit_arrays(x[:3000], y[:3000])
    assert auc(m.predict(x[3000:]), y[3000:]) > 0.97
    assert {(max(a, b), min(a, b)) for a, b, _ in m.pairs[:1]} == {(1, 0)}


def test_scores_are_sums_of_lookups():
    rng = np.random.default_rng(1)
    x, y = rng.random((300, 3)), (rng.random(300) > 0.5).astype(float)
    m = quality.fit_arrays(x, y, rounds=5, pair_rounds=2)
    for row in x[:20]:
        z = m.base + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(m.edges, m.tables, row))
        z += sum(t[np.searchsorted(m.pair_edges[a], row[a], side="right"), np.searchsorted(m.pair_edges[b], row[b], side="right")] for a, b, t in m.pairs)
        assert np.isclose(m.logit(row[None])[0], z)


def test_pu_learns_without_negatives(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]

    def text(bad):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        return " ".join(t + [rng.choice(("vile", "awfulx", "nastyish")) for _ in range(3 * bad)])

    y = [int(rng.random() < 0.15) for _ in range(3000)]
    docs = spark.createDataFrame([(i, text(v)) for i, v in enumerate(y)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 2], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit(docs, labels)
    assert toxicity.fit(docs, flipped) == model  # the held-out fold teaches nothing
    got = toxicity.score(docs, model).where(held_out()).select("doc_id", "score").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(y[r["doc_id"]]) for r in got]) > 0.98


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.75)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    got = module.score(docs, model).select("doc_id", "score", held_out().alias("h")).join(labels, "doc_id").where("h").toPandas()
    assert auc(got["score"].to_numpy(), got[label].to_numpy()) >= least
    assert got["score"].between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows_and_columns(spark, module, awkward, nothing, labels):
    model = module.fit(awkward, labels)
    out = module.score(awkward, model)
    assert out.columns == awkward.columns  # a column named score is replaced
    rows = out.collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1  # null is the empty text
    assert module.score(nothing, module.fit(nothing, labels)).count() == 0
    assert module.score(awkward, module.fit(awkward, labels.limit(0))).where(F.col("score").isNull()).count() == 0


def test_held_out_fold_teaches_nothing(spark):
    docs = spark.createDataFrame([(i, f"text number {i} !!" if i % 2 else f"plain {i}") for i in range(200)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    flipped = y.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, t) for t in (y, flipped))
    assert all(np.array_equal(s, t) for s, t in zip(a.tables, b.tables))
