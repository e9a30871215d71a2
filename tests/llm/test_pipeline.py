import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_neardup import components, simhash
from helpers import SF001
from tidecorpus.llm import mixing
from tidecorpus.llm.common import stored


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF001))
        assert docs.columns == first.columns, name
        if name != "mixing":  # filters keep whole rows of their input
            assert docs.exceptAll(before).count() == 0 and 0 < docs.count() <= before.count()
        if name == "simhash_near_dedup":
            rows = before.collect()
            root = components([simhash(r["text"]) for r in rows], 4)
            best = {}
            for r, c in zip(rows, root):
                best[c] = min(best.get(c, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(best.values())
        if name == "mixing":
            drawn = mixing.draw(before.withColumn("domain", mixing.domain_of()), **mixing.PRODUCTION).where("copies > 0")
            assert {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r["doc_id"]: r["copies"] for r in drawn.collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert last.where("piece = 0").count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF001)
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert out.count() > 0 and full <= 2048


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES])
def test_awkward_input(spark, stage, awkward, nothing):
    for docs in (awkward, nothing):
        out = stage[1](spark, docs, SF001)
        assert out.count() <= 2 * docs.count() + 10_000
        if stage[0] != "best_fit_packing":
            assert out.columns == docs.columns
