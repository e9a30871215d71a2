"""Checks that must fail the job, and inputs that once broke it."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidecorpus import jobs
from tidecorpus import session as se
from tidecorpus.functions import text as tx
from tidecorpus.operators import encode as en
from tidecorpus.operators import evaluate as ev
from tidecorpus.sources.text import list_files, read_ledgers


def test_lengths_that_differ_raise(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1])], "i int, ids array<int>")
    with pytest.raises(Exception, match="encoded lengths differ"):
        en.assert_single_length(df, "ids", 10, "i").collect()
    assert en.assert_single_length(df, "ids", 1, "i").first()["n_lengths"] == 1


def test_a_label_without_weight_raises(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 1.0])], "label int, logits array<double>")
    w = spark.createDataFrame([(0, 1.0)], "label int, weight double")
    with pytest.raises(Exception, match="no weight"):
        ev.weighted_cross_entropy(df, w).collect()


@pytest.mark.parametrize("token", ["$url", "a\\b", "$1", "\\"])
def test_tokens_stand_for_themselves(spark, token):
    df = spark.createDataFrame([("x http://a.b #Tag @me",)], "t string")
    got = df.select(tx.replace_urls("t", token), tx.replace_hashtags("t", token), tx.replace_mentions("t", token)).first()
    assert got[0] == f"x {token} #Tag @me" and got[1] == f"x http://a.b  {token} Tag  @me" and got[2] == f"x http://a.b #Tag {token}"


def test_ledgers_under_a_folder_named_latest(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tc-testdata-"), "latest")
    os.makedirs(d)
    for name in ("lm-a.json", "lm-a.test.json"):
        with open(os.path.join(d, name), "w") as f:
            json.dump({"model_name": "lm-a", "hate": [{"eval_macro_f1": 0.5}]}, f, indent=2)  # several lines: read whole
    assert read_ledgers(spark, d + "/*.json").count() == 1


def test_checkpoint_folder_must_be_given_off_local():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        se.ensure_checkpoint_dir(Session())


def test_dataset_job_reads_only_the_chosen_files(spark):
    src = tempfile.mkdtemp(prefix="tc-files-")
    for i in range(200):
        with open(os.path.join(src, f"f{i:03}.txt"), "w") as f:
            f.write(f"line of {i}\nsecond of {i}\n")
    assert list_files(spark, src, "*.txt").count() == 200
    out = jobs.generate_dataset(spark, src, os.path.join(src, "out"), num_files=3)
    assert out.count() == 6 and out.where("split = 'test'").count() == 2
    assert out.select(F.regexp_extract("text", r"(\d+)", 1)).distinct().count() == 3


def test_masks_do_not_depend_on_how_files_are_split(spark):
    from tidecorpus.operators import vocab as vb

    src = tempfile.mkdtemp(prefix="tc-lines-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("".join(f"some words of line {i}\n" for i in range(400)))
    model = vb.train_bpe(spark.read.text(src).withColumnRenamed("value", "text"), "text", 60, 1, 40)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = []
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            out = jobs.prepare_mlm(spark, src, model, os.path.join(src, f"out{size}"), max_length=16, batch_size=8)
            got.append(sorted(map(str, out.collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1]
