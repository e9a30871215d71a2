"""End-to-end jobs on line files cut from the sf0.001 documents (one file per source)."""

import json
import os
import re
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import SF001
from tidecorpus import constants as K
from tidecorpus import jobs


@pytest.fixture(scope="module")
def corpus_dir():
    d = tempfile.mkdtemp(prefix="tc-corpus-", dir="/tmp")
    t = pq.read_table(os.path.join(SF001, "documents.parquet"), columns=["doc_id", "text", "source"]).to_pylist()
    by_src = {}
    for r in sorted(t, key=lambda r: r["doc_id"]):
        by_src.setdefault(r["source"], []).append(r["text"])
    for src, texts in by_src.items():
        with open(os.path.join(d, f"{src}.txt"), "w", encoding="utf-8") as f:
            f.write("\n".join(texts) + "\n")
    return d


def _py_len(line):
    s = re.sub(r"\s+", " ", re.sub("\n+", ". ", line)).strip()
    s = re.sub("emoji.*?emoji", "emoji", s)
    return min(len(s.split(" ")) if s else 0, 126)


def test_filter_tweets(spark, corpus_dir):
    out = os.path.join(tempfile.mkdtemp(prefix="tc-out-", dir="/tmp"), "kept")
    got = sorted(r["value"] for r in jobs.filter_tweets(spark, corpus_dir, out, 4).collect())
    want = []
    for name in os.listdir(corpus_dir):
        with open(os.path.join(corpus_dir, name), encoding="utf-8") as f:
            want += [ln.rstrip("\n") for ln in f if _py_len(ln.rstrip("\n")) >= K.MIN_TOKENS]
    assert got == sorted(want) and len(os.listdir(out)) >= 4


def test_generate_dataset(spark, corpus_dir):
    base = tempfile.mkdtemp(prefix="tc-ds-", dir="/tmp")
    ds = jobs.generate_dataset(spark, corpus_dir, os.path.join(base, "a"), num_files=6)
    splits = {r["split"]: r["n"] for r in ds.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert set(splits) == {"train", "test"}
    limited = jobs.generate_dataset(spark, corpus_dir, os.path.join(base, "b"), num_files=6, limit=5)
    assert sorted(r["n"] for r in limited.groupBy("split").agg(F.count("*").alias("n")).collect()) == [5, 5]
    with pytest.raises(ValueError):
        jobs.generate_dataset(spark, corpus_dir, os.path.join(base, "c"), num_files=6, limit=10**6)


def test_train_tokenizer_and_prepare_mlm(spark, corpus_dir):
    base = tempfile.mkdtemp(prefix="tc-tok-", dir="/tmp")
    model = jobs.train_tokenizer(spark, corpus_dir, base, lowercase=True, vocab_size=60, min_frequency=2, limit_alphabet=40, num_files=3)
    vocab = [r["token"] for r in model.vocab.orderBy("id").collect()]
    assert vocab[:5] == K.SEQUENCE_SPECIALS and len(vocab) <= 60
    assert os.path.isdir(os.path.join(base, "vocab")) and os.path.isdir(os.path.join(base, "merges"))
    out = jobs.prepare_mlm(spark, corpus_dir, model, os.path.join(base, "mlm"), max_length=32, batch_size=16, seed=3)
    rows = out.collect()
    assert rows and all(len(r["input_ids"]) == 32 and len(r["labels"]) == 32 for r in rows)
    for r in rows:
        assert r["labels"][0] == K.IGNORE_INDEX  # <s> is never masked
        assert all(lab == K.IGNORE_INDEX for lab, m in zip(r["labels"], r["attention_mask"]) if m == 0)  # nor padding
    sizes = {}
    for r in rows:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert max(sizes.values()) <= 16


def test_summarise_benchmarks(spark):
    d = tempfile.mkdtemp(prefix="tc-led-", dir="/tmp")
    led = {t: [{m: 0.5 + 0.01 * i, "eval_loss": 1.0} for i in range(3)] for t, m in K.TASK_METRIC.items()}
    for name, bump in (("model-a", 0.0), ("model-b", 0.1)):
        runs = {t: [{k: (v + bump if k != "eval_loss" else v) for k, v in r.items()} for r in rs] for t, rs in led.items()}
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            json.dump(dict(runs, model_name=name), f)
    out = jobs.summarise_benchmarks(spark, os.path.join(d, "*.json")).collect()
    assert [r["model"] for r in out] == ["model-b", "model-a"]
    assert out[1]["hate"] == "51.000 +- 0.816" and abs(out[1]["score"] - 51.0) < 1e-9


def test_evaluate_run_and_weights(spark):
    d = tempfile.mkdtemp(prefix="tc-run-", dir="/tmp")
    rows = [(0, [1.0, 0.0])] * 258 + [(0, [0.0, 1.0])] * 83 + [(1, [0.0, 1.0])] * 104 + [(1, [1.0, 0.0])] * 55
    preds = spark.createDataFrame(rows, "label int, logits array<double>")
    out = {r["metric"]: r["value"] for r in jobs.evaluate_run(spark, "hate", preds, "lm-a", 0, d).collect()}
    assert abs(out["eval_macro_f1"] - 0.695073) < 1e-6 and round(out["eval_acc"], 3) == 0.724
    assert spark.read.parquet(d).filter(F.col("model") == "lm-a").count() == len(out)
    ctx = spark.createDataFrame([(1, [1] + [0] * 8, [-1.0, 2.0] + [-1.0] * 7), (0, [0] * 9, [-1.0] * 9)], "HATEFUL int, labels array<int>, logits array<double>")
    m = {r["metric"]: r["value"] for r in jobs.evaluate_run(spark, "context_hate", ctx, "lm-a", 0).collect()}
    assert m["eval_hate_f1"] == 1.0 and m["eval_calls_f1"] == 0.0 and "eval_mean_f1" in m
    train = spark.createDataFrame([(0,), (0,), (1,), (2,), (3,), (4,), (5,), (6,)], "label int")
    assert jobs.class_weights(spark, "emotion", train).count() == 7
    assert jobs.class_weights(spark, "hate", train) is None


def test_command_line(corpus_dir):
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = tempfile.mkdtemp(prefix="tc-cli-", dir="/tmp")
    env = dict(os.environ, PYTHONPATH=repo)
    run = lambda *a: subprocess.run([sys.executable, "-m", "tidecorpus", "--master", "local[2]", *a], cwd=base, env=env, capture_output=True, text=True, timeout=600)
    r = run("filter-tweets", corpus_dir, os.path.join(base, "kept"), "2")
    assert r.returncode == 0 and "kept" in r.stdout, r.stderr[-2000:]
    r = run("train-tokenizer", os.path.join(base, "kept"), os.path.join(base, "tok"), "--lowercase", "--vocab-size", "40", "--min-frequency", "2", "--num-files", "2")
    assert r.returncode == 0 and "vocabulary of" in r.stdout, r.stderr[-2000:]
    r = run("prepare-mlm", os.path.join(base, "kept"), os.path.join(base, "tok"), os.path.join(base, "mlm"), "--max-length", "16", "--batch-size", "8")
    assert r.returncode == 0 and "encoded rows" in r.stdout, r.stderr[-2000:]
