"""Evaluation (FIXTURES §4), splits, results and statistics goldens."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import SF01
from tidecorpus import constants as K
from tidecorpus.operators import evaluate as ev
from tidecorpus.operators import results as rs
from tidecorpus.operators import splits as sp
from tidecorpus.operators import stats as st
from tidecorpus.operators import tasks as tk
from tidecorpus.session import table
from tidecorpus.sources.text import read_ledgers


def test_composite_and_perplexity(spark):
    means = spark.createDataFrame([("m", t, v) for t, v in zip(K.SCORE_TASKS_FOUR, [0.801, 0.707, 0.551, 0.736])], "model string, task string, mean double")
    s = rs.composite_score(means, K.SCORE_TASKS_FOUR).collect()[0]["score"]
    assert round(s, 3) == 0.699 and abs(s - 0.69875) < 1e-12
    df = spark.createDataFrame([(1.753,), (1.834,), (1.826,)], "l double")
    got = [round(r["p"], 3) for r in df.select(ev.perplexity("l").alias("p")).collect()]
    assert got == [5.772, 6.259, 6.209]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 348 + [(1,)] * 51, "label int")
    w = {r["label"]: round(r["weight"], 6) for r in tk.balanced_weights(df, "label", tk.label_dim(spark, ["a", "b"])).collect()}
    assert w == {0: 0.573276, 1: 3.911765}
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0), (0, 0)], "c1 int, c2 int")
    w = {r["category"]: r["weight"] for r in tk.positive_weights(df, ["c1", "c2"]).collect()}
    assert w["c1"] == 2.0 and math.isinf(w["c2"])
    w = {r["category"]: r["weight"] for r in tk.positive_weights(df, ["c1", "c2"], limited=True).collect()}
    assert w["c2"] == 0.0
    with pytest.raises(Exception):
        tk.balanced_weights(spark.createDataFrame([(0,)], "label int"), "label", tk.label_dim(spark, ["a", "b"])).collect()


def test_threshold_and_extended(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "x double")
    assert [r["p"] for r in df.select(ev.sigmoid_round(F.col("x")).alias("p")).collect()] == [0, 0, 1]
    only_calls = spark.createDataFrame([([1.0] + [-1.0] * 8,)], "logits array<double>")
    assert only_calls.select(ev.any_category_positive().alias("p")).collect()[0]["p"] == 0


def test_single_label_report_smoke_run(spark):
    # confusion of the smoke run: ok 258 / 83 wrong, hateful 104 / 55 wrong
    rows = [(0, [1.0, 0.0])] * 258 + [(0, [0.0, 1.0])] * 83 + [(1, [0.0, 1.0])] * 104 + [(1, [1.0, 0.0])] * 55
    df = spark.createDataFrame(rows, "label int, logits array<double>")
    rep = {r["metric"]: r["value"] for r in ev.single_label_report(df, K.HATE_LABELS).collect()}
    assert round(rep["acc"], 3) == 0.724 and rep["micro_f1"] == rep["acc"]
    assert abs(rep["ok_f1"] - 0.788991) < 1e-6 and abs(rep["hateful_f1"] - 0.601156) < 1e-6
    assert abs(rep["macro_f1"] - 0.695073) < 1e-6


def test_mean_std_and_histogram(spark):
    df = spark.createDataFrame([("m", "t", "x", 0.01), ("m", "t", "x", 0.03)], "model string, task string, metric string, value double")
    r = rs.mean_std(df).collect()[0]
    assert abs(r["mean"] - 2.0) < 1e-9 and abs(r["std"] - 1.0) < 1e-9 and r["text"] == "2.000 +- 1.000"
    h = spark.createDataFrame([(0.0,), (39.5,), (40.0,), (41.0,)], "x double")
    bins = {r["bin"]: r["n"] for r in st.histogram(h, "x").collect()}
    assert bins[0] == 1 and bins[39] == 2 and sum(bins.values()) == 3 and len(bins) == 40


def test_stratified_split_exact(spark):
    lab = table(spark, SF01, "labels").select("doc_id", F.col("toxic").alias("label"))
    out = sp.stratified_split(lab, "label", "doc_id", 0.25, 0)
    n = lab.count()
    assert out.count() == n
    assert out.filter(F.col("split") == "dev").count() == math.ceil(0.25 * n)
    per = {(r["label"], r["split"]): r["c"] for r in out.groupBy("label", "split").agg(F.count("*").alias("c")).collect()}
    assert per[(1, "dev")] in (12, 13) and per[(0, "dev")] in (87, 88)
    d2 = sp.random_split(lab, "doc_id", 0.2, 20212021)
    assert d2.filter(F.col("split") == "dev").count() == math.ceil(0.2 * n)
    assert sp.exact_sample(lab, "doc_id", 10, 1).count() == 10


def test_ledger_scan_and_plan(spark):
    tmp = tempfile.mkdtemp(prefix="tc-ledger-", dir="/tmp")
    led = {"hate": [{"eval_macro_f1": 0.7, "eval_loss": 0.5}, {"eval_macro_f1": 0.8, "eval_loss": 0.4}], "model_name": "x"}
    with open(os.path.join(tmp, "lm-uncased-200k.json"), "w") as f:
        json.dump(led, f)
    with open(os.path.join(tmp, "test.json"), "w") as f:
        json.dump(led, f)
    rows = read_ledgers(spark, os.path.join(tmp, "*.json")).collect()
    assert {r["model"] for r in rows} == {"lm-uncased-200k"}
    assert sorted((r["run"], r["metric"], r["value"]) for r in rows) == [(0, "eval_loss", 0.5), (0, "eval_macro_f1", 0.7), (1, "eval_loss", 0.4), (1, "eval_macro_f1", 0.8)]
    plan = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "model string, times int")
    found = spark.createDataFrame([("b", 4), ("c", 12)], "model string, n_runs long")
    d = {r["model"]: r["runs_left"] for r in rs.ledger_deficit(plan, found).collect()}
    assert d == {"a": 10, "b": 6}
    p = spark.createDataFrame([("m", 3)], "model string, runs_left int")
    ex = spark.createDataFrame([("m", "hate", 2)], "model string, task string, n_runs long")
    seeds = sorted(r["seed"] for r in rs.run_plan(p, ["hate"], ex).collect())
    assert seeds == [2023, 2024, 2025]
    fresh = sorted(r["seed"] for r in rs.run_plan(p, ["hate"]).collect())
    assert fresh == [2021, 2022, 2023]


def test_order_by_list_requires_all(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, v double")
    assert [r["model"] for r in rs.order_by_list(df, "model", ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(Exception):
        rs.order_by_list(df, "model", ["b", "a", "zz"]).collect()


def test_kruskal_wallis_known_value(spark):
    e = table(spark, SF01, "events").withColumn("task", F.lit("all"))
    r = st.kruskal_wallis(e, ["task"], "event_type", "value", "event_id").collect()[0]
    assert abs(r["H"] - 3.579596) < 1e-6 and r["n"] == 10000
    assert abs(r["p_value"] - math.exp(-r["H"] / 2) * (1 + r["H"] / 2)) < 1e-12


def test_chi2_odd_dof_and_bh(spark):
    df = spark.createDataFrame([(3.0, 1), (3.0, 3), (0.5, 2)], "x double, k int")
    got = [r["p"] for r in df.select(st.chi2_sf(F.col("x"), F.col("k")).alias("p")).collect()]
    assert abs(got[0] - math.erfc(math.sqrt(1.5))) < 1e-12
    assert abs(got[1] - 0.391625) < 1e-6  # chi2.sf(3, 3)
    assert abs(got[2] - math.exp(-0.25)) < 1e-12
    p = spark.createDataFrame([("t", "a", "b", 0.01), ("t", "a", "c", 0.04), ("t", "b", "c", 0.03)], "task string, group_a string, group_b string, p_value double")
    adj = {(r["group_a"], r["group_b"]): round(r["p_adj"], 6) for r in st.bh_adjust(p, ["task"], "p_value").collect()}
    assert adj == {("a", "b"): 0.03, ("b", "c"): 0.04, ("a", "c"): 0.04}


def test_first_n_guarded_and_strict(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id long")
    assert sp.first_n(df, ["id"], 3).count() == 3
    assert sp.first_n(df, ["id"], 10).count() == 5  # guarded: min(limit, len)
    assert sp.first_n(df, ["id"], 0).count() == 5   # falsy limit = all
    with pytest.raises(ValueError):
        sp.first_n(df, ["id"], 10, strict=True)


def test_ledger_append_and_export(spark):
    d = tempfile.mkdtemp(prefix="tc-ledger-store-", dir="/tmp")
    rows = [("m1", "hate", 0, "eval_macro_f1", 0.7), ("m1", "hate", 1, "eval_macro_f1", 0.8), ("m2", "irony", 0, "eval_macro_f1", 0.6)]
    df = spark.createDataFrame(rows, "model string, task string, run int, metric string, value double")
    rs.append_ledger(df, d)
    rs.append_ledger(df.filter(F.col("model") == "m2"), d)
    back = spark.read.parquet(d)
    assert back.count() == 4 and back.filter(F.col("model") == "m2").count() == 2
    js = {r["model"]: json.loads(r["ledger"]) for r in rs.ledger_json(df).collect()}
    assert js["m1"] == {"hate": [{"eval_macro_f1": 0.7}, {"eval_macro_f1": 0.8}]}
    parsed = rs.parse_ledger(rs.ledger_json(df), "ledger").collect()
    assert sorted((r["model"], r["run"], r["value"]) for r in parsed) == [("m1", 0, 0.7), ("m1", 1, 0.8), ("m2", 0, 0.6)]


def test_merge_special_token_lists(spark):
    # Sequence specials followed by the social tokens, ordinal kept
    a = spark.createDataFrame([(t, i) for i, t in enumerate(K.SEQUENCE_SPECIALS)], "token string, ord int")
    b = spark.createDataFrame([(t, i + len(K.SEQUENCE_SPECIALS)) for i, t in enumerate(K.SOCIAL_TOKENS)], "token string, ord int")
    merged = [r["token"] for r in a.unionByName(b).orderBy("ord").collect()]
    assert merged == K.SEQUENCE_SPECIALS + K.SOCIAL_TOKENS


def test_label_domain_strict_and_split(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "label int")
    valid, rejected = tk.validate_labels(df, "label", 2)
    assert sorted(r["label"] for r in valid.collect()) == [0, 1]
    assert rejected.count() == 2
    assert tk.assert_labels(spark.createDataFrame([(0,), (1,)], "label int"), "label", 2).count() == 2
    with pytest.raises(Exception):
        tk.assert_labels(df.filter(F.col("label").isNotNull()), "label", 2).collect()
