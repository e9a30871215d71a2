"""The portable hash must behave like independent random numbers wherever it is used."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecorpus.operators import batching as bt
from tidecorpus.operators import encode as en
from tidecorpus.operators import splits as sp
from tidecorpus.operators import stats as st
from tidecorpus.operators.indexing import portable_hash


def test_any_id_is_valid(spark):
    ids = [(0,), (2**60,), (-(2**63),), (2**63 - 1,), (140_000 * 2**33,), (None,)]
    out = [r[0] for r in spark.createDataFrame(ids, "id long").select(portable_hash("id", 3, 2**40)).collect()]
    assert len(set(out)) == len(ids) and all(len(h) == 32 for h in out)


def test_masks_are_independent(spark):
    n = 120
    df = spark.range(3000).select("id", F.array_repeat(F.lit(50), n).alias("ids"), F.array_repeat(F.lit(0), n).alias("s"))
    ids, labels = en.mlm_mask("ids", "s", "id", 7, 2000)
    out = df.select(ids.alias("i"), labels.alias("l")).collect()
    chosen = np.array([[x != -100 for x in r["l"]] for r in out])
    assert abs(chosen.mean() - 0.15) < 0.005
    assert 0.9 < chosen.sum(1).std() / np.sqrt(n * 0.15 * 0.85) < 1.1  # binomial spread
    gaps = np.diff(np.flatnonzero(chosen.ravel()))
    assert 0.93 < gaps.std() / (np.sqrt(0.85) / 0.15) < 1.07  # geometric gaps
    new = np.array([r["i"] for r in out])[chosen]
    assert abs((new == 4).mean() - 0.8) < 0.02 and abs((new == 50).mean() - 0.1) < 0.015
    other = new[(new != 4) & (new != 50)]
    assert len(np.unique(other)) > 0.8 * min(2000, len(other) * 0.75) and abs(other.mean() - 1000) < 40


@pytest.mark.parametrize("split", ["random", "stratified"])
def test_dev_rows_stand_alone(spark, split):
    df = spark.range(20_000).withColumn("label", (F.col("id") % 3).cast("int"))
    out = sp.random_split(df, "id", 0.25, 1) if split == "random" else sp.stratified_split(df, "label", "id", 0.25, 1)
    dev = np.array([r["split"] == "dev" for r in out.orderBy("id").collect()])
    starts = (dev[1:] & ~dev[:-1]).sum() + dev[0]
    assert 1.25 < dev.sum() / starts < 1.42  # 1 / (1 - 0.25) for independent rows


def test_epochs_are_shuffled_anew(spark):
    out = bt.repeat_epochs(spark.range(5000), 2, "id", 3).toPandas()
    order = [out[out.epoch == e].sort_values("id").shuffle_key.rank().to_numpy() for e in (0, 1)]
    assert abs(np.corrcoef(order)[0, 1]) < 0.05 and abs(np.corrcoef(order[0], np.arange(5000))[0, 1]) < 0.05


def test_bootstrap_width(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(10, 4000)
    df = spark.createDataFrame([(i, "g", float(v)) for i, v in enumerate(x)], "id long, g string, v double")
    got = st.bootstrap_mean_ci(df, ["g"], "v", "id", 800, 0).first()
    w = rng.poisson(1, (2000, len(x)))
    lo, hi = np.quantile((w @ x) / w.sum(1), [0.025, 0.975])
    assert abs((got["ci_high"] - got["ci_low"]) / (hi - lo) - 1) < 0.1
    assert got["ci_low"] < x.mean() < got["ci_high"]


def test_replicates_need_not_divide_by_eight(spark):
    df = spark.createDataFrame([(i, "g", float(i)) for i in range(50)], "id long, g string, v double")
    assert st.bootstrap_mean_ci(df, ["g"], "v", "id", 13, 0).count() == 1
