"""Evaluation over prediction tables.

A prediction table is one row per example with ``labels`` / ``logits`` arrays
(multi-label) or ``label`` + ``logits`` (single label). Every report is a
conditional-sum aggregate (partial per task, tiny final merge); per-category
rows come from ``posexplode`` so k categories never multiply the shuffle by
more than k small partial rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 when b = 0 (sklearn's zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = _safe_div(tp, tp + fp)
    r = _safe_div(tp, tp + fn)
    f = _safe_div(2 * tp, 2 * tp + fp + fn)
    return p, r, f


def binary_prf(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary precision / recall / F1 of the positive class (0 when undefined)."""
    agg = df.groupBy(*by).agg(
        F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"),
        F.count_if((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"),
        F.count_if((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(*by, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def sigmoid_round(x: Column) -> Column:
    """A7 threshold: rint(sigmoid(x)) – half to even, so logit 0 → 0."""
    return F.rint(F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).cast("int")


def category_report(df: DataFrame, categories: Sequence[str] = K.EXTENDED_HATE_CATEGORIES) -> DataFrame:
    """Per-category F1 / P / R of ``labels`` vs thresholded ``logits``.

    Output long rows ``category, precision, recall, f1`` (k rows).
    """
    names = F.array(*[F.lit(c.lower()) for c in categories])
    cells = df.select(F.posexplode(F.arrays_zip("labels", "logits")).alias("i", "z"))
    cells = cells.select("i", F.col("z.labels").alias("y"), sigmoid_round(F.col("z.logits")).alias("p"))
    rep = binary_prf(cells, "y", "p", ["i"])
    return rep.select(names[F.col("i")].alias("category"), "precision", "recall", "f1")


def category_summary(report: DataFrame) -> DataFrame:
    """A7 tail: mean F1 / precision / recall over the categories."""
    return report.agg(
        F.avg("f1").alias("mean_f1"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall")
    )


def any_category_positive(logits: str = "logits") -> Column:
    """Predicted hateful when any logit of columns 1.. (CALLS excluded) is > 0."""
    return F.exists(F.slice(F.col(logits), 2, F.size(F.col(logits)) - 1), lambda x: x > 0).cast("int")


def extended_report(df: DataFrame, hateful: str = "HATEFUL") -> DataFrame:
    """P / R / F1 of the derived binary task against the gold ``HATEFUL`` column."""
    t = df.select(F.col(hateful).alias("y"), any_category_positive().alias("p"))
    r = binary_prf(t, "y", "p")
    return r.select(
        F.col("precision").alias("hate_precision"), F.col("recall").alias("hate_recall"), F.col("f1").alias("hate_f1")
    )


def argmax(logits: str | Column) -> Column:
    """First index of the maximum (0-based), like numpy argmax."""
    a = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def single_label_report(df: DataFrame, id2label: Sequence[str], label: str = "label", logits: str = "logits") -> DataFrame:
    """Per-class F1 / P / R, micro F1, macro F1 / P / R, accuracy.

    One pass: confusion counts per class from (label, prediction) pair counts.
    Output long rows ``metric, value``.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(label).cast("int").alias("y"), argmax(logits).alias("p"))
    pc = pairs.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))  # ≤ k² rows
    classes = spark.createDataFrame([(i, n) for i, n in enumerate(id2label)], "c int, name string")
    # each pair count adds to its true class and to its predicted class: one aggregate by class
    sides = F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
                    F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))
    tally = pc.select(F.explode(sides).alias("z")).groupBy("z.c").agg(F.sum("z.t").alias("n_true"), F.sum("z.p").alias("n_pred"), F.sum("z.h").alias("hits"))
    per = classes.join(tally, "c", "left").select("c", "name", *[F.coalesce(x, F.lit(0)).alias(n) for x, n in ((F.col("hits"), "tp"), (F.col("n_pred") - F.col("hits"), "fp"), (F.col("n_true") - F.col("hits"), "fn"))])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    per = per.select("name", "tp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    # one row: the k classes, the means over them, and accuracy = Σ tp / Σ (tp + fn)
    acc = _safe_div(F.sum("tp"), F.sum(F.col("tp") + F.col("fn")))
    row = per.agg(
        F.collect_list(F.struct("name", "f1", "precision", "recall")).alias("each"), acc.alias("acc"), acc.alias("micro_f1"),
        F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
    )
    entry = lambda name, value: F.struct(name.alias("metric"), value.cast("double").alias("value"))
    each = F.flatten(F.transform("each", lambda z: F.array(*[entry(F.concat(z["name"], F.lit(f"_{m}")), z[m]) for m in ("f1", "precision", "recall")])))
    summary = F.array(*[entry(F.lit(m), F.col(m)) for m in ("micro_f1", "macro_f1", "macro_precision", "macro_recall", "acc")])
    return row.select(F.explode(F.concat(each, summary)).alias("m")).select("m.metric", "m.value")


def perplexity(loss: str | Column) -> Column:
    """A10: exp(loss); overflow gives +∞."""
    return F.exp(F.col(loss) if isinstance(loss, str) else loss)


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, label: str = "label", logits: str = "logits") -> DataFrame:
    """Σ w[y]·(logsumexp(x) − x[y]) / Σ w[y]; ``weights`` (label, weight) is k rows."""
    m = F.array_max(F.col(logits))
    lse = F.log(F.aggregate(F.col(logits), F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m
    nll = lse - F.col(logits)[F.col(label)]
    t = df.select(F.col(label).alias("_y"), nll.alias("_nll"))
    j = t.join(weights.select(F.col(label).alias("_y"), F.col("weight").alias("_w")), "_y", "left")
    # a label without a weight must fail, not fall out of the sum
    lost = F.count_if(F.col("_w").isNull())
    out = j.agg((F.sum(F.col("_w") * F.col("_nll")) / F.sum("_w")).alias("loss"), lost.alias("_lost"))
    return out.filter(F.assert_true(F.col("_lost") == 0, F.lit("a label has no weight")).isNull()).select("loss")


def softplus(z: Column) -> Column:
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def bce_with_logits(df: DataFrame, pos_weight: DataFrame | None = None, labels: str = "labels", logits: str = "logits") -> DataFrame:
    """Mean over all cells of pw·y·softplus(−x) + (1−y)·softplus(x).

    ``pos_weight`` is (i, weight) per category (k rows) or None for weight 1.
    """
    cells = df.select(F.posexplode(F.arrays_zip(labels, logits)).alias("i", "z"))
    cells = cells.select("i", F.col("z." + labels).cast("double").alias("y"), F.col("z." + logits).cast("double").alias("x"))
    if pos_weight is not None:
        cells = cells.join(pos_weight.select("i", F.col("weight").alias("pw")), "i", "left")
        pw = F.coalesce(F.col("pw"), F.lit(1.0))
    else:
        pw = F.lit(1.0)
    cell = pw * F.col("y") * softplus(-F.col("x")) + (F.lit(1.0) - F.col("y")) * softplus(F.col("x"))
    return cells.agg(F.avg(cell).alias("loss"))


def best_epoch(df: DataFrame, keys: Sequence[str], epoch: str = "epoch", metric: str = "value") -> DataFrame:
    """Epoch with the highest metric per key; ties → lowest epoch.

    ``max(struct(metric, -epoch))`` is an ordinary partial/final aggregate, so a
    key with many epochs does not need a window over its rows.
    """
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("neg")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b.neg")).alias("best_epoch"), F.col("_b.m").alias("best_value")
    )
