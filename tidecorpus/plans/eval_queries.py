"""Evaluation queries (A6–A12, A21) on prediction tables derived from
``embeddings`` and ``events`` (SURVEY §7.3).

Multi-label stand-in (9 categories, CALLS first):
  labels[i] = int(embedding[i] > 0), logits[i] = embedding[i] + embedding[i+9],
  HATEFUL = int(label >= 5).
Single-label stand-in (10 classes): label, logits = embedding[0:10].
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import evaluate as ev
from ..operators import tasks as tk
from ..session import table
from .registry import query

CLASSES = [f"class{i}" for i in range(10)]


def multilabel_predictions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    head, tail = F.slice("embedding", 1, 9), F.slice("embedding", 10, 9)
    return e.select(
        "vec_id",
        F.transform(head, lambda x: (x > 0).cast("int")).alias("labels"),
        F.zip_with(head, tail, lambda a, b: a + b).alias("logits"),
        (F.col("label") >= 5).cast("int").alias("HATEFUL"),
    )


def single_predictions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.slice("embedding", 1, 10).alias("logits"))


_CELLS_SQL = """(SELECT e.vec_id, r.i, CASE WHEN e.embedding[r.i + 1] > 0 THEN 1 ELSE 0 END AS y,
                   CASE WHEN e.embedding[r.i + 1] + e.embedding[r.i + 10] > 0 THEN 1 ELSE 0 END AS p,
                   (e.embedding[r.i + 1] + e.embedding[r.i + 10])::DOUBLE AS x
                 FROM embeddings e, range(9) r(i))"""


def _prf_sql(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {g}count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
                       count(*) FILTER (WHERE y = 1 AND p = 0) AS fn FROM {src} {grp})"""


def _ratios_sql(prefix: str = "") -> str:
    return (
        f"round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS {prefix}precision, "
        f"round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS {prefix}recall, "
        f"round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS {prefix}f1"
    )


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(
    "a6_binary_prf",
    sql=f"""SELECT {_ratios_sql()} FROM {_prf_sql("(SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS p FROM embeddings)")}""",
)
def a6_binary_prf(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        (F.col("label") >= 5).cast("int").alias("y"), (F.col("embedding")[0] > 0).cast("int").alias("p")
    )
    return _round(ev.binary_prf(e, "y", "p"), "precision", "recall", "f1")


_NAMES_SQL = "[" + ", ".join(f"'{c.lower()}'" for c in K.EXTENDED_HATE_CATEGORIES) + "]"


@query(
    "a7_category_report",
    sql=f"SELECT {_NAMES_SQL}[i + 1] AS category, {_ratios_sql()} FROM {_prf_sql(_CELLS_SQL, 'i')}",
)
def a7_category_report(spark, sf_dir):
    rep = ev.category_report(multilabel_predictions(spark, sf_dir))
    return _round(rep, "precision", "recall", "f1")


@query(
    "a7_category_summary",
    sql=f"""SELECT round(avg(f1), 6) AS mean_f1, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall
            FROM (SELECT CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
                         CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
                         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1
                  FROM {_prf_sql(_CELLS_SQL, 'i')})""",
)
def a7_category_summary(spark, sf_dir):
    s = ev.category_summary(ev.category_report(multilabel_predictions(spark, sf_dir)))
    return _round(s, "mean_f1", "mean_precision", "mean_recall")


@query(
    "a8_extended_hate_report",
    sql=f"""SELECT {_ratios_sql('hate_')} FROM {_prf_sql('''(SELECT CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
                 CASE WHEN list_bool_or(list_transform(range(1, 9), lambda i: embedding[i + 1] + embedding[i + 10] > 0)) THEN 1 ELSE 0 END AS p
                 FROM embeddings)''')}""",
)
def a8_extended_hate_report(spark, sf_dir):
    r = ev.extended_report(multilabel_predictions(spark, sf_dir))
    return _round(r, "hate_precision", "hate_recall", "hate_f1")


_A9_SQL = """
WITH pr AS (SELECT label AS y, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS p FROM embeddings),
cls AS (SELECT range AS c, 'class' || range AS name FROM range(10)),
per AS (SELECT c, name, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE y <> c AND p = c) AS fp,
               count(*) FILTER (WHERE y = c AND p <> c) AS fn FROM cls, pr GROUP BY c, name),
m AS (SELECT name, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM per),
acc AS (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc FROM pr)
SELECT name || '_f1' AS metric, round(f1, 6) AS value FROM m
UNION ALL SELECT name || '_precision', round(precision, 6) FROM m
UNION ALL SELECT name || '_recall', round(recall, 6) FROM m
UNION ALL SELECT 'macro_f1', round(avg(f1), 6) FROM m
UNION ALL SELECT 'macro_precision', round(avg(precision), 6) FROM m
UNION ALL SELECT 'macro_recall', round(avg(recall), 6) FROM m
UNION ALL SELECT 'acc', round(acc, 6) FROM acc
UNION ALL SELECT 'micro_f1', round(acc, 6) FROM acc
"""


@query("a9_single_label_report", sql=_A9_SQL)
def a9_single_label_report(spark, sf_dir):
    return _round(ev.single_label_report(single_predictions(spark, sf_dir), CLASSES), "value")


@query(
    "a10_perplexity",
    sql="SELECT event_type, round(avg(value) / 10, 6) AS eval_loss, round(exp(avg(value) / 10), 6) AS perplexity FROM events GROUP BY event_type",
)
def a10_perplexity(spark, sf_dir):
    """Loss stand-in: mean ``value``/10 per event type; perplexity = exp(loss)."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") / 10).alias("eval_loss"))
    return e.select("event_type", F.round("eval_loss", 6).alias("eval_loss"), F.round(ev.perplexity("eval_loss"), 6).alias("perplexity"))


@query(
    "a11_weighted_cross_entropy",
    sql="""
    WITH w AS (SELECT label, (SELECT count(*) FROM embeddings) / (10.0 * count(*)) AS weight FROM embeddings GROUP BY label),
    x AS (SELECT label, embedding[1:10] AS l FROM embeddings),
    n AS (SELECT label, ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) + list_max(l) - l[label + 1] AS nll FROM x)
    SELECT round(sum(w.weight * nll) / sum(w.weight), 6) AS loss FROM n JOIN w USING (label)
    """,
)
def a11_weighted_cross_entropy(spark, sf_dir):
    p = single_predictions(spark, sf_dir)
    dim = tk.label_dim(spark, CLASSES)
    w = tk.balanced_weights(p, "label", dim)
    return _round(ev.weighted_cross_entropy(p, w), "loss")


@query(
    "a12_bce_with_logits",
    sql=f"""
    WITH c AS {_CELLS_SQL},
    pw AS (SELECT i, 1.0 / (2.0 * avg(y)) AS pw FROM c GROUP BY i)
    SELECT round(avg(pw * y * (ln(1 + exp(-abs(-x))) + greatest(-x, 0)) + (1 - y) * (ln(1 + exp(-abs(x))) + greatest(x, 0))), 6) AS loss
    FROM c JOIN pw USING (i)
    """,
)
def a12_bce_with_logits(spark, sf_dir):
    p = multilabel_predictions(spark, sf_dir)
    means = p.select(F.posexplode("labels").alias("i", "y")).groupBy("i").agg(F.avg("y").alias("m"))
    pw = means.select("i", (F.lit(1.0) / (F.lit(2.0) * F.col("m"))).alias("weight"))
    return _round(ev.bce_with_logits(p, pw), "loss")


@query(
    "a21_best_epoch",
    sql="""
    WITH e AS (SELECT event_type AS model, user_id AS run, hour(ts) AS epoch, avg(value) AS v FROM events GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY model, run ORDER BY v DESC, epoch ASC) AS k FROM e)
    SELECT model, run, CAST(epoch AS INTEGER) AS best_epoch, round(v, 6) AS best_value FROM r WHERE k = 1
    """,
)
def a21_best_epoch(spark, sf_dir):
    """events as an epoch log: model = event_type, run = user_id, epoch = hour(ts)."""
    e = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("model"), F.col("user_id").alias("run"), F.hour("ts").alias("epoch")
    ).agg(F.avg("value").alias("value"))
    return _round(ev.best_epoch(e, ["model", "run"]), "best_value")
