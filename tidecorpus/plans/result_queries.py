"""Results / statistics queries on a benchmark ledger derived from ``events``
(SURVEY §7.3): model = a model name per ``event_type``, run = ``user_id``,
task = by the ``k`` field of ``props`` (five bands of 20), headline metric of the
task = ``value``/100, ``eval_loss`` = ``value``/10. One event = one run record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import results as rs
from ..operators import stats as st
from ..operators.indexing import hash_bound, portable_hash_sql
from ..session import table
from .corpus import TOKEN_LEN_SQL, token_lengths
from .registry import query

# stand-in model name of each event type (a 5-row dimension)
MODELS = {
    "view": "lm-a-cased",
    "click": "lm-a-uncased",
    "purchase": "lm-b-cased",
    "signup": "lm-b-uncased",
    "error": "lm-b-deacc",
}
TASK_BANDS = ["context_hate", "hate", "sentiment", "emotion", "irony"]
ORDER = ["lm-b-uncased", "lm-b-deacc", "lm-b-cased", "lm-a-cased", "lm-a-uncased"]

_MODELS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MODELS.items()) + ") m(event_type, model))"
_TASK_SQL = "CASE " + " ".join(f"WHEN k < {20 * (i + 1)} THEN '{t}'" for i, t in enumerate(TASK_BANDS[:-1])) + f" ELSE '{TASK_BANDS[-1]}' END"
_LED = f"""led AS (SELECT m.model, {_TASK_SQL} AS task, e.user_id AS run, e.event_id, e.value
          FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e JOIN {_MODELS_SQL} m USING (event_type)),
long AS (SELECT model, task, run, event_id, CASE WHEN task = 'context_hate' THEN 'eval_mean_f1' ELSE 'eval_macro_f1' END AS metric, value / 100 AS value FROM led
         UNION ALL SELECT model, task, run, event_id, 'eval_loss' AS metric, value / 10 AS value FROM led)"""


def _task_col():
    k = F.get_json_object("props", "$.k").cast("int")
    c = F.lit(TASK_BANDS[-1])
    for i in reversed(range(len(TASK_BANDS) - 1)):
        c = F.when(k < 20 * (i + 1), F.lit(TASK_BANDS[i])).otherwise(c)
    return c


def ledger(spark, sf_dir) -> DataFrame:
    """Long ledger rows: model, task, run, event_id, metric, value."""
    dim = spark.createDataFrame(list(MODELS.items()), "event_type string, model string")
    e = table(spark, sf_dir, "events").join(F.broadcast(dim), "event_type", "inner")
    e = e.select("model", _task_col().alias("task"), F.col("user_id").alias("run"), "event_id", "value")
    headline = F.when(F.col("task") == "context_hate", F.lit("eval_mean_f1")).otherwise(F.lit("eval_macro_f1"))
    m = F.array(
        F.struct(headline.alias("metric"), (F.col("value") / 100).alias("value")),
        F.struct(F.lit("eval_loss").alias("metric"), (F.col("value") / 10).alias("value")),
    )
    return e.select("model", "task", "run", "event_id", F.explode(m).alias("m")).select(
        "model", "task", "run", "event_id", "m.metric", "m.value"
    )


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(
    "r2_ledger_parse",
    sql=f"WITH {_LED} SELECT event_id, model, task, 0 AS run, metric, value FROM long",
)
def r2_ledger_parse(spark, sf_dir):
    """Each event as a one-run ledger fragment in JSON, parsed back to long rows."""
    led = ledger(spark, sf_dir)
    frag = led.groupBy("event_id", "model", "task").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    js = frag.select("event_id", "model", F.to_json(F.create_map("task", F.array("m"))).alias("ledger"))
    return rs.parse_ledger(js, "ledger", ["event_id", "model"])


def _headline_means(spark, sf_dir) -> DataFrame:
    led = rs.headline(ledger(spark, sf_dir), rs.headline_dim(spark))
    return led.groupBy("model", "task").agg(F.avg(F.col("value") * 100).alias("mean"))


_HEAD_SQL = ", ".join(f"('{t}', '{m}')" for t, m in K.TASK_METRIC.items())
_HM = f"""{_LED},
hd AS (SELECT * FROM (VALUES {_HEAD_SQL}) h(task, metric)),
hm AS (SELECT model, task, avg(value * 100) AS mean FROM long JOIN hd USING (task, metric) GROUP BY model, task)"""


@query(
    "a2_mean_std",
    sql=f"""WITH {_LED}
    SELECT model, task, metric, round(avg(value * 100), 6) AS mean, round(stddev_pop(value * 100), 6) AS std, count(*) AS runs,
           printf('%.3f +- %.3f', avg(value * 100), stddev_pop(value * 100)) AS text
    FROM long GROUP BY model, task, metric""",
)
def a2_mean_std(spark, sf_dir):
    return _r6(rs.mean_std(ledger(spark, sf_dir)), "mean", "std")


@query(
    "a3_composite_score",
    sql=f"""WITH {_HM}
    SELECT model, round(avg(mean) FILTER (WHERE task IN ({", ".join(f"'{t}'" for t in K.SCORE_TASKS_FOUR)})), 6) AS score,
           round(avg(mean), 6) AS score5 FROM hm GROUP BY model""",
)
def a3_composite_score(spark, sf_dir):
    hm = _headline_means(spark, sf_dir)
    four = rs.composite_score(hm, K.SCORE_TASKS_FOUR)
    five = rs.composite_score(hm, K.SCORE_TASKS_FIVE, name="score5")
    return _r6(four.join(five, "model"), "score", "score5")


@query(
    "p12_case_flag",
    sql=f"SELECT DISTINCT model, CASE WHEN contains(model, '-cased') THEN 'cased' ELSE 'uncased' END AS casing FROM {_MODELS_SQL}",
)
def p12_case_flag(spark, sf_dir):
    return ledger(spark, sf_dir).select("model", rs.case_flag().alias("casing")).distinct()


@query(
    "p15_metric_rename_scale",
    sql=f"WITH {_LED} SELECT event_id, replace(metric, 'eval_', '') AS metric, round(value * 100, 6) AS value FROM long",
)
def p15_metric_rename_scale(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return led.select("event_id", rs.rename_metric().alias("metric"), F.round(F.col("value") * 100, 6).alias("value"))


@query(
    "p16_headline_metric",
    sql=f"WITH {_LED}, hd AS (SELECT * FROM (VALUES {_HEAD_SQL}) h(task, metric)) SELECT event_id, model, task, metric, value FROM long JOIN hd USING (task, metric)",
)
def p16_headline_metric(spark, sf_dir):
    return rs.headline(ledger(spark, sf_dir), rs.headline_dim(spark)).select("event_id", "model", "task", "metric", "value")


_R3_COLS = ", ".join(f"round(avg(mean) FILTER (WHERE task = '{t}'), 6) AS {t}" for t in K.SCORE_TASKS_FIVE)


@query("r3_wide_by_task", sql=f"WITH {_HM} SELECT model, {_R3_COLS} FROM hm GROUP BY model")
def r3_wide_by_task(spark, sf_dir):
    w = rs.wide_by(_headline_means(spark, sf_dir), "model", "task", K.SCORE_TASKS_FIVE, "mean", F.avg)
    return _r6(w, *K.SCORE_TASKS_FIVE)


@query("r1_long_from_wide", sql=f"WITH {_HM} SELECT model, task, round(mean, 6) AS mean FROM hm")
def r1_long_from_wide(spark, sf_dir):
    w = rs.wide_by(_headline_means(spark, sf_dir), "model", "task", K.SCORE_TASKS_FIVE, "mean", F.avg)
    return _r6(rs.long_from_wide(w, ["model"], K.SCORE_TASKS_FIVE, "task", "mean"), "mean")


@query(
    "l1_sort_by_score",
    sql=f"""WITH {_HM}
    SELECT model, round(avg(mean) FILTER (WHERE task IN ({", ".join(f"'{t}'" for t in K.SCORE_TASKS_FOUR)})), 6) AS score
    FROM hm GROUP BY model ORDER BY score DESC""",
)
def l1_sort_by_score(spark, sf_dir):
    return _r6(rs.composite_score(_headline_means(spark, sf_dir), K.SCORE_TASKS_FOUR), "score").orderBy(F.desc("score"))


@query(
    "l2_order_by_list",
    sql=f"""WITH {_HM}, o AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(ORDER))}) o(model, pos))
    SELECT model, task, round(mean, 6) AS mean FROM hm JOIN o USING (model) ORDER BY pos""",
)
def l2_order_by_list(spark, sf_dir):
    return _r6(rs.order_by_list(_headline_means(spark, sf_dir), "model", ORDER), "mean")


PLAN = [(m, 200) for m in ORDER] + [("lm-c", 200)]
_PLAN_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{m}', {t})" for m, t in PLAN) + ") p(model, times))"
_J4 = f"""{_LED},
found AS (SELECT model, count(DISTINCT run) AS n_runs FROM long GROUP BY model),
def AS (SELECT p.model, p.times, f.n_runs, greatest(p.times - coalesce(f.n_runs, 0), 0) AS runs_left
        FROM {_PLAN_SQL} p LEFT JOIN found f USING (model) WHERE greatest(p.times - coalesce(f.n_runs, 0), 0) > 0)"""


def _deficit(spark, sf_dir):
    plan = spark.createDataFrame(PLAN, "model string, times int")
    found = ledger(spark, sf_dir).groupBy("model").agg(F.count_distinct("run").alias("n_runs"))
    return rs.ledger_deficit(plan, found)


@query("j4_ledger_deficit", sql=f"WITH {_J4} SELECT model, runs_left FROM def")
def j4_ledger_deficit(spark, sf_dir):
    """Wanted 200 runs per planned model; runs found = distinct runs in the ledger."""
    return _deficit(spark, sf_dir).select("model", "runs_left")


@query(
    "r5_run_plan",
    sql=f"""WITH {_J4},
    ex AS (SELECT model, task, count(DISTINCT run) AS n_runs FROM long GROUP BY model, task),
    t AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in TASK_BANDS)}) t(task))
    SELECT d.model, t.task, (coalesce(ex.n_runs, 0) + i.i)::INTEGER AS run, ({K.RUN_SEED_BASE} + coalesce(ex.n_runs, 0) + i.i)::INTEGER AS seed
    FROM def d CROSS JOIN t LEFT JOIN ex ON ex.model = d.model AND ex.task = t.task, range(d.runs_left) i(i)""",
)
def r5_run_plan(spark, sf_dir):
    """Runs left per (model, task), seeds continuing after the runs present."""
    existing = ledger(spark, sf_dir).groupBy("model", "task").agg(F.count_distinct("run").alias("n_runs"))
    return rs.run_plan(_deficit(spark, sf_dir), TASK_BANDS, existing)


_SEED_SQL = f"({K.RUN_SEED_BASE} + run % 50)"


@query(
    "r5_repeated_seeds",
    sql=f"""WITH {_LED}
    SELECT model, task, CAST({_SEED_SQL} AS INTEGER) AS seed, count(*) AS times FROM (SELECT DISTINCT model, task, run FROM long)
    GROUP BY ALL HAVING count(*) > 1""",
)
def r5_repeated_seeds(spark, sf_dir):
    """Seeds that several runs of one (model, task) share; the stand-in plan starts anew after 50 runs."""
    runs = ledger(spark, sf_dir).select("model", "task", "run").distinct()
    return rs.repeated_seeds(runs.withColumn("seed", (F.lit(K.RUN_SEED_BASE) + F.col("run") % 50).cast("int")))


# two metrics a task, of which some (model, task) lack the first or the second in a part of their runs
_TWO = [(t, m, i) for t, ms in K.TASK_METRICS_TABLE.items() for i, m in enumerate(ms)]
_TWO_SQL = "(VALUES " + ", ".join(f"('{t}', '{m}', {i})" for t, m, i in _TWO) + ") d(task, metric, pos)"
_GAPS_SQL = """NOT (l.model = 'lm-b-deacc' AND l.task = 'emotion' AND d.pos = 1 AND l.event_id % 3 = 0)
      AND NOT (l.model = 'lm-b-uncased' AND l.task = 'irony' AND d.pos = 0 AND l.event_id % 2 = 0)"""


def two_metric_ledger(spark, sf_dir) -> DataFrame:
    """Long rows with both metrics of each task's table; some runs lack one."""
    led = ledger(spark, sf_dir).where(F.col("metric") == "eval_loss").select("model", "task", "event_id", (F.col("value") * 10).alias("v"))
    dim = spark.createDataFrame(_TWO, "task string, metric string, pos int")
    rows = led.join(F.broadcast(dim), "task")  # ten rows
    m, t, p, e = F.col("model"), F.col("task"), F.col("pos"), F.col("event_id")
    gap = ((m == "lm-b-deacc") & (t == "emotion") & (p == 1) & (e % 3 == 0)) | ((m == "lm-b-uncased") & (t == "irony") & (p == 0) & (e % 2 == 0))
    return rows.where(~gap).select("model", "task", e.alias("run"), "metric", (F.col("v") / (F.lit(100.0) + p)).alias("value"))


@query(
    "a2_stop_rule",
    sql=f"""WITH {_LED},
    l AS (SELECT model, task, event_id, value * 10 AS v FROM long WHERE metric = 'eval_loss'),
    x AS (SELECT l.model, l.task, l.event_id, d.metric, d.pos, l.v / (100.0 + d.pos) AS value FROM l JOIN {_TWO_SQL} USING (task) WHERE {_GAPS_SQL}),
    n AS (SELECT model, task, count(DISTINCT event_id) AS runs FROM x GROUP BY model, task),
    c AS (SELECT n.model, n.task, d.metric, d.pos, n.runs, count(x.event_id) AS held FROM n JOIN {_TWO_SQL} ON d.task = n.task
          LEFT JOIN x ON x.model = n.model AND x.task = n.task AND x.metric = d.metric GROUP BY ALL),
    s AS (SELECT model, task, coalesce(min(pos) FILTER (WHERE held < runs), 99) AS stop FROM c GROUP BY model, task)
    SELECT x.model, x.task, replace(x.metric, 'eval_', '') AS metric, round(avg(100 * value), 6) AS mean, round(stddev_pop(100 * value), 6) AS std
    FROM x JOIN s ON s.model = x.model AND s.task = x.task WHERE x.pos < s.stop GROUP BY x.model, x.task, x.metric""",
)
def a2_stop_rule(spark, sf_dir):
    """The two-metric results table: a metric missing from any run ends its task's list."""
    return _r6(rs.results_table(two_metric_ledger(spark, sf_dir)).drop("runs", "pos", "text"), "mean", "std")


@query(
    "a15_bootstrap_ci",
    sql=f"""WITH b AS (SELECT e.event_type, e.value,
                    substr({portable_hash_sql('e.event_id', 0, 'r.b // 8')}, 4 * (r.b % 8) + 1, 4) AS u, r.b
                    FROM events e, range(200) r(b)),
    w AS (SELECT event_type, b, value, CASE {" ".join(f"WHEN u < '{hash_bound(p, 4)}' THEN {k}" for k, p in enumerate(st.POISSON1_CDF))} ELSE 8 END AS w FROM b),
    m AS (SELECT event_type, b, sum(w * value) / sum(w) AS m FROM w GROUP BY event_type, b),
    ci AS (SELECT event_type, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY event_type),
    mean AS (SELECT event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, round(mean, 6) AS mean, n, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM mean JOIN ci USING (event_type)""",
)
def a15_bootstrap_ci(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return _r6(st.bootstrap_mean_ci(e, ["event_type"], "value", "event_id", 200, 0), "mean", "ci_low", "ci_high")


_KW_SQL = """WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) AS rk, count(*) OVER (PARTITION BY value) AS t FROM events),
a AS (SELECT event_type, value, rk + (t - 1) / 2.0 AS ar, t FROM r),
g AS (SELECT event_type, sum(ar) AS R, count(*) AS n FROM a GROUP BY event_type),
tt AS (SELECT sum(t * t * t - t) AS T FROM (SELECT DISTINCT value, t FROM a)),
s AS (SELECT sum(R * R / n) AS S, count(*) AS k, sum(n) AS N FROM g),
h AS (SELECT k, N, (12.0 / (N * (N + 1)) * S - 3.0 * (N + 1)) / (1 - T / (N * N * N - N)) AS H FROM s, tt)"""


@query(
    "a16_kruskal_wallis",
    sql=_KW_SQL + "\nSELECT 'all' AS task, k, CAST(N AS BIGINT) AS n, round(H, 6) AS H, round(exp(-H / 2) * (1 + H / 2), 6) AS p_value FROM h",
)
def a16_kruskal_wallis(spark, sf_dir):
    """H over ``events.value`` grouped by event type, with tie correction; p for k−1 = 4 dof."""
    e = table(spark, sf_dir, "events").withColumn("task", F.lit("all"))
    out = st.kruskal_wallis(e, ["task"], "event_type", "value", "event_id")
    return _r6(out.select("task", F.col("k"), "n", "H", "p_value"), "H", "p_value")


@query(
    "a17_dunn_z",
    sql="""WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) AS rk, count(*) OVER (PARTITION BY value) AS t FROM events),
a AS (SELECT event_type, value, rk + (t - 1) / 2.0 AS ar, t FROM r),
g AS (SELECT event_type, avg(ar) AS mr, count(*) AS n FROM a GROUP BY event_type),
tt AS (SELECT sum(t * t * t - t) AS T FROM (SELECT DISTINCT value, t FROM a)),
nn AS (SELECT count(*) AS total FROM events)
SELECT 'all' AS task, x.event_type AS group_a, y.event_type AS group_b,
       round((x.mr - y.mr) / sqrt((total * (total + 1) / 12.0 - T / (12.0 * (total - 1))) * (1.0 / x.n + 1.0 / y.n)), 6) AS z
FROM g x JOIN g y ON x.event_type < y.event_type, tt, nn""",
)
def a17_dunn_z(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("task", F.lit("all"))
    return _r6(st.dunn_test(e, ["task"], "event_type", "value", "event_id").select("task", "group_a", "group_b", "z"), "z")


_DUNN_P_SQL = f"""WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) AS rk, count(*) OVER (PARTITION BY value) AS t FROM events),
a AS (SELECT event_type, value, rk + (t - 1) / 2.0 AS ar, t FROM r),
g AS (SELECT event_type, avg(ar) AS mr, count(*) AS n FROM a GROUP BY event_type),
tt AS (SELECT sum(t * t * t - t) AS T FROM (SELECT DISTINCT value, t FROM a)),
nn AS (SELECT count(*) AS total FROM events),
z AS (SELECT x.event_type AS group_a, y.event_type AS group_b,
       (x.mr - y.mr) / sqrt((total * (total + 1) / 12.0 - T / (12.0 * (total - 1))) * (1.0 / x.n + 1.0 / y.n)) AS z
  FROM g x JOIN g y ON x.event_type < y.event_type, tt, nn),
h AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS h FROM z),
p AS (SELECT group_a, group_b, z, {st.erfc_sql("h")} AS p_value FROM h),
q AS (SELECT *, row_number() OVER (ORDER BY p_value, group_a, group_b) AS i, count(*) OVER () AS m FROM p)
SELECT 'all' AS task, group_a, group_b, round(z, 6) AS z, round(p_value, 6) AS p_value,
       round(least(min(p_value * m / i) OVER (ORDER BY i DESC), 1.0), 6) AS p_adj FROM q"""


@query("a17_dunn_bh", sql=_DUNN_P_SQL)
def a17_dunn_bh(spark, sf_dir):
    """Dunn z, two-sided p and Benjamini–Hochberg adjustment."""
    e = table(spark, sf_dir, "events").withColumn("task", F.lit("all"))
    return _r6(st.dunn_test(e, ["task"], "event_type", "value", "event_id"), "z", "p_value", "p_adj")


@query(
    "a18_corpus_budget",
    sql="SELECT 2048 * 12500 AS needed, count(*) AS available, count(*) >= 2048 * 12500 AS enough FROM documents",
)
def a18_corpus_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.agg(
        F.lit(2048 * 12500).alias("needed"), F.count(F.lit(1)).alias("available")
    ).withColumn("enough", F.col("available") >= F.col("needed"))


@query("a19_distinct_lengths", sql=f"SELECT DISTINCT {TOKEN_LEN_SQL} AS token_len FROM documents")
def a19_distinct_lengths(spark, sf_dir):
    return token_lengths(spark, sf_dir).select("token_len").distinct()


@query("a20_sample_counts", sql="SELECT lang, least(500, count(*)) AS n_samples FROM documents GROUP BY lang")
def a20_sample_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(rs.capped_count(d, 500).alias("n_samples"))


@query(
    "d8_token_length_by_tokenizer",
    sql=f"""SELECT lang, tokenizer, round(avg(n), 6) AS mean_len FROM (
        SELECT lang, 'whitespace' AS tokenizer, {TOKEN_LEN_SQL} AS n FROM documents
        UNION ALL SELECT lang, 'chars128' AS tokenizer, least(length(text), 126) AS n FROM documents) GROUP BY lang, tokenizer""",
)
def d8_token_length_by_tokenizer(spark, sf_dir):
    """E14 per tokenizer variant (texts × tokenizers by in-place explode), long form, mean per task."""
    from ..functions import text as tx

    d = table(spark, sf_dir, "documents").select("lang", "text")
    ws = tx.token_len(tx.collapse_emoji_spans(tx.tidy("text")))
    ch = F.least(F.length("text"), F.lit(126))
    x = d.select("lang", F.explode(F.array(F.struct(F.lit("whitespace").alias("tokenizer"), ws.alias("n")), F.struct(F.lit("chars128").alias("tokenizer"), ch.alias("n")))).alias("t"))
    return x.groupBy("lang", "t.tokenizer").agg(F.round(F.avg("t.n"), 6).alias("mean_len"))
