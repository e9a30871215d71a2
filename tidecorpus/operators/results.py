"""Results tables (SURVEY §2.2 P12, P15, P16; §2.5 J4, J5; §2.6 A2, A3, A18–A20;
§2.8 L1, L2; §2.10 R1–R5; §2.1 S10).

The ledger is a long table ``model, task, run, metric, value``; every summary
is an aggregate over it, and every lookup table (headline metric per task,
model order, plan) is a small dimension joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import discard, stored

LEDGER_RUNS = T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))


def parse_ledger(df: DataFrame, json_col: str, keys: Sequence[str] = ("model",)) -> DataFrame:
    """R2: ledger JSON (task → list of runs, each metric → value) to long rows.
    Non-list entries (``model_name``) parse to null and are dropped."""
    keys = list(keys)
    m = df.select(*keys, F.from_json(json_col, T.MapType(T.StringType(), T.StringType())).alias("m"))
    t = m.select(*keys, F.explode("m").alias("task", "runs_json"))
    t = t.select(*keys, "task", F.from_json("runs_json", LEDGER_RUNS).alias("runs")).filter(F.col("runs").isNotNull())
    r = t.select(*keys, "task", F.posexplode("runs").alias("run", "metrics"))
    return r.select(*keys, "task", F.col("run").cast("int").alias("run"), F.explode("metrics").alias("metric", "value"))


def ledger_json(long: DataFrame, keys: Sequence[str] = ("model",), run: str = "run") -> DataFrame:
    """S10 export: long rows → one ledger JSON per key (task → runs in run order).
    Ledgers are per model and hold a handful of runs per task."""
    per_run = long.groupBy(*keys, "task", run).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    by_run = lambda x, y: F.when(x["r"] < y["r"], -1).when(x["r"] > y["r"], 1).otherwise(0)
    runs = F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), "m")), by_run)
    per_task = per_run.groupBy(*keys, "task").agg(runs.alias("runs"))
    per_task = per_task.select(*keys, "task", F.transform("runs", lambda x: x["m"]).alias("runs"))
    return per_task.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task", "runs")))).alias("ledger"))


def append_ledger(long: DataFrame, path: str) -> None:
    """Append runs to the ledger store, partitioned by model."""
    long.write.mode("append").partitionBy("model").parquet(path)


def upsert_ledger(long: DataFrame, path: str) -> None:
    """S10 / R4, repeatable: the runs in ``long`` replace those of the same (model, task, run) in the store and
    leave all others alone, so a job that is run again leaves one copy. The store has a folder a (model, task);
    only the folders that ``long`` touches are written anew."""
    spark = long.sparkSession
    new = stored(long.select("model", "task", "run", "metric", "value"))
    rows, old = new, None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        touched = new.select("model", "task").distinct()
        old = stored(read_ledger_store(spark, path).join(touched, ["model", "task"], "left_semi").join(new.select("model", "task", "run").distinct(), ["model", "task", "run"], "left_anti"))
        rows = new.unionByName(old)
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("model", "task").parquet(path)
    discard(new)
    discard(old)


def read_ledger_store(spark: SparkSession, path: str) -> DataFrame:
    """The store of ``upsert_ledger`` as long rows."""
    schema = "run int, metric string, value double, model string, task string"
    return spark.read.schema(schema).parquet(path).select("model", "task", "run", "metric", "value")


def ledger_lines(long: DataFrame) -> DataFrame:
    """S10 export without folding a model's runs into one row: one JSON object a run, with model, task, run and
    its metrics. A run's metrics are a handful; runs may be any number."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))
    per_run = long.groupBy("model", "task", "run").agg(m.alias("metrics"))
    return per_run.select(F.to_json(F.struct("model", "task", "run", "metrics")).alias("value"))


def parse_ledger_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """The long rows of ``ledger_lines``."""
    r = lines.select(F.from_json(col, "model string, task string, run int, metrics map<string,double>").alias("r"))
    return r.select("r.model", "r.task", "r.run", F.explode("r.metrics").alias("metric", "value"))


def repeated_seeds(runs: DataFrame) -> DataFrame:
    """(model, task, seed, times) of seeds that more than one run of a (model, task) used."""
    return runs.groupBy("model", "task", "seed").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)


def results_table(long: DataFrame, task_metrics: Mapping[str, Sequence[str]] = K.TASK_METRICS_TABLE, scale: float = 100.0, digits: int = 3) -> DataFrame:
    """A2 over several metrics a task, in their order: mean, population std and text per (model, task, metric).
    A metric that any run of the task lacks ends the task's list: it and the later ones are left out. The
    listed metrics are a small dimension; only aggregates per (model, task, metric) are joined."""
    spark = long.sparkSession
    dim = spark.createDataFrame([(t, m, i) for t, ms in task_metrics.items() for i, m in enumerate(ms)], "task string, metric string, pos int")
    runs = long.groupBy("model", "task").agg(F.count_distinct("run").alias("runs"))
    held = mean_std(headline(long, dim.select("task", "metric")), scale=scale, digits=digits).withColumnRenamed("runs", "held")
    wanted = runs.join(F.broadcast(dim), "task")
    have = wanted.join(held, ["model", "task", "metric"], "left")
    stop = have.groupBy("model", "task").agg(F.min(F.when(F.coalesce(F.col("held"), F.lit(0)) < F.col("runs"), F.col("pos"))).alias("stop"))
    kept = have.join(stop, ["model", "task"]).filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop")))
    return kept.select("model", "task", rename_metric("metric").alias("metric"), "pos", "runs", "mean", "std", "text")


def case_flag(model: str | Column = "model") -> Column:
    """``cased`` when the model name contains ``-cased``, else ``uncased``."""
    m = F.col(model) if isinstance(model, str) else model
    return F.when(m.contains("-cased"), F.lit("cased")).otherwise(F.lit("uncased"))


def rename_metric(metric: str | Column = "metric") -> Column:
    """Drop the ``eval_`` prefix."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.regexp_replace(m, "eval_", "")


def headline_dim(spark: SparkSession, task_metric: Mapping[str, str] = K.TASK_METRIC) -> DataFrame:
    return spark.createDataFrame(list(task_metric.items()), "task string, metric string")


def headline(long: DataFrame, dim: DataFrame) -> DataFrame:
    """Keep the headline metric of each task (broadcast join on task, metric)."""
    return long.join(F.broadcast(dim), ["task", "metric"], "inner")


def mean_std(long: DataFrame, keys: Sequence[str] = ("model", "task", "metric"), scale: float = 100.0, digits: int = 3) -> DataFrame:
    """A2: mean and population std over runs, plus the ``"%.3f +- %.3f"`` text."""
    v = F.col("value") * F.lit(scale)
    agg = long.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(F.lit(1)).alias("runs"))
    fmt = f"%.{digits}f +- %.{digits}f"
    return agg.withColumn("text", F.format_string(fmt, "mean", "std"))


def composite_score(means: DataFrame, tasks: Sequence[str], model: str = "model", task: str = "task", value: str = "mean", name: str = "score") -> DataFrame:
    """A3: mean over the listed tasks per model (nulls skipped, as pandas does)."""
    return means.filter(F.col(task).isin(list(tasks))).groupBy(model).agg(F.avg(value).alias(name))


def wide_by(long: DataFrame, key: str, pivot: str, values: Sequence[str], value: str, agg=F.first) -> DataFrame:
    """One row per ``key``, one column per listed ``pivot`` value."""
    return long.groupBy(key).pivot(pivot, list(values)).agg(agg(value))


def long_from_wide(wide: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Wide → long (melt)."""
    return wide.unpivot(list(ids), list(values), var, val)


def order_by_list(df: DataFrame, col: str, order: Sequence[str], strict: bool = True) -> DataFrame:
    """L2: keep only listed values, in list order; a listed value absent from the
    data is an error when ``strict``."""
    spark = df.sparkSession
    pos = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"{col} string, _pos int")
    out = df.join(F.broadcast(pos), col, "inner")
    if strict:
        missing = pos.join(df.select(col).distinct(), col, "left_anti").agg(F.count(F.lit(1))).scalar()
        # a filter keeps the check in the plan (a dropped column would be pruned)
        out = out.filter(F.assert_true(missing == 0, F.lit("ordered value absent from data")).isNull())
    return out.orderBy("_pos").drop("_pos")


def ledger_deficit(plan: DataFrame, found: DataFrame, wanted: str = "times") -> DataFrame:
    """Planned models × wanted runs minus runs found; satisfied models are
    skipped; a model without a ledger counts 0."""
    j = plan.join(found, "model", "left")
    left = F.greatest(F.col(wanted) - F.coalesce(F.col("n_runs"), F.lit(0)), F.lit(0))
    return j.withColumn("runs_left", left).filter(F.col("runs_left") > 0)


def run_plan(plan: DataFrame, tasks: Sequence[str], existing: DataFrame | None = None, seed_base: int = K.RUN_SEED_BASE) -> DataFrame:
    """(model, task, run, seed) for the runs still to do. Seeds continue
    after the runs already present (2021 + existing + i) so a resumed plan does
    not repeat seeds. Rows are replicated in place (explode), no join."""
    p = plan.select("model", "runs_left", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    if existing is not None:
        p = p.join(existing, ["model", "task"], "left")
    else:
        p = p.withColumn("n_runs", F.lit(0))
    base = F.coalesce(F.col("n_runs"), F.lit(0))
    p = p.select("model", "task", base.alias("_b"), F.explode(F.sequence(F.lit(0), F.col("runs_left") - 1)).alias("i"))
    return p.select("model", "task", (F.col("_b") + F.col("i")).cast("int").alias("run"), (F.lit(seed_base) + F.col("_b") + F.col("i")).cast("int").alias("seed"))


def capped_count(df: DataFrame, cap: int | None) -> Column:
    """``min(max_samples, len)``."""
    n = F.count(F.lit(1))
    return n if cap is None else F.least(F.lit(cap).cast("long"), n)
