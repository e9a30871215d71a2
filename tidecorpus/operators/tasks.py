"""Labelled-set preparation.

Label dimensions are tiny tables (k ≤ 10 rows), so every lookup against them is
a broadcast join by construction. Unknown names raise inside the job
(``raise_error``) instead of silently producing nulls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .splits import stratified_split


def label_dim(spark: SparkSession, names: Sequence[str], name_col: str = "name", id_col: str = "label") -> DataFrame:
    """Dimension table (label id, name) from an ordered name list."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{id_col} int, {name_col} string")


def select_schema(df: DataFrame, schema: T.StructType | Sequence[str]) -> DataFrame:
    """Exactly the declared columns, in order (and cast, P2, when a schema is given)."""
    if isinstance(schema, T.StructType):
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return df.select(*schema)


def label_ok(label: str, k: int) -> Column:
    """True where the label lies in 0..k-1, false elsewhere and for null."""
    return F.coalesce(F.col(label).between(0, k - 1), F.lit(False))


def validate_labels(df: DataFrame, label: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected) by the label domain 0..k-1 (null rejected)."""
    ok = label_ok(label, k)
    return df.filter(ok), df.filter(~ok)


def assert_labels(df: DataFrame, label: str, k: int) -> DataFrame:
    """P2 strict form: fail the job on a label outside 0..k-1."""
    check = F.assert_true(F.col(label).between(0, k - 1), F.lit(f"label outside 0..{k - 1}"))
    return df.withColumn(label, F.when(check.isNull(), F.col(label)))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P3."""
    return df.withColumnsRenamed(dict(mapping))


def add_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """P4."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def encode_labels(df: DataFrame, dim: DataFrame, col: str, out: str = "label", strict: bool = True) -> DataFrame:
    """Name → id through the dimension (broadcast). Unmapped names raise."""
    d = dim.select(F.col("name").alias("_name"), F.col("label").alias("_id"))
    j = df.join(F.broadcast(d), df[col] == d["_name"], "left")
    mapped = F.col("_id")
    if strict:
        mapped = F.when(F.col("_id").isNotNull(), F.col("_id")).otherwise(
            F.raise_error(F.concat(F.lit("unknown label: "), F.col(col).cast("string")))
        ).cast("int")
    return j.withColumn(out, mapped).drop("_name", "_id")


def decode_labels(df: DataFrame, dim: DataFrame, col: str = "label", out: str = "label_name") -> DataFrame:
    """Id → name (inverse dimension; ids are unique by construction)."""
    d = dim.select(F.col("label").alias("_id"), F.col("name").alias(out))
    return df.join(F.broadcast(d), df[col] == d["_id"], "left").drop("_id")


def flag_label(df: DataFrame, flag: str, out: str = "label") -> DataFrame:
    """Label from a 0/1 flag column."""
    return df.withColumn(out, F.col(flag).cast("int"))


def balanced_weights(df: DataFrame, label: str, dim: DataFrame) -> DataFrame:
    """A4: ``n / (k · n_c)`` per class of the dimension; a class absent from the
    data fails the job (as the published rule does)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    k = dim.count()
    total = df.agg(F.count(F.lit(1))).scalar()
    j = dim.select(F.col("label").alias(label)).join(counts, label, "left")
    n_c = F.when(F.col("n_c").isNotNull(), F.col("n_c")).otherwise(F.raise_error(F.lit("class absent from data")))
    return j.select(label, (total / (F.lit(k) * n_c)).alias("weight"))


def positive_weights(df: DataFrame, categories: Sequence[str], limited: bool = False) -> DataFrame:
    """A5: ``1 / (2 · mean)`` per category column; mean 0 gives ∞ (0 in limited mode)."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in categories])
    longf = means.unpivot([], list(categories), "category", "mean")
    inf = F.lit(0.0) if limited else F.lit(float("inf"))
    w = F.when(F.col("mean") == 0, inf).otherwise(F.lit(1.0) / (F.lit(2.0) * F.col("mean")))
    return longf.select("category", w.alias("weight"))


@dataclass
class TaskSpec:
    """How to build one task's labelled set from a table."""

    name: str
    id_col: str
    text_col: str
    label_col: str
    dev_size: float = 0.25
    seed: int = 0
    limit: int | None = None
    normalise: bool = True
    extra: list[str] = field(default_factory=list)


def load_task(df: DataFrame, spec: TaskSpec) -> DataFrame:
    """Encode label → stratified split → normalise text → typed select → limit.

    Returns one table with a ``split`` column (not three handles).
    """
    t = df.withColumn("label", F.col(spec.label_col).cast("int"))
    t = stratified_split(t, "label", spec.id_col, spec.dev_size, spec.seed)
    text = tx.social_normalise(spec.text_col) if spec.normalise else F.col(spec.text_col)
    t = t.select(F.col(spec.id_col).alias("id"), text.alias("text"), "label", "split", *spec.extra)
    if spec.limit:
        # L3 per split: the first `limit` rows of each split in id order
        from .indexing import group_index

        t = group_index(t, ["id"], ["split"], "_pos").filter(F.col("_pos") < spec.limit).drop("_pos")
    return t


def pool_tasks(frames: Mapping[str, DataFrame]) -> DataFrame:
    """All tasks, text only, with the upper-cased task name."""
    out = None
    for name, f in frames.items():
        part = f.select("text", F.upper(F.lit(name)).alias("task"))
        out = part if out is None else out.unionByName(part)
    return out
