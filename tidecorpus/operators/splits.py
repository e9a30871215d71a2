"""Seeded, exact-size splits and samples.

Sizes are exact (not ``sampleBy`` / ``randomSplit``): the rows taken are the
first ones of a seeded portable-hash order, ranked with ``group_index`` so a
large stratum is spread over many tasks. Only per-class counts (k rows) and
per-file counts reach the driver-side planning, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indexing import group_index, portable_hash
from .selection import INTEGRAL, first_rows


def stratified_quotas(counts: DataFrame, label: str, size: float) -> DataFrame:
    """Per-class dev quota: floor(size·n_c), then the leftover of
    ``ceil(size·n)`` one each to the largest remainders (ties: label asc).

    ``counts`` has one row per class (``label``, ``n``) – bounded by the label set.
    """
    tot = Window.partitionBy(F.lit(1))
    c = counts.select(label, "n", F.sum("n").over(tot).alias("_N"))
    c = c.select(
        label,
        "n",
        F.floor(F.col("n") * F.lit(size)).alias("_base"),
        (F.col("n") * F.lit(size) - F.floor(F.col("n") * F.lit(size))).alias("_rem"),
        F.ceil(F.col("_N") * F.lit(size)).alias("_target"),
    )
    c = c.withColumn("_left", F.col("_target") - F.sum("_base").over(tot))
    r = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rem"), F.asc(label))
    c = c.withColumn("_r", F.row_number().over(r))
    return c.select(label, (F.col("_base") + (F.col("_r") <= F.col("_left")).cast("long")).alias("quota"))


def stratified_split(
    df: DataFrame, label: str, id_col: str, size: float = 0.25, seed: int = 0, names: tuple[str, str] = ("train", "dev")
) -> DataFrame:
    """Seeded stratified split; dev gets exactly the quota of each class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    quotas = stratified_quotas(counts, label, size)
    keyed = df.withColumn("_h", portable_hash(id_col, seed))
    ranked = group_index(keyed, ["_h", id_col], [label], "_rank")
    # one row a label found in the data: the join's kind follows from the size at run time
    out = ranked.join(quotas, label, "inner")
    split = F.when(F.col("_rank") < F.col("quota"), F.lit(names[1])).otherwise(F.lit(names[0]))
    return out.withColumn("split", split).drop("_h", "_rank", "quota")


def random_split(df: DataFrame, id_col: str, size: float = 0.2, seed: int = 20212021, names=("train", "dev")) -> DataFrame:
    """Not stratified; the first ceil(size·n) rows of the hash order are dev."""
    # scalar subquery: the row count stays inside the plan (no driver round trip)
    quota = F.ceil(df.agg(F.count(F.lit(1))).scalar() * F.lit(size))
    ranked = group_index(df.withColumn("_h", portable_hash(id_col, seed)), ["_h", id_col], (), "_rank")
    split = F.when(F.col("_rank") < quota, F.lit(names[1])).otherwise(F.lit(names[0]))
    return ranked.withColumn("split", split).drop("_h", "_rank")


def file_holdout(df: DataFrame, file_col: str, k: int = 6, seed: int = 0) -> DataFrame:
    """D3: rank distinct files by a seeded hash, keep the first k; the k-th is test.

    Files are few next to rows: the file table is aggregated first (one row per
    file) and joined back; AQE broadcasts it when it is small.
    """
    files = df.select(file_col).distinct().withColumn("_h", text_hash(file_col, seed))
    ranked = group_index(files, ["_h", file_col], (), "_r")
    chosen = ranked.filter(F.col("_r") < k).select(
        file_col, F.when(F.col("_r") == k - 1, F.lit("test")).otherwise(F.lit("train")).alias("split")
    )
    return df.join(F.broadcast(chosen), file_col, "inner")  # k rows by construction


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: those of the n smallest hashes, found by counting
    (``operators.selection``) and kept by a filter, so n may be any share of the table."""
    keyed = df.withColumn("_h", portable_hash(id_col, seed))
    return first_rows(keyed, ["_h", id_col] if _orderable(df, id_col) else ["_h"], n).drop("_h")


def _orderable(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (*INTEGRAL, T.StringType))


def first_n(df: DataFrame, order: Sequence[str], limit: int | None, strict: bool = False) -> DataFrame:
    """First ``limit`` rows in ``order``; falsy limit = all rows.

    The bound of the ``limit``-th row is found by counting and the rows are one
    filter: no row is sorted, moved or stored. ``strict`` (L4) raises when fewer
    than ``limit`` rows exist. ``order`` must be a total order (end with a unique
    key) of integers and strings; other types are numbered by ``group_index``.
    """
    if not limit:
        return df
    if all(_orderable(df, c) for c in order):
        return first_rows(df, order, limit, strict)
    if strict:
        n = df.count()
        if n < limit:
            raise ValueError(f"asked for {limit} rows, only {n} exist")
    return group_index(df, order, (), "_pos").filter(F.col("_pos") < limit).drop("_pos")


def seeded_file_order(df: DataFrame, file_col: str, seed: int) -> DataFrame:
    """Seeded shuffle of a file list: order by md5(seed:path), path."""
    return df.select(file_col).distinct().orderBy(text_hash(file_col, seed), file_col)


def text_hash(col: str, seed: int):
    """Seeded key for string ids, equal in Spark and DuckDB: md5('<seed>:' || value)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col)))
