"""Helpers shared by the operators: stored tables, folds, safe column names."""

from __future__ import annotations

import gc
import sys
import types
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

__all__ = ["table", "stored", "discard", "freed", "null_safe_text", "ascii_lower", "held_out", "pick", "UPPER", "LOWER"]


def stored(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back; ``options`` of the writer.

    Cuts lineage with files that every executor can read, so a lost executor
    costs no recomputation of what stands before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tide-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tide_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table made by :func:`stored` that no later step reads."""
    path = getattr(df, "_tide_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def freed(sc: SparkContext) -> None:
    """Collect the driver's garbage, as Spark's cleaner does every half hour: shuffle files and checkpoints of
    steps that are done go then, else with the driver's next full collection, often after the job."""
    gc.collect()
    sc._jvm.System.gc()


def worker_cached(key, make):
    """``make()``, kept for the life of the Python worker (tasks reuse workers; the package ships by
    value, so its own globals do not outlive a task)."""
    kept = sys.modules.setdefault("_tide_worker_cache", types.ModuleType("_tide_worker_cache")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def null_safe_text(col: str | Column) -> Column:
    """The text as a string; null is the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A–Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold whose crc32(doc_id as text) mod 5 is 0 (null id: the empty text, so true)."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5) == 0


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed, so that extra columns of the caller cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in cols.items()])
