"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",)) -> None:
    """Columnar save; ``split`` as a partition column gives partition pruning."""
    cols = [c for c in partition_by if c in df.columns]
    w = df.write.mode("overwrite")
    (w.partitionBy(*cols) if cols else w).parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Load a saved dataset."""
    return spark.read.parquet(path)


def write_shards(df: DataFrame, out_dir: str, n_shards: int | None = None, text_col: str = "value", max_rows: int = 1_000_000) -> None:
    """Text files, overwrite. Every scan partition writes its own files of at
    most ``max_rows`` lines, with no shuffle; only a given ``n_shards`` deals rows
    to that many files. No blank line is written for an empty batch."""
    out = df.select(text_col)
    out = out.repartition(n_shards) if n_shards else out
    out.write.mode("overwrite").option("maxRecordsPerFile", max_rows).text(out_dir)


def write_csv(df: DataFrame, out_dir: str) -> None:
    """CSV with header (quotes and newlines escaped)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(out_dir)


def encode_once(df: DataFrame, path: str) -> DataFrame:
    """Encode once, share with all readers: write, then read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
