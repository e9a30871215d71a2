"""Registry of named queries: each is a Spark plan over the driver tables plus,
where one exists, the DuckDB SQL that computes the same rows (the oracle).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    bench: bool = False


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, bench: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, bench)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    """Import every plan module so their queries register."""
    from . import corpus, text_queries, task_queries, eval_queries, array_queries, vocab_queries, result_queries, stream_queries, sink_queries, misc_queries, wordpiece_queries, noisy_queries  # noqa: F401

    return REGISTRY
