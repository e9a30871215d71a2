"""Arrow UDFs that go through a batch a slice at a time.

A batch has up to 10,000 rows. As Python objects, its texts or arrays take many
times their bytes, and so do the results, for every task of an executor and every
UDF of a stage. Here only one slice of a batch, ``SLICE_BYTES`` on average, is
Python objects, and its results leave before the next slice is read, so that a
worker's memory is that of the batch itself, however long texts and tables are.
The batch is bounded in bytes by the session (``session.bound_batches``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches

SLICE_BYTES = 1 << 18
LARGE_SLICE = 1 << 22


def slices(batches: Iterator[pa.Array], size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The batches in parts of about ``size`` bytes, at least one row each; nothing is copied."""
    for b in batches:
        rows = max(1, size * len(b) // max(1, b.nbytes))
        for at in range(0, max(1, len(b)), rows):
            yield b.slice(at, rows)


def sliced_udf(returns, make: Callable[[], Callable[[pa.Array], pa.Array]], size: int = SLICE_BYTES):
    """A UDF of one column. ``make`` runs once a task and gives the function from a slice to its results.
    Work that stays in Arrow may take slices of ``LARGE_SLICE``."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_slice = make()
        for part in slices(batches, size):
            yield of_slice(part)

    def bounded(c) -> Column:
        bound_batches(SparkSession.active())  # the session itself where this thread has none active
        return run(c)

    return bounded


def text_udf(make: Callable[[], Callable[[str], str]]):
    """A UDF ``text → text``; null stays null."""

    def whole():
        one = make()
        return lambda part: pa.array([None if t is None else one(t) for t in part.to_pylist()], pa.string())

    return sliced_udf(T.StringType(), whole)


def pieces_and_ids(rows: list[list[str]], ids: list[list[int]]) -> pa.StructArray:
    """The results of an encoder that gives subword pieces and their ids."""
    return pa.StructArray.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.int32()))], ["pieces", "ids"])
