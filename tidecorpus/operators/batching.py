"""Batching.

Batches are not nested lists: each row carries ``batch_id`` (and its position
in the batch), so a batch is a key, and per-batch work (dynamic padding) is a
window partitioned by that key – bounded by the batch size, never by the
corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import pad, round_up
from .indexing import group_index, portable_hash


def batches_across_files(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size batches over the whole line stream (crossing files)."""
    idx = group_index(df, order, (), "row_index")
    return idx.withColumn("batch_id", F.floor(F.col("row_index") / size).cast("long")).withColumn(
        "pos_in_batch", F.pmod(F.col("row_index"), F.lit(size)).cast("int")
    )


def batches_within_files(df: DataFrame, file_col: str, order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size batches inside each file; the short tail is its own batch."""
    idx = group_index(df, order, [file_col], "line_in_file")
    return idx.withColumn("batch_in_file", F.floor(F.col("line_in_file") / size).cast("long")).withColumn(
        "pos_in_batch", F.pmod(F.col("line_in_file"), F.lit(size)).cast("int")
    )


def length_grouped_batches(df: DataFrame, id_col: str, length: str, size: int, seed: int = 0, mega: int = 50) -> DataFrame:
    """Shuffle (seeded), cut into megabatches of ``mega·size`` rows, sort
    each megabatch by length (desc), cut into batches of ``size``.

    The window is partitioned by megabatch – bounded by ``mega·size`` rows.
    """
    shuffled = group_index(df.withColumn("_h", portable_hash(id_col, seed)), ["_h", id_col], (), "_r")
    m = shuffled.withColumn("megabatch", F.floor(F.col("_r") / (mega * size)).cast("long"))
    w = Window.partitionBy("megabatch").orderBy(F.desc(length), F.asc("_r"))
    m = m.withColumn("_k", F.row_number().over(w) - 1)
    per_mega = -(-(mega * size) // size)
    return m.withColumn("batch_id", (F.col("megabatch") * per_mega + F.floor(F.col("_k") / size)).cast("long")).drop("_h", "_r", "_k")


def dynamic_pad(df: DataFrame, ids: str, batch: str | Sequence[str], pad_id: int = 1, multiple: int | None = None, out: str | None = None) -> DataFrame:
    """Pad every sequence to the longest of its batch (optionally rounded
    up to a multiple, e.g. 8)."""
    keys = [batch] if isinstance(batch, str) else list(batch)
    longest = F.max(F.size(ids)).over(Window.partitionBy(*keys))
    target = round_up(longest, multiple)
    return df.withColumn(out or ids, pad(ids, target, pad_id))


def repeat_epochs(df: DataFrame, epochs: int, id_col: str, seed: int = 0) -> DataFrame:
    """The data ``epochs`` times, each epoch with its own shuffle key.

    ``explode(sequence(…))`` replicates rows in place – no join."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return e.withColumn("shuffle_key", portable_hash(id_col, F.col("epoch") + F.lit(seed)))


def limit_rows(df: DataFrame, row_index: str, limit: int | None) -> DataFrame:
    """``row_index < limit``; a falsy limit (0 or None) means all rows."""
    return df if not limit else df.filter(F.col(row_index) < limit)
