"""Consecutive row indexes without a window over a whole group.

``row_number().over(Window.partitionBy(g).orderBy(o))`` puts every row of a
group into one task; with a hot group (a third of the corpus in one label, one
file, or no group at all) that task holds a third of the data. Instead:

1. range-partition on ``(g…, o…)`` into a fixed number of partitions – a hot
   group is spread over many partitions – and sort within each partition;
2. tag rows with ``spark_partition_id()`` and ``monotonically_increasing_id()``
   (position inside the partition, no extra pass);
3. count rows per (partition, group): at most ``#partitions + #groups`` rows;
4. exclusive prefix sums of those counts per group (a window over the small
   count table only) give each (partition, group) its offset;
5. index = offset + position − first position of that (partition, group).

The tagged rows (partition id, position) are written once as a reliable
checkpoint into the session's checkpoint folder. Both the count branch and the
row branch then read the same stored values: range bounds come from sampling,
which depends on the row order inside upstream partitions, so two independent
evaluations of the exchange could disagree. The checkpoint also makes the index
survive executor loss. The join back to the offsets is size-checked at runtime
by AQE: broadcast when the offset table is small (the usual case), a shuffle
join otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions


def group_index(
    df: DataFrame,
    order: Sequence[str | Column],
    groups: Sequence[str] = (),
    name: str = "idx",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of each row inside its group in ``order``.

    ``order`` must be a total order inside each group (append a unique key).
    """
    groups = list(groups)
    tagged = range_tagged(df, order, groups, partitions)
    counts = tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_pid") if groups else Window.orderBy("_pid")
    offsets = counts.select("_pid", *groups, "_first", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    joined = tagged.join(offsets, ["_pid", *groups], "inner")
    return joined.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first")).drop("_pid", "_mid", "_first", "_off")


def range_tagged(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Steps 1–2: rows range-partitioned on (groups, order), sorted, tagged with
    ``_pid`` / ``_mid`` and stored once (reliable checkpoint)."""
    n = partitions or shuffle_partitions(df.sparkSession)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(g) for g in groups] + order_cols
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Global 0-based row index in ``order``."""
    return group_index(df, order, (), name)


def portable_hash(id_col: str | Column, seed: int | Column, pos: str | Column | int = 0) -> Column:
    """Seeded pseudo-random key both Spark and DuckDB compute alike: 32 hex digits of
    ``md5('<seed>:<id>:<pos>')``. Any id is valid (no arithmetic, so no overflow);
    a null id counts as the empty text. Sorting by it shuffles; runs of its digits
    are independent uniform numbers (``hash_below``, ``hash_int``)."""
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    p = F.col(pos) if isinstance(pos, str) else F.lit(pos) if isinstance(pos, int) else pos
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", s.cast("string"), F.coalesce(i.cast("string"), F.lit("")), p.cast("string")))


def portable_hash_sql(id_sql: str, seed: int | str, pos: int | str = 0) -> str:
    return f"md5(({seed})::VARCHAR || ':' || coalesce(({id_sql})::VARCHAR, '') || ':' || ({pos})::VARCHAR)"


def hash_bound(p: float, digits: int = 8) -> str:
    """Hex digits under which a share ``p`` of all hashes lies."""
    return f"{min(int(p * 16**digits), 16**digits - 1):0{digits}x}"


def hash_below(h: Column, p: float, at: int = 0, digits: int = 8) -> Column:
    """True with probability ``p``: compares ``digits`` hex digits from place ``at``."""
    return F.substring(h, at + 1, digits) < F.lit(hash_bound(p, digits))


def hash_int(h: Column, at: int = 0, digits: int = 8) -> Column:
    """The number written by ``digits`` (at most 15) hex digits from place ``at``."""
    return F.conv(F.substring(h, at + 1, digits), 16, 10).cast("long")
