"""The first n rows in an order, without sorting or storing the rows.

``orderBy(...).limit(n)`` sends n rows through one task, and numbering every row
sorts and stores the whole table to keep n. Here the n-th smallest key is found
by counting: a histogram of the first order column names the bin that the n-th
row falls into, the next pass counts inside that bin, and so on, until at most
``EXACT`` rows share the bin; their keys are read and the n-th of them is the
bound. The rows are then one filter on the input, in the tasks that scan it.

A pass is one partial and final aggregate of at most ``BINS`` bins, whatever the
input; integers are halved into ``BINS`` equal steps, strings are told apart by
their next characters. Equal values of one column are counted on by the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 65_536
EXACT = 10_000
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _at(bins: list[tuple], n: int) -> tuple[int, int]:
    """(which bin holds the n-th row, rows in the bins before it)."""
    before = 0
    for i, (_, count) in enumerate(bins):
        if before + count >= n:
            return i, before
        before += count
    raise AssertionError("fewer rows than asked for")


def _histogram(df: DataFrame, key: Column) -> list[tuple]:
    rows = df.groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most BINS bins and one of nulls
    return sorted(((r["b"], r["n"]) for r in rows), key=lambda x: (x[0] is not None, x[0].encode() if isinstance(x[0], str) else x[0]))


def _integer_step(df: DataFrame, col: str, n: int, lo: int, hi: int):
    width = -(-(hi - lo + 1) // BINS)
    # whole-number division of decimals: no overflow and no rounding at the bins' ends
    bins = _histogram(df, F.expr(f"(cast(`{col}` as decimal(20,0)) - cast({lo} as decimal(20,0))) div cast({width} as decimal(20,0))"))
    i, before = _at(bins, n)
    b, count = bins[i]
    if b is None:
        return F.col(col).isNull(), n - before, count, None
    lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
    return F.col(col).between(lo, hi), n - before, count, (lo, hi) if hi > lo else None


def _string_step(df: DataFrame, col: str, n: int, prefix: str):
    """The next characters: four while that stays under ``BINS`` prefixes, else one."""
    for more in (4, 1):
        key = F.substring(col, 1, len(prefix) + more)
        if more == 1 or df.select(F.approx_count_distinct(key)).first()[0] < BINS * 0.9:
            break
    bins = _histogram(df, key)
    i, before = _at(bins, n)
    b, count = bins[i]
    if b is None:
        return F.col(col).isNull(), n - before, count, None
    whole = len(b) < len(prefix) + more  # the value ends here: all these rows are alike
    return (F.col(col) == b) if whole else F.startswith(F.col(col), F.lit(b)), n - before, count, None if whole else b


def nth_bound(df: DataFrame, order: Sequence[str], n: int) -> tuple | None:
    """The n-th smallest key of the order columns as a tuple of values (n from 1; None if there are fewer rows)."""
    left = df.select(*order)
    count = left.count()
    if n > count:
        return None
    fields = {f.name: f.dataType for f in left.schema.fields}
    for col in order:
        kind = fields[col]
        if isinstance(kind, INTEGRAL):
            ends = left.agg(F.min(col), F.max(col)).first()
            state = (ends[0], ends[1]) if ends[0] is not None else None
            step = lambda d, m, s, c=col: _integer_step(d, c, m, *s)
        elif isinstance(kind, T.StringType):
            state, step = "", lambda d, m, s, c=col: _string_step(d, c, m, s)
        else:
            raise TypeError(f"order columns are integers or strings, not {kind.simpleString()}")
        while count > EXACT and state is not None:
            where, n, count, state = step(left, n, state)
            left = left.where(where)
        if count <= EXACT:
            break
    # at most EXACT rows, or rows alike in every order column
    rows = left.distinct() if count > EXACT else left
    keys = sorted((tuple(r) for r in rows.limit(EXACT + 1).collect()), key=lambda t: tuple((v is not None, v.encode() if isinstance(v, str) else v) for v in t))
    return keys[0] if count > EXACT else keys[n - 1]


def _compared(order: Sequence[str], bound: tuple, df: DataFrame) -> tuple[Column, Column]:
    """(key < bound, key = bound), nulls first."""
    less, equal = F.lit(False), F.lit(True)
    types = {f.name: f.dataType for f in df.schema.fields}
    for c, v in zip(order, bound):
        value = F.lit(v).cast(types[c])
        below = F.lit(False) if v is None else (F.col(c).isNull() | (F.col(c) < value))
        less = less | (equal & F.coalesce(below, F.lit(False)))
        equal = equal & F.col(c).eqNullSafe(value)
    return less, equal


def first_rows(df: DataFrame, order: Sequence[str], n: int, strict: bool = False) -> DataFrame:
    """Exactly min(n, rows) rows, the smallest by the order columns (integers or strings; nulls first).
    ``strict``: fewer than n rows are an error. Rows alike in all order columns are interchangeable."""
    if n <= 0:
        return df.limit(0)
    bound = nth_bound(df, order, n)
    if bound is None:
        if strict:
            raise ValueError(f"asked for {n} rows, only {df.count()} exist")
        return df
    less, equal = _compared(order, bound, df)
    below, ties = (df.select(*order).agg(F.count_if(less), F.count_if(equal)).first())
    if below + ties == n:
        return df.where(less | equal)
    return df.where(less).unionByName(df.where(equal).limit(n - below))
