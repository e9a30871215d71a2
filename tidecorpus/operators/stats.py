"""Summary statistics over long tables: histogram (A14), bootstrap intervals
(A15), Kruskal–Wallis (A16), Dunn + Benjamini–Hochberg (A17).

All ranks come from windows partitioned by the test group (task), never from
an un-partitioned global window; the per-task value column is pre-aggregated
to (value, multiplicity) before ranking so a hot group does not pin one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, col: str, lo: float = 0, hi: float = 40, bins: int = 40, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram on [lo, hi]; the last bin is closed; outside values dropped.

    Output ``bin, n`` (plus ``by`` columns) with empty bins reported as 0.
    The bin table is ``bins`` rows, so joining it back is always a broadcast.
    """
    by = by or []
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("long")
    counts = df.filter((x >= lo) & (x <= hi)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    if by:
        # every group gets every bin by an in-place explode (no join)
        grid = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).cast("long").alias("bin"))
        keys = by + ["bin"]
        return grid.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ A15 bootstrap
# Poisson(1) cumulative probabilities P(X <= k), k = 0..7 (fixed values)
POISSON1_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999898508833446]


# four hex digits of a hash are one uniform draw; a 32-digit hash holds eight
DRAWS, DIGITS = 8, 4


def poisson1_weight(h: "Column", draw: int) -> "Column":
    """Poisson(1) draw from the ``draw``-th four hex digits of a hash by inverse CDF."""
    from .indexing import hash_below

    w = F.lit(8)
    for k in reversed(range(len(POISSON1_CDF))):
        w = F.when(hash_below(h, POISSON1_CDF[k], DIGITS * draw, DIGITS), F.lit(k)).otherwise(w)
    return w


def bootstrap_mean_ci(df: DataFrame, by: list[str], value: str, id_col: str, replicates: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Group mean with a seeded Poisson-bootstrap interval.

    A row meets ``replicates / 8`` hashes; each gives the Poisson(1) weights of
    eight replicates, summed side by side, so rows grow by replicates / 8 inside
    the task and leave it as partial sums per (group, hash). Replicate means are
    Σw·x / Σw; the interval is the exact percentile over the means of a group.
    """
    from .indexing import portable_hash

    chunks = -(-replicates // DRAWS)
    rep = df.select(*by, F.col(value).cast("double").alias("_x"), F.col(id_col).alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"))
    rep = rep.withColumn("_h", portable_hash("_id", seed, F.col("_c")))
    sums = []
    for k in range(DRAWS):
        w = poisson1_weight(F.col("_h"), k)
        sums += [F.sum(w * F.col("_x")).alias(f"_s{k}"), F.sum(w).alias(f"_w{k}")]
    part = rep.groupBy(*by, "_c").agg(*sums)
    each = F.array(*[F.struct((F.col("_c") * DRAWS + k).alias("b"), (F.col(f"_s{k}") / F.col(f"_w{k}")).alias("m")) for k in range(DRAWS)])
    means = part.select(*by, F.explode(each).alias("_z")).select(*by, F.col("_z.b").alias("_b"), F.col("_z.m").alias("_m")).filter(F.col("_b") < replicates)
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = means.groupBy(*by).agg(F.percentile("_m", lo).alias("ci_low"), F.percentile("_m", hi).alias("ci_high"))
    mean = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return mean.join(ci, by, "inner")


# ------------------------------------------------------------------ A16 Kruskal–Wallis
def average_ranks(df: DataFrame, task: list[str], value: str, id_col: str) -> DataFrame:
    """(task…, value, avg_rank, t): 1-based average rank of each distinct value
    within its task, ties averaged; t = multiplicity.

    Row positions come from ``group_index`` (range partitioned, no window over a
    task); the tie average is min(position) + (t + 1) / 2, a plain aggregate.
    """
    from .indexing import group_index

    pos = group_index(df.select(*task, value, id_col), [value, id_col], task, "_p")
    return pos.groupBy(*task, value).agg(
        (F.min("_p") + (F.count(F.lit(1)) + 1) / 2.0).alias("avg_rank"), F.count(F.lit(1)).alias("t")
    )


def kruskal_wallis(df: DataFrame, task: list[str], group: str, value: str, id_col: str) -> DataFrame:
    """H statistic with tie correction, and its chi-square p-value (k − 1 dof)."""
    ranks = average_ranks(df, task, value, id_col)
    cells = df.groupBy(*task, value, group).agg(F.count(F.lit(1)).alias("c"))
    rs = cells.join(ranks, task + [value], "inner").groupBy(*task, group).agg(
        F.sum(F.col("c") * F.col("avg_rank")).alias("R"), F.sum("c").alias("n_g")
    )
    ties = ranks.groupBy(*task).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("T"), F.sum("t").alias("N"))
    per = rs.groupBy(*task).agg(F.sum(F.pow("R", 2) / F.col("n_g")).alias("S"), F.count(F.lit(1)).alias("k"))
    j = per.join(ties, task, "inner")
    N = F.col("N").cast("double")
    h0 = F.lit(12.0) / (N * (N + 1)) * F.col("S") - F.lit(3.0) * (N + 1)
    corr = F.lit(1.0) - F.col("T") / (N * N * N - N)
    out = j.select(*task, "k", F.col("N").alias("n"), (h0 / corr).alias("H"))
    return out.withColumn("p_value", chi2_sf(F.col("H"), F.col("k") - 1))


def chi2_sf(x: "Column", dof: "Column") -> "Column":
    """Chi-square survival function. Even dof: exp(−x/2)·Σ_{j<dof/2} (x/2)^j / j!
    as a native fold; odd dof: erfc and its series, native too."""
    half = x / 2.0
    m = (dof / 2).cast("int")
    terms = F.aggregate(
        F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("acc")),
        lambda s, j: F.struct(
            (s["term"] * F.when(j == 0, F.lit(1.0)).otherwise(half / j)).alias("term"),
            (s["acc"] + s["term"] * F.when(j == 0, F.lit(1.0)).otherwise(half / j)).alias("acc"),
        ),
    )
    even = F.exp(-half) * terms["acc"]
    # odd: erfc(√(x/2)) + Σ_{j odd < dof} √(2x/π)·e^{−x/2}·x^((j−1)/2) / (3·5·…·j)
    odd = F.aggregate(
        F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))),
        F.struct((F.sqrt(x * (2.0 / math.pi)) * F.exp(-half)).alias("term"), F.lit(0.0).alias("acc")),
        lambda s, j: F.struct((s["term"] * x / (j * 2 + 3)).alias("term"), (s["acc"] + F.when(j < m, s["term"]).otherwise(0.0)).alias("acc")),
    )
    tail = F.when(x <= 0, F.lit(1.0)).otherwise(erfc(F.sqrt(half)) + odd["acc"])
    return F.when(dof % 2 == 0, even).otherwise(tail)


# --- fixed values: Cody's rational approximations of erf and erfc (published 1969), in the published order ---
ERF_NUM = [3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1]
ERF_DEN = [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
ERFC_NUM = [5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
            1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8]
ERFC_DEN = [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
            4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
TAIL_NUM = [3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2]
TAIL_DEN = [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def _horner(y, num, den):
    """The quotient of the two polynomials, each one nested product; for columns, numbers and SQL texts alike."""
    a, b = num[-1] * y, y
    for p, q in zip(num[:-2], den[:-1]):
        a, b = (a + p) * y, (b + q) * y
    return (a + num[-2]) / (b + den[-1])


class _Sql(str):
    """SQL text with the arithmetic of ``_horner``."""

    def _op(self, op, other, swap=False):
        a, b = (other, self) if swap else (self, other)
        return _Sql("({} {} {})".format(*(f"{v!r}::DOUBLE" if isinstance(v, float) else v for v in (a,)), op, *(f"{v!r}::DOUBLE" if isinstance(v, float) else v for v in (b,))))

    __add__ = lambda s, o: s._op("+", o)
    __mul__ = lambda s, o: s._op("*", o)
    __rmul__ = lambda s, o: s._op("*", o, True)
    __truediv__ = lambda s, o: s._op("/", o)


def erfc(x: "Column") -> "Column":
    """Complementary error function of x ≥ 0, as one native expression; relative error under 1e-13 for x up to 26."""
    y = F.when(x > 4.0, x).otherwise(F.lit(4.0))  # no division by a small number on the other branches
    sq = F.lit(1.0) / (y * y)
    near = F.lit(1.0) - x * _horner(x * x, ERF_NUM, ERF_DEN)
    mid = F.exp(-(x * x)) * _horner(x, ERFC_NUM, ERFC_DEN)
    far = F.exp(-(x * x)) / y * (F.lit(1.0 / math.sqrt(math.pi)) - sq * _horner(sq, TAIL_NUM, TAIL_DEN))
    return F.when(x <= 0.46875, near).when(x <= 4.0, mid).otherwise(far)


def erfc_sql(x: str) -> str:
    """The same in SQL; ``x`` should be a column name, as it is written out at each use."""
    v, sq = _Sql(x), _Sql(f"(1.0::DOUBLE / ({x} * {x}))")
    near = f"1.0 - {x} * {_horner(_Sql(f'({x} * {x})'), ERF_NUM, ERF_DEN)}"
    mid = f"exp(-({x} * {x})) * {_horner(v, ERFC_NUM, ERFC_DEN)}"
    far = f"exp(-({x} * {x})) / {x} * ({1.0 / math.sqrt(math.pi)!r}::DOUBLE - {sq} * {_horner(sq, TAIL_NUM, TAIL_DEN)})"
    return f"(CASE WHEN {x} <= 0.46875 THEN {near} WHEN {x} <= 4.0 THEN {mid} ELSE {far} END)"


# ------------------------------------------------------------------ A17 Dunn + Benjamini–Hochberg
def dunn_test(df: DataFrame, task: list[str], group: str, value: str, id_col: str) -> DataFrame:
    """Pairwise Dunn z of mean ranks between groups, two-sided p, and
    Benjamini–Hochberg adjusted p. Pairs are of *groups* (k·(k−1)/2 rows per
    task), never of rows."""
    ranks = average_ranks(df, task, value, id_col)
    cells = df.groupBy(*task, value, group).agg(F.count(F.lit(1)).alias("c"))
    g = cells.join(ranks, task + [value], "inner").groupBy(*task, group).agg(
        (F.sum(F.col("c") * F.col("avg_rank")) / F.sum("c")).alias("mr"), F.sum("c").alias("n_g")
    )
    ties = ranks.groupBy(*task).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("T"), F.sum("t").alias("N"))
    a = g.select(*task, F.col(group).alias("group_a"), F.col("mr").alias("mr_a"), F.col("n_g").alias("n_a"))
    b = g.select(*task, F.col(group).alias("group_b"), F.col("mr").alias("mr_b"), F.col("n_g").alias("n_b"))
    pairs = a.join(b, task, "inner").filter(F.col("group_a") < F.col("group_b")).join(ties, task, "inner")
    N = F.col("N").cast("double")
    var = (N * (N + 1) / 12.0 - F.col("T") / (12.0 * (N - 1))) * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b"))
    z = (F.col("mr_a") - F.col("mr_b")) / F.sqrt(var)
    pairs = pairs.select(*task, "group_a", "group_b", z.alias("z"))
    pairs = pairs.withColumn("p_value", two_sided_p(F.col("z")))
    return bh_adjust(pairs, task, "p_value")


def two_sided_p(z: "Column") -> "Column":
    """Two-sided normal p = erfc(|z| / √2); null and NaN give null."""
    return F.when(F.isnan(z), F.lit(None).cast("double")).otherwise(erfc(F.abs(z) / math.sqrt(2.0)))


def bh_adjust(df: DataFrame, by: list[str], p: str, out: str = "p_adj") -> DataFrame:
    """Benjamini–Hochberg: sort p ascending, q_i = min_{j≥i} p_j·m / j, capped at 1.
    Windows are partitioned by test (task), over its k·(k−1)/2 comparisons."""
    from pyspark.sql import Window as W

    w_rank = W.partitionBy(*by).orderBy(F.col(p), F.col("group_a"), F.col("group_b")) if by else W.orderBy(F.col(p), "group_a", "group_b")
    m = F.count(F.lit(1)).over(W.partitionBy(*by)) if by else F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    r = df.withColumn("_r", F.row_number().over(w_rank)).withColumn("_m", m)
    r = r.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    w_tail = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return r.withColumn(out, F.least(F.min("_q").over(w_tail), F.lit(1.0))).drop("_r", "_m", "_q")
