"""Mixing sources to target weights by hierarchical budgets.

Leaves of the tree are the distinct values of ``levels`` (domain, lang,
source). A token budget flows from the root down. At a node each child gets its
share by weight; a child whose tokens, over at most ``max_epochs`` passes, fall
short gets what it has, and the rest is dealt again over its siblings by
weight. Only when all siblings are full does a shortage reach the parent's
siblings, because a node's own limit is the sum of its leaves. In closed form:
children in order of limit / weight are full up to a point, and the others
share what remains (a window over the children of a node, never over documents).
Shares are rounded down to whole tokens.

A leaf with budget b and t tokens is read ``b div t`` times in full; the next
epoch takes the longest prefix of ``b mod t`` tokens of its seeded order (md5 of
seed, epoch and doc_id; then doc_id and content). A hot leaf is range-split:
running token sums join sums inside a range with offsets of the ranges.

Tokens are words between white space. Null text is the empty text, with no
tokens; a null level is the value ''. A leaf without tokens is drawn 0 times.
Identical rows (id, text and leaf) are one unit and are drawn alike. An empty
table gives an empty result. Extra columns pass through in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import range_tagged
from .common import null_safe_text, stored

WS = " \t\n\x0b\x0c\r"
LEVELS = ("domain", "lang", "source")
#: Target weights by path from the root; paths that are not named weigh 1.
WEIGHTS = {"web": 5.0, "books": 3.0, "code": 2.0, "web/en": 4.0, "web/de": 2.0, "books/en": 2.0, "code/en": 3.0, "web/en/src0": 0.5}
PRODUCTION = {"weights": WEIGHTS, "budget_share": 1.0, "max_epochs": 2, "seed": 11}


def domain_of(source: str = "source") -> Column:
    """The domain of a source: its number mod 3 names web, books or code (no number: web)."""
    n = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), n % 3 + 1)


def n_tokens(text: str = "text") -> Column:
    t = F.btrim(null_safe_text(text), F.lit(WS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def weight_of(weights: dict[str, float], names: list[str]) -> Column:
    path = F.concat_ws("/", *[F.col(c) for c in names])
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
    return F.coalesce(F.try_element_at(table, path), F.lit(1.0))


def budgets(leaves: DataFrame, weights: dict[str, float], budget_share: float, max_epochs: int, levels=LEVELS) -> DataFrame:
    """Leaf table (levels, tokens) with ``budget``: one row per leaf, so its size is that of the tree."""
    levels = list(levels)
    tree = leaves.withColumn("_cap", F.col("tokens") * max_epochs)
    for d in range(1, len(levels) + 1):  # a weight of 0 anywhere above closes the leaf
        tree = tree.withColumn("_cap", F.when(weight_of(weights, levels[:d]) > 0, F.col("_cap")).otherwise(F.lit(0).cast("long")))
    total = tree.agg(F.least(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(budget_share)), F.coalesce(F.sum("_cap"), F.lit(0))).alias("_b"))
    parent = total
    for d in range(1, len(levels) + 1):
        up, here = levels[: d - 1], levels[:d]
        nodes = tree.groupBy(*here).agg(F.sum("_cap").alias("_cap")).withColumn("_w", weight_of(weights, here))
        # the root's side is one row
        nodes = nodes.join(parent, up) if up else nodes.crossJoin(F.broadcast(parent))
        order = Window.partitionBy(*up).orderBy(F.when(F.col("_w") > 0, F.col("_cap") / F.col("_w")).otherwise(F.lit(0.0)), *here)
        before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        nodes = nodes.withColumn("_full", F.col("_cap") * after <= F.col("_w") * (F.col("_b") - before))
        all_of = Window.partitionBy(*up)
        rest = F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_of), F.lit(0))
        free = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_of)
        share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.floor(F.col("_w") * rest / free)))
        parent = nodes.select(*here, share.alias("_b"))
    return leaves.join(parent, levels).withColumnRenamed("_b", "budget")


def draw(docs: DataFrame, weights: dict[str, float], budget_share: float = 1.0, max_epochs: int = 2, seed: int = 11, levels=LEVELS) -> DataFrame:
    """(levels, doc_id, content, n_tokens, copies): how often each unit is drawn.

    ``docs`` has doc_id, text and the level columns.
    """
    levels = list(levels)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels], F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(null_safe_text("text"), F.lit(7)).alias("content"), n_tokens().alias("n_tokens"))
    units = rows.groupBy(*levels, "doc_id", "content").agg(F.sum("n_tokens").alias("n_tokens"))
    leaves = units.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, weights, budget_share, max_epochs, levels).select(*levels, F.coalesce(F.expr("try_divide(budget - budget % tokens, tokens)").cast("long"), F.lit(0)).alias("full"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(-1)).alias("part"))
    # written first, so that the join knows its size: one row a leaf, broadcast while that is small, and a hot leaf stays spread
    keyed = units.join(stored(plan), levels).withColumn("_o", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    tagged = range_tagged(keyed, ["_o", "doc_id", "content"], levels)
    sums = tagged.groupBy("_pid", *levels).agg(F.sum("n_tokens").alias("_s"))
    w = Window.partitionBy(*levels).orderBy("_pid")
    offsets = sums.select("_pid", *levels, (F.sum("_s").over(w) - F.col("_s")).alias("_off"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_pid", *levels).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = tagged.withColumn("_run", inside).join(offsets, ["_pid", *levels])
    return run.select(*levels, "doc_id", "content", "n_tokens", (F.col("full") + (F.col("_off") + F.col("_run") <= F.col("part")).cast("long")).alias("copies"))


def mixed(docs: DataFrame, weights: dict[str, float], budget_share: float = 1.0, max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """All columns of the documents drawn, a document as often as it is drawn. A column ``domain`` is
    used if there is one, else the domain follows from the source."""
    src = docs if "domain" in docs.columns else docs.withColumn("domain", domain_of())
    got = draw(src, weights, budget_share, max_epochs, seed).where(F.col("copies") > 0)
    names = [*LEVELS, "doc_id", "content"]
    got = got.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col("copies").alias("times"))
    # the caller's columns travel inside one struct, so none of their names can clash
    keys = [*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in LEVELS], F.col("doc_id").cast("long"), F.xxhash64(null_safe_text("text"), F.lit(7))]
    rows = src.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(f"of{i}") for i, k in enumerate(keys)])
    cond = rows["of0"] == got["k0"]
    for i in range(1, len(names)):
        cond = cond & (rows[f"of{i}"].eqNullSafe(got[f"k{i}"]) if names[i] == "doc_id" else rows[f"of{i}"] == got[f"k{i}"])
    return rows.join(got, cond).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")).select("row.*")


def oracle_sql(weights: dict[str, float] = WEIGHTS, budget_share: float = 1.0, max_epochs: int = 2, seed: int = 11) -> str:
    """DuckDB SQL for ``draw`` over ``documents`` (ids distinct)."""
    case = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in sorted(weights.items()))
    steps, parent = [], f"(SELECT LEAST(FLOOR(SUM(tokens) * {budget_share}), SUM(cap)) AS b FROM leaf)"
    for d in range(1, len(LEVELS) + 1):
        here, up = ", ".join(LEVELS[:d]), ", ".join(LEVELS[: d - 1])
        path = " || '/' || ".join(LEVELS[:d])
        by = f"PARTITION BY {up}" if up else ""
        join = f"JOIN {parent} USING ({up})" if up else f"CROSS JOIN {parent}"
        steps.append(f"""
n{d} AS (SELECT * FROM (SELECT {here}, SUM(cap)::DOUBLE AS cap, (CASE {path} {case} ELSE 1.0 END)::DOUBLE AS w FROM leaf GROUP BY {here}) {join}),
f{d} AS (SELECT *, cap * SUM(w) OVER ({by} ORDER BY cap / w, {here} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (b - COALESCE(SUM(cap) OVER ({by} ORDER BY cap / w, {here} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM n{d}),
b{d} AS (SELECT {here}, CASE WHEN full_ THEN cap ELSE LEAST(cap, FLOOR(w * (b - COALESCE(SUM(cap) FILTER (full_) OVER ({by}), 0)) / SUM(w) FILTER (NOT full_) OVER ({by}))) END AS b FROM f{d})""")
        parent = f"b{d}"
    last = ", ".join(LEVELS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) AS INT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
    regexp_replace(coalesce(text, ''), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t FROM documents),
u AS (SELECT doc_id, lang, source, domain, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '[\\x20\\x09-\\x0D]+')) END::BIGINT AS n_tokens FROM d),
leaf AS (SELECT {last}, SUM(n_tokens)::BIGINT AS tokens, SUM(n_tokens)::BIGINT * {max_epochs} AS cap FROM u GROUP BY {last}),{",".join(steps)},
p AS (SELECT {last}, CASE WHEN tokens > 0 THEN b::BIGINT // tokens ELSE 0 END AS full_, CASE WHEN tokens > 0 THEN b::BIGINT % tokens ELSE -1 END AS part FROM leaf JOIN {parent} USING ({last})),
o AS (SELECT u.*, full_, part, SUM(n_tokens) OVER (PARTITION BY {last} ORDER BY md5('{seed}:' || full_ || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS run FROM u JOIN p USING ({last}))
SELECT doc_id, domain, lang, source, n_tokens, (full_ + CASE WHEN run <= part THEN 1 ELSE 0 END)::BIGINT AS copies FROM o
"""
