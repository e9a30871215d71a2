"""Document fingerprints: SimHash votes and a search by permuted block tables.

All of it is DataFrame functions; no Python runs on the executors.

A text's terms are its pairs of neighbouring words (a single word: itself; no
word: the empty term). A term votes with its weight, the length of its words
less ``FREE`` letters, held in 1 to 8, so that pairs of short common words count
little. Two 64-bit hashes of the term vote on 128 signed bits: a bit is 1 where
the weights of terms that set it exceed half of all. Votes are added four bits
at a time in 16-bit lanes; a chunk of terms is small enough for its lanes.

``within`` finds all pairs of distinct fingerprints at most ``RADIUS`` bits
apart. Of four blocks of 32 bits at least one is then without a difference, so
each fingerprint stands in four tables, permuted to begin with another block;
equal beginnings meet in a join that tests the exact distance. Equal
fingerprints are one row with a count, and no group of copies forms pairs.

``neighbour_texts`` pairs each document with the one that follows it by
descending id (the last one with the first). Texts are dealt once, by id range:
range bounds come from quantiles of the ids (at most ``MAX_RANGES``) and each
range also gets the first row of the next.

Null text is the empty text. Null ids come last in descending order; ties of
ids go by a hash of the text. Repeated rows are kept. One row alone is its own
next. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe_text, stored
from .neardup import WS, bit_or, lane_bit, lane_sums, shingles

RADIUS = 3
FREE = 5
CHUNK = 4_095  # terms of weight 8 at most: 4095 * 8 < 2 ** 15
RANGE_ROWS = 1_000
MAX_RANGES = 32_768


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, hi, lo): the fingerprint of each row; ``keys`` identify a row."""
    src = rows.select(*keys, F.btrim(F.lower(F.col(text)), F.lit(WS)).alias("_t"))
    terms = src.select(*keys, F.posexplode(shingles(F.split("_t", r"[\x20\x09-\x0D]+"), 2)).alias("_pos", "_s"))
    terms = terms.where((F.col("_pos") == 0) | F.col("_s.i1").isNotNull())
    term = F.concat_ws(" ", F.col("_s.i0"), F.col("_s.i1"))
    terms = terms.select(*keys, F.floor(F.col("_pos") / CHUNK).alias("_c"), F.xxhash64(term).alias("_h"), F.xxhash64(term, F.lit(1)).alias("_g"), F.greatest(F.lit(1), F.least(F.lit(8), F.length(term) - FREE)).cast("long").alias("_w"))
    part = terms.groupBy(*keys, "_c").agg(F.sum("_w").alias("_n"), *lane_sums(F.col("_h"), "h", F.col("_w")), *lane_sums(F.col("_g"), "g", F.col("_w")))
    total = part.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(lane_bit(i, p)).alias(f"_{p}{i}") for p in "hg" for i in range(64)])
    bits = {p: bit_or([F.col(f"_{p}{i}") * 2 > F.col("_n") for i in range(64)]) for p in "hg"}
    return total.select(*keys, bits["h"].alias("hi"), bits["g"].alias("lo"))


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Differing bits of (a, b) and (c, d)."""
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def text_of(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(hi, lo, hi2, lo2, bits): every ordered pair of distinct fingerprints at most ``radius`` (0 to 3) bits apart."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find pairs up to 3 bits apart")
    nodes = prints.select("hi", "lo").distinct()
    block = [F.shiftrightunsigned("hi", 32), F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("lo", 32), F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF))]
    tables = nodes.select("hi", "lo", F.posexplode(F.array(*block)).alias("t", "front"))
    other = tables.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), "t", "front")
    bits = distance(F.col("hi"), F.col("lo"), F.col("hi2"), F.col("lo2"))
    found = tables.join(other, (tables["t"] == other["t"]) & (tables["front"] == other["front"]) & (bits <= radius) & (bits > 0))
    return found.select("hi", "lo", "hi2", "lo2", bits.alias("bits")).distinct()


def neighbour_texts(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(_range, doc_id, content, text, next_id, next_content, next_text) of every row, dealt by ``_range``."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text("text").alias("text")).withColumn("content", F.xxhash64("text", F.lit(7)))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    parts = max(1, min(n // range_rows, MAX_RANGES))
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    # binary search: cuts at or under the id, in log2 steps; an id is in range 0 if it is null
    size = 1
    while size <= len(cuts):
        size *= 2
    padded = F.array(*[F.lit(c).cast("long") for c in cuts + [2**63 - 1] * (size - len(cuts))])

    def ranged(df: DataFrame) -> DataFrame:
        df = df.withColumn("_r", F.lit(0))
        step = size // 2
        while step:
            df = df.withColumn("_r", F.col("_r") + F.when(F.col("doc_id") >= F.element_at(padded, F.col("_r") + step), step).otherwise(0))
            step //= 2
        return df

    # first row of each range, by descending id: one row a range
    firsts = ranged(ids).groupBy("_r").agg(F.max("doc_id").alias("_top"))
    up = Window.orderBy("_r")
    last = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("_to", F.coalesce(F.lead("_r").over(up), F.first("_r").over(last)))
    placed = ranged(src).join(F.broadcast(firsts), "_r")
    is_first = F.col("doc_id").eqNullSafe(F.col("_top"))
    both = F.when(is_first, F.array(F.struct(F.col("_r").alias("r"), F.lit(0).alias("halo")), F.struct(F.col("_to").alias("r"), F.lit(1).alias("halo")))).otherwise(F.array(F.struct(F.col("_r").alias("r"), F.lit(0).alias("halo"))))
    dealt = placed.select("doc_id", "content", "text", F.explode(both).alias("_p")).select("doc_id", "content", "text", F.col("_p.r").alias("_range"), F.col("_p.halo").alias("_halo"))
    w = Window.partitionBy("_range").orderBy("_halo", F.col("doc_id").desc_nulls_last(), "content")
    out = dealt.withColumn("_n", F.lead(F.struct("doc_id", "content", "text")).over(w)).where(F.col("_halo") == 0)
    return out.select("_range", "doc_id", "content", "text", F.col("_n.doc_id").alias("next_id"), F.col("_n.content").alias("next_content"), F.col("_n.text").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, content, hi, lo) of every row's whole text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text("text").alias("text")).withColumn("content", F.xxhash64("text", F.lit(7))).withColumn("uid", F.monotonically_increasing_id())
    return votes(src, ["uid", "doc_id", "content"], "text").drop("uid")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next document, and the number
    of other documents whose fingerprint is at most ``radius`` bits away."""
    near = neighbour_texts(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = near.select("_range", "doc_id", "content", "next_id", "next_content", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("_range", "doc_id", "content", "next_id", "next_content", "n_chars", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"), F.array("text", "edited").alias("both")).withColumn("uid", F.monotonically_increasing_id())
    # rows lie dealt by _range: with it among the keys, votes and sides are added up where they are
    keys = ["_range", "uid", "doc_id", "content", "next_id", "next_content", "n_chars", "sha"]
    sides = rows.select(*keys, F.posexplode("both").alias("side", "t"))
    prints = votes(sides, [*keys, "side"], "t")
    wide = prints.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("hi", "lo")])
    wide = stored(wide.drop("_range"))
    of = wide.select(F.col("doc_id").alias("_id"), F.col("content").alias("_c"), F.col("hi0").alias("_hi"), F.col("lo0").alias("_lo")).groupBy("_id", "_c").agg(F.first("_hi").alias("_hi"), F.first("_lo").alias("_lo"))
    out = wide.join(of, wide["next_id"].eqNullSafe(of["_id"]) & (wide["next_content"] == of["_c"]))
    nodes = wide.groupBy(F.col("hi0").alias("hi"), F.col("lo0").alias("lo")).agg(F.count(F.lit(1)).alias("n"))
    pairs = within(nodes, radius)
    others = nodes.withColumnRenamed("n", "m").withColumnsRenamed({"hi": "hi2", "lo": "lo2"})
    around = pairs.join(others, ["hi2", "lo2"]).groupBy("hi", "lo").agg(F.sum("m").alias("m"))
    counted = nodes.join(around, ["hi", "lo"], "left").select(F.col("hi").alias("hi0"), F.col("lo").alias("lo0"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"))
    like = lambda a, b: (1 - distance(F.col("hi0"), F.col("lo0"), F.col(a), F.col(b)) / F.lit(128.0))
    return out.join(counted, ["hi0", "lo0"]).select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_of(F.col("hi0"), F.col("lo0")).alias("fingerprint"), text_of(F.col("hi1"), F.col("lo1")).alias("edited_fingerprint"),
        like("hi1", "lo1").alias("near_edited"), like("_hi", "_lo").alias("near_next"), "n_near")
