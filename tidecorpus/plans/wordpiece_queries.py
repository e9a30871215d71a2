"""WordPiece queries (E4, E5, E14, P10) with added tokens, over ``documents`` in their social form.

No published vocabulary file can be read here, so a small one is derived from
the texts by a fixed rule (frequent short words, letters, word ends); the encoder
takes any (token, id) table, such as ``operators.wordpiece.read_vocabulary``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..operators import wordpiece as wp
from ..sources.tables import documents, social_documents
from . import sqltext as S
from .registry import query

N_LETTERS, N_HEADS, N_TAILS = 40, 400, 300
LETTERS = "^\\p{L}+$"


def small_vocabulary(spark, sf_dir) -> DataFrame:
    """(token, id): specials, two marks, the commonest letters, short words and word ends; at most 790 rows."""
    words = documents(spark, sf_dir, "text").select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    counts = words.where(F.col("w").rlike(LETTERS)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    letters = counts.select(F.explode(F.split("w", "")).alias("t"), "n").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(N_LETTERS)
    heads = counts.where(F.length("w").between(2, 6)).orderBy(F.desc("n"), "w").limit(N_HEADS).select(F.col("w").alias("t"))
    ends = counts.select(F.explode(F.array(*[F.when(F.length("w") > k, F.expr(f"right(w, {k})")) for k in (2, 3)])).alias("t"), "n").where("t is not null")
    tails = ends.groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(N_TAILS)
    fixed = spark.createDataFrame([(t,) for t in [*wp.SPECIALS, ".", ","]], "t string")
    tail = F.concat(F.lit(wp.CONTINUES), F.col("t")).alias("t")
    tokens = fixed.unionByName(letters.select("t")).unionByName(letters.select(tail)).unionByName(heads).unionByName(tails.select(tail)).distinct()
    # at most 790 rows
    return tokens.select(F.col("t").alias("token"), (F.row_number().over(Window.orderBy("t")) - 1).cast("int").alias("id"))


_FIXED = ", ".join(f"({S.q(t)})" for t in [*wp.SPECIALS, ".", ","])
_VOCAB_SQL = f"""
wc AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE regexp_full_match(w, '\\p{{L}}+') GROUP BY w),
letters AS (SELECT ch AS t FROM (SELECT unnest(string_split(w, '')) AS ch, n FROM wc) GROUP BY ch ORDER BY sum(n) DESC, ch LIMIT {N_LETTERS}),
heads AS (SELECT w AS t FROM wc WHERE length(w) BETWEEN 2 AND 6 ORDER BY n DESC, w LIMIT {N_HEADS}),
tails AS (SELECT right(w, k) AS t FROM wc, (VALUES (2), (3)) x(k) WHERE length(w) > k GROUP BY 1 ORDER BY sum(n) DESC, t LIMIT {N_TAILS}),
vocab AS MATERIALIZED (SELECT t AS token, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS id FROM (
  SELECT t FROM (VALUES {_FIXED}) f(t) UNION SELECT t FROM letters UNION SELECT '##' || t FROM letters UNION SELECT t FROM heads UNION SELECT '##' || t FROM tails)),
parts AS MATERIALIZED (SELECT CASE WHEN starts_with(token, '##') THEN substr(token, 3) ELSE token END AS body, starts_with(token, '##') AS tail, id FROM vocab WHERE NOT starts_with(token, '['))"""

# added tokens become one private character each, so that marks inside them are not split
_ADDED = sorted(K.SOCIAL_TOKENS, key=lambda t: (-len(t), t))
_PRIVATE = {t: chr(0xE000 + i) for i, t in enumerate(_ADDED)}


def _words_sql(text: str) -> str:
    """Words, marks and added tokens (as private characters) of a text, in order."""
    x = f"lower({text})"
    for t, c in _PRIVATE.items():  # no added token holds another, so one after the other equals leftmost-longest
        x = S.rep(x, t, f" {c} ")
    x = S.rr(x, "([!-/:-@\\[-`{-~]|\\p{P})", " \\1 ")
    return f"list_filter(string_split_regex({S.cjk(x)}, '[ \\t\\n\\r\\p{{Zs}}]+'), lambda w: w <> '')"


def _segment_sql(text: str) -> str:
    added = " ".join(f"WHEN {S.q(c)} THEN {S.q(t)}" for t, c in _PRIVATE.items())
    added_id = " ".join(f"WHEN {S.q(c)} THEN CAST((SELECT max(id) FROM vocab) + {1 + K.SOCIAL_TOKENS.index(t)} AS VARCHAR)" for t, c in _PRIVATE.items())
    is_added = ", ".join(S.q(c) for c in _PRIVATE.values())
    return f"""{_VOCAB_SQL},
tokens AS MATERIALIZED (SELECT doc_id, lang, {_words_sql(text)} AS ws FROM documents),
flat AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM tokens),
seg AS (
  SELECT DISTINCT w, 1 AS pos, 0 AS n, '' AS pieces, '' AS ids FROM flat
  UNION ALL
  SELECT w, pos + len, n + 1, pieces || ' ' || piece, ids || ',' || id FROM (
    SELECT s.w, s.pos, s.n, s.pieces, s.ids, l.len, p.id, (CASE WHEN p.tail THEN '##' ELSE '' END) || p.body AS piece
    FROM seg s, range(1, 8) l(len), parts p
    WHERE p.body = substr(s.w, s.pos, l.len) AND p.tail = (s.pos > 1) AND s.pos + l.len - 1 <= length(s.w) AND length(s.w) <= {wp.MAX_WORD}
    QUALIFY row_number() OVER (PARTITION BY s.w, s.pos ORDER BY l.len DESC) = 1)),
spelt AS MATERIALIZED (SELECT f.w, coalesce(s.n, 1) AS n,
    CASE f.w {added} ELSE coalesce(substr(s.pieces, 2), '{wp.UNK}') END AS pieces,
    CASE f.w {added_id} ELSE coalesce(substr(s.ids, 2), (SELECT CAST(id AS VARCHAR) FROM vocab WHERE token = '{wp.UNK}')) END AS ids
  FROM (SELECT DISTINCT w FROM flat) f LEFT JOIN (SELECT * FROM seg WHERE pos > length(w) AND w NOT IN ({is_added})) s ON s.w = f.w)"""


_SOCIAL_TEXT = S.social_plain(S.SOCIAL)
_LENGTH_SQL = f"""WITH RECURSIVE {_segment_sql(S.collapse_emoji(_SOCIAL_TEXT))},
len AS (SELECT t.doc_id, t.lang, CAST(least(coalesce(sum(s.n), 0), {K.MAX_LENGTH - 2}) AS INTEGER) AS token_len
  FROM tokens t LEFT JOIN flat f ON f.doc_id = t.doc_id LEFT JOIN spelt s ON s.w = f.w GROUP BY t.doc_id, t.lang)"""


def social_texts(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, text): the placeholder form of the social texts (T1 without camel split and run cap)."""
    docs = social_documents(spark, sf_dir)
    return docs.select("doc_id", "lang", tx.social_normalise("social", shorten=0, camel_split=False, laughter=False).alias("text"))


@query("p10_wordpiece_filter", sql=f"{_LENGTH_SQL} SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE token_len >= 6) AS n_kept, CAST(sum(token_len) AS BIGINT) AS n_tokens FROM len GROUP BY lang")
def p10_wordpiece_filter(spark, sf_dir):
    """Rows and kept rows by language, lengths in subword pieces with the four added tokens."""
    length = wp.token_counter(small_vocabulary(spark, sf_dir))
    lens = social_texts(spark, sf_dir).select("lang", length("text").alias("token_len"))
    return lens.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("token_len") >= K.MIN_TOKENS).alias("n_kept"), F.sum("token_len").alias("n_tokens"))


@query("e14_wordpiece_lengths", sql=f"{_LENGTH_SQL} SELECT doc_id, token_len FROM len")
def e14_wordpiece_lengths(spark, sf_dir):
    """Truncated length of every social text in subword pieces."""
    length = wp.token_counter(small_vocabulary(spark, sf_dir))
    return social_texts(spark, sf_dir).select("doc_id", length("text").alias("token_len"))


@query(
    "e4_wordpiece_encode",
    sql=f"""WITH RECURSIVE {_segment_sql(_SOCIAL_TEXT)}
    SELECT t.doc_id, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n_pieces, coalesce(string_agg(s.pieces, ' ' ORDER BY f.at), '') AS pieces, coalesce(string_agg(s.ids, ',' ORDER BY f.at), '') AS ids
    FROM tokens t LEFT JOIN flat f ON f.doc_id = t.doc_id LEFT JOIN spelt s ON s.w = f.w GROUP BY t.doc_id""",
)
def e4_wordpiece_encode(spark, sf_dir):
    """Pieces and ids of every whole social text."""
    enc = wp.encoder(small_vocabulary(spark, sf_dir), K.SOCIAL_TOKENS)
    coded = social_texts(spark, sf_dir).select("doc_id", enc("text").alias("e"))
    return coded.select("doc_id", F.size("e.pieces").cast("long").alias("n_pieces"), F.array_join("e.pieces", " ").alias("pieces"), F.array_join(F.col("e.ids").cast("array<string>"), ",").alias("ids"))
