"""Text-normalisation queries on ``documents``.

Whole texts are processed; the result is reported as (doc_id, md5, length) of
the normalised text so the comparison stays cheap while every character counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import documents, social_documents
from . import sqltext as S
from .registry import query


def _digest(df: DataFrame, expr: Column) -> DataFrame:
    return df.select("doc_id", F.md5(expr).alias("h"), F.length(expr).alias("n_chars"))


def _sql_digest(expr: str, src: str = "documents") -> str:
    return f"SELECT doc_id, md5({expr}) AS h, CAST(length({expr}) AS INTEGER) AS n_chars FROM {src}"


@query("t1a_replace_mentions", sql=_sql_digest(S.mentions(S.SOCIAL)))
def t1a_replace_mentions(spark, sf_dir):
    return _digest(social_documents(spark, sf_dir), tx.replace_mentions("social"))


@query("t1b_replace_urls", sql=_sql_digest(S.urls(S.SOCIAL)))
def t1b_replace_urls(spark, sf_dir):
    return _digest(social_documents(spark, sf_dir), tx.replace_urls("social"))


@query("t1c_replace_hashtags", sql=_sql_digest(S.hashtags(S.SOCIAL)))
def t1c_replace_hashtags(spark, sf_dir):
    return _digest(social_documents(spark, sf_dir), tx.replace_hashtags("social"))


@query("t1d_replace_emoji", sql=_sql_digest(S.emoji(S.SOCIAL)))
def t1d_replace_emoji(spark, sf_dir):
    return _digest(social_documents(spark, sf_dir), tx.replace_emoji("social"))


@query("t1_social_normalise_plain", sql=_sql_digest(S.social_plain(S.SOCIAL)))
def t1_social_normalise_plain(spark, sf_dir):
    """T1 with camel split and run cap off (the SQL-expressible part)."""
    c = tx.social_normalise("social", shorten=None, camel_split=False)
    return _digest(social_documents(spark, sf_dir), c)


@query("t1_social_normalise")
def t1_social_normalise(spark, sf_dir):
    """Full T1 (camel split inside tags, runs capped at 3): rows-only check,
    goldens in tests/test_text.py."""
    return _digest(social_documents(spark, sf_dir), tx.social_normalise("social"))


@query("t1e_cap_char_runs")
def t1e_cap_char_runs(spark, sf_dir):
    """Runs of > 3 equal characters cut to 3 (back-references: rows-only)."""
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.cap_char_runs("text"))


@query("t2_newlines_to_period", sql=_sql_digest(S.newlines("text")))
def t2_newlines_to_period(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.newlines_to_period("text"))


@query("t3_collapse_whitespace", sql=_sql_digest(S.collapse_ws(S.newlines("text"))))
def t3_collapse_whitespace(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.collapse_whitespace(tx.newlines_to_period("text")))


@query("t4_tidy", sql=_sql_digest(S.tidy("text")))
def t4_tidy(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.tidy("text"))


@query(
    "t4_strip_only",
    sql=_sql_digest(
        S.rr("text", "^" + tx.PY_WS + "+|" + tx.PY_WS + "+$", "")
    ),
)
def t4_strip_only(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.strip_ws("text"))


@query("t5_emoji_collapse", sql=_sql_digest(S.collapse_emoji(S.social_plain(S.SOCIAL))))
def t5_emoji_collapse(spark, sf_dir):
    c = tx.collapse_emoji_spans(tx.social_normalise("social", shorten=None, camel_split=False))
    return _digest(social_documents(spark, sf_dir), c)


@query("t6_lowercase", sql=_sql_digest("lower(text)"))
def t6_lowercase(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), F.lower("text"))


@query("t7_nfkc")
def t7_nfkc(spark, sf_dir):
    """NFKC via an Arrow UDF (DuckDB has no NFKC): rows-only; goldens in tests."""
    from ..functions.udfs import nfkc

    return _digest(documents(spark, sf_dir, "doc_id", "text"), nfkc("text"))


@query("t8_clean_text", sql=_sql_digest(S.clean("text")))
def t8_clean_text(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.clean_text("text"))


@query("t9_space_cjk", sql=_sql_digest(S.cjk("text")))
def t9_space_cjk(spark, sf_dir):
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.space_cjk("text"))


@query("t10_strip_accents", sql=_sql_digest("strip_accents(text)"))
def t10_strip_accents(spark, sf_dir):
    from ..functions.udfs import strip_accents

    return _digest(documents(spark, sf_dir, "doc_id", "text"), strip_accents("text"))


_NORMALISED = S.social_plain(S.SOCIAL)


@query("t11_t14_rewrap_social_tokens", sql=_sql_digest(S.rewrap(_NORMALISED)))
def t11_t14_rewrap_social_tokens(spark, sf_dir):
    c = tx.social_normalise("social", shorten=None, camel_split=False)
    c = tx.fix_http_url(tx.rewrap_url(tx.rewrap_hashtag(tx.rewrap_user(c))))
    return _digest(social_documents(spark, sf_dir), c)


def _t15(lower: bool, deacc: bool):
    def run(spark, sf_dir):
        c = tx.social_normalise("social", shorten=None, camel_split=False)
        c = tx.tokenizer_normalise(c, lowercase=lower, strip_accents=deacc)
        return _digest(social_documents(spark, sf_dir), c)

    return run


query("t15_normalise_cased", sql=_sql_digest(S.tokenizer_normalise(_NORMALISED)))(_t15(False, False))
query("t15_normalise_uncased", sql=_sql_digest(S.tokenizer_normalise(_NORMALISED, lowercase=True)))(_t15(True, False))
query(
    "t15_normalise_deacc",
    sql=_sql_digest(S.tokenizer_normalise(_NORMALISED, lowercase=True, strip_accents=True)),
)(_t15(True, True))


@query("t15_normalise_full_unicode")
def t15_normalise_full_unicode(spark, sf_dir):
    """Full tokenizer normaliser incl. NFKC (Arrow UDF): rows-only."""
    c = tx.tokenizer_normalise(tx.social_normalise("social"), lowercase=True, strip_accents=True)
    return _digest(social_documents(spark, sf_dir), c)


@query(
    "t16_detokenise",
    sql="""
    SELECT doc_id, md5(h) AS h, CAST(length(h) AS INTEGER) AS n_chars FROM (
      SELECT doc_id, trim(replace(array_to_string(
          list_transform(string_split(""" + S.tidy("text") + """, ' '),
                         lambda w, i: CASE WHEN i % 2 = 1 THEN w || '@@' ELSE w END), ' '), '@@ ', '')) AS h
      FROM documents)
    """,
)
def t16_detokenise(spark, sf_dir):
    """Pieces = tidied words, every other one marked as continued with ``@@``."""
    words = F.split(tx.tidy("text"), " ", -1)
    pieces = F.transform(words, lambda w, i: F.when(i % 2 == 0, F.concat(w, F.lit("@@"))).otherwise(w))
    return _digest(documents(spark, sf_dir, "doc_id", "text"), tx.detokenise(pieces))


@query(
    "t18_alphabet",
    sql="SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents",
)
def t18_alphabet(spark, sf_dir):
    """Sorted distinct characters (partial distinct per task, then final)."""
    d = documents(spark, sf_dir, "text")
    return d.select(F.explode(tx.characters("text")).alias("ch")).distinct().orderBy("ch")


def _lines(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "lang", "text")
    return d.select("doc_id", "lang", F.explode(F.split("text", "\n", -1)).alias("value"))


_LINES_SQL = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS value FROM documents"


@query(
    "s2_skip_empty_lines",
    sql=f"SELECT lang, count(*) AS n_lines FROM ({_LINES_SQL}) WHERE length(value) > 0 GROUP BY lang",
)
def s2_skip_empty_lines(spark, sf_dir):
    from ..sources.text import non_empty

    return non_empty(_lines(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "s3_skip_blank_lines",
    sql=f"SELECT lang, count(*) AS n_lines FROM ({_LINES_SQL}) WHERE {S.rr('value', tx.PY_WS, '')} <> '' GROUP BY lang",
)
def s3_skip_blank_lines(spark, sf_dir):
    from ..sources.text import non_blank

    return non_blank(_lines(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"))
