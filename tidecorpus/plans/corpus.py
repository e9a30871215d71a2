"""Corpus filter (P10, P11, A13, A14, A22) – the minimum end-to-end slice.

documents → tidy (T2–T4) → collapse emoji spans (T5) → token length (E14,
truncated at 128) → keep ``>= 6``. One stage, no shuffle until the final
per-language aggregate (partial + final hash aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..sources.tables import documents
from .registry import query

# the same token length in DuckDB SQL (whitespace tokenizer, capped at 126)
_TIDY_SQL = "trim(regexp_replace(regexp_replace(text, '\\n+', '. ', 'g'), '[\\x09-\\x0D\\x1C-\\x1F\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
_COLLAPSED_SQL = f"regexp_replace({_TIDY_SQL}, 'emoji.*?emoji', 'emoji', 'g')"
TOKEN_LEN_SQL = f"CAST(least(CASE WHEN length({_COLLAPSED_SQL}) = 0 THEN 0 ELSE len(string_split({_COLLAPSED_SQL}, ' ')) END, 126) AS INTEGER)"


def token_lengths(spark: SparkSession, sf_dir: str, basic: bool = False) -> DataFrame:
    """doc_id, lang, token_len of the tidied, emoji-collapsed text."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    collapsed = tx.collapse_emoji_spans(tx.tidy("text"))
    return docs.select("doc_id", "lang", tx.token_len(collapsed, basic=basic).alias("token_len"))


def filter_corpus(df: DataFrame, text_col: str = "text", min_tokens: int = K.MIN_TOKENS, basic: bool = False) -> DataFrame:
    """P10 as a reusable transformation: keep rows whose token length ≥ min_tokens.

    The original text is kept; only the length is computed on the cleaned form.
    """
    length = tx.token_len(tx.collapse_emoji_spans(tx.tidy(text_col)), basic=basic)
    return df.filter(length >= min_tokens)


@query(
    "p10_min_length_filter",
    sql=f"""
    SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE {TOKEN_LEN_SQL} >= 6) AS n_kept
    FROM documents GROUP BY lang
    """,
    bench=True,
)
def p10_min_length_filter(spark, sf_dir):
    t = token_lengths(spark, sf_dir)
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("token_len") >= K.MIN_TOKENS).alias("n_kept"),
    )


_BASIC_SQL = (
    "least(len(regexp_extract_all(regexp_replace(" + _TIDY_SQL + ", 'emoji.*?emoji', 'emoji', 'g'), "
    "'[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\x09-\\x0D\\x1C-\\x1F\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')), 126)"
)


@query(
    "p10_min_length_filter_basic",
    sql=f"""
    SELECT lang, count(*) AS n_rows, count(*) FILTER (WHERE {_BASIC_SQL} >= 6) AS n_kept
    FROM documents GROUP BY lang
    """,
)
def p10_min_length_filter_basic(spark, sf_dir):
    t = token_lengths(spark, sf_dir, basic=True)
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("token_len") >= K.MIN_TOKENS).alias("n_kept"),
    )


@query(
    "p10_kept_documents",
    sql=f"SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE {TOKEN_LEN_SQL} >= 6",
)
def p10_kept_documents(spark, sf_dir):
    """The kept rows themselves (original text kept; its length reported)."""
    kept = filter_corpus(documents(spark, sf_dir, "doc_id", "lang", "text"))
    return kept.select("doc_id", "lang", F.length("text").alias("n_chars"))


@query(
    "p11_short_and_border",
    sql=f"""
    SELECT lang, count(*) FILTER (WHERE {TOKEN_LEN_SQL} <= 5) AS n_junk,
           count(*) FILTER (WHERE {TOKEN_LEN_SQL} = 6) AS n_border
    FROM documents GROUP BY lang
    """,
)
def p11_short_and_border(spark, sf_dir):
    t = token_lengths(spark, sf_dir)
    return t.groupBy("lang").agg(
        F.count_if(F.col("token_len") <= 5).alias("n_junk"),
        F.count_if(F.col("token_len") == 6).alias("n_border"),
    )


@query(
    "a13_share_under_predicate",
    sql=f"""
    SELECT lang, round(avg(CASE WHEN {TOKEN_LEN_SQL} <= 5 THEN 1.0 ELSE 0.0 END), 6) AS junk_share
    FROM documents GROUP BY lang
    """,
)
def a13_share_under_predicate(spark, sf_dir):
    t = token_lengths(spark, sf_dir)
    return t.groupBy("lang").agg(F.round(F.avg((F.col("token_len") <= 5).cast("double")), 6).alias("junk_share"))


@query(
    "a14_length_histogram",
    sql=f"""
    WITH l AS (SELECT {TOKEN_LEN_SQL} AS x FROM documents),
    b AS (SELECT least(floor(x), 39)::BIGINT AS bin, count(*) AS n FROM l WHERE x >= 0 AND x <= 40 GROUP BY 1)
    SELECT r.range AS bin, coalesce(b.n, 0) AS n FROM range(40) r LEFT JOIN b ON b.bin = r.range
    """,
)
def a14_length_histogram(spark, sf_dir):
    """40 bins on [0, 40], last bin closed, values outside dropped, empty bins kept."""
    from ..operators.stats import histogram

    return histogram(token_lengths(spark, sf_dir), "token_len", lo=0, hi=40, bins=40)


@query(
    "a22_row_counts",
    sql=f"""
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE {TOKEN_LEN_SQL} >= 6) AS n_kept FROM documents
    """,
)
def a22_row_counts(spark, sf_dir):
    t = token_lengths(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("token_len") >= K.MIN_TOKENS).alias("n_kept"))
