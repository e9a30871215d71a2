"""Cleaning steps on texts in which each of them has work to do (S2, S3, T1d, T4, T8, T9, T14, T15, J1, T17).

The given texts hold no empty lines, control characters, ideographs or emoji
sequences, so a fixed frame of them is put around every text; the steps run over
the whole result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..operators import encode as en
from ..operators import wordpiece as wp
from ..session import table
from ..sources.tables import documents
from . import sqltext as S
from .registry import query
from .text_queries import _digest, _sql_digest
from .wordpiece_queries import _SOCIAL_TEXT, _segment_sql, small_vocabulary, social_texts

HEAD = "　\t \x0b"
TAIL = "\n\n  \n 　\nx​\x07y­ 中文字z 한 http://url fin ﬁn Ａ﹖ url, @usuario.\n \x1c"
EMOJI_TAIL = (
    " \U0001F1E6\U0001F1F7\U0001F1EB\U0001F1F7 1️⃣#⃣ \U0001F44D\U0001F3FD\U0001F937\U0001F3FB‍♀️ \U0001F469‍\U0001F4BB"
    " \U0001F468‍\U0001F469‍\U0001F467x❤️‍\U0001F525 ☀️ \U0001F3F4\U000E0067\U000E0062\U000E0065\U000E006E\U000E0067\U000E007F"
)
# NFKC of the compatibility characters above
_COMPAT = {"ﬁ": "fi", "Ａ": "A", "﹖": "?", " ": " ", " ": " ", "　": " "}

_NOISY = f"({S.q(HEAD)} || text || {S.q(TAIL)})"
_EMOJI = f"(text || {S.q(EMOJI_TAIL)})"
_LINES = f"SELECT lang, unnest(string_split({_NOISY}, chr(10))) AS value FROM documents"


def noisy(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "lang", "text").withColumn("noisy", F.concat(F.lit(HEAD), "text", F.lit(TAIL)))


def _noisy_lines(spark, sf_dir) -> DataFrame:
    return noisy(spark, sf_dir).select("lang", F.explode(F.split("noisy", "\n", -1)).alias("value"))


@query("s2_skip_empty_lines_noisy", sql=f"SELECT lang, count(*) AS n_lines FROM ({_LINES}) WHERE length(value) > 0 GROUP BY lang")
def s2_skip_empty_lines_noisy(spark, sf_dir):
    """Lines of texts with one empty line each."""
    from ..sources.text import non_empty

    return non_empty(_noisy_lines(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"))


@query("s3_skip_blank_lines_noisy", sql=f"SELECT lang, count(*) AS n_lines FROM ({_LINES}) WHERE {S.rr('value', tx.PY_WS, '')} <> '' GROUP BY lang")
def s3_skip_blank_lines_noisy(spark, sf_dir):
    """Lines of texts with an empty line and lines of white space."""
    from ..sources.text import non_blank

    return non_blank(_noisy_lines(spark, sf_dir)).groupBy("lang").agg(F.count(F.lit(1)).alias("n_lines"))


@query("t4_strip_noisy", sql=_sql_digest(S.rr(_NOISY, "^" + tx.PY_WS + "+|" + tx.PY_WS + "+$", "")))
def t4_strip_noisy(spark, sf_dir):
    """White space of every kind at both ends."""
    return _digest(noisy(spark, sf_dir), tx.strip_ws("noisy"))


@query("t8_clean_text_noisy", sql=_sql_digest(S.clean(_NOISY)))
def t8_clean_text_noisy(spark, sf_dir):
    """Control, format and private characters, and separators of every kind."""
    return _digest(noisy(spark, sf_dir), tx.clean_text("noisy"))


@query("t9_space_cjk_noisy", sql=_sql_digest(S.cjk(_NOISY)))
def t9_space_cjk_noisy(spark, sf_dir):
    """Ideographs spaced; Hangul left alone."""
    return _digest(noisy(spark, sf_dir), tx.space_cjk("noisy"))


@query("t14_http_url_noisy", sql=_sql_digest(S.rewrap(_NOISY)))
def t14_http_url_noisy(spark, sf_dir):
    """T11 to T14 where all four rules match."""
    return _digest(noisy(spark, sf_dir), tx.fix_http_url(tx.rewrap_url(tx.rewrap_hashtag(tx.rewrap_user("noisy")))))


def _nfkc_sql(x: str) -> str:
    for a, b in _COMPAT.items():
        x = S.rep(x, a, b)
    return x


@query("t15_normalise_noisy", sql=_sql_digest(S.tokenizer_normalise(_nfkc_sql(_NOISY), lowercase=True)))
def t15_normalise_noisy(spark, sf_dir):
    """The whole tokenizer normaliser where its NFKC step changes every text."""
    return _digest(noisy(spark, sf_dir), tx.tokenizer_normalise("noisy", lowercase=True))


@query("t1d_emoji_sequences", sql=_sql_digest(S.emoji(_EMOJI)))
def t1d_emoji_sequences(spark, sf_dir):
    """Flags, keycaps, skin tones, joined sequences, variation selectors and tag letters."""
    d = documents(spark, sf_dir, "doc_id", "text").withColumn("e", F.concat("text", F.lit(EMOJI_TAIL)))
    return _digest(d, tx.replace_emoji("e"))


@query(
    "j1_gold_join_two_keys",
    sql="""SELECT d.lang, d.doc_id, g.toxic AS is_toxic FROM documents d JOIN
    (SELECT x.lang, l.doc_id, CASE WHEN x.lang = t.lang THEN l.toxic ELSE 1 - l.toxic END AS toxic
     FROM labels l JOIN documents t USING (doc_id), (SELECT DISTINCT lang FROM documents) x) g ON g.lang = d.lang AND g.doc_id = d.doc_id""",
)
def j1_gold_join_two_keys(spark, sf_dir):
    """Gold labels by (lang, id); the gold set holds every id once for each language, with another label."""
    docs = documents(spark, sf_dir, "doc_id", "lang")
    langs = docs.select(F.col("lang").alias("other")).distinct()  # one row a language
    own = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id")
    gold = own.crossJoin(F.broadcast(langs)).select(F.col("other").alias("lang"), "doc_id", F.when(F.col("lang") == F.col("other"), F.col("toxic")).otherwise(1 - F.col("toxic")).alias("is_toxic"))
    return docs.join(gold, ["lang", "doc_id"])


@query(
    "t17_wordpiece_decode",
    sql=f"""WITH RECURSIVE {_segment_sql(_SOCIAL_TEXT)}
    SELECT t.doc_id, coalesce(string_agg(replace(s.pieces, ' ##', ''), ' ' ORDER BY f.at), '') AS text
    FROM tokens t LEFT JOIN flat f ON f.doc_id = t.doc_id LEFT JOIN spelt s ON s.w = f.w GROUP BY t.doc_id""",
)
def t17_wordpiece_decode(spark, sf_dir):
    """Ids of subword pieces back to text: looked up, joined, continuations closed up."""
    vocab = small_vocabulary(spark, sf_dir)
    vocab = spark.createDataFrame(vocab.collect(), vocab.schema)  # at most 790 rows
    coded = social_texts(spark, sf_dir).select("doc_id", wp.encoder(vocab, K.SOCIAL_TOKENS)("text").alias("e"))
    ids = coded.select("doc_id", F.transform("e.ids", lambda i: i).alias("ids"))
    whole = en.add_missing_tokens(vocab, K.SOCIAL_TOKENS)
    tokens = en.lookup_tokens(ids, "doc_id", "ids", whole, "tokens", wp.UNK)
    return tokens.select("doc_id", F.replace(F.array_join("tokens", " "), F.lit(" ##"), F.lit("")).alias("text"))
