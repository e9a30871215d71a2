"""Vocabulary queries (E1a–E1d, E4, S12, P13, P14, L7, T18): subword training on
``documents`` and, small, on ``part.p_name``, and the word vocabulary of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import encode as en
from ..operators import vocab as vb
from ..session import stored, table
from ..sources.tables import documents, social_documents
from ..functions import text as tx
from . import sqltext as S
from .array_queries import _TOK_CTE, _VOC_CTE, VOCAB, word_vocab
from .registry import query

ALPHA_LIMIT = 20
BPE_MERGES = 30
DOCUMENT_MERGES = 1000

_WC_SQL = "wc AS (SELECT '▁' || w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE length(p_name) > 0) GROUP BY 1)"


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name")


@query("e1a_word_counts", sql=f"WITH {_WC_SQL} SELECT word, n FROM wc")
def e1a_word_counts(spark, sf_dir):
    return vb.word_counts(_names(spark, sf_dir), "p_name")


_ALPHA_SQL = f"""{_WC_SQL},
cc AS (SELECT ch, sum(n) AS n FROM (SELECT unnest(string_split(word, '')) AS ch, n FROM wc) GROUP BY ch),
al AS (SELECT ch FROM cc ORDER BY n DESC, ch ASC LIMIT {ALPHA_LIMIT})"""


@query(
    "e1b_alphabet",
    sql=f"WITH {_ALPHA_SQL} SELECT ch AS token, (row_number() OVER (ORDER BY ch) - 1 + 5)::INTEGER AS id FROM al",
)
def e1b_alphabet(spark, sf_dir):
    return vb.alphabet(vb.word_counts(_names(spark, sf_dir), "p_name"), ALPHA_LIMIT)


@query(
    "e1c_pair_counts",
    sql=f"""WITH {_ALPHA_SQL},
    kc AS (SELECT list_filter(string_split(word, ''), lambda c: list_contains(a.l, c)) AS c, n FROM wc, (SELECT list(ch) AS l FROM al) a),
    pr AS (SELECT unnest(list_transform(range(1, len(c)), lambda i: struct_pack(l := c[i], r := c[i + 1]))) AS p, n FROM kc WHERE len(c) > 1)
    SELECT p.l AS left, p.r AS right, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY 1, 2""",
)
def e1c_pair_counts(spark, sf_dir):
    words = vb.word_counts(_names(spark, sf_dir), "p_name")
    return vb.initial_pair_counts(words, vb.alphabet(words, ALPHA_LIMIT))


def _part_model(spark, sf_dir):
    return vb.train_bpe(_names(spark, sf_dir), "p_name", vocab_size=5 + ALPHA_LIMIT + BPE_MERGES, min_frequency=2, limit_alphabet=ALPHA_LIMIT)


@query("e1d_part_bpe_merges")
def e1d_part_bpe_merges(spark, sf_dir):
    """Merges of the 16 words of part names: rows-only; tie rules tested in tests/test_batching_vocab.py."""
    return _part_model(spark, sf_dir).merges


@query("e1_e2_part_bpe_vocabulary")
def e1_e2_part_bpe_vocabulary(spark, sf_dir):
    """Specials, alphabet (code-point order), then merged tokens in merge order, of part names."""
    return _part_model(spark, sf_dir).vocab


@query("e4_part_bpe_encode")
def e4_part_bpe_encode(spark, sf_dir):
    """Subword pieces of every part name with the merges of part names (Arrow UDF, rows-only)."""
    model = _part_model(spark, sf_dir)
    enc = vb.bpe_encoder(spark, model)
    pieces = _names(spark, sf_dir).select("p_partkey", enc("p_name").alias("pieces"))
    ids = en.lookup_ids(pieces, "p_partkey", "pieces", model.vocab, "ids").join(pieces, "p_partkey")
    return ids.select("p_partkey", F.array_join("pieces", " ").alias("pieces"), F.array_join("ids", ",").alias("ids"))


_DOC_WC_SQL = "wc AS (SELECT '▁' || w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents WHERE length(text) > 0) GROUP BY 1)"
_DOC_ALPHA_SQL = f"""{_DOC_WC_SQL},
cc AS (SELECT ch, sum(n) AS n FROM (SELECT unnest(string_split(word, '')) AS ch, n FROM wc) GROUP BY ch),
al AS (SELECT ch FROM cc ORDER BY n DESC, ch ASC LIMIT {K.LIMIT_ALPHABET})"""


@query("e1a_document_word_counts", sql=f"WITH {_DOC_WC_SQL} SELECT word, n FROM wc")
def e1a_document_word_counts(spark, sf_dir):
    return vb.word_counts(documents(spark, sf_dir, "text"), "text")


@query(
    "e1b_document_alphabet",
    sql=f"WITH {_DOC_ALPHA_SQL} SELECT ch AS token, (row_number() OVER (ORDER BY ch) - 1 + 5)::INTEGER AS id FROM al",
)
def e1b_document_alphabet(spark, sf_dir):
    return vb.alphabet(vb.word_counts(documents(spark, sf_dir, "text"), "text"), K.LIMIT_ALPHABET)


@query(
    "e1c_document_pair_counts",
    sql=f"""WITH {_DOC_ALPHA_SQL},
    kc AS (SELECT list_filter(string_split(word, ''), lambda c: list_contains(a.l, c)) AS c, n FROM wc, (SELECT list(ch) AS l FROM al) a),
    pr AS (SELECT unnest(list_transform(range(1, len(c)), lambda i: struct_pack(l := c[i], r := c[i + 1]))) AS p, n FROM kc WHERE len(c) > 1)
    SELECT p.l AS left, p.r AS right, CAST(sum(n) AS BIGINT) AS n FROM pr GROUP BY 1, 2""",
)
def e1c_document_pair_counts(spark, sf_dir):
    words = stored(vb.word_counts(documents(spark, sf_dir, "text"), "text"))  # texts are split and counted once
    return vb.initial_pair_counts(words, vb.alphabet(words, K.LIMIT_ALPHABET))


def _model(spark, sf_dir):
    return vb.train_bpe(documents(spark, sf_dir, "text"), "text", vocab_size=len(K.SEQUENCE_SPECIALS) + K.LIMIT_ALPHABET + DOCUMENT_MERGES)


@query("e1d_bpe_merges")
def e1d_bpe_merges(spark, sf_dir):
    """At least 1,000 merges of the documents' whole texts (more where the alphabet is below its limit): rows-only,
    tested against a trainer that merges one pair at a time."""
    return _model(spark, sf_dir).merges


@query("e1_e2_bpe_vocabulary")
def e1_e2_bpe_vocabulary(spark, sf_dir):
    """Specials, alphabet (code-point order), then merged tokens in merge order."""
    return _model(spark, sf_dir).vocab


@query("e4_bpe_encode")
def e4_bpe_encode(spark, sf_dir):
    """Subword pieces and ids of every document with the trained merges (Arrow UDF without a shuffle, rows-only)."""
    enc = vb.bpe_pair_encoder(spark, _model(spark, sf_dir))
    coded = documents(spark, sf_dir, "doc_id", "text").select("doc_id", enc("text").alias("e"))
    return coded.select("doc_id", F.array_join("e.pieces", " ").alias("pieces"), F.array_join(F.col("e.ids").cast("array<string>"), ",").alias("ids"))


@query(
    "s12_vocab_dump",
    sql=f"WITH {_TOK_CTE},\n{_VOC_CTE}\nSELECT printf('%-6d --- %s', id, token) AS line FROM voc",
)
def s12_vocab_dump(spark, sf_dir):
    return vb.vocab_lines(word_vocab(spark, sf_dir))


_SOCIAL_TOK = S.tidy("lower(" + S.social_plain(S.SOCIAL) + ")")
_SOCIAL_VOC = (
    f"tok AS (SELECT doc_id, string_split({_SOCIAL_TOK}, ' ') AS tokens FROM documents),\n"
    + _VOC_CTE
)


@query(
    "p13_social_token_entries",
    sql=f"""WITH {_SOCIAL_VOC}
    SELECT token, id FROM voc WHERE {" OR ".join(f"contains(token, '{t}')" for t in K.SOCIAL_TOKENS)}""",
)
def p13_social_token_entries(spark, sf_dir):
    d = social_documents(spark, sf_dir)
    toks = d.select("doc_id", en.word_tokens(tx.social_normalise("social", shorten=None, camel_split=False)).alias("tokens"))
    return vb.with_social_tokens(en.build_word_vocab(toks, "tokens", VOCAB))


@query(
    "p14_exclude_ids",
    sql=f"WITH {_TOK_CTE},\n{_VOC_CTE}\nSELECT token, id FROM voc WHERE id NOT IN (335, 1388, 1999)",
)
def p14_exclude_ids(spark, sf_dir):
    return vb.exclude_ids(word_vocab(spark, sf_dir), [335, 1388, 1999])


@query("l7_first_ids", sql=f"WITH {_TOK_CTE},\n{_VOC_CTE}\nSELECT token, id FROM voc ORDER BY id LIMIT 20")
def l7_first_ids(spark, sf_dir):
    return vb.first_ids(word_vocab(spark, sf_dir), 20)


@query(
    "t18_vocab_alphabet",
    sql=f"WITH {_TOK_CTE},\n{_VOC_CTE}\nSELECT DISTINCT unnest(string_split(token, '')) AS ch FROM voc",
)
def t18_vocab_alphabet(spark, sf_dir):
    return vb.vocab_alphabet(word_vocab(spark, sf_dir))
