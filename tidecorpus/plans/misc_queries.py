"""Remaining §2 rows under their own IDs: S4, T12, T13, E23, J5, J6, L3, L4,
U1–U3, D5 – each over the driver tables, each with its DuckDB twin."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..operators import encode as en
from ..operators import splits as sp
from ..session import ensure_checkpoint_dir, table
from ..sources.tables import documents, social_documents
from . import sqltext as S
from .array_queries import _TOK_CTE, _VOC_CTE, encoded, tokens, word_vocab
from .registry import query
from .result_queries import MODELS, TASK_BANDS, ledger
from .text_queries import _digest, _sql_digest

_NORMALISED = S.social_plain(S.SOCIAL)


@query("t12_rewrap_hashtag", sql=_sql_digest(S.rep(_NORMALISED, "hashtag", " hashtag ")))
def t12_rewrap_hashtag(spark, sf_dir):
    c = tx.rewrap_hashtag(tx.social_normalise("social", shorten=None, camel_split=False))
    return _digest(social_documents(spark, sf_dir), c)


@query("t13_rewrap_url", sql=_sql_digest(S.rr(_NORMALISED, "(" + tx.NON_WORD + ")url(" + tx.NON_WORD + ")", " url ")))
def t13_rewrap_url(spark, sf_dir):
    c = tx.rewrap_url(tx.social_normalise("social", shorten=None, camel_split=False))
    return _digest(social_documents(spark, sf_dir), c)


_ENC_SQL = f"""WITH {_TOK_CTE},\n{_VOC_CTE},
ex AS (SELECT doc_id, unnest(generate_series(1, len(tokens[1:126]))) AS pos, unnest(tokens[1:126]) AS tok FROM tok),
g AS (SELECT e.doc_id, list(coalesce(v.id, 3) ORDER BY e.pos) AS body FROM ex e LEFT JOIN voc v ON e.tok = v.token GROUP BY e.doc_id),
inp AS (SELECT t.doc_id, [0] || coalesce(g.body, []::INTEGER[]) || [2] AS input_ids FROM tok t LEFT JOIN g USING (doc_id))
"""


@query(
    "e23_model_columns",
    sql=_ENC_SQL + """SELECT doc_id, array_to_string(input_ids, ',') AS input_ids,
        array_to_string(list_transform(input_ids, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END), ',') AS attention_mask FROM inp""",
)
def e23_model_columns(spark, sf_dir):
    """Model-facing columns only; ``token_type_ids`` is absent here, so it is not selected."""
    e = encoded(spark, sf_dir).withColumn("attention_mask", en.attention_mask("input_ids"))
    m = en.model_columns(e, ("doc_id", "input_ids", "attention_mask", "token_type_ids", "labels"))
    return m.select("doc_id", *[F.array_join(c, ",").alias(c) for c in m.columns if c != "doc_id"])


@query(
    "j6_first_token_lookup",
    sql=f"""WITH {_TOK_CTE},\n{_VOC_CTE}
    SELECT t.doc_id, coalesce(v.id, 3) AS first_id FROM tok t LEFT JOIN voc v ON v.token = t.tokens[1] WHERE len(t.tokens) > 0""",
)
def j6_first_token_lookup(spark, sf_dir):
    """Dictionary lookup join: each document's first token → id (unknown → ``<unk>``)."""
    t = tokens(spark, sf_dir).filter(F.size("tokens") > 0).select("doc_id", F.col("tokens")[0].alias("token"))
    v = F.broadcast(word_vocab(spark, sf_dir))  # ≤ vocab_size rows
    return t.join(v, "token", "left").select("doc_id", F.coalesce("id", F.lit(K.UNK_ID)).alias("first_id"))


@query(
    "j5_run_grid",
    sql=f"""WITH m AS (SELECT DISTINCT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODELS.items())} END AS model FROM events)
    SELECT m.model, t.task, r.run::INTEGER AS run, (2021 + r.run)::INTEGER AS seed
    FROM m, (VALUES {", ".join(f"('{t}')" for t in TASK_BANDS)}) t(task), range(3) r(run)""",
)
def j5_run_grid(spark, sf_dir):
    """models × tasks × runs (seed 2021 + run), by in-place explodes – no join."""
    models = ledger(spark, sf_dir).select("model").distinct()
    g = models.select("model", F.explode(F.array(*[F.lit(t) for t in TASK_BANDS])).alias("task"))
    g = g.select("model", "task", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    return g.select("model", "task", F.col("run").cast("int"), (F.lit(K.RUN_SEED_BASE) + F.col("run")).cast("int").alias("seed"))


@query("l3_first_n_guarded", sql="SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def l3_first_n_guarded(spark, sf_dir):
    """First min(100, len) rows in id order (the limit is the operator)."""
    return sp.first_n(documents(spark, sf_dir, "doc_id"), ["doc_id"], 100)


@query("l4_first_n_strict", sql="SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def l4_first_n_strict(spark, sf_dir):
    """First 100 rows; fewer rows than asked would be an error."""
    return sp.first_n(documents(spark, sf_dir, "doc_id"), ["doc_id"], 100, strict=True)


@query(
    "u1_union_by_name",
    sql="SELECT doc_id, toxic, NULL::VARCHAR AS lang FROM labels UNION ALL BY NAME SELECT doc_id, NULL::INTEGER AS toxic, lang FROM documents",
)
def u1_union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    b = documents(spark, sf_dir, "doc_id", "lang")
    return a.unionByName(b, allowMissingColumns=True)


_BENCH_WORDS = "SELECT DISTINCT unnest(string_split(" + S.tidy("lower(text)") + ", ' ')) AS token FROM benchmark"
_DOC_WORDS = "SELECT DISTINCT unnest(string_split(" + S.tidy("lower(text)") + ", ' ')) AS token FROM documents"


@query("u2_token_set_difference", sql=f"{_BENCH_WORDS} EXCEPT {_DOC_WORDS}")
def u2_token_set_difference(spark, sf_dir):
    """Words of ``benchmark`` that never occur in ``documents`` (set difference)."""
    bench = table(spark, sf_dir, "benchmark").select(F.explode(en.word_tokens("text")).alias("token"))
    docs = documents(spark, sf_dir, "text").select(F.explode(en.word_tokens("text")).alias("token"))
    return bench.subtract(docs)


_MERGED = K.SEQUENCE_SPECIALS + K.SOCIAL_TOKENS
_MERGED_SQL = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(_MERGED)) + ") s(token, id)"


@query(
    "u3_merged_special_lists",
    sql=f"""WITH {_TOK_CTE},
    cnt AS (SELECT t AS token, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM tok) GROUP BY t),
    top AS (SELECT token, n FROM cnt WHERE token NOT IN (SELECT token FROM {_MERGED_SQL}) ORDER BY n DESC, token ASC LIMIT {100 - len(_MERGED)})
    SELECT token, id FROM {_MERGED_SQL} UNION ALL
    SELECT token, (row_number() OVER (ORDER BY n DESC, token ASC) - 1 + {len(_MERGED)})::INTEGER FROM top""",
)
def u3_merged_special_lists(spark, sf_dir):
    """Vocabulary of 100 whose specials are the merged lists (sequence specials,
    then social tokens, order kept), followed by the most frequent words."""
    return en.build_word_vocab(tokens(spark, sf_dir), "tokens", 100, _MERGED)


@query(
    "d5_presplit_sets",
    sql="SELECT 'train' AS split, count(*) AS n FROM documents UNION ALL SELECT 'test' AS split, count(*) AS n FROM benchmark",
)
def d5_presplit_sets(spark, sf_dir):
    """Sets given as separate inputs keep their split: documents = train, benchmark = test."""
    tr = documents(spark, sf_dir, "text").select("text", F.lit("train").alias("split"))
    te = table(spark, sf_dir, "benchmark").select("text", F.lit("test").alias("split"))
    return tr.unionByName(te).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s4_named_splits",
    sql=f"""WITH f AS (SELECT source, row_number() OVER (ORDER BY source DESC) AS r FROM (SELECT DISTINCT source FROM documents))
    SELECT CASE WHEN f.r = 1 THEN 'test' ELSE 'train' END AS split, CAST(sum(len(string_split(d.text, chr(10)))) AS BIGINT) AS n_lines
    FROM documents d LEFT JOIN f USING (source) GROUP BY 1""",
)
def s4_named_splits(spark, sf_dir):
    """documents written as one text folder per source; the last source in sorted
    order is read as the test split, the others as train (one scan of the partitioned folder)."""
    d = documents(spark, sf_dir, "source", "text")
    base = os.path.join(ensure_checkpoint_dir(spark), "sinks", f"lines-{uuid.uuid4().hex}")
    d.write.mode("overwrite").partitionBy("source").text(base)
    last = F.broadcast(d.agg(F.max("source").alias("last")))  # one row
    lines = spark.read.schema("value string, source string").text(base)  # lines without a source are in the train split
    splits = lines.crossJoin(last).select(F.when(F.col("source") == F.col("last"), "test").otherwise("train").alias("split"))
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n_lines"))
