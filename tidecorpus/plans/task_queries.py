"""Labelled-set queries on ``labels ⋈ documents``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import EMOTION_LABELS
from ..operators import splits as sp
from ..operators import tasks as tk
from ..operators.indexing import portable_hash_sql
from ..functions import text as tx
from ..session import table
from ..sources.tables import documents, labelled_documents
from . import sqltext as S
from .registry import query

LANGS = ["de", "en", "es", "fr"]  # label dimension used for the lang → id examples
_LANG_DIM_SQL = "(SELECT * FROM (VALUES (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr')) v(label, name))"
_LABELLED_SQL = "(SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


@query(
    "p1_typed_select",
    sql=f"SELECT CAST(doc_id AS BIGINT) AS id, md5(text) AS h, CAST(toxic AS INTEGER) AS label FROM {_LABELLED_SQL}",
)
def p1_typed_select(spark, sf_dir):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.IntegerType())]
    )
    t = tk.select_schema(labelled_documents(spark, sf_dir), schema)
    return t.select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), F.col("toxic").alias("label"))


@query(
    "p2_label_domain",
    sql=f"""SELECT count(*) FILTER (WHERE q + t BETWEEN 0 AND 1) AS n_valid,
                   count(*) FILTER (WHERE NOT (q + t BETWEEN 0 AND 1)) AS n_rejected
            FROM (SELECT quality AS q, toxic AS t FROM {_LABELLED_SQL})""",
)
def p2_label_domain(spark, sf_dir):
    """Label = quality + toxic checked against the domain {0, 1}; both counts come from one pass."""
    t = labelled_documents(spark, sf_dir).withColumn("label", F.col("quality") + F.col("toxic"))
    ok = tk.label_ok("label", 2)
    return t.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_rejected"))


@query("p3_rename", sql="SELECT doc_id AS id, toxic AS is_toxic, quality AS is_quality FROM labels")
def p3_rename(spark, sf_dir):
    return tk.rename(table(spark, sf_dir, "labels"), {"doc_id": "id", "toxic": "is_toxic", "quality": "is_quality"})


@query("p4_constant_columns", sql="SELECT doc_id, toxic, 'toxic' AS task, 'es' AS lang FROM labels")
def p4_constant_columns(spark, sf_dir):
    return tk.add_constants(table(spark, sf_dir, "labels").select("doc_id", "toxic"), {"task": "toxic", "lang": "es"})


@query("p5_drop_column", sql="SELECT doc_id, toxic FROM labels")
def p5_drop_column(spark, sf_dir):
    return table(spark, sf_dir, "labels").drop("quality")


def _d1_sql(seed: int = 0, size: float = 0.25, label: str = "toxic") -> str:
    h = portable_hash_sql("doc_id", seed)
    return f"""
    WITH t AS (SELECT doc_id, {label} AS label FROM {_LABELLED_SQL}),
    c AS (SELECT label, count(*) AS n FROM t GROUP BY label),
    q0 AS (SELECT label, floor(n * {size}) AS base, n * {size} - floor(n * {size}) AS rem,
                  ceil(sum(n) OVER () * {size}) AS target FROM c),
    q1 AS (SELECT label, base, target - sum(base) OVER () AS lft,
                  row_number() OVER (ORDER BY rem DESC, label ASC) AS r FROM q0),
    q AS (SELECT label, base + CASE WHEN r <= lft THEN 1 ELSE 0 END AS quota FROM q1),
    r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {h}, doc_id) - 1 AS rk FROM t)
    SELECT doc_id, label, CASE WHEN rk < quota THEN 'dev' ELSE 'train' END AS split FROM r JOIN q USING (label)
    """


def _d1(spark, sf_dir):
    t = labelled_documents(spark, sf_dir).select("doc_id", F.col("toxic").alias("label"))
    return sp.stratified_split(t, "label", "doc_id", 0.25, 0)


@query("d1_stratified_split", sql=_d1_sql())
def d1_stratified_split(spark, sf_dir):
    return _d1(spark, sf_dir).select("doc_id", "label", "split")


@query("p6_filter_split", sql=f"SELECT doc_id FROM ({_d1_sql()}) WHERE split = 'dev'")
def p6_filter_split(spark, sf_dir):
    return _d1(spark, sf_dir).filter(F.col("split") == "dev").select("doc_id")


@query(
    "a1_split_value_counts",
    sql=f"SELECT split, label, count(*) AS n FROM ({_d1_sql()}) GROUP BY split, label",
)
def a1_split_value_counts(spark, sf_dir):
    return _d1(spark, sf_dir).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(
    "p7_label_encode",
    sql=f"SELECT d.doc_id, m.label FROM documents d JOIN {_LANG_DIM_SQL} m ON d.lang = m.name",
)
def p7_label_encode(spark, sf_dir):
    dim = tk.label_dim(spark, LANGS)
    return tk.encode_labels(documents(spark, sf_dir, "doc_id", "lang"), dim, "lang").select("doc_id", "label")


@query("p8_flag_label", sql="SELECT doc_id, CAST(toxic AS INTEGER) AS label FROM labels")
def p8_flag_label(spark, sf_dir):
    return tk.flag_label(table(spark, sf_dir, "labels"), "toxic").select("doc_id", "label")


@query(
    "p9_label_decode",
    sql=f"""SELECT e.vec_id, m.name AS label_name FROM embeddings e
            LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(EMOTION_LABELS))}) v(label, name)) m
            ON e.label = m.label""",
)
def p9_label_decode(spark, sf_dir):
    """Emotion ids → names (ids 7–9 of the stand-in table have no name → null)."""
    dim = tk.label_dim(spark, EMOTION_LABELS)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return tk.decode_labels(emb, dim).select("vec_id", "label_name")


@query(
    "j1_gold_join",
    sql="SELECT d.doc_id, d.lang, g.toxic AS is_toxic FROM documents d JOIN (SELECT doc_id, toxic FROM labels) g USING (doc_id)",
)
def j1_gold_join(spark, sf_dir):
    """Test rows ⋈ gold labels, gold side pruned to two columns."""
    gold = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("is_toxic"))
    return documents(spark, sf_dir, "doc_id", "lang").join(gold, "doc_id", "inner")


@query(
    "a4_balanced_weight",
    sql="SELECT toxic AS label, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY toxic",
)
def a4_balanced_weight(spark, sf_dir):
    dim = tk.label_dim(spark, ["no", "yes"])
    w = tk.balanced_weights(table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label"), "label", dim)
    return w.select("label", F.round("weight", 6).alias("weight"))


_CAT = [f"c{i}" for i in range(9)]
_CAT_SQL = ", ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN 1 ELSE 0 END AS c{i}" for i in range(9))


def _category_frame(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[(F.col("embedding")[i] > 0).cast("int").alias(f"c{i}") for i in range(9)], F.lit(0).alias("c_none"))


@query(
    "a5_positive_weight",
    sql=f"""WITH m AS (SELECT {", ".join(f"avg(c{i}) AS c{i}" for i in range(9))}, 0.0 AS c_none FROM (SELECT {_CAT_SQL} FROM embeddings)),
            u AS (UNPIVOT m ON {", ".join(_CAT)}, c_none INTO NAME category VALUE mean)
            SELECT category, CASE WHEN mean = 0 THEN 'inf'::DOUBLE ELSE round(1.0 / (2.0 * mean), 6) END AS weight FROM u""",
)
def a5_positive_weight(spark, sf_dir):
    """Nine sign bits of ``embedding`` as categories, plus an all-zero one (∞)."""
    w = tk.positive_weights(_category_frame(spark, sf_dir), _CAT + ["c_none"])
    return w.select("category", F.when(F.col("weight") == float("inf"), F.col("weight")).otherwise(F.round("weight", 6)).alias("weight"))


@query(
    "d2_random_split",
    sql=f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {portable_hash_sql('doc_id', 20212021)}, doc_id) - 1
                   < ceil(count(*) OVER () * 0.2) THEN 'dev' ELSE 'train' END AS split FROM documents""",
)
def d2_random_split(spark, sf_dir):
    return sp.random_split(documents(spark, sf_dir, "doc_id"), "doc_id", 0.2, 20212021).select("doc_id", "split")


@query(
    "d3_file_holdout",
    sql="""WITH f AS (SELECT source, row_number() OVER (ORDER BY md5('0:' || source), source) - 1 AS r
                      FROM (SELECT DISTINCT source FROM documents))
           SELECT d.doc_id, CASE WHEN f.r = 5 THEN 'test' ELSE 'train' END AS split
           FROM documents d JOIN f USING (source) WHERE f.r < 6""",
)
def d3_file_holdout(spark, sf_dir):
    """``documents.source`` plays the file; 6 files sampled, the last is test."""
    return sp.file_holdout(documents(spark, sf_dir, "doc_id", "source"), "source", 6, 0).select("doc_id", "split")


@query(
    "d4_exact_sample",
    sql=f"SELECT doc_id FROM documents ORDER BY {portable_hash_sql('doc_id', 7)}, doc_id LIMIT 10",
)
def d4_exact_sample(spark, sf_dir):
    return sp.exact_sample(documents(spark, sf_dir, "doc_id"), "doc_id", 10, 7)


@query(
    "d6_task_loader",
    sql=f"""SELECT s.doc_id AS id, md5({S.tidy('d.text')}) AS h, s.label, s.split
            FROM ({_d1_sql()}) s JOIN documents d USING (doc_id)""",
)
def d6_task_loader(spark, sf_dir):
    """Task 'toxic': label from flag → stratified 25 % dev → tidied text → typed select."""
    spec = tk.TaskSpec("toxic", "doc_id", "text", "toxic", 0.25, 0, normalise=False)
    t = tk.load_task(labelled_documents(spark, sf_dir), spec).withColumn("text", tx.tidy("text"))
    return t.select("id", F.md5("text").alias("h"), "label", "split")


@query("d6_task_loader_social")
def d6_task_loader_social(spark, sf_dir):
    """Same with the full social normaliser (camel split, run cap): rows-only."""
    spec = tk.TaskSpec("toxic", "doc_id", "text", "toxic", 0.25, 0, normalise=True)
    t = tk.load_task(labelled_documents(spark, sf_dir), spec)
    return t.select("id", F.md5("text").alias("h"), "label", "split")


@query(
    "d6_task_loader_limited",
    sql=f"""SELECT id, label, split FROM (
              SELECT doc_id AS id, label, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS pos
              FROM ({_d1_sql()})) WHERE pos <= 50""",
)
def d6_task_loader_limited(spark, sf_dir):
    """Smoke-test limit: the first 50 rows (id order) of each split (L3 per split)."""
    spec = tk.TaskSpec("toxic", "doc_id", "text", "toxic", 0.25, 0, limit=50, normalise=False)
    return tk.load_task(labelled_documents(spark, sf_dir), spec).select("id", "label", "split")


@query(
    "d7_pooled_tasks",
    sql=f"""SELECT task, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct FROM (
              SELECT text, 'TOXIC' AS task FROM {_LABELLED_SQL}
              UNION ALL SELECT text, 'QUALITY' AS task FROM {_LABELLED_SQL}) GROUP BY task""",
)
def d7_pooled_tasks(spark, sf_dir):
    lab = labelled_documents(spark, sf_dir)
    pooled = tk.pool_tasks({"toxic": lab.select("text"), "quality": lab.select("text")})
    return pooled.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("n_distinct"))


ARTICLE_ROWS = 1000


@query(
    "j2_unnest_comments",
    sql="SELECT conv_id, turn, role, md5(text) AS h, 'conv ' || CAST(conv_id AS VARCHAR) AS title FROM conversations",
)
def j2_unnest_comments(spark, sf_dir):
    """``conversations`` folded into articles (title + array of comments, each with
    its own ``title`` field) and unnested again: the article title wins."""
    from ..operators.indexing import group_index
    from ..sources.text import unnest_comments

    c = table(spark, sf_dir, "conversations")
    # a conversation may hold a third of all rows: an article is at most ARTICLE_ROWS of its turns
    c = c.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))  # rows without an id are kept
    c = group_index(c, ["turn", F.xxhash64("role", "text")], ["_conv"], "_i")
    articles = c.groupBy("conv_id", F.expr(f"_i div {ARTICLE_ROWS}")).agg(
        F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("title"),
        F.collect_list(F.struct("conv_id", "turn", "role", "text", F.col("role").alias("title"))).alias("comments"),
    )
    rows = unnest_comments(articles.select("title", "comments"))
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("h"), "title")


@query(
    "l5_first_files",
    sql="""SELECT d.doc_id, d.source FROM documents d
           WHERE d.source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 5)""",
)
def l5_first_files(spark, sf_dir):
    """The first 5 files in sorted order (``source`` plays the file), then their rows."""
    d = documents(spark, sf_dir, "doc_id", "source")
    first = d.select("source").distinct().orderBy("source").limit(5)  # bounded top-k of file names
    return d.join(F.broadcast(first), "source", "left_semi").select("doc_id", "source")


@query(
    "l6_seeded_file_order",
    sql="SELECT source, row_number() OVER (ORDER BY md5('42:' || source), source) - 1 AS pos FROM (SELECT DISTINCT source FROM documents)",
)
def l6_seeded_file_order(spark, sf_dir):
    """Seeded, repeatable shuffle of the file list (position of each file)."""
    from ..operators.indexing import group_index

    files = sp.seeded_file_order(documents(spark, sf_dir, "source"), "source", 42)
    keyed = files.withColumn("_h", sp.text_hash("source", 42))
    return group_index(keyed, ["_h", "source"], (), "pos").select("source", F.col("pos").cast("long").alias("pos"))
