"""J2 and S4 where one conversation or the list of sources is large."""

import duckdb
from pyspark.sql import functions as F

from tidecorpus.plans import task_queries as tq
from tidecorpus.plans.registry import load_all
from tidecorpus.sources import text as st


def _same(spark, name, folder, table):
    q = load_all()[name]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in q.fn(spark, folder).collect()), key=key) == sorted(c.execute(q.sql).fetchall(), key=key)


def test_articles_of_a_long_conversation_are_bounded(spark, tmp_path, monkeypatch):
    long = spark.range(3500).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "no id"), (None, 1, "user", "no id")]
    c = long.unionByName(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    c.write.parquet(f"{tmp_path}/conversations.parquet")
    sizes, unnest = [], st.unnest_comments
    monkeypatch.setattr(st, "unnest_comments", lambda a: sizes.extend(r[0] for r in a.select(F.size("comments")).collect()) or unnest(a))
    _same(spark, "j2_unnest_comments", tmp_path, "conversations")
    assert sum(sizes) == 3506 and max(sizes) <= getattr(tq, "ARTICLE_ROWS", 1000)


def test_named_splits_collect_no_list_of_sources(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(i, f"line {i}\nnext", s) for i, s in enumerate(["001", "02", "a b", "a=b/c", "é", "z", "z", None])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    q, collect = load_all()["s4_named_splits"], DataFrame.collect
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: (_ for _ in ()).throw(AssertionError("collected to the driver")))
        out = q.fn(spark, str(tmp_path))
    assert sorted(map(tuple, collect(out))) == [("test", 2), ("train", 14)]  # the line pair without a source is in the train split
    _same(spark, "s4_named_splits", str(tmp_path), "documents")
