"""Sink / source round trips on the driver tables.

Each query writes under ``<spark.checkpoint.dir>/sinks/<run id>`` (the shared
folder of the cluster), reads the output back with the matching source, and
reports a digest the oracle computes straight from the tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import results as rs
from ..operators import tasks as tk
from ..operators import vocab as vb
from ..plans.corpus import TOKEN_LEN_SQL, filter_corpus
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources import text as src
from ..sources.tables import documents, labelled_documents
from .array_queries import _TOK_CTE, _VOC_CTE, word_vocab
from .registry import query
from .result_queries import _LED, ledger
from .task_queries import _d1_sql


def _out(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "sinks", f"{name}-{uuid.uuid4().hex}")


@query(
    "s8_s14_dataset_roundtrip",
    sql=f"SELECT label, count(*) AS n_dev FROM ({_d1_sql()}) WHERE split = 'dev' GROUP BY label",
)
def s8_s14_dataset_roundtrip(spark, sf_dir):
    """Task set saved with ``split`` as partition column, loaded back; the dev
    filter prunes partitions (only ``split=dev`` files are read)."""
    spec = tk.TaskSpec("toxic", "doc_id", "text", "toxic", 0.25, 0, normalise=False)
    t = tk.load_task(labelled_documents(spark, sf_dir), spec)
    path = _out(spark, "dataset")
    back = sinks.encode_once(t, path + "-flat")  # S14: encode once, readers read
    sinks.save_dataset(back, path)  # S8
    dev = sinks.load_dataset(spark, path).filter(F.col("split") == "dev")
    return dev.groupBy("label").agg(F.count(F.lit(1)).alias("n_dev"))


@query(
    "s9_sharded_text_sink",
    sql=f"SELECT count(*) AS n_lines, count(DISTINCT md5(text)) AS n_distinct FROM documents WHERE {TOKEN_LEN_SQL} >= 6",
)
def s9_sharded_text_sink(spark, sf_dir):
    """P10's kept texts (newlines folded to spaces: one text per line) written as
    8 text shards, read back as lines."""
    kept = filter_corpus(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "text")
    path = _out(spark, "shards")
    # the shard line carries the doc id so the original text can be checked
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("text", "[\\r\\n]", " "))
    sinks.write_shards(kept.select(line.alias("value")), path, 8)
    back = src.read_lines(spark, path, "*").select(F.split("value", "\t", 2)[0].cast("long").alias("doc_id"))
    joined = back.join(kept, "doc_id", "inner")
    return joined.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct(F.md5("text")).alias("n_distinct"))


@query(
    "s5_s11_csv_roundtrip",
    sql="SELECT lang, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
)
def s5_s11_csv_roundtrip(spark, sf_dir):
    """documents (texts with newlines and quotes) → CSV with header → read back
    multi-line with the explicit schema: every text survives whole."""
    d = documents(spark, sf_dir, "doc_id", "lang", "text")
    path = _out(spark, "csv")
    sinks.write_csv(d, path)
    back = src.read_csv(spark, path, "doc_id long, lang string, text string")
    return back.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("n_distinct"), F.sum(F.length("text")).cast("long").alias("n_chars")
    )


@query(
    "s1_line_scan",
    sql="""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents)
    SELECT count(*) AS n_lines, count(DISTINCT md5(v)) AS n_distinct, CAST(sum(length(v)) AS BIGINT) AS n_chars FROM l""",
)
def s1_line_scan(spark, sf_dir):
    """documents written as text, scanned back line by line (blank lines included)."""
    path = _out(spark, "lines")
    sinks.write_shards(documents(spark, sf_dir, "text"), path, text_col="text")
    lines = src.read_lines(spark, path, "*")
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct(F.md5("value")).alias("n_distinct"), F.sum(F.length("value")).cast("long").alias("n_chars"))


@query(
    "s6_nested_json_scan",
    sql="""SELECT title, i AS id, md5(l[i]) AS md5_text FROM (SELECT doc_id::VARCHAR AS title, string_split(text, chr(10)) AS l FROM documents), range(1, 100000) r(i) WHERE i <= len(l)""",
)
def s6_nested_json_scan(spark, sf_dir):
    """Each document as an article whose comments are its lines; JSON array files written, scanned, unnested."""
    article = F.struct(F.col("doc_id").cast("string").alias("title"), F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("id"), x.alias("text"))).alias("comments"))

    def array_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [(lead if k == 0 else ",") + v for k, v in enumerate(b["value"])]})
                lead = ","
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    path = _out(spark, "articles")
    documents(spark, sf_dir, "doc_id", "text").select(F.to_json(article).alias("value")).mapInPandas(array_lines, "value string").write.text(path)
    rows = src.unnest_comments(src.read_articles(spark, path))
    return rows.select("title", F.col("id").cast("long").alias("id"), F.md5("text").alias("md5_text"))


@query(
    "s10_r4_ledger_append",
    sql=f"WITH {_LED} SELECT model, task, metric, count(*) AS n, round(sum(value), 6) AS total FROM long GROUP BY model, task, metric",
)
def s10_r4_ledger_append(spark, sf_dir):
    """The ledger store filled by two appends and read back as one."""
    long, path = ledger(spark, sf_dir), _out(spark, "ledger")
    for part in (0, 1):
        rs.append_ledger(long.where(F.col("event_id") % 2 == part), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("model").cast("string").alias("model"), "task", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    "s10_ledger_upsert",
    sql=f"WITH {_LED} SELECT model, task, CAST(run AS INTEGER) AS run, metric, round(max(value), 6) AS value FROM long WHERE run % 10 < 5 GROUP BY ALL",
)
def s10_ledger_upsert(spark, sf_dir):
    """Two overlapping writes of the ledger store, the second one twice: every run stands once."""
    long = ledger(spark, sf_dir).where(F.col("run") % 10 < 5).groupBy("model", "task", F.col("run").cast("int").alias("run"), "metric").agg(F.max("value").alias("value"))
    path = _out(spark, "store")
    rs.upsert_ledger(long.withColumn("value", F.when(F.col("run") % 2 == 0, F.lit(-1.0)).otherwise(F.col("value"))), path)
    for _ in range(2):
        rs.upsert_ledger(long.where(F.col("run") % 2 == 0), path)
    return rs.read_ledger_store(spark, path).withColumn("value", F.round("value", 6))


@query(
    "s10_ledger_export",
    sql=f"WITH {_LED} SELECT model, task, metric, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT model, task, run, metric, max(value) AS value FROM long GROUP BY ALL) GROUP BY ALL",
)
def s10_ledger_export(spark, sf_dir):
    """The ledger exported as JSON lines, one a run, and read back."""
    long = ledger(spark, sf_dir).groupBy("model", "task", F.col("run").cast("int").alias("run"), "metric").agg(F.max("value").alias("value"))
    path = _out(spark, "export")
    rs.ledger_lines(long).write.text(path)
    back = rs.parse_ledger_lines(spark.read.text(path))
    return back.groupBy("model", "task", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("s13_vocabulary_files", sql=f"WITH {_TOK_CTE},\n{_VOC_CTE}\nSELECT token, id FROM voc")
def s13_vocabulary_files(spark, sf_dir):
    """The vocabulary saved as the published JSON and merge files and loaded back."""
    path = _out(spark, "vocabulary")
    merges = spark.createDataFrame([], "rank int, left string, right string")
    vb.save_vocabulary_files(vb.BpeModel(word_vocab(spark, sf_dir), merges), path)
    return vb.load_vocabulary_files(spark, path).vocab
