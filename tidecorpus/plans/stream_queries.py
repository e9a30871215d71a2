"""Streaming queries (ST1, ST2) over the driver's ``documents`` parquet.

The stream runs with ``availableNow`` into a parquet sink under the session's
checkpoint folder; the registered result reads that sink back as a batch frame.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, table, table_path
from ..streaming import stream as stm
from .corpus import TOKEN_LEN_SQL
from .registry import query


def _run(spark, sf_dir, build):
    base = os.path.join(ensure_checkpoint_dir(spark), "stream-out", uuid.uuid4().hex)
    out = build(stm.path_stream(spark, table_path(sf_dir, "documents"), table(spark, sf_dir, "documents").schema))
    q = stm.start_sink(out, base, "parquet", os.path.join(base, "_ck"))
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(base)


@query(
    "st2_stream_filter",
    sql=f"SELECT lang, count(*) AS n_kept FROM documents WHERE {TOKEN_LEN_SQL} >= 6 GROUP BY lang",
)
def st2_stream_filter(spark, sf_dir):
    """The corpus filter as a stream; equals the batch result."""
    out = _run(spark, sf_dir, lambda s: stm.filter_stream(s, "text").select("doc_id", "lang", "text"))
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"))


@query("st1_stream_encode")
def st1_stream_encode(spark, sf_dir):
    """Clean → encode → pad as a stream with the word vocabulary: rows-only."""
    from .array_queries import word_vocab

    vocab = word_vocab(spark, sf_dir)
    out = _run(spark, sf_dir, lambda s: stm.encode_stream(s.select("doc_id", "text"), vocab, "text"))
    return out.select("doc_id", F.size("input_ids").alias("n_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"))
