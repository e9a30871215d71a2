"""Structured Streaming versions of the corpus jobs.

Both jobs are stateless projections/filters on a file stream, so they run in
append mode without watermarks; the checkpoint gives restart after failure,
which the batch reference lacks. Batch and stream share the same Column
functions, so an ``availableNow`` run equals the batch result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..functions import text as tx
from ..operators import encode as en
from ..session import ensure_checkpoint_dir


def line_stream(spark: SparkSession, in_dir: str, max_files_per_trigger: int = 8, glob: str = "*.txt*") -> DataFrame:
    """ST source: new line files of ``in_dir`` as they arrive."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", glob)
        .text(in_dir)
        .select("value", F.col("_metadata.file_path").alias("file_path"))
    )


def table_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str = "*.parquet", max_files_per_trigger: int = 8) -> DataFrame:
    """ST source over parquet files of a directory (the driver tables)."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", glob)
        .parquet(directory)
    )


def path_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int = 64) -> DataFrame:
    """ST source over one table, a parquet file or a folder of them. The path is given as a pattern that
    matches it alone: the source takes a plain path for a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def filter_stream(df: DataFrame, text_col: str = "value", min_tokens: int = K.MIN_TOKENS) -> DataFrame:
    """ST2: keep texts whose token length (after collapsing emoji spans) ≥ 6;
    the original text is kept."""
    length = tx.token_len(tx.collapse_emoji_spans(tx.tidy(text_col)))
    return df.filter(length >= min_tokens)


def ids_encoder(spark: SparkSession, vocab: DataFrame, unk: int = K.UNK_ID):
    """Stateless token → id UDF for streams (a stream cannot regroup without
    state). The vocabulary is bounded by ``vocab_size`` and broadcast once."""
    return en.array_lookup(vocab, "token", "id", unk, "int")


def encode_stream(df: DataFrame, vocab: DataFrame | None = None, text_col: str = "value", max_len: int = K.MAX_LENGTH, model=None) -> DataFrame:
    """ST1: clean → skip blank lines → ids → truncate → specials → pad → masks.

    With ``model`` (a trained BPE model) the text goes through the tokenizer
    normaliser and subword ids; otherwise through word tokens and ``vocab``.
    Both are stateless per row, so the stream needs no state store.
    """
    if model is not None:
        from ..operators.vocab import bpe_id_encoder

        enc = bpe_id_encoder(df.sparkSession, model)
        body = en.truncate(enc(tx.tokenizer_normalise(text_col, lowercase=True)), max_len)
    else:
        to_ids = ids_encoder(df.sparkSession, vocab)
        body = to_ids(en.truncate(en.word_tokens(tx.social_normalise(text_col)), max_len))
    ids = en.build_inputs(body)
    padded = en.pad(ids, max_len)
    return df.filter(F.regexp_replace(text_col, tx.PY_WS, "") != "").select(
        "*",
        padded.alias("input_ids"),
        en.attention_mask(padded).alias("attention_mask"),
        en.token_type_ids(padded).alias("token_type_ids"),
    )


def start_sink(df: DataFrame, out_dir: str, fmt: str = "parquet", checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append-mode file sink; the checkpoint lives under the session's checkpoint folder."""
    spark = df.sparkSession
    ck = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "streams", uuid.uuid4().hex)
    w = df.writeStream.format(fmt).option("path", out_dir).option("checkpointLocation", ck).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
