"""The five evaluation-set loaders: read → labels → split →
normalise text → typed select → per-split limit, each returning one table with
a ``split`` column (train / dev / test) instead of three handles.

Seeded splits use the portable hash of a row's number in file order, counted by
``operators.scan_order`` over the records of ``sources.chunked``: the same rows
fall into the same split whatever the split size, the number of cores or the way
files are packed into tasks. Splits are exact in size; they are not the same rows
scikit-learn would pick (SURVEY D1/D2). Of pre-split files only rows of the named
splits are taken, as the published loaders do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..sources.chunked import read_article_records, read_csv_records
from ..sources.text import unnest_comments_at
from .scan_order import number_records
from .selection import first_rows
from .splits import random_split, stratified_split
from .tasks import encode_labels, label_dim


def _rows(spark: SparkSession, path, columns: Mapping[str, str]) -> DataFrame:
    """CSV records with ``_row``: their number in file order."""
    return number_records(read_csv_records(spark, path, columns), "_row")


def _comments(spark: SparkSession, path) -> DataFrame:
    return unnest_comments_at(number_records(read_article_records(spark, path), "_article"), "_article")


def _limited(df: DataFrame, limit: int) -> DataFrame:
    """L3 per split, guarded: the first min(limit, rows) of each of the three splits."""
    parts = [first_rows(df.filter(F.col("split") == s), ["_row"], limit) for s in ("train", "dev", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _finish(df: DataFrame, cols: Sequence[str], text_cols: Sequence[str], preprocess: bool, preprocess_args: Mapping | None, limit: int | None) -> DataFrame:
    if preprocess:
        args = dict(preprocess_args or {})  # falsy → defaults
        df = df.withColumns({c: tx.social_normalise(c, **args) for c in text_cols})
    if limit:
        df = _limited(df, limit)
    return df.select(*cols, "split")


def load_sentiment(spark: SparkSession, path: str, limit: int | None = None, preprocess: bool = True, preprocess_args: Mapping | None = None,
                   polarity: Sequence[str] = K.SENTIMENT_POLARITY) -> DataFrame:
    """CSV ``text, lang, polarity, split``; label = polarity id (unknown raises); pre-split."""
    df = _rows(spark, path, {"text": "string", "lang": "string", "polarity": "string", "split": "string"})
    df = encode_labels(df, label_dim(spark, polarity), "polarity").filter(F.col("split").isin("train", "dev", "test"))
    return _finish(df, ["text", "lang", "label"], ["text"], preprocess, preprocess_args, limit)


def load_emotion(spark: SparkSession, train_path: str, test_path: str, limit: int | None = None, random_state: int = 2021,
                 preprocess: bool = True, preprocess_args: Mapping | None = None) -> DataFrame:
    """CSV ``text, label`` (names); 25 % of train stratified into dev."""
    cols = {"text": "string", "label": "string"}
    train = _rows(spark, train_path, cols).withColumnRenamed("label", "name")
    test = _rows(spark, test_path, cols).withColumnRenamed("label", "name").withColumn("split", F.lit("test"))
    dim = label_dim(spark, K.EMOTION_LABELS)
    train = stratified_split(encode_labels(train, dim, "name"), "label", "_row", 0.25, random_state)
    test = encode_labels(test, dim, "name")
    df = train.unionByName(test)
    return _finish(df, ["text", "label"], ["text"], preprocess, preprocess_args, limit)


def load_hate(spark: SparkSession, train_path: str, dev_path: str, test_path: str, limit: int | None = None,
              preprocess: bool = True, preprocess_args: Mapping | None = None) -> DataFrame:
    """CSV files per split with ``text, HS``; label = HS as int."""
    parts = []
    for split, path in (("train", train_path), ("dev", dev_path), ("test", test_path)):
        d = _rows(spark, path, {"text": "string", "HS": "int"})
        parts.append(d.select("_row", "text", F.col("HS").alias("label"), F.lit(split).alias("split")))
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _finish(df, ["text", "label"], ["text"], preprocess, preprocess_args, limit)


def load_irony(spark: SparkSession, path: str, limit: int | None = None, random_state: int = 20202021,
               preprocess: bool = True, preprocess_args: Mapping | None = None) -> DataFrame:
    """Merged CSV ``id, topic, is_ironic, text, lang, split``; label = is_ironic;
    25 % of train stratified into dev."""
    cols = {"id": "string", "topic": "string", "is_ironic": "int", "text": "string", "lang": "string", "split": "string"}
    df = _rows(spark, path, cols)
    df = df.withColumn("label", F.col("is_ironic").cast("int"))
    train = stratified_split(df.filter(F.col("split") == "train").drop("split"), "label", "_row", 0.25, random_state)
    test = df.filter(F.col("split") == "test")
    return _finish(train.unionByName(test), ["text", "lang", "label"], ["text"], preprocess, preprocess_args, limit)


def load_context_hate(spark: SparkSession, train_path: str, test_path: str, limit: int | None = None,
                      preprocess: bool = True, preprocess_args: Mapping | None = None) -> DataFrame:
    """JSON articles → one row per comment with the article title (J2); 20 % of
    train to dev at random (seed 20212021); ``id``, ``title``, ``text``,
    ``HATEFUL`` and the nine category flags, plus ``labels`` (E22)."""
    train = _comments(spark, train_path)
    test = _comments(spark, test_path).withColumn("split", F.lit("test"))
    train = random_split(train, "_row", 0.2, K.SPLIT_SEED_CONTEXT)
    df = train.unionByName(test).withColumn("labels", F.array(*[F.col(c).cast("int") for c in K.EXTENDED_HATE_CATEGORIES]))
    cols = ["id", "title", "text", "HATEFUL", *K.EXTENDED_HATE_CATEGORIES, "labels"]
    return _finish(df, cols, ["text", "title"], preprocess, preprocess_args, limit)
