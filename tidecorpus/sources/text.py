"""Line, CSV and JSON sources.

Line files are read with ``spark.read.text`` – splittable, one row per line,
``\\n`` / ``\\r\\n`` / ``\\r`` handled like Python's universal newlines. The file
path and byte offset of each split come from the ``_metadata`` column so that a
stable line order (file, block, position) can be rebuilt without a global sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_WS


def list_files(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt*") -> DataFrame:
    """``file_path`` of each matching file; lists the folder and reads no contents."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select(F.col("_metadata.file_path").alias("file_path"))


def read_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.txt*") -> DataFrame:
    """Text lines with ``file_path`` and ``block_start`` (split offset) columns."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("pathGlobFilter", glob).text(paths)
    return df.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def non_empty(df: DataFrame, col: str = "value") -> DataFrame:
    """Drop empty lines only."""
    return df.filter(F.length(col) > 0)


def non_blank(df: DataFrame, col: str = "value") -> DataFrame:
    """S3: drop empty and whitespace-only lines (Python's whitespace set)."""
    return df.filter(F.regexp_replace(col, PY_WS, "") != "")


def read_splits(spark: SparkSession, files: Mapping[str, str | Sequence[str]], glob: str = "*") -> DataFrame:
    """Named splits of line files as one table ``text, split``."""
    parts = [
        read_lines(spark, p, glob).select(F.col("value").alias("text"), F.lit(name).alias("split"))
        for name, p in files.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV with header; quoted fields may hold newlines and doubled quotes."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .schema(schema)
        .csv(path)
    )


def read_csv_columns(spark: SparkSession, path: str | Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """S5 by header name: read every field as text, keep and cast the named
    columns (files may carry extra or reordered columns)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


CONTEXT_COMMENT = T.StructType(
    [T.StructField("id", T.DecimalType(20, 0)), T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ["HATEFUL", "CALLS", "WOMEN", "LGBTI", "RACISM", "CLASS", "POLITICS", "DISABLED", "APPEARANCE", "CRIMINAL"]]
)
CONTEXT_ARTICLE = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("comments", T.ArrayType(CONTEXT_COMMENT))]
)


def read_articles(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = CONTEXT_ARTICLE) -> DataFrame:
    """One JSON array of articles per file (``multiLine``), explicit schema."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def unnest_comments(articles: DataFrame) -> DataFrame:
    """One row per comment, carrying the article title (which overrides the
    comment's own ``title``). Articles without comments give no row."""
    c = articles.select(F.col("title").alias("_article_title"), F.explode("comments").alias("c"))  # explode, not explode_outer
    fields = [f for f in c.schema["c"].dataType.fieldNames() if f != "title"]
    return c.select(*[F.col(f"c.{f}").alias(f) for f in fields], F.col("_article_title").alias("title"))


def unnest_comments_at(articles: DataFrame, row: str, name: str = "_row") -> DataFrame:
    """J2 keeping the order: ``name`` is a text that sorts by (article number ``row``, place of the comment)."""
    c = articles.select(row, F.col("title").alias("_article_title"), F.posexplode("comments").alias("_pos", "c"))
    fields = [f for f in c.schema["c"].dataType.fieldNames() if f != "title"]
    key = F.format_string("%019d:%010d", F.col(row).cast("long"), "_pos")
    return c.select(*[F.col(f"c.{f}").alias(f) for f in fields], F.col("_article_title").alias("title"), key.alias(name))


def read_ledgers(spark: SparkSession, glob_path: str) -> DataFrame:
    """S7 + R2: benchmark ledgers → long rows ``model, task, run, metric, value``.

    model = file name up to the first ``.``; files whose name holds ``test`` are skipped;
    the ``model_name`` entry (a string) is not a task and is dropped.
    """
    raw = spark.read.text(glob_path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("fname")
    )
    raw = raw.filter(~F.col("fname").contains("test"))
    from ..operators.results import parse_ledger

    return parse_ledger(raw.select(F.regexp_extract("fname", "^[^.]+", 0).alias("model"), "value"), "value")
