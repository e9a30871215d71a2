"""Driver tables mapped onto the roles of the data model.

The driver's ``documents`` table stands in for tweet files: ``source`` plays the
file, ``doc_id`` the position. Its text holds no URL, hashtag or emoji, so a
``social`` column appends one of each per row (same formula in the oracle SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def social_column(text: str = "text", doc_id: str = "doc_id") -> Column:
    """``text @u<id> http://x.y/<id> #CamelTag<id> www.site<id>.org/p 🤣 ok 😺``"""
    i = F.col(doc_id).cast("string")
    return F.concat(
        F.col(text), F.lit(" @u"), i, F.lit(" http://x.y/"), i, F.lit(" #CamelTag"), i, F.lit(" www.site"), i, F.lit(".org/p"),
        F.lit(" \U0001F923 ok \U0001F63A"),
    )



def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """documents, pruned to ``cols`` at the scan."""
    df = table(spark, sf_dir, "documents")
    return df.select(*cols) if cols else df


def social_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the derived ``social`` text (doc_id, lang, source, social)."""
    return documents(spark, sf_dir).select("doc_id", "lang", "source", social_column().alias("social"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels ⋈ documents`` – the labelled-set stand-in (one row per labelled doc)."""
    labels = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    # labels is a fraction of documents; Spark picks broadcast only when its
    # runtime size is under the threshold (AQE), otherwise a shuffle join.
    return docs.join(labels, "doc_id", "inner")
