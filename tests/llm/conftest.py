import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names."""
    long_text = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog. All rights reserved.", "en", "src0", 10),
        (1, "The quick brown fox jumps over the lazy dog. All rights reserved.", "en", "src0", 10),
        (2, None, None, None, None), (3, "", "en", "src1", 0), (None, "no id at all here", "en", "src2", 5), (None, None, None, "src2", None),
        (4, long_text, "de", "src0", 1), (5, long_text + " end", "de", "src0", 1), (6, "x" * 50_000, "fr", "src3", 1), (7, " \n\t ", "es", "src4", 4),
        (8, "one", "en", "src5", 3), (9, "two words", "en", "src5", 9), (10, "Ünïcödé 漢字 😀 <|endoftext|> text   with  spaces \n \n", "zz", "src6", 1),
        (11, "The quick brown fox jumps over the lazy dog. All rights reserved.", "en", "src7", 10),
    ]
    names = ["uid", "content", "score", "fp", "length", "sequence_id", "domain", "_t", "tokens"]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
