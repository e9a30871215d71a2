"""Paths and helpers shared by the root tests (fixtures live in ``conftest.py``)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def one(spark, expr_col, value, schema="x string"):
    """Evaluate a Column function on one literal row."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_col.alias("y")).collect()[0]["y"]
