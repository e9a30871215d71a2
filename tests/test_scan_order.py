"""Numbers in scan order, whatever the splits, and padding without bringing batches together."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidecorpus.operators import scan_order as so
from tidecorpus.sources.text import non_blank, read_lines


@pytest.fixture(scope="module")
def folder():
    d, r = tempfile.mkdtemp(prefix="tc-lines-", dir="/tmp"), random.Random(0)
    for k, n in enumerate((700, 3, 0, 250)):
        with open(os.path.join(d, f"f{k}.txt"), "w") as f:
            f.writelines(f"{k}-{i} " + "x" * r.randint(0, 60) + "\n" + ("\n" if r.random() < 0.1 else "") for i in range(n))
    return d


def _with(spark, **conf):
    keys = {"max": "spark.sql.files.maxPartitionBytes", "cost": "spark.sql.files.openCostInBytes", "least": "spark.sql.files.minPartitionNum"}
    for k, v in conf.items():
        spark.conf.set(keys[k], v)


@pytest.mark.parametrize("conf", [dict(max="2000", cost="1", least="40"), dict(max="128m", cost="4m", least="1")])
def test_lines(spark, folder, conf):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    _with(spark, **conf)
    try:
        lines = non_blank(read_lines(spark, folder, "*.txt"))
        got = [r["value"].split(" ")[0] for r in so.number_lines(lines).orderBy("row_index").collect()]
        assert got == [f"{k}-{i}" for k, n in ((0, 700), (1, 3), (3, 250)) for i in range(n)]
        numbered = so.number_lines(lines)
        assert [r[0] for r in numbered.select("row_index").orderBy("row_index").collect()] == list(range(953))
        per_file = so.number_lines(lines, ["file_path"]).select(F.split("value", " ")[0].alias("v"), "row_index").collect()
        assert all(int(r["v"].split("-")[1]) == r["row_index"] for r in per_file)
        plan = so.number_lines(lines)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan  # no line moves
        batches = so.with_batches(numbered, 100).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("pos_in_batch").alias("p")).orderBy("batch_id").collect()
        assert [(b["n"], b["p"]) for b in batches] == [(100, 99)] * 9 + [(53, 52)]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_parquet_rows(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="tc-rows-", dir="/tmp"), "t")
    spark.range(1000).select("id", F.lit("x").alias("row_index_of"), (F.col("id") * 2).alias("v")).repartition(3).write.parquet(d)
    got = so.read_numbered(spark, d, "id", "v", name="n").collect()
    assert sorted(r["n"] for r in got) == list(range(1000))
    kept = so.read_numbered(spark, d, "id", "v", name="n").where("v > 500").collect()
    at = {r["id"]: r["n"] for r in got}
    assert all(at[r["id"]] == r["n"] for r in kept)  # a pushed filter changes no number


@pytest.mark.parametrize("parts", [1, 7])
def test_padding(spark, parts):
    r = random.Random(parts)
    rows = [(i, [r.randint(1, 99) for _ in range(r.randint(0, 40))]) for i in range(333)]
    df = spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1).withColumn("batch", F.floor(F.col("i") / 16).cast("long"))
    df = df.repartitionByRange(parts, "i").sortWithinPartitions("i")  # batches are cut by task ends
    got = {x["i"]: x["padded"] for x in so.pad_runs(df, "ids", "batch", 16, 0, 8).collect()}
    for i, ids in rows:
        longest = max(len(v) for j, v in rows if j // 16 == i // 16)
        width = -(-longest // 8) * 8
        assert got[i] == ids + [0] * (width - len(ids))


def test_padding_of_nothing(spark):
    df = spark.createDataFrame([], "ids array<int>, batch long")
    assert so.pad_runs(df, "ids", "batch", 4, 0).count() == 0
