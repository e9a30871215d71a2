"""Property tests: invariants under random input."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecorpus.functions import text as tx
from tidecorpus.operators import encode as en
from tidecorpus.operators import splits as sp
from tidecorpus.operators.indexing import group_index

WS = " \t\n\r\x0b\x0c\x1c\x85\xa0  　"
texts = st.lists(st.text(alphabet=st.sampled_from(list(WS) + list("ab.é中@#")), max_size=30), min_size=1, max_size=25)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _py_tidy(s):
    return re.sub(r"\s+", " ", re.sub("\n+", ". ", s)).strip()


@SETTINGS
@given(texts)
def test_tidy_equals_python_and_is_idempotent(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    once = df.select(tx.tidy("x").alias("y"))
    twice = once.select(tx.tidy("y").alias("z"))
    got = [r["y"] for r in once.collect()]
    assert got == [_py_tidy(x) for x in xs]
    assert [r["z"] for r in twice.collect()] == [_py_tidy(_py_tidy(x)) for x in xs]


@SETTINGS
@given(st.lists(st.lists(st.integers(5, 99), max_size=140), min_size=1, max_size=20))
def test_pad_gives_max_length(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "ids array<int>")
    body = en.truncate("ids", 128)
    out = df.select(en.pad(en.build_inputs(body), 128).alias("p"), en.attention_mask(en.pad(en.build_inputs(body), 128)).alias("m"))
    for s, r in zip(seqs, out.collect()):
        assert len(r["p"]) == 128
        assert sum(r["m"]) == min(len(s), 126) + 2


@SETTINGS
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(0, 1000))
def test_split_sizes_exact_and_union(spark, labels, seed):
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "id long, label int")
    out = sp.stratified_split(df, "label", "id", 0.25, seed).collect()
    assert sorted(r["id"] for r in out) == list(range(len(labels)))
    assert sum(r["split"] == "dev" for r in out) == math.ceil(0.25 * len(labels))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("aaab"), st.integers(0, 20)), min_size=1, max_size=300))
def test_group_index_matches_row_number(spark, rows):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g string, v int")
    got = group_index(df, ["v", "id"], ["g"], "idx").select("id", "idx").collect()
    want = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1).alias("idx")).collect()
    assert sorted(got) == sorted(want)
