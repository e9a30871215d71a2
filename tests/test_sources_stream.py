"""Sources and sinks (S1–S14), streaming (ST1, ST2 batch = stream), entry contract."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import SF001
from tidecorpus.operators import vocab as vb
from tidecorpus.sources import sinks
from tidecorpus.sources import text as src
from tidecorpus.plans.corpus import filter_corpus
from tidecorpus.streaming import stream as stm


def _tmp(prefix):
    return tempfile.mkdtemp(prefix=prefix, dir="/tmp")


def test_line_scan_newlines_and_splits(spark):
    d = _tmp("tc-s1-")
    with open(os.path.join(d, "a.txt"), "wb") as f:
        f.write(b"uno\r\ndos\n\ntres\n")
    with open(os.path.join(d, "skip.csv"), "w") as f:
        f.write("x\n")
    rows = [r["value"] for r in src.read_lines(spark, d).collect()]
    assert rows == ["uno", "dos", "", "tres"]
    both = src.read_splits(spark, {"train": os.path.join(d, "a.txt"), "test": os.path.join(d, "a.txt")})
    assert {r["split"] for r in both.collect()} == {"train", "test"} and both.count() == 8


def test_csv_multiline_quotes(spark):
    d = _tmp("tc-s5-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write('text,HS\n"hola ""che""\nsegunda línea",1\nchau,0\n')
    rows = src.read_csv(spark, p, "text string, HS int").orderBy("HS").collect()
    assert rows[1]["text"] == 'hola "che"\nsegunda línea' and rows[0]["text"] == "chau"


def test_json_articles_unnest(spark):
    d = _tmp("tc-s6-")
    arts = [
        {"title": "T1", "comments": [{"id": 18446744073709551615, "text": "a", "title": "own", "HATEFUL": 1, "CALLS": 0}]},
        {"title": "T2", "comments": []},
    ]
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump(arts, f)
    rows = src.unnest_comments(src.read_articles(spark, d)).collect()
    assert len(rows) == 1 and rows[0]["title"] == "T1" and int(rows[0]["id"]) == 18446744073709551615


def test_sinks_roundtrip(spark):
    d = _tmp("tc-sink-")
    df = spark.createDataFrame([("a", "train"), ("b", "dev"), ("c", "test")], "text string, split string")
    sinks.save_dataset(df, os.path.join(d, "ds"))
    back = sinks.load_dataset(spark, os.path.join(d, "ds"))
    assert back.filter(F.col("split") == "dev").count() == 1
    sinks.write_shards(df.withColumnRenamed("text", "value"), os.path.join(d, "shards"), 2)
    assert sorted(r["value"] for r in spark.read.text(os.path.join(d, "shards")).collect()) == ["a", "b", "c"]
    sinks.write_csv(df, os.path.join(d, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 3
    assert sinks.encode_once(df, os.path.join(d, "enc")).count() == 3


def test_vocab_save_and_dump(spark):
    d = _tmp("tc-s13-")
    df = spark.createDataFrame([("ab ab",)], "text string")
    m = vb.train_bpe(df, "text", vocab_size=12, min_frequency=1)
    v, mg = vb.save_vocabulary(m, d, "tok")
    assert os.path.isdir(v) and os.path.basename(mg) == "tok-merges"
    with pytest.raises(NotADirectoryError):
        vb.save_vocabulary(m, os.path.join(d, "missing"))
    lines = [r["line"] for r in vb.vocab_lines(m.vocab).collect()]
    assert lines[0] == "0      --- <s>"


def test_stream_equals_batch(spark):
    d = _tmp("tc-st-")
    inp = os.path.join(d, "in")
    os.makedirs(inp)
    texts = ["uno dos tres cuatro cinco seis", "corto", "emoji a b c d e emoji f g", "a b c d e f g h"]
    for i, t in enumerate(texts):
        with open(os.path.join(inp, f"p{i}.txt"), "w") as f:
            f.write(t + "\n")
    q = stm.start_sink(stm.filter_stream(stm.line_stream(spark, inp, 2)).select("value"), os.path.join(d, "out"), "text", os.path.join(d, "ck"))
    q.awaitTermination(120)
    streamed = sorted(r["value"] for r in spark.read.text(os.path.join(d, "out")).collect())
    batch = sorted(r["value"] for r in filter_corpus(spark.read.text(inp), "value").collect())
    assert streamed == batch == sorted([texts[0], texts[3]])


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["lang", "n_rows", "n_kept"]
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100
    # the flagship also runs on the smallest scale through the registry
    assert qs["p10_min_length_filter"](spark, SF001).count() == df.count()


def test_bpe_stream_equals_batch(spark):
    d = _tmp("tc-st1-")
    inp = os.path.join(d, "in")
    os.makedirs(inp)
    lines = ["hola hola mundo", "mundo hola", "   ", "adios mundo cruel"]
    for i, t in enumerate(lines):
        with open(os.path.join(inp, f"p{i}.txt"), "w") as f:
            f.write(t + "\n")
    model = vb.train_bpe(spark.createDataFrame([(x,) for x in lines], "text string"), "text", vocab_size=30, min_frequency=1)
    q = stm.start_sink(stm.encode_stream(stm.line_stream(spark, inp, 2), model=model, max_len=16).select("value", "input_ids"),
                       os.path.join(d, "out"), "parquet", os.path.join(d, "ck"))
    q.awaitTermination(120)
    streamed = sorted((r["value"], tuple(r["input_ids"])) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    batch = sorted((r["value"], tuple(r["input_ids"])) for r in stm.encode_stream(spark.read.text(inp), model=model, max_len=16).collect())
    assert streamed == batch and len(streamed) == 3 and all(len(ids) == 16 for _, ids in streamed)


def test_saved_vocabulary_loads_back(spark):
    d = _tmp("tc-load-")
    m = vb.train_bpe(spark.createDataFrame([("ab ab cd",)], "text string"), "text", vocab_size=14, min_frequency=1)
    vb.save_vocabulary(m, d, "x")
    back = vb.load_model(spark, d, "x")
    assert sorted(back.vocab.collect()) == sorted(m.vocab.collect())
    assert sorted(back.merges.collect()) == sorted(m.merges.collect())
