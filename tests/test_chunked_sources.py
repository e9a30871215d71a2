"""S5 and S6 over many small blocks equal Spark's whole-file readers; record numbers do not depend on splits."""

import csv
import json
import os
import random
import tempfile

import pytest
from pyspark.sql import types as T

from tidecorpus.sources import chunked
from tidecorpus.sources import text as src

COLS = {"id": "int", "text": "string", "note": "string"}


@pytest.fixture
def small_blocks(spark):
    """Splits of some hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "30"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _text(r):
    bits = ["plain", 'say ""quoted""'.replace('""', '"'), "a,b", "line\nbreak", "win\r\nline", "é漢😀", "", '"', "x" * r.randint(0, 900), "[{}]", "\\", "end\n"]
    return "".join(r.choice(bits) for _ in range(r.randint(0, 5)))


def _csv(path, n, seed, end):
    r = random.Random(seed)
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["note", "extra", "id", "text"])
        for i in range(n):
            w.writerow([_text(r), "x", i, _text(r)])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_equals_whole_file(small_blocks, end):
    d = tempfile.mkdtemp(prefix="tc-csv-", dir="/tmp")
    for k in range(2):
        _csv(os.path.join(d, f"f{k}.csv"), 40, 10 + k, end)
    want = src.read_csv_columns(small_blocks, d, COLS)
    got = chunked.read_csv_records(small_blocks, d, COLS)
    assert chunked._pieces(small_blocks, d, "\n").rdd.getNumPartitions() > 10
    # Spark's reader makes \r\n inside quotes \n where the file's lines end so; here texts stay as they are
    same = lambda rows: sorted(str(r).replace("\\r\\n", "\\n") if end == "\r\n" else str(r) for r in rows)
    assert same(got.select(*COLS).collect()) == same(want.collect())
    rows = got.orderBy("file_path", "block_start", "record").collect()
    assert [r.id for r in rows] == [*range(40)] * 2  # (block, record) is the order of the file


def test_csv_record_longer_than_blocks(small_blocks):
    d = tempfile.mkdtemp(prefix="tc-csv-", dir="/tmp")
    long = "\n".join(f"line {i}, \"q\"" for i in range(600))
    with open(os.path.join(d, "a.csv"), "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "text", "note"])
        w.writerows([(1, long, "a"), (2, "b", long), (3, "", "z")])
    got = chunked.read_csv_records(small_blocks, d, COLS).orderBy("file_path", "block_start", "record").collect()
    assert [(r.id, r.text, r.note) for r in got] == [(1, long, "a"), (2, "b", long), (3, None, "z")]


SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("comments", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])))])


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_equals_whole_file(small_blocks, indent):
    d = tempfile.mkdtemp(prefix="tc-json-", dir="/tmp")
    r = random.Random(3)
    for k, n in enumerate((30, 1, 0)):
        items = [{"title": f"{k}-{i} " + _text(r), "comments": [{"id": j, "text": _text(r) + '\\"],{"'} for j in range(r.randint(0, 6))]} for i in range(n)]
        with open(os.path.join(d, f"f{k}.json"), "w") as f:
            json.dump(items, f, indent=indent, ensure_ascii=bool(k % 2))
            f.write("\n")
    want = src.read_articles(small_blocks, d, SCHEMA)
    got = chunked.read_article_records(small_blocks, d, SCHEMA)
    assert sorted(map(str, got.select("title", "comments").collect())) == sorted(map(str, want.collect()))
    rows = got.orderBy("file_path", "block_start", "record").collect()
    assert [x.title.split(" ")[0] for x in rows] == [f"0-{i}" for i in range(30)] + ["1-0"]


def test_broken_files_fail(small_blocks):
    d = tempfile.mkdtemp(prefix="tc-json-", dir="/tmp")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('[{"title": "a", "comments": []}, {"title": 1 "b"}]')
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed"):
        chunked.read_article_records(small_blocks, d, SCHEMA).collect()
