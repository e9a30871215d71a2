"""Tables as folders of files in the streams; UDFs that take a batch in slices; texts cut into tokens once."""

import shutil
import tempfile
import threading
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from helpers import SF001
from tidecorpus.functions import slices as sl
from tidecorpus.functions import text as tx
from tidecorpus.operators import encode as en
from tidecorpus.operators import vocab as vb
from tidecorpus.plans import array_queries, stream_queries


def test_streams_read_a_folder_of_files(spark):
    d = tempfile.mkdtemp(prefix="tc-folder-", dir="/tmp")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    shutil.copy(f"{SF001}/region.parquet", f"{d}/region.parquet")
    for q in (stream_queries.st1_stream_encode, stream_queries.st2_stream_filter):
        rows = lambda at: sorted(map(tuple, q(spark, at).collect()), key=str)  # noqa: B023,E731
        assert rows(d) == rows(SF001) and rows(d)


def test_streams_of_an_empty_table(spark):
    d = tempfile.mkdtemp(prefix="tc-empty-", dir="/tmp")
    spark.read.parquet(f"{SF001}/documents.parquet").limit(0).write.parquet(f"{d}/documents.parquet")
    assert stream_queries.st2_stream_filter(spark, d).count() == 0


def test_slices_are_small_and_whole():
    b = pa.array(["x" * 1000] * 9000 + [None] * 100 + ["y" * 3_000_000])
    parts = list(sl.slices(iter([b, b.slice(0, 0)])))
    assert pa.chunked_array(parts).to_pylist() == b.to_pylist()
    assert max(len(p) for p in parts) < 1000 and len(list(sl.slices(iter([pa.array(["a" * 5_000_000] * 3)])))) == 3


def test_sliced_udfs_on_awkward_rows(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ñ \U0001F923", None, "", "ﬁ" * 400_000, "plain"] * 40)], "i int, t string").coalesce(1)
    from tidecorpus.functions.udfs import nfkc, strip_accents

    got = {r.i: r for r in df.select("i", nfkc("t").alias("n"), strip_accents("t").alias("s"), F.length(tx.replace_emoji("t")).alias("e")).collect()}
    assert [got[i].n for i in (1, 2, 4)] == [None, "", "plain"] and got[198].n == "fi" * 400_000
    assert got[0].s == "n \U0001F923" and got[195].e > 4 and got[196].e is None
    vocab = spark.createDataFrame([("a", 5), ("b", 6), ("a", 7)], "token string, id int")
    rows = spark.createDataFrame([(0, ["a", "z", None, "b"]), (1, None), (2, []), (3, ["b"] * 300_000)], "k int, t array<string>").coalesce(1)
    ids = {r.k: r.ids for r in en.lookup_ids(rows, "k", "t", vocab).collect()}
    assert ids == {0: [7, 3, 3, 6], 1: None, 2: [], 3: [6] * 300_000}
    back = spark.createDataFrame([(0, [6, 99, None]), (1, None)], "k int, t array<int>")
    assert {r.k: r.tokens for r in en.lookup_tokens(back, "k", "t", vocab).collect()} == {0: ["b", "<unk>", "<unk>"], 1: None}


def test_batches_are_bounded_in_bytes(spark):
    key, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", {}
    rows = spark.range(0, 6000, 1, 1).select("id", F.when(F.col("id") % 100 == 7, F.lit(None)).otherwise(F.repeat(F.lit("xy"), F.lit(1500))).alias("t"))
    own = spark.conf.get(key, None)
    try:
        for limit in (None, "64m"):  # a limit that the caller set stays
            spark.conf.unset(key) if limit is None else spark.conf.set(key, limit)
            part = sl.sliced_udf("int", lambda: lambda p: pa.array([len(p)] * len(p), pa.int32()), 1 << 40)
            got = rows.select("id", part("t").alias("n")).agg(F.max("n"), F.count("n"), F.countDistinct("id")).first()
            sizes[limit] = got[0]
            assert got[1:] == (6000, 6000) and spark.conf.get(key) == (limit or str(4 << 20))
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
    assert sizes[None] < 2000 and sizes["64m"] == 6000


def test_batches_are_bounded_whichever_session_and_thread(spark):
    from __spark_entry__ import queries
    from tidecorpus.functions.udfs import nfkc

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    names = ("t1_social_normalise", "t1d_emoji_sequences", "t13_rewrap_url", "t1d_replace_emoji", "e4_wordpiece_encode")
    own, other, found = spark.conf.get(key, None), spark.newSession(), queries()

    def in_thread():  # no session is active in a new thread
        try:
            nfkc("t")
            seen.append(spark.conf.get(key, None))
            for name in names:
                other.conf.unset(key)
                found[name](other, SF001)
                seen.append(other.conf.get(key, None))
        except Exception as e:
            seen.append(e)

    try:
        spark.conf.unset(key)
        run = threading.Thread(target=in_thread)
        run.start()
        run.join()
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
    assert seen == [str(4 << 20)] * 6


def test_words_are_cut_from_one_tidied_text(spark):
    df = spark.createDataFrame([(0, " A\n\nb  c "), (1, ""), (2, None), (3, " 　\t ")], "k int, t string")
    out = df.select("k", en.word_tokens("t").alias("w"))
    assert {r.k: r.w for r in out.collect()} == {0: ["a.", "b", "c"], 1: [], 2: None, 3: []}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2


def test_texts_are_read_once_for_pairs_and_equality(spark):
    for q in (array_queries.e8_special_tokens_mask, array_queries.e24_encoding_equality):
        assert "documents.parquet" not in q(spark, SF001)._jdf.queryExecution().toString()


def test_character_pairs_by_hand(spark):
    words = [("▁hola", 3), ("▁ho\nla", 2), ("a", 9), ("", 4), ("zzzz", 5), ("▁h\U0001F923o", 7)]
    df = spark.createDataFrame(words, "word string, n long")
    alpha = spark.createDataFrame([(c, i) for i, c in enumerate("▁hola\n")], "token string, id int")
    want: Counter = Counter()
    for w, n in words:
        kept = [c for c in w if c in "▁hola\n"]
        for pair in zip(kept, kept[1:]):
            want[pair] += n
    pairs = vb.initial_pair_counts(df, alpha)
    assert {(r.left, r.right): r.n for r in pairs.collect()} == dict(want)
    assert "array_contains" not in pairs._jdf.queryExecution().toString()
