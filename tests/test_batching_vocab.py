"""Batching (E13, E15–E17, E19, E20), row index, and BPE (E1, E4) goldens."""

import os
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecorpus.operators import batching as bt
from tidecorpus.operators import vocab as vb
from tidecorpus.operators.indexing import group_index
from tidecorpus.sources.text import read_lines


def _two_files(tmp):
    with open(os.path.join(tmp, "f1.txt"), "w") as f:
        f.write("\n".join(f"f1t{i}" for i in range(1, 5)) + "\n")
    with open(os.path.join(tmp, "f2.txt"), "w") as f:
        f.write("\n".join(f"f2t{i}" for i in range(1, 6)) + "\n")


def test_batches_across_and_within_files(spark):
    tmp = tempfile.mkdtemp(prefix="tc-lines-", dir="/tmp")
    _two_files(tmp)
    lines = read_lines(spark, tmp).withColumn("mid", F.monotonically_increasing_id())
    across = bt.batches_across_files(lines, ["file_path", "block_start", "mid"], 3)
    got = across.groupBy("batch_id").agg(F.sort_array(F.collect_list("value")).alias("v")).orderBy("batch_id").collect()
    assert [r["v"] for r in got] == [["f1t1", "f1t2", "f1t3"], ["f1t4", "f2t1", "f2t2"], ["f2t3", "f2t4", "f2t5"]]
    within = bt.batches_within_files(lines, "file_path", ["block_start", "mid"], 3)
    got = within.groupBy("file_path", "batch_in_file").agg(F.sort_array(F.collect_list("value")).alias("v")).orderBy("file_path", "batch_in_file").collect()
    assert [r["v"] for r in got] == [["f1t1", "f1t2", "f1t3"], ["f1t4"], ["f2t1", "f2t2", "f2t3"], ["f2t4", "f2t5"]]


def test_group_index_equals_row_number(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("aab"), rnd.randint(0, 50)) for i in range(2000)]  # hot group "a"
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = group_index(df, ["v", "id"], ["g"], "idx").select("id", "idx")
    want = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1).alias("idx"))
    assert sorted(got.collect()) == sorted(want.collect())
    glob = group_index(df, ["v", "id"], [], "idx").select("id", "idx")
    want = df.select("id", (F.row_number().over(Window.orderBy("v", "id")) - 1).alias("idx"))
    assert sorted(glob.collect()) == sorted(want.collect())


def test_dynamic_pad_epochs_limit(spark):
    df = spark.createDataFrame([(1, [5]), (2, [5, 6, 7]), (3, [5, 6])], "id long, ids array<int>").withColumn("b", F.lit(0))
    out = bt.dynamic_pad(df, "ids", "b", 1, 8).orderBy("id").collect()
    assert [len(r["ids"]) for r in out] == [8, 8, 8]
    out = bt.dynamic_pad(df, "ids", "b", 1, None).orderBy("id").collect()
    assert [r["ids"] for r in out] == [[5, 1, 1], [5, 6, 7], [5, 6, 1]]
    assert bt.repeat_epochs(df, 3, "id").count() == 9
    idx = df.withColumn("row_index", F.col("id") - 1)
    assert bt.limit_rows(idx, "row_index", 0).count() == 3
    assert bt.limit_rows(idx, "row_index", None).count() == 3
    assert bt.limit_rows(idx, "row_index", 2).count() == 2


def test_length_grouped_batches_cover_all(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(100)], "id long, n int")
    b = bt.length_grouped_batches(df, "id", "n", 8, seed=1, mega=2).collect()
    sizes = Counter(r["batch_id"] for r in b)
    assert sum(sizes.values()) == 100 and max(sizes.values()) <= 8


def _brute_bpe(lines, vocab_size, min_freq, specials):
    words = Counter()
    for line in lines:
        for w in line.split(" "):
            words["▁" + w] += 1
    chars = sorted({c for w in words for c in w})
    ids = {t: i for i, t in enumerate(specials)}
    for c in chars:
        ids[c] = len(ids)
    seqs = {w: [ids[c] for c in w] for w in words}
    tok = {i: t for t, i in ids.items()}
    merges = []
    while len(tok) < vocab_size:
        pc = Counter()
        for w, s in seqs.items():
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += words[w]
        cands = [(-n, p) for p, n in pc.items() if n >= min_freq]
        if not cands:
            break
        _, (a, b) = min(cands)
        new = len(tok)
        tok[new] = tok[a] + tok[b]
        merges.append((tok[a], tok[b]))
        for w, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return [tok[i] for i in range(len(tok))], merges


def test_bpe_golden(spark):
    lines = ["ab ab cd cd ef", "ab cd"] * 3
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    m = vb.train_bpe(df, "text", vocab_size=100, min_frequency=2, limit_alphabet=400, specials=["<s>"])
    got = [r["token"] for r in m.vocab.orderBy("id").collect()]
    assert got == ["<s>", "a", "b", "c", "d", "e", "f", "▁", "ab", "cd", "▁ab", "▁cd", "ef", "▁ef"]


def test_bpe_matches_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "abcde"
    lines = [" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    m = vb.train_bpe(df, "text", vocab_size=30, min_frequency=2, limit_alphabet=400, specials=["<s>", "<pad>"], checkpoint_every=5)
    want_vocab, want_merges = _brute_bpe(lines, 30, 2, ["<s>", "<pad>"])
    assert [r["token"] for r in m.vocab.orderBy("id").collect()] == want_vocab
    assert [(r["left"], r["right"]) for r in m.merges.orderBy("rank").collect()] == want_merges
    enc = vb.bpe_encoder(spark, m)
    pieces = df.select(enc("text").alias("p")).collect()
    # every piece is in the vocabulary, and the pieces spell the word-marked text
    vocab = set(want_vocab)
    for line, r in zip(lines, pieces):
        assert all(p in vocab for p in r["p"])
        assert "".join(r["p"]) == "".join("▁" + w for w in line.split(" "))


def test_alphabet_limit_drops_rare(spark):
    df = spark.createDataFrame([("aaa bbb c",)], "text string")
    words = vb.word_counts(df, "text")
    a = [r["token"] for r in vb.alphabet(words, 2).orderBy("id").collect()]
    # counts a 3, b 3, ▁ 3, c 1: the top two by (count desc, char asc) are a, b
    assert a == ["a", "b"]


@pytest.mark.parametrize("seed,merges_per_round", [(11, 1), (11, 4), (11, 64), (12, 64), (13, 9)])
def test_rounds_equal_one_merge_at_a_time(spark, seed, merges_per_round):
    rnd = random.Random(seed)
    lines = [" ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 7))) for _ in range(5)) for _ in range(80)]
    df = spark.createDataFrame([(x,) for x in lines], "text string")
    got = vb.train_bpe(df, "text", vocab_size=40, min_frequency=2, specials=["<s>"], merges_per_round=merges_per_round)
    want_vocab, want_merges = _brute_bpe(lines, 40, 2, ["<s>"])
    assert [r["token"] for r in got.vocab.orderBy("id").collect()] == want_vocab
    assert [(r["left"], r["right"]) for r in got.merges.orderBy("rank").collect()] == want_merges


def test_hot_group_is_spread(spark):
    # one label holds a third of all rows: its rows must land in many tasks
    from tidecorpus.operators.indexing import range_tagged

    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 50}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, g string")
    tagged = range_tagged(df, ["id"], ["g"], partitions=16)
    per_task = {r["_pid"]: r["n"] for r in tagged.filter(F.col("g") == "hot").groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    assert len(per_task) >= 4 and max(per_task.values()) <= 2000 / 3


def test_id_encoder_equals_lookup_join(spark):
    from tidecorpus.operators import encode as en

    lines = ["ab abc cab", "bca zz ab", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "k long, text string")
    m = vb.train_bpe(df.filter(F.length("text") > 0), "text", vocab_size=20, min_frequency=1, limit_alphabet=400)
    direct = {r["k"]: r["ids"] for r in df.select("k", vb.bpe_id_encoder(spark, m)("text").alias("ids")).collect()}
    pieces = df.select("k", vb.bpe_encoder(spark, m)("text").alias("p"))
    joined = {r["k"]: r["ids"] for r in en.lookup_ids(pieces, "k", "p", m.vocab).collect()}
    assert direct == joined and direct[2] == []
