"""Vocabulary files and the word encoder."""

import random
import tempfile

from tidecorpus.operators import vocab as vb


def test_files_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tc-vocab-")
    vocab = spark.createDataFrame([("<s>", 0), ("▁", 1), ("ñ", 2), ('"', 3)], "token string, id int")
    merges = spark.createDataFrame([("▁", "ñ", 0), ("▁ñ", '"', 1)], "left string, right string, rank int")
    vb.save_vocabulary_files(vb.BpeModel(vocab, merges), d, "x")
    back = vb.load_vocabulary_files(spark, d, "x")
    assert sorted(map(tuple, back.vocab.collect())) == sorted(map(tuple, vocab.collect()))
    assert [(r["left"], r["right"]) for r in back.merges.orderBy("rank").collect()] == [("▁", "ñ"), ("▁ñ", '"')]


def merge_by_scans(word, ranks, alphabet):
    parts = [c if c in alphabet else "<unk>" for c in word]
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_word_encoder_by_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        symbols, ranks = list("abc"), {}
        for r in range(8):
            a, b = rng.choice(symbols), rng.choice(symbols)
            if (a, b) not in ranks:
                ranks[a, b] = r
                symbols.append(a + b)
        for _ in range(10):
            word = "".join(rng.choice("abcz") for _ in range(rng.randint(0, 20)))
            assert vb._bpe_word(word, ranks, set("abc"), {}) == merge_by_scans(word, ranks, set("abc")), (word, ranks)


def test_long_word_is_quick():
    ranks = {("a", "a"): 0, ("aa", "aa"): 1}
    assert len(vb._bpe_word("a" * 200_000, ranks, {"a"}, {})) == 50_000
