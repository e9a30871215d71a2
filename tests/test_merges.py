"""Symbol arrays under merges against lists merged one word at a time."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecorpus.operators import merges as mg
from tidecorpus.operators import vocab as vb


def _merged(words, pair, new):
    out = []
    for w in words:
        t, k = [], 0
        while k < len(w):
            hit = k + 1 < len(w) and (w[k], w[k + 1]) == pair
            t.append(new if hit else w[k])
            k += 2 if hit else 1
        out.append(t)
    return out


def _counts(words, weights):
    c = Counter()
    for w, n in zip(words, weights):
        for p in zip(w, w[1:]):
            c[p] += n
    return {k: v for k, v in c.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_changes_are_exact(seed):
    r = random.Random(seed)
    for _ in range(40):
        size = r.randint(1, 4)
        words = [[r.randrange(size) for _ in range(r.randint(0, 12))] for _ in range(r.randint(1, 12))]
        weights = [r.randint(1, 9) for _ in words]
        t = mg.WordTable(np.array([x for w in words for x in [*w, mg.END]], np.int32), np.array(weights))
        now = Counter(_counts(words, weights))
        assert t.counts() == now
        for new in range(size, size + 12):
            pairs = [k for k, v in now.items() if v]
            if not pairs:
                break
            pair, apart = r.choice(pairs), t.copy()
            change = t.merge(pair, new)
            words = _merged(words, pair, new)
            now.update(change)
            assert {k: v for k, v in now.items() if v} == _counts(words, weights)
            assert t.packed()[0].tolist() == [x for w in words if len(w) > 1 for x in [*w, mg.END]]
            assert apart.merge(pair, new) == change  # the copy was left alone


def test_rounds_rewrites_and_samples_give_one_result(spark):
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdé\n") for _ in range(r.randint(0, 9))) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    kw = dict(vocab_size=70, min_frequency=2, limit_alphabet=6)
    merges = lambda m: [(x["left"], x["right"]) for x in m.merges.orderBy("rank").collect()]
    want = merges(vb.train_bpe(df, "text", merges_per_round=1, **kw))
    assert len(want) > 40
    assert merges(vb.train_bpe(df, "text", rewrite_every=5, sample_words=20, **kw)) == want
    assert merges(vb.train_bpe(df, "text", most_pairs=7, **kw)) == want


def test_blocks_and_characters(spark):
    words = spark.createDataFrame([("▁abc", 3), ("▁a", 2), ("▁x\nz", 1), ("", 5)], "word string, n long").coalesce(1)
    got = {r["ch"]: r["n"] for r in mg.character_totals(words).collect()}
    want = words.select(F.explode(F.split("word", "")).alias("ch"), "n").where("ch != ''").groupBy("ch").agg(F.sum("n").alias("n"))
    assert got == {r["ch"]: r["n"] for r in want.collect()}
    ids = {"▁": 0, "a": 1, "c": 2, "\n": 3}
    row = mg.blocks(words, ids).collect()[0]
    assert np.frombuffer(row["sym"], "<i4").tolist() == [0, 1, 2, -1, 0, 1, -1, 0, 3, -1] and np.frombuffer(row["weight"], "<i8").tolist() == [3, 2, 1]
