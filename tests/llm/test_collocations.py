"""Operator 12 against plain counting, its double array against a dictionary, corner cases, several blocks."""

import re
from collections import Counter

import numpy as np
import pytest

from tidecorpus.llm import collocations
from tidecorpus.llm.collocations import DoubleArray


def plain(rows, min_count, first=2000):
    """rows: (text, lang)."""
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            c = counts.setdefault(lang, Counter())
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        for rank, (s, _, phrase, a, le, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, phrase.decode(), a, le, r, n[lang], -s))
    return sorted(out)


def texts(seed, n):
    r = np.random.default_rng(seed)
    words = ["New", "york", "city", "HALL", "é", "ÉCOLE", "x-y", "a", "b", "c#", "日本", "the", "of"] + [f"r{i}" for i in range(400)]
    p = np.r_[np.full(13, 0.06), np.full(400, 0.22 / 400)]
    out = []
    for _ in range(n):
        w = list(r.choice(words, r.integers(0, 60), p=p))
        for _ in range(r.integers(0, 6)):
            w.insert(r.integers(0, len(w) + 1), r.choice(["new york city hall", "the of", ".", "\n", "\t", "  a  b", ",;", "the the the"]))
        out.append((" ".join(w), r.choice(["en", "fr"])))
    return out


@pytest.mark.parametrize("rows", [1, 40, 5000])
def test_double_array(rows):
    r = np.random.default_rng(rows)
    k, vocab = 1 + rows % 3 + 1, 10 if rows == 1 else 900
    table = np.unique(r.zipf(1.4, (rows, k)) % vocab * 5 + 2, axis=0)
    table = table[r.permutation(len(table))]
    ids = np.where(r.random(20000) < 0.05, -1, r.zipf(1.4, 20000) % vocab * 5 + 2)
    look = {tuple(x): i for i, x in enumerate(table.tolist())}
    all_ids = ids.tolist()
    want = [(i, look[tuple(all_ids[i : i + k])]) for i in range(len(ids) - k + 1) if tuple(all_ids[i : i + k]) in look]
    assert [tuple(map(int, x)) for x in zip(*DoubleArray(table).walk(ids))] == want


def test_runs_hold_every_window_once():
    r = np.random.default_rng(5)
    for k in (2, 3, 4):
        ids = np.where(r.random(500) < 0.1, -1, r.integers(0, 9, 500))
        ok = (r.random(500) < 0.7) & np.r_[[(ids[i : i + k - 1] >= 0).all() and i + k - 1 <= 500 for i in range(500)]]
        out = collocations.runs_of(ids, ok, k)
        got = Counter(tuple(out[i : i + k]) for i in range(len(out) - k + 1) if (out[i : i + k] >= 0).all())
        want = Counter(tuple(ids[i : i + k]) for i in range(500 - k + 1) if ok[i] and ok[i + 1])
        assert got == want


@pytest.mark.parametrize("block", [100_000, 7])
def test_plain_counting(spark, block):
    rows = [*texts(1, 250), *texts(1, 5), (None, "en"), ("", "fr"), ("new york " * 40, None), ("new york " * 10, "und")]
    df = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, word string, f int").repartition(4)
    min_count = 12 if block > 7 else 40
    got = collocations.top(collocations.mine(df, min_count=min_count, block=block, vocab_block=4 * block))
    assert sorted(map(tuple, got.collect())) == plain(rows, min_count)


def test_top_and_empty(spark, nothing):
    rows = texts(2, 120)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.top(collocations.mine(df, min_count=8), 5)
    assert sorted(map(tuple, got.collect())) == plain(rows, 8, 5)
    assert collocations.top(collocations.mine(nothing)).count() == 0
    assert collocations.mine(df.limit(2)).count() == 0


def test_awkward(spark, awkward):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    got = collocations.top(collocations.mine(awkward, min_count=2))
    want = plain([r for r in rows if r[0] is None or len(r[0]) < 9000], 2)
    short = {r for r in map(tuple, got.collect()) if r[0] == "en"}
    assert short == {w for w in want if w[0] == "en"}
    long_text = [(" ".join(f"w{i % 50}" for i in range(40_000)), "en")]
    got = collocations.mine(spark.createDataFrame(long_text, "text string, lang string")).collect()
    assert {r.a for r in got} == {797, 798, 799, 800} - {797, 798} or len(got) == 50


def test_disk_holds_two_texts_whatever_the_blocks(spark, monkeypatch):
    """Tables of texts that stand at once, at each write: what the pass reads and what it has written."""
    live, most, carried = {}, [0], []
    stored, discard = collocations.stored, collocations.discard

    def store(df, **options):
        out = stored(df, **options)
        if "ids" in df.columns:
            live[out._tide_path] = True
            carried.extend(set(df.columns) & {"text"})
            most[0] = max(most[0], len(live))
        return out

    def drop(df):
        live.pop(getattr(df, "_tide_path", None), None)
        discard(df)

    monkeypatch.setattr(collocations, "stored", store)
    monkeypatch.setattr(collocations, "discard", drop)
    monkeypatch.setattr(collocations, "TRIES", 2, raising=False)
    rows = texts(3, 120)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.top(collocations.mine(df, min_count=10, block=15, vocab_block=9))
    assert sorted(map(tuple, got.collect())) == plain(rows, 10)
    assert most[0] == 2 and not live and not carried
