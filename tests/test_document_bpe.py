"""BPE of whole documents: 1,000 merges and more against a trainer that merges one pair at a time."""

import heapq
from collections import Counter

import duckdb
import pytest

from tidecorpus import constants as K
from tidecorpus.operators import vocab as vb
from tidecorpus.plans.registry import load_all

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def one_at_a_time(texts, vocab_size, min_frequency, limit_alphabet, specials):
    words = Counter(vb.MARK + w for t in texts if t for w in t.split(" "))
    chars = Counter()
    for w, n in words.items():
        for c in w:
            chars[c] += n
    kept = sorted(sorted(chars, key=lambda c: (-chars[c], c))[:limit_alphabet])
    ids = {c: len(specials) + i for i, c in enumerate(kept)}
    token = [*specials, *kept]
    seqs = [[ids[c] for c in w if c in ids] for w in words]
    weights, pairs, where = list(words.values()), Counter(), {}
    for i, s in enumerate(seqs):
        for p in zip(s, s[1:]):
            pairs[p] += weights[i]
            where.setdefault(p, set()).add(i)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    merges = []
    while len(token) < vocab_size and heap:
        n, (a, b) = heapq.heappop(heap)
        if -n != pairs[a, b]:
            continue
        if -n < min_frequency:
            break
        merges.append((token[a], token[b], len(merges)))
        changed = set()
        for i in where[a, b]:
            s, out = seqs[i], []
            for p in zip(s, s[1:]):
                pairs[p] -= weights[i]
                changed.add(p)
            for x in s:
                if out and out[-1] == a and x == b:
                    out[-1] = len(token)
                else:
                    out.append(x)
            for p in zip(out, out[1:]):
                pairs[p] += weights[i]
                where.setdefault(p, set()).add(i)
                changed.add(p)
            seqs[i] = out
        token.append(token[a] + token[b])
        for p in changed:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
    return merges, token


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").select("text").collect()]


def test_document_queries_equal_one_merge_at_a_time(spark, texts):
    want, token = one_at_a_time(texts, 5 + K.LIMIT_ALPHABET + 1000, K.MIN_FREQUENCY, K.LIMIT_ALPHABET, K.SEQUENCE_SPECIALS)
    assert len(want) >= 1000
    q = load_all()
    got = q["e1d_bpe_merges"].fn(spark, SF01).orderBy("rank").collect()
    assert [tuple(r) for r in got] == want
    vocab = q["e1_e2_bpe_vocabulary"].fn(spark, SF01).orderBy("id").collect()
    assert [(r["token"], r["id"]) for r in vocab] == [(t, i) for i, t in enumerate(token)]


@pytest.mark.parametrize("sample,pairs,ahead", [(40, 60, 16), (2000, 300, 100)])
def test_guesses_from_few_words_and_few_pairs_change_nothing(spark, sample, pairs, ahead):
    df = spark.read.parquet(f"{SF001}/documents.parquet").limit(60).select("text").cache()
    want, _ = one_at_a_time([r["text"] for r in df.collect()], 160, 4, 60, ["<s>"])
    m = vb.train_bpe(df, "text", 160, 4, 60, ["<s>"], merges_per_round=ahead, sample_words=sample, most_pairs=pairs)
    assert [tuple(r) for r in m.merges.orderBy("rank").collect()] == want


def test_documents_are_encoded_whole(spark):
    rows = load_all()["e4_bpe_encode"].fn(spark, SF001).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        if K.UNK not in r["pieces"]:
            assert "".join(r["pieces"].split(" ")) == "".join(vb.MARK + w for w in texts[r["doc_id"]].split(" ")) if texts[r["doc_id"]] else r["pieces"] == ""
        assert len(r["ids"].split(",")) == len(r["pieces"].split(" "))


@pytest.mark.parametrize("name", ["e1a_document_word_counts", "e1b_document_alphabet", "e1c_document_pair_counts"])
def test_document_twins(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    q = load_all()[name]
    assert sorted(map(tuple, q.fn(spark, SF001).collect())) == sorted(c.execute(q.sql).fetchall())
