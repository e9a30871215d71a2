import bisect
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecorpus.llm import packing

BPE = P.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    gaps, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        if i < len(gaps):
            g = gaps.pop(i)
        else:
            g, bins = capacity, bins + 1
        if g > n:
            bisect.insort(gaps, g - n)
    return bins


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_best_fit_is_gapless_and_close_to_best_fit_decreasing(spark):
    rng = random.Random(3)
    lengths = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    for per_range in (200, 10_000):  # many ranges, and one
        out = packing.best_fit(df, 100, per_range).join(df, "id").collect()
        assert sorted(r["id"] for r in out) == list(range(3000))
        bins = check_places(out, 100)
        assert bins <= 1.01 * best_fit_decreasing(lengths, 100) + 1


def test_a_round_does_not_depend_on_ranges(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.randint(1, 50)) for i in range(800)], "id long, length long")
    a, b = (sorted(map(tuple, packing.best_fit(df, 100, n).collect())) for n in (50, 10_000))
    assert a == b


def test_match_is_bracket_matching():
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 2, 500)
    stack, want = [], []
    for i, k in enumerate(kind):
        if k == 0:
            stack.append(i)
        want.append(stack.pop() if k == 1 and stack else -1)
    assert packing._match(kind).tolist() == want


def test_encoder_equals_tokenizer():
    tok, enc = Tokenizer.from_file(BPE), packing.encoder(BPE, P.PATTERN)
    rng = random.Random(5)
    pool = ["a", " ", "  ", "\n", "\t", "Hello", "don't", "é", "漢字", "😀", "123", "!?", "<|endoftext|>", " ", "\r\n", "the"]
    for _ in range(2000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_arrays_of_texts_equal_tokenizer():
    tok, enc = Tokenizer.from_file(BPE), packing.batch_encoder(BPE, P.PATTERN)
    rng = random.Random(6)
    pool = ["a", " ", "  ", "\n", "\t", "Hello", "don't", "é", "漢字", "😀", "123", "!?", "<|endoftext|>", "\u00a0", "\u3000", "\r\n", "the", " b", "\x85", "\x1c"]
    for kind in (pa.string(), pa.large_string()):
        for _ in range(150):
            texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 15))]
            ids, stops = enc(pa.array(texts, kind), (0,))
            want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
            assert [x.tolist() for x in np.split(ids, stops)] == [*want, []], texts


def test_a_distinct_word_is_encoded_once_an_array(monkeypatch):
    import tiktoken

    given = []

    class Counted(tiktoken.Encoding):
        def encode_to_numpy(self, text, **options):
            given.append(len(text))
            return super().encode_to_numpy(text, **options)

    monkeypatch.setattr(tiktoken, "Encoding", Counted)
    enc = packing.batch_encoder(BPE, P.PATTERN)
    words = [f"w{i:06d}" for i in range(300)]
    rng = random.Random(7)
    texts = [" ".join(rng.sample(words, 300)) for _ in range(50)]
    ids, stops = enc(pa.array(texts))
    assert sum(given) <= 300 * 8 + 50 * 7 and len(given) <= 51  # the words, and each text's first
    tok = Tokenizer.from_file(BPE)
    assert [x.tolist() for x in np.split(ids, stops)[:-1]] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_and_blocks_change_nothing(spark, awkward, monkeypatch):
    rows = lambda: sorted(map(tuple, packing.token_pieces(awkward, BPE, P.PATTERN, 16).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(packing, "SLICE_BYTES", 64)
    monkeypatch.setattr(packing, "UNITS", 3)
    assert rows() == whole and any(r[1] for r in whole)


def test_pack_round_trip(spark, awkward):
    tok = Tokenizer.from_file(BPE)
    out = packing.pack(awkward, BPE, P.PATTERN, 64, 0).collect()
    check_places(out, 64)
    want = sorted(([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in awkward.collect()))
    docs = {}
    for r in out:
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 64
        docs.setdefault((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]), []).append(r)
    whole = sorted(x for r in out if r["piece"] == 0 and r["length"] < 64 for x in [r["ids"]] if len(x) < 64 and x[-1] == 0)
    assert whole == sorted(w for w in want if len(w) < 64)
    assert sum(r["length"] for r in out) == sum(map(len, want))
    assert all(r["length"] == 64 for r in out if r["piece"] > 0)


def test_empty(spark, nothing):
    assert packing.pack(nothing, BPE, P.PATTERN).count() == 0
    assert packing.pack(nothing.select("doc_id", "text").limit(0), BPE, P.PATTERN, keep_ids=False).agg(F.count("*")).first()[0] == 0
