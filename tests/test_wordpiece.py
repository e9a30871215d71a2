"""WordPiece against a plain longest-match loop over a set; added tokens; vocabulary files; bounded memo."""

import os
import random
import tempfile
import unicodedata

import pytest

from tidecorpus.operators import wordpiece as wp

VOCAB = [*wp.SPECIALS, "a", "ab", "abc", "b", "c", "ca", "##a", "##b", "##bc", "##c", "##cab", "é", "ñ", "##ñ", ".", ",", "@", "中", "u", "##u", "x", "##x"]
ADDED = ["@usuario", "url", "hashtag", "emoji", "url2"]


def plain(text, vocab, added, lowercase=True, max_word=100):
    """Nothing shared with the encoder: one character at a time, entries looked up in a set."""
    text = "".join(" " if c in "\t\n\r" or unicodedata.category(c) in ("Zs", "Zl", "Zp") else c for c in text)
    text = "".join(c for c in text if c == " " or (c != "�" and unicodedata.category(c) not in ("Cc", "Cf", "Cn", "Co")))
    text = text.lower() if lowercase else text
    parts, word, i = [], "", 0
    while i < len(text):
        hits = [a for a in added if text.startswith(a, i)]
        c = text[i]
        mark = (33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 or unicodedata.category(c).startswith("P") or 0x4E00 <= ord(c) <= 0x9FFF)
        if hits or c == " " or mark:
            parts, word = parts + [("w", word)] * bool(word), ""
        if hits:
            best = max(hits, key=len)
            parts.append(("a", best))
            i += len(best)
            continue
        if mark:
            parts.append(("w", c))
        elif c != " ":
            word += c
        i += 1
    out = []
    for kind, w in parts + [("w", word)] * bool(word):
        if kind == "a":
            out.append(w)
            continue
        pieces, at = [], 0
        while at < len(w) and len(w) <= max_word:
            for end in range(len(w), at, -1):
                piece = ("##" if at else "") + w[at:end]
                if piece in vocab and piece not in wp.SPECIALS:
                    pieces.append(piece)
                    at = end
                    break
            else:
                pieces = None
                break
        out += pieces if pieces and at == len(w) else [wp.UNK]
    return out


def test_random_texts():
    r = random.Random(0)
    bits = ["a", "b", "c", "abc", "A", "É", "ñ", "Ñ", "中", ".", ",", "@", "@usuario", "url", "URL", "url2", "hashtag", "emoji", " ", "  ", "\n", "\t", " ", " ", "​", "\x1c", "\x85", "�", "q", "[UNK]", "x" * 60, "😀"]
    model = wp.WordPiece(VOCAB, ADDED)
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        want = plain(t, set(VOCAB), ADDED)
        assert model.pieces(t) == want, t
        for cap in (0, 1, 5, 126):
            assert model.count(t, cap) == min(len(want), cap)


def test_added_tokens_are_leftmost_longest():
    model = wp.WordPiece(VOCAB, ADDED)
    assert model.pieces("curl2x") == ["c", "url2", "x"] and model.pieces("@usuarioab") == ["@usuario", "ab"]
    assert wp.WordPiece(VOCAB, []).pieces("curl") == [wp.UNK]
    with pytest.raises(ValueError):
        wp.WordPiece(VOCAB, ["two words"])


def test_word_limits_and_memory():
    model = wp.WordPiece(VOCAB, [])
    assert model.pieces("x" * 100) == ["x"] + ["##x"] * 99 and model.pieces("x" * 101) == [wp.UNK]
    model.count("abc" * 200_000, 126)
    assert not model.memo  # a long chunk is not remembered
    wp_chars, wp.MEMO_CHARS = wp.MEMO_CHARS, 500
    try:
        for i in range(400):
            model.pieces(f"abc{i}")
        assert len(model.memo) < 100
    finally:
        wp.MEMO_CHARS = wp_chars


def test_udfs_and_file(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tc-vocab-", dir="/tmp"), "vocab.txt")
    with open(path, "w") as f:
        f.write("\n".join(VOCAB) + "\n")
    vocab = wp.read_vocabulary(spark, path)
    assert [r["token"] for r in vocab.orderBy("id").collect()] == VOCAB
    texts = [None, "", "abc cab\nabc", "emoji q emoji abc emoji", "@usuario url"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["e"] for r in df.select("i", wp.encoder(vocab, ADDED)("text").alias("e")).collect()}
    ids = {t: i for i, t in enumerate(VOCAB)} | {a: len(VOCAB) + i for i, a in enumerate(ADDED)}
    for i, t in enumerate(texts):
        want = plain(t or "", set(VOCAB), ADDED)
        assert got[i]["pieces"] == want and got[i]["ids"] == [ids[p] for p in want]
    n = [r["n"] for r in df.orderBy("i").select(wp.token_counter(vocab, ADDED)("text").alias("n")).collect()]
    # newline runs are a full stop, an emoji span is one token
    assert n == [0, 0, len(plain("abc cab. abc", set(VOCAB), ADDED)), len(plain("emoji abc emoji", set(VOCAB), ADDED)), 2]
    assert wp.filter_corpus(df, vocab, min_tokens=2).count() == 3
