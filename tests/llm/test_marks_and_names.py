"""Operator 4 on runs of spaces by whole-text dynamic programming; operators 1 and 10 with any column names."""

import random

import public_tokenizers

from tidecorpus.llm import mixing, neardup
from tidecorpus.llm import token_count as tc

PIECES = tc.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
BY_TEXT = dict(PIECES)
LONGEST = max(map(len, BY_TEXT))


def whole_text(text):
    """(best score, pieces) over the whole marked text, every vocabulary match looked up in a dict."""
    if not text:
        return 0
    t = text.replace(" ", tc.MARK)
    t = t if t[0] == tc.MARK else tc.MARK + t
    unknown = min(BY_TEXT.values()) - tc.UNKNOWN_PENALTY
    best = [(0.0, 0, False)]
    for end in range(1, len(t) + 1):
        found = None
        for at in range(max(0, end - LONGEST), end):
            s = BY_TEXT.get(t[at:end])
            if s is not None and (found is None or best[at][0] + s > found[0]):
                found = (best[at][0] + s, best[at][1] + 1, False)
        if t[end - 1] not in BY_TEXT and (found is None or best[end - 1][0] + unknown > found[0]):
            found = (best[end - 1][0] + unknown, best[end - 1][1] + (not best[end - 1][2]), True)
        best.append(found)
    return best[-1][1]


def test_runs_of_spaces_are_pieces():
    counter = tc.Counter(PIECES)
    assert counter.count(" " * 16) == whole_text(" " * 16) == 1
    r = random.Random(0)
    for _ in range(300):
        text = "".join(r.choice(["    ", "  ", " ", "x = 1\n", "def", "return", "\t", "ümlaut", "漢字", tc.MARK, "a" * 9]) for _ in range(r.randint(0, 9)))
        assert counter.count(text) == whole_text(text), repr(text)


def test_long_words_are_not_remembered():
    counter = tc.Counter(PIECES)
    counter.count("漢" * 5000 + " " + "ab" * 200 + " short")
    assert all(len(w) <= tc.MEMO_WORD for w in counter.memo)


def test_column_names_of_the_caller(spark):
    names = ["_copies", "_e", "row", "times", "time", "k0", "of0", "content", "_tide_content", "keep_id", "copies", "a b", "x.y"]
    docs = spark.createDataFrame([(i, f"text number {i} of some words {i % 3}", "en", f"src{i % 2}", 5, *["q"] * len(names)) for i in range(12)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    out = mixing.mixed(docs, **mixing.PRODUCTION)
    assert out.columns == docs.columns and {tuple(r[5:]) for r in out.collect()} == {("q",) * len(names)}
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and {tuple(r[5:]) for r in kept.collect()} == {("q",) * len(names)}
