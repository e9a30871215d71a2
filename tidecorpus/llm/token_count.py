"""Token counts by a count-only Viterbi over a unigram vocabulary.

A text is split into words the way the piece vocabulary is used: every space
becomes the word mark, a mark is put in front unless one stands there, and a
word runs from a mark to the next. An Aho-Corasick automaton lists, for every position of a word, all
pieces that end there. Dynamic programming carries the best score and, with it,
the number of pieces; no path is kept.

Tie rules of the unigram tokenizer: a path replaces another only if its score
is strictly higher, and starts are tried from left to right, so of equal paths
the one with the earliest start (the longest last piece) stays. A position
where no piece of one character begins offers that character as unknown, at the
lowest score of the vocabulary less ``UNKNOWN_PENALTY``; neighbouring unknown
characters are one piece. Scores are added as doubles, in order of the text.

Counts of words add up to the text's count. Words are memoised for the worker's
life (emptied at ``MEMO`` words). Memory is that of one word's positions and the
automaton.

Null text is the empty text; an empty text has 0 tokens. Repeated rows get
equal counts. Extra columns pass through; ``n_tokens`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe_text, worker_cached

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 300_000
MEMO_WORD = 64
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")  # a run of marks with the word that follows


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a piece file; control, unknown and byte pieces match no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """Counts of words under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for p, s in pieces:
            self.auto.add_word(p, (len(p), s))
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if len(pieces):
            self.auto.make_automaton()
        self.empty = not pieces
        self.memo: dict[str, int] = {}
        # a cut before a run of marks crosses no piece, unless some piece holds a mark after another character
        crossing = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.parts = (lambda text: [text]) if crossing else SEGMENT.findall

    def count_word(self, word: str) -> int:
        """Pieces of the best path through one marked word."""
        # score, pieces and whether the last piece is unknown, at every position
        score, pieces, open_ = [0.0], [0], [False]
        single, unknown = self.single, self.unknown
        at_end: dict[int, list] = {}
        if not self.empty:
            for end, match in self.auto.iter(word):
                at_end.setdefault(end, []).append(match)
        for end, ch in enumerate(word):
            best, n, was_open = None, 0, False
            # the matches of one end come longest first, that is, by start
            for length, s in at_end.get(end, ()):
                at = end + 1 - length
                total = score[at] + s
                if best is None or total > best:
                    best, n = total, pieces[at] + 1
            if ch not in single:
                total = score[end] + unknown
                if best is None or total > best:
                    best, n, was_open = total, pieces[end] + (not open_[end]), True
            score.append(best)
            pieces.append(n)
            open_.append(was_open)
        return pieces[-1]

    def count(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        memo, total = self.memo, 0
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:  # a text that begins with a space has its mark already
            marked = MARK + marked
        for w in self.parts(marked):
            n = memo.get(w)
            if n is None:
                n = self.count_word(w)
                if len(w) <= MEMO_WORD:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = n
            total += n
        return total


def with_counts(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` of every whole text."""
    # the vocabulary is a file of bounded size; only it is sent to the executors
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_cached(("unigram", vocabulary_path), lambda: Counter(sent.value))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", counted(null_safe_text(text)))
