"""Byte-pair merges over word types held as flat symbol arrays.

``WordTable`` is the state of one block of words: all symbols in one array, links
to the symbol before and after, the weight of every word, and an index from a
pair to the places where it starts. A merge goes straight to those places, so it
costs what it changes, not the number of words; the index follows, because every
pair that a merge makes holds the new symbol.

In Spark a block is one stored row (symbols and weights as bytes). Merging runs
in rounds over the stored blocks: apply what was committed since the blocks were
written, report how each of the guessed further merges changes the pair counts,
and now and then write the blocks anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pair = tuple[int, int]
BLOCK_WORDS = 200_000
END = -1


class WordTable:
    """Symbols of many words, each word followed by -1, under merges."""

    def __init__(self, sym: np.ndarray, weight: np.ndarray, pairs: Sequence[Pair] | None = None):
        """``pairs``: the ones to look up at first (all if None)."""
        self.sym = sym.astype(np.int32)
        self.word = np.cumsum(np.r_[0, sym[:-1] == END]) if len(sym) else np.empty(0, np.int64)
        self.weight = weight
        n = len(sym)
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        self.at: dict[Pair, list[np.ndarray]] = {}
        if n > 1:
            self._index(pairs)

    def _index(self, pairs) -> None:
        l, r = self.sym[:-1], self.sym[1:]
        if pairs is None:
            start = np.flatnonzero((l >= 0) & (r >= 0))
        else:
            size = int(self.sym.max()) + 1
            wanted = [(a, b) for a, b in pairs if a < size and b < size]
            # the last place answers for -1: no symbol
            left, right = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
            left[[a for a, _ in wanted]] = True
            right[[b for _, b in wanted]] = True
            start = np.flatnonzero(left[l] & right[r])
            codes = np.array(sorted(a * (1 << 32) + b for a, b in wanted), np.int64)
            code = l[start].astype(np.int64) * (1 << 32) + r[start]
            if len(codes):
                start = start[codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code]
        self._add(start)

    def _add(self, start: np.ndarray) -> None:
        """Index the pairs that start at these places (ascending)."""
        if not len(start):
            return
        code = self.sym[start].astype(np.int64) * (1 << 32) + self.sym[self.after[start]]
        order = np.argsort(code, kind="stable")
        code, start = code[order], start[order]
        cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        for a, b in zip(cut, np.r_[cut[1:], len(code)]):
            c = int(code[a])
            self.at.setdefault((c >> 32, c & 0xFFFFFFFF), []).append(start[a:b])

    def counts(self) -> dict[Pair, int]:
        """Weighted counts of all neighbouring pairs; only before any merge."""
        l, r = self.sym[:-1], self.sym[1:]
        start = np.flatnonzero((l >= 0) & (r >= 0)) if len(self.sym) > 1 else np.empty(0, np.int64)
        return self._totals([start], [1])

    def _totals(self, starts: list[np.ndarray], signs: list[int], codes: list[np.ndarray] | None = None) -> dict[Pair, int]:
        codes = codes or [self.sym[s].astype(np.int64) * (1 << 32) + self.sym[self.after[s]] for s in starts]
        code = np.concatenate(codes)
        if not len(code):
            return {}
        value = np.concatenate([self.weight[self.word[s]] * k for s, k in zip(starts, signs)])
        order = np.argsort(code, kind="stable")
        code, value = code[order], value[order]
        cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        total = np.add.reduceat(value, cut)
        return {(int(c) >> 32, int(c) & 0xFFFFFFFF): int(v) for c, v in zip(code[cut], total) if v}

    def merge(self, pair: Pair, new: int, report: bool = True) -> dict[Pair, int]:
        """Replace the pair by ``new``, left to right without overlap; how the pair counts change."""
        held = self.at.pop(pair, None)
        if not held:
            return {}
        i = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
        sym, after, before = self.sym, self.after, self.before
        j = after[i]
        live = (sym[i] == pair[0]) & (j < len(sym))
        i, j = i[live], j[live]
        live = sym[j] == pair[1]
        i, j = i[live], j[live]
        if pair[0] == pair[1] and len(i):  # in a run, every second start
            run = np.r_[True, i[1:] != j[:-1]]
            first = np.flatnonzero(run)
            within = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            i, j = i[within % 2 == 0], j[within % 2 == 0]
        if not len(i):
            return {}
        n = len(sym)
        left, right = before[i], after[j]
        has_left = (left >= 0) & (sym[np.maximum(left, 0)] >= 0)
        has_right = (right < n) & (sym[np.minimum(right, n - 1)] >= 0)
        if report:  # links that go: left of i, (i, j), right of j; a link between two merges once
            joined = np.r_[False, left[1:] == j[:-1]] & has_left
            gone = [left[has_left & ~joined], i, j[has_right]]
            old = [sym[s].astype(np.int64) * (1 << 32) + sym[after[s]] for s in gone]
        sym[i] = new
        sym[j] = -2  # no symbol any more
        after[i] = right
        before[right[right < n]] = i[right < n]
        made_left = left[has_left]
        # where the left neighbour was itself merged, the link starts at its new symbol
        prev = before[i[has_left]]
        fresh = np.unique(np.r_[prev, i[has_right]]) if len(made_left) else i[has_right]
        self._add(fresh)
        if not report:
            return {}
        now = self.sym[fresh].astype(np.int64) * (1 << 32) + self.sym[self.after[fresh]]
        return self._totals([*gone, fresh], [-1, -1, -1, 1], [*old, now])

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, weights) without the gaps; words of one symbol have no pair and go."""
        keep = self.sym != -2
        sym, word = self.sym[keep], self.word[keep]
        size = np.bincount(word[sym >= 0], minlength=len(self.weight)) if len(sym) else np.zeros(len(self.weight), np.int64)
        long = size > 1
        return sym[long[word]] if len(sym) else sym, self.weight[long]

    def copy(self) -> "WordTable":
        """The same state, to be merged apart."""
        out = WordTable.__new__(WordTable)
        out.sym, out.after, out.before = self.sym.copy(), self.after.copy(), self.before.copy()
        out.word, out.weight = self.word, self.weight
        out.at = {k: list(v) for k, v in self.at.items()}
        return out


def encode_words(words: Sequence[str], weights: np.ndarray, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with -1 after each word, weights): characters outside ``ids`` are dropped."""
    raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), "<u4").astype(np.int64) if len(words) else np.empty(0, np.int64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if len(words) else np.empty(0, np.int64)
    chars = np.array(sorted(map(ord, ids)), np.int64)
    value = np.array([ids[chr(c)] for c in chars], np.int32)
    at = np.searchsorted(chars, raw)
    sym = np.where(chars[np.minimum(at, len(chars) - 1)] == raw, value[np.minimum(at, len(chars) - 1)], -2) if len(chars) else np.full(len(raw), -2)
    sym[ends] = END
    return sym[sym != -2].astype(np.int32), weights


def _int_bytes(column: pa.ChunkedArray | pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def character_totals(words: DataFrame) -> DataFrame:
    """(ch, n): characters weighted by word count, added up in the task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            text = b.column("word").to_pylist()
            raw = np.frombuffer("".join(text).encode("utf-32-le"), "<u4")
            n = np.repeat(b.column("n").to_numpy(zero_copy_only=False), [len(w) for w in text])
            order = np.argsort(raw, kind="stable")
            cut = np.flatnonzero(np.r_[True, raw[order][1:] != raw[order][:-1]]) if len(raw) else np.empty(0, np.int64)
            if len(cut):
                total[raw[order][cut]] += np.add.reduceat(n[order], cut)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in some], pa.string()), pa.array(total[some])], ["ch", "n"])

    return words.mapInArrow(task, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))


def character_pairs(words: DataFrame, chars: Sequence[str]) -> DataFrame:
    """(left, right, n): neighbouring characters of the words (word, n) once all but ``chars`` are dropped."""
    ids = {c: i for i, c in enumerate(chars)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[Pair, int] = {}  # at most the square of len(chars)
        for b in batches:
            sym, weight = encode_words(b.column("word").to_pylist(), b.column("n").to_numpy(zero_copy_only=False), ids)
            for pair, n in WordTable(sym, weight, []).counts().items():
                total[pair] = total.get(pair, 0) + n
        left, right = ([chars[p[i]] for p in total] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(list(total.values()), pa.int64())], ["left", "right", "n"])

    return words.mapInArrow(task, "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def blocks(words: DataFrame, ids: dict[str, int]) -> DataFrame:
    """(sym binary, weight binary): the words (word, n) as blocks of at most ``BLOCK_WORDS``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_w, size = [], [], 0

        def row():
            t = WordTable(np.concatenate(held_s), np.concatenate(held_w), [])
            sym, weight = t.packed()
            return pa.RecordBatch.from_arrays([pa.array([sym.astype("<i4").tobytes()], pa.binary()), pa.array([weight.astype("<i8").tobytes()], pa.binary())], ["sym", "weight"])

        for b in batches:
            sym, weight = encode_words(b.column("word").to_pylist(), b.column("n").to_numpy(zero_copy_only=False), ids)
            held_s.append(sym)
            held_w.append(weight)
            size += b.num_rows
            if size >= BLOCK_WORDS:
                yield row()
                held_s, held_w, size = [], [], 0
        if size:
            yield row()

    return words.mapInArrow(task, "sym binary, weight binary")


def _change_batches(total: dict[tuple[int, int, int], int]) -> Iterator[pa.RecordBatch]:
    keys = list(total)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        columns = [pa.array([k[j] for k in part], pa.int32()) for j in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total[k] for k in part], pa.int64())], ["step", "left", "right", "n"])


def pair_totals(stored: DataFrame, done: Sequence[Pair], first_id: int) -> DataFrame:
    """(left, right, n) after the merges ``done``."""

    def task(batches):
        total: dict = {}
        for b in batches:
            for sym, weight in zip(_int_bytes(b.column("sym"), "<i4"), _int_bytes(b.column("weight"), "<i8")):
                t = WordTable(sym, weight, done)
                for k, pair in enumerate(done):
                    t.merge(pair, first_id + k, report=False)
                for (l, r), n in WordTable(*t.packed(), []).counts().items():
                    total[0, l, r] = total.get((0, l, r), 0) + n
        yield from _change_batches(total)

    return stored.mapInArrow(task, "step int, left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def changes(stored: DataFrame, done: Sequence[Pair], ahead: Sequence[Pair], first_id: int) -> DataFrame:
    """(step, left, right, n): how each merge of ``ahead``, after the merges ``done``, changes the pair counts."""

    def task(batches):
        total: dict = {}
        for b in batches:
            for sym, weight in zip(_int_bytes(b.column("sym"), "<i4"), _int_bytes(b.column("weight"), "<i8")):
                t = WordTable(sym, weight, [*done, *ahead])
                for k, pair in enumerate(done):
                    t.merge(pair, first_id + k, report=False)
                for k, pair in enumerate(ahead):
                    for (l, r), n in t.merge(pair, first_id + len(done) + k).items():
                        total[k, l, r] = total.get((k, l, r), 0) + n
        yield from _change_batches(total)

    return stored.mapInArrow(task, "step int, left int, right int, n long").groupBy("step", "left", "right").agg(F.sum("n").alias("n"))


def rewritten(stored: DataFrame, done: Sequence[Pair], first_id: int) -> DataFrame:
    """The blocks after the merges ``done``."""

    def task(batches):
        for b in batches:
            rows = []
            for sym, weight in zip(_int_bytes(b.column("sym"), "<i4"), _int_bytes(b.column("weight"), "<i8")):
                t = WordTable(sym, weight, done)
                for k, pair in enumerate(done):
                    t.merge(pair, first_id + k, report=False)
                rows.append(t.packed())
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.astype("<i4").tobytes() for s, _ in rows], pa.binary()), pa.array([w.astype("<i8").tobytes() for _, w in rows], pa.binary())], ["sym", "weight"]
            )

    return stored.mapInArrow(task, "sym binary, weight binary")
