"""Operator 12: phrase collocations by broadcast double-array tries.

A phrase of ``k`` words can only be frequent when both its phrases of ``k - 1``
words are (Apriori). The texts therefore become numbers once, one per frequent
(lang, word), with a break at every piece end and rare word, and are cut down
after each level to the runs in which every phrase of the level is a candidate.
All windows of ``k`` words of what is left are Apriori-safe.

One level, in two passes over the numbered texts:

1. *Sieve.* Every task sorts its windows and reports each distinct one with a
   count that stops at ``min_count``; Spark sums these. Only windows whose sum
   reaches ``min_count`` can be frequent: the candidates.
2. *Count.* Candidates in blocks of at most ``block`` entries become
   double-array tries over word numbers, which are broadcast packed, ``TRIES`` a
   pass. A task unpacks one at a time for every ``WALKED`` words of its texts.
   Numpy advances the states of all text positions that start with a first word
   of the trie together, one word level at a time
   (``next = base[state] + symbol``, kept where ``check[next] == state``), and
   bin-counts the accepting states; Spark sums the shards, of which there are
   as many as cores, not as splits of the texts. The same walk marks the
   positions that may start a phrase of the next level.

What is broadcast is at most ``TRIES`` blocks of ``block`` candidates or one of ``vocab_block``
words, however large the input; more blocks are more passes, never a larger broadcast. No window, no
text and no count is dropped: a level with no candidate ends the loop. Tables in
the checkpoint folder hold the numbered texts, so a lost executor repeats one
task of one pass. On disk are at most the texts that a pass reads and those it
writes: a pass sums its counts and drops what it read before the next one
begins, and so do passes over the vocabulary, which carry numbers and the words
that have none yet. A frequent word or language is no hot key: words, windows and
states are summed in the task first; the joins that turn numbers into counts and
words have one row a key on one side, so a split of the other side is exact.

Results in the corner cases: null text is the empty text and yields nothing;
null lang is ``und`` (together with a lang of that name); repeated rows and
repeated ids count as often as they stand; the id is not read. Ties of score are
ordered by ``a`` descending, then the phrase in UTF-8 byte order. A very long
text is sliced only where a piece ends, so no phrase is lost. Empty table or no
frequent phrase: no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import row_index
from ..session import bound_batches
from .common import LOWER, UPPER, ascii_lower, discard, freed, null_safe_text, pick, stored

PIECE_END = "[.,;:!?\\x0A-\\x0D]"
BETWEEN = "[\\x20\\x09]+"
SLICE_BYTES = 1 << 20
BUFFER = 1 << 18
PAIRS = 1 << 21
TRIES = 16
WALKED = 1 << 20
ROW_GROUP = 16 << 20
BREAK, UNKNOWN = -1, -2


def _bytes_table() -> bytes:
    """A–Z to a–z, piece ends to a line feed, tab to a space."""
    t = bytearray(range(256))
    for a, b in zip(UPPER, LOWER):
        t[ord(a)] = ord(b)
    for c in b".,;:!?\n\x0b\x0c\r":
        t[c] = 10
    t[9] = 32
    return bytes(t)


# --- words -----------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) over all texts."""
    pieces = texts.select("lang", F.explode(F.split(ascii_lower(F.col("text")), PIECE_END)).alias("piece"))
    words = pieces.select("lang", F.explode(F.split("piece", BETWEEN)).alias("word")).where(F.col("word") != "")
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def _looked_up(words: list[bytes], get) -> np.ndarray:
    return np.fromiter((get(w, UNKNOWN) for w in words), np.int64, len(words))


def _numbers(texts: list[str], table: bytes, get) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of some texts of one language, ``UNKNOWN`` for a word without one and ``BREAK`` at piece
    ends, and the words."""
    blob = "\n".join(texts).encode().translate(table)
    words = blob.split()
    if not words:
        return np.empty(0, np.int64), words
    ids = _looked_up(words, get)
    raw = np.frombuffer(blob, np.uint8)
    gap = (raw == 32) | (raw == 10)
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(raw == 10)
    piece = np.searchsorted(ends, start)
    out = np.full(len(ids) + int(piece[-1]) + 1, BREAK, np.int64)
    out[np.arange(len(ids)) + piece] = ids
    return out, words


def runs_of(ids: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The words of ``ids`` in runs of two or more neighbours ``ok`` (phrases of ``k - 1`` words that start
    there), each run followed by -1. Every window of ``k`` words whose two phrases are ok stands once."""
    edge = np.diff(np.r_[0, ok.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= 2
    first, size = first[long], (last - first)[long] + k - 2
    if not len(first):
        return np.empty(0, np.int64)
    ends = np.cumsum(size + 1)
    out = ids[np.minimum(np.repeat(first - (ends - size - 1), size + 1) + np.arange(ends[-1]), len(ids) - 1)]
    out[ends - 1] = -1
    return out


def _bytes_of(arrays: list[np.ndarray], kind: str = "<i4") -> pa.Array:
    return pa.array([a.astype(kind).tobytes() for a in arrays], pa.binary())


def _rows(arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_bytes_of(arrays)], names=["ids"])


def _each(col: pa.Array, kind: str = "<i4") -> Iterator[np.ndarray]:
    for v in col:
        yield np.frombuffer(v.as_buffer(), kind).astype(np.int64)


def _arrays(col: pa.Array) -> Iterator[np.ndarray]:
    """Arrays of the rows, short rows joined (they end in -1, so nothing runs over)."""
    held, size = [], 0
    for a in _each(col):
        held.append(a)
        size += len(a)
        if size >= BUFFER:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _kept(df: DataFrame) -> DataFrame:
    """Stored with small row groups (a row here is long, and a scan holds a row group) and packed well."""
    return stored(df, **{"parquet.block.size": ROW_GROUP, "compression": "zstd"})


def numbered(texts: DataFrame, frequent: DataFrame, n_frequent: int, block: int) -> DataFrame:
    """Table (ids): runs of two or more frequent words as 32-bit numbers. One pass a block of the
    vocabulary; while further blocks follow, the numbers are carried along with the words that have none yet."""
    if n_frequent >= 1 << 31:
        raise ValueError("word numbers have 32 bits")
    sc = texts.sparkSession.sparkContext
    blocks = range(0, max(n_frequent, 1), block)
    table, state = _bytes_table(), texts
    for at in blocks:
        vocab = sc.broadcast(frequent.where((F.col("id") >= at) & (F.col("id") < at + block)).select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow())
        done, carried = at + block >= n_frequent, at > 0

        def task(batches: Iterator[pa.RecordBatch], vocab=vocab, done=done, carried=carried):
            by_lang: dict[str, dict[bytes, int]] = {}
            for b in vocab.value.to_batches(max_chunksize=10_000):
                for lang, word, i in zip(*(c.to_pylist() for c in b.columns)):
                    by_lang.setdefault(lang, {})[word] = i

            for b in batches:
                langs, body = b.column("lang").to_pylist(), b.column("words" if carried else "text").to_pylist()
                if not done or carried:  # row by row: the words without a number stay beside what earlier blocks found
                    found, rest = [], []
                    before = _each(b.column("ids")) if carried else None
                    for lang, t in zip(langs, body):
                        get = by_lang.get(lang, {}).get
                        if carried:
                            ids, words = next(before), t.split()
                            new = ids[ids == UNKNOWN] = _looked_up(words, get)
                        else:
                            ids, words = _numbers([t], table, get)
                            new = ids[ids != BREAK]
                        found.append(ids)
                        rest.append(b"" if done else b" ".join(compress(words, (new == UNKNOWN).tolist())))
                    if not done:
                        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(rest, pa.binary()), _bytes_of(found)], names=["lang", "words", "ids"])
                    else:
                        yield _rows([r for r in (runs_of(a, a >= 0, 2) for a in found) if len(r)])
                    continue
                for lang in dict.fromkeys(langs):
                    get = by_lang.get(lang, {}).get
                    some, size = [], 0
                    for x, t in [*zip(langs, body), (lang, None)]:
                        if x != lang:
                            continue
                        if t is not None:
                            some.append(t)
                            size += len(t)
                        if some and (t is None or size >= SLICE_BYTES):
                            a, _ = _numbers(some, table, get)
                            kept = runs_of(a, a >= 0, 2)
                            if len(kept):
                                yield _rows([kept])
                            some, size = [], 0

        out = _kept(state.mapInArrow(task, "ids binary" if done else "lang string, words binary, ids binary"))
        if carried:
            discard(state)
        vocab.destroy()
        state = out
    return state


# --- double-array trie ------------------------------------------------------


class DoubleArray:
    """Trie over rows of word numbers (all of one length): ``base``, ``check`` and the row at each last state.

    A child of state ``s`` by symbol ``x`` is ``base[s] + x`` where ``check`` there is ``s``. The first word
    is one symbol; each further word is spelt in digits of 8 bits, so that a state has 256 children at
    most. States with many children have their window of 256 places alone, the others share places found
    by trial, states with one child take the gaps: at most a few dozen places a row, whatever the rows.
    """

    ALONE = 8

    def __init__(self, rows: np.ndarray):
        n, k = rows.shape
        self.words = np.unique(rows)
        width = len(self.words)
        self.digits = max(1, -(-(width - 1).bit_length() // 8))
        self.depth = k
        sym = np.searchsorted(self.words, rows)
        shifts = [8 * d for d in range(self.digits - 1, -1, -1)]
        steps = np.column_stack([sym[:, 0], *[(sym[:, j] >> s) & 255 for j in range(1, k) for s in shifts]])
        order = np.lexsort(steps.T[::-1])
        steps = steps[order]
        self.shared = width + 1 + 512  # places from here to the windows are found by trial
        self.free = np.ones(self.shared + 2 * steps.size + 4096, dtype=bool)
        self.windows = len(self.free)
        self.base, self.check = np.zeros(len(self.free), np.int32), np.full(len(self.free), -1, np.int32)
        self.draw = np.random.default_rng(0)
        self.free[: width + 1] = False
        self.base[0] = 1
        state = 1 + steps[:, 0]
        self.check[state] = 0
        for level in range(1, steps.shape[1]):
            new = np.r_[True, (state[1:] != state[:-1]) | (steps[1:, level] != steps[:-1, level])]
            place = self._place(state[new], steps[new, level])
            state = place[np.cumsum(new) - 1]
        self.row = np.full(len(self.check), -1, np.int32)
        self.row[state] = order
        del self.free, self.draw

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places of the children (sorted by parent); sets base and check."""
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        size = np.diff(np.r_[first, len(parent)])
        child_of = np.repeat(np.arange(len(first)), size)
        start = np.zeros(len(first), np.int64)
        alone = np.flatnonzero(size >= self.ALONE)
        start[alone] = self.windows + 256 * np.arange(len(alone))
        self._grow(256 * len(alone))
        for i in np.flatnonzero((size > 1) & (size < self.ALONE)):
            mine = symbol[first[i] : first[i] + size[i]]
            for b in self.draw.integers(self.shared - 256, len(self.free) - 256, 256):
                if self.free[b + mine].all():
                    break
            else:
                b = self.windows
                self._grow(256)
            start[i] = b
            self.free[b + mine] = False
        one = np.flatnonzero(size == 1)
        holes = self.shared + np.flatnonzero(self.free[self.shared :])[: len(one)]
        start[one] = holes - symbol[first[one]]
        self.free[holes] = False
        self.base[parent[first]] = start
        place = start[child_of] + symbol
        self.check[place] = parent
        return place

    def _grow(self, more: int) -> None:
        """Further windows behind the shared places."""
        self.windows += more
        self.base = np.r_[self.base, np.zeros(more, np.int32)]
        self.check = np.r_[self.check, np.full(more, -1, np.int32)]

    def packed(self) -> tuple:
        arrays = [(a.dtype.str, a.nbytes, pa.compress(a, "zstd", asbytes=True)) for a in (self.words, self.base, self.check, self.row)]
        return self.depth, self.digits, arrays

    @classmethod
    def of(cls, packed: tuple) -> "DoubleArray":
        out = cls.__new__(cls)
        out.depth, out.digits, arrays = packed
        out.words, out.base, out.check, out.row = (np.frombuffer(pa.decompress(body, size, "zstd"), kind) for kind, size, body in arrays)
        return out

    def _symbols(self, ids: np.ndarray) -> np.ndarray:
        """Places of the numbers among the trie's words, -1 for another."""
        at = np.searchsorted(self.words, ids)
        return np.where(self.words[np.minimum(at, len(self.words) - 1)] == ids, at, -1)

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, rows) at which a row of the trie starts: all positions from its least to its greatest
        first word advance level by level."""
        k = self.depth
        if len(ids) < k:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = ids[: len(ids) - k + 1]
        least, greatest = self.words[np.flatnonzero(self.check[1 : len(self.words) + 1] == 0)[[0, -1]]]
        pos = np.flatnonzero((starts >= least) & (starts <= greatest))
        state = 1 + self._symbols(ids[pos])
        pos, state = pos[state > 0], state[state > 0]
        for level in range(1, k):
            x = self._symbols(ids[pos + level])
            live = x >= 0
            pos, state, x = pos[live], state[live], x[live]
            for d in range(self.digits - 1, -1, -1):
                nxt = self.base[state] + ((x >> (8 * d)) & 255)
                live = self.check[nxt] == state
                pos, state, x = pos[live], nxt[live], x[live]
        return pos, self.row[state]


# --- levels -----------------------------------------------------------------


def _windows(ids: np.ndarray, k: int, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """Two exact keys of every window of k words without a break: words 1, 2 and words 3, 4."""
    m = len(ids) - k + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.ones(m, bool)
    for j in range(k):
        whole &= ids[j : j + m] >= 0
    at = np.flatnonzero(whole)
    hi = ids[at] * radix + ids[at + 1]
    lo = np.zeros(len(hi) if k > 2 else 0, np.int64)
    for j in range(2, k):
        lo = lo * radix + ids[at + j]
    return hi, lo


def sieved(texts: DataFrame, k: int, radix: int, min_count: int) -> DataFrame:
    """Candidates (w: array of k word numbers): windows whose counts, stopped at ``min_count`` in every
    report, reach ``min_count`` together. A task reports after every ``PAIRS`` windows of two words, or
    ``BUFFER`` longer ones, which is what it holds."""

    room = PAIRS if k == 2 else BUFFER

    def report(hi, lo):
        if k == 2:
            hi.sort()  # in place: one number is the whole window
            first = np.flatnonzero(np.r_[True, hi[1:] != hi[:-1]])
        else:
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        for a in range(0, len(first), 1 << 16):
            f = first[a : a + (1 << 16)]
            n = np.diff(np.r_[f, first[a + (1 << 16)] if a + (1 << 16) < len(first) else len(hi)])
            second = np.zeros(len(f), np.int64) if k == 2 else lo[f]
            yield pa.RecordBatch.from_arrays([pa.array(hi[f]), pa.array(second), pa.array(np.minimum(n, min_count))], names=["hi", "lo", "n"])

    def task(batches: Iterator[pa.RecordBatch]):
        his, los, size = np.empty(room, np.int64), np.empty(0 if k == 2 else room, np.int64), 0
        for b in batches:
            for ids in _arrays(b.column("ids")):
                hi, lo = _windows(ids, k, radix)
                while len(hi):
                    part = min(len(hi), room - size)
                    his[size : size + part] = hi[:part]
                    if k > 2:
                        los[size : size + part] = lo[:part]
                    hi, lo, size = hi[part:], lo[part:], size + part
                    if size == room:
                        yield from report(his, los)
                        size = 0
        if size:
            yield from report(his[:size], los[:size])

    seen = texts.mapInArrow(task, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    r = F.lit(radix)
    hi, lo = F.col("hi"), F.col("lo")
    words = [F.expr(f"hi div {radix}"), hi % r]
    words += [] if k == 2 else [lo] if k == 3 else [F.expr(f"lo div {radix}"), lo % r]
    return seen.where(F.col("n") >= min_count).select(F.array(*[w.cast("long") for w in words]).alias("w"))


def _parts(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, marks, where a row of the result ends) of the rows, in parts of ``WALKED`` words or more."""
    held, marks, size = [], [], 0

    def joined():
        part = np.concatenate(held), np.concatenate(marks), np.cumsum([len(x) for x in held])[:-1]
        held.clear()
        marks.clear()
        return part

    for b in batches:
        if first:
            found = ((ids, np.zeros(len(ids), np.uint8)) for ids in _arrays(b.column("ids")))
        else:
            found = zip(_each(b.column("ids")), (np.frombuffer(v.as_buffer(), np.uint8) for v in b.column("ok")))
        for ids, mark in found:
            held.append(ids)
            marks.append(mark)
            size += len(ids)
            if size >= WALKED:
                yield joined()
                size = 0
    if held:
        yield joined()


def _trie_of(candidates: DataFrame, at: int, block: int) -> tuple[int, int, tuple]:
    """(first idx, entries, packed trie) of one block of candidates."""
    mine = candidates.where((F.col("idx") >= at) & (F.col("idx") < at + block)).select("idx", "w").toArrow()
    rows = np.array(mine.column("w").to_pylist(), dtype=np.int64)
    return at, len(rows), DoubleArray(rows[np.argsort(mine.column("idx").to_numpy())]).packed()


def counted(texts: DataFrame, candidates: DataFrame, n: int, k: int, block: int, last_level: bool) -> tuple[DataFrame, DataFrame | None]:
    """((idx, f) of the candidates, a stored table whose ``ids`` are the texts cut down to the runs of the
    next level), one pass for ``TRIES`` blocks. ``texts``, a stored table, is discarded once it is read."""
    sc = texts.sparkSession.sparkContext
    state, counts = texts, None
    for at in range(0, n, TRIES * block):
        end = min(n, at + TRIES * block)
        shared = sc.broadcast([_trie_of(candidates, x, block) for x in range(at, end, block)])
        first, last = at == 0 or last_level, end == n

        def task(batches: Iterator[pa.RecordBatch], shared=shared, at=at, end=end, first=first, last=last):
            total = np.zeros(end - at, np.int64)
            names = ["idx", "n", "ids", "ok"]
            for ids, mark, ends in _parts(batches, first):
                for begin, size, packed in shared.value:
                    pos, row = DoubleArray.of(packed).walk(ids)
                    total[begin - at : begin - at + size] += np.bincount(row, minlength=size)
                    mark[pos] = 1
                if last_level:
                    continue
                out, oks = [], []
                for mine, ok in zip(np.split(ids, ends), np.split(mark, ends)):
                    kept = runs_of(mine, ok > 0, k + 1) if last else mine
                    if len(kept):
                        out.append(kept)
                        oks.append(ok)
                if out:
                    none = [pa.nulls(len(out), pa.int64())] * 2
                    yield pa.RecordBatch.from_arrays([*none, _bytes_of(out), pa.nulls(len(out), pa.binary()) if last else _bytes_of(oks, "u1")], names=names)
            some = np.flatnonzero(total)
            for a in range(0, len(some), 1 << 16):
                x = some[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(at + x), pa.array(total[x]), *[pa.nulls(len(x), pa.binary())] * 2], names=names)

        # each task reports every candidate it has met: no more tasks than run at once
        source = state.where(F.col("ids").isNotNull()).select("ids", *([] if first else ["ok"])).coalesce(sc.defaultParallelism)
        out = _kept(source.mapInArrow(task, "idx long, n long, ids binary, ok binary"))
        shared.destroy()
        some = stored(out.where(F.col("idx").isNotNull()).groupBy("idx").agg(F.sum("n").alias("f")))
        counts = some if counts is None else counts.unionByName(some)
        if last_level:
            discard(out)
        else:
            discard(state)
            state = out
        freed(sc)
    if last_level:
        discard(texts)
    return counts, None if last_level else state


# --- scores -----------------------------------------------------------------


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(phrases: DataFrame, all_counts: DataFrame, inside: tuple[int, int]) -> DataFrame:
    """(w, a, l, r, score) of the candidates that no longer one covers to ``inside`` (share, of)."""
    size = F.size("w")
    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = phrases.select("w", F.col("f").alias("a"), k).select("w", "a", "k", F.expr("slice(w, 1, k)").alias("wl"), F.expr("slice(w, k + 1, size(w) - k)").alias("wr"))
    left, right = (all_counts.select(F.col("w").alias(f"w{c}"), F.col("f").alias(c)) for c in "lr")
    cuts = cuts.join(left, "wl").join(right, "wr")
    score = F.expr("cast(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) as decimal(30,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.select("w", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("w", "a").agg(F.min("cut").alias("cut"))
    best = best.select("w", "a", "cut.l", "cut.r", "cut.score")
    start = F.explode(F.sequence(F.lit(1), F.col("size"))).alias("start")
    longer = phrases.where(size > 2).select("w", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    longer = longer.withColumn("size", F.size("w") - F.col("m") + 1).select("f", "w", "m", start)
    cover = longer.select(F.expr("slice(w, start, m)").alias("w"), "f").groupBy("w").agg(F.max("f").alias("cover"))
    share, of = inside
    covered = F.col("cover").isNotNull() & (F.lit(of).cast("decimal(8,0)") * _decimal("cover") >= F.lit(share).cast("decimal(8,0)") * _decimal("a"))
    return best.join(cover, "w", "left").where(~covered).drop("cover")


def mine(docs: DataFrame, min_count: int = 30, max_words: int = 4, inside: tuple[int, int] = (80, 100), block: int = 100_000, vocab_block: int = 400_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All collocations: (lang, phrase, a, l, r, n, score)."""
    if not 2 <= max_words <= 4:
        raise ValueError("max_words is 2, 3 or 4")
    texts = pick(docs, text=text_col, lang=lang_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), null_safe_text("text").alias("text"))
    sc = docs.sparkSession.sparkContext
    bound_batches(docs.sparkSession)
    words = stored(word_counts(texts))
    n_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = stored(row_index(words.where(F.col("f") >= min_count), [F.col("f").desc(), "lang", "word"], "id"))
    freed(sc)
    radix = frequent.count()
    levels = [frequent.select(F.array("id").alias("w"), "f")]
    state = numbered(texts, frequent, radix, vocab_block) if radix else None
    for k in range(2, max_words + 1 if radix else 2):
        candidates = stored(row_index(sieved(state.where(F.col("ids").isNotNull()).select("ids"), k, radix, min_count), ["w"], "idx"))
        freed(sc)
        n = candidates.count()
        if not n:
            discard(state)
            break
        counts, state = counted(state, candidates, n, k, block, k == max_words)
        levels.append(stored(candidates.join(counts, "idx").where(F.col("f") >= min_count).select("w", "f")))
    spark = docs.sparkSession
    if len(levels) == 1:
        return spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    phrases = levels[1]
    for more in levels[2:]:
        phrases = phrases.unionByName(more)
    kept = stored(scored(phrases, phrases.unionByName(levels[0]), inside))
    each = kept.select("w", F.posexplode("w").alias("pos", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelt = each.groupBy("w").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("words"))
    spelt = spelt.select("w", "lang", F.concat_ws(" ", F.col("words.word")).alias("phrase"))
    return kept.join(spelt, "w").join(n_lang, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top(found: DataFrame, first: int = 2000) -> DataFrame:
    """The best ``first`` of each language, ranked from 1."""
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(min_count: int = 30, first: int = 2000) -> str:
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PIECE_END}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '{BETWEEN}'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) t(k)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {min_count}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k >= 2),
halves AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(v[1:j], ' ') AS lp, array_to_string(v[j + 1:k], ' ') AS rp FROM c, range(1, 4) t(j) WHERE j < k),
cuts AS (SELECT h.lang, h.phrase, a, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.lp JOIN f r ON r.lang = h.lang AND r.phrase = h.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
cover AS (SELECT lang, phrase, max(f) AS f FROM (
  SELECT lang, a AS f, array_to_string(v[s:s + m - 1], ' ') AS phrase FROM c, range(2, 4) t(m), range(1, 4) u(s) WHERE m < k AND s + m - 1 <= k) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN cover USING (lang, phrase) WHERE cover.f IS NULL OR 100::HUGEINT * cover.f < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= {first}"""
