"""Subword vocabulary.

Training (byte-pair merges over metaspace words):

* E1a – the corpus shrinks to a *word-type* table ``(word, n)`` with one
  partial + final aggregate; everything after works on word types, whose
  number grows far slower than the corpus.
* E1b – alphabet: character counts weighted by ``n``; the ``limit_alphabet``
  most frequent are kept; characters outside it are dropped from words.
* E1c – pair counts: consecutive symbol pairs weighted by ``n``, summed.
* E1d – merge loop: the best pair (count desc, then left id, right id asc) is
  taken while its count ≥ ``min_frequency`` and the vocabulary is below
  ``vocab_size``. A round guesses many merges, one pass over the stored symbol
  arrays gives the exact changes of the pair counts at each, and those that were
  the best pair are committed. The driver holds pair counts (bounded) and a
  bounded sample of words, never the word table.

Encoding (E4) applies the learned merges by rank to each word in an Arrow
batch UDF with a per-worker memo, so each distinct word is encoded about once
per executor and the corpus is never shuffled for it.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.slices import pieces_and_ids, sliced_udf
from ..session import discard, shuffle_partitions, stored
from . import merges as mg

MARK = K.WORD_MARK
#: Words whose pieces a task remembers.
MEMO_WORDS = 50_000


def metaspace_words(text) -> Column:
    """E1a pre-split: each space-separated piece gets the word mark; consecutive
    spaces give a lone mark, as the metaspace pre-tokenizer does."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(t, " ", -1), lambda w: F.concat(F.lit(MARK), w))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over the corpus – partial aggregation absorbs hot words."""
    words = df.filter(F.length(text) > 0).select(F.explode_outer(metaspace_words(text)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def char_counts(words: DataFrame) -> DataFrame:
    """Characters weighted by word count."""
    ch = words.select(F.explode(F.split("word", "", -1)).alias("ch"), "n")
    return ch.groupBy("ch").agg(F.sum("n").alias("n"))


def alphabet(words: DataFrame, limit: int, specials: Sequence[str] = K.SEQUENCE_SPECIALS) -> DataFrame:
    """The ``limit`` most frequent characters (ties: char asc), ids after
    the specials in code-point order."""
    top = char_counts(words).orderBy(F.desc("n"), F.asc("ch")).limit(limit)
    w = Window.orderBy("ch")  # ≤ limit rows
    return top.select(F.col("ch").alias("token"), (F.row_number().over(w) - 1 + len(specials)).cast("int").alias("id"))


def initial_pair_counts(words: DataFrame, alpha: DataFrame) -> DataFrame:
    """E1c on the first round, as strings: consecutive kept characters of each
    word, weighted by the word count. Pairs are added up in the task."""
    kept = sorted(r["token"] for r in alpha.select("token").collect())  # ≤ limit_alphabet values
    return mg.character_pairs(words, kept)


def pair_counts(symbols: DataFrame) -> DataFrame:
    """(left, right, n) over a (sym array<int>, n) word table."""
    s = F.col("sym")
    z = F.arrays_zip(F.slice(s, 1, F.size(s) - 1).alias("l"), F.slice(s, 2, F.size(s) - 1).alias("r"))
    p = symbols.filter(F.size("sym") > 1).select(F.explode(z).alias("p"), "n")
    return p.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("n"))


def apply_merge(sym: Column, a: int, b: int, new: int) -> Column:
    """Replace each (a, b) pair left to right, non-overlapping, with ``new``."""
    empty = F.array().cast("array<int>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        hit = (F.size(acc) > 0) & (last == F.lit(a)) & (x == F.lit(b))
        return F.when(hit, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(new)))).otherwise(
            F.concat(acc, F.array(x))
        )

    return F.aggregate(sym, empty, step)


@dataclass
class BpeModel:
    vocab: DataFrame   # token STRING, id INT
    merges: DataFrame  # left STRING, right STRING, rank INT


class _Ranked:
    """Pair counts with the best pair (count desc, left id, right id asc) at hand."""

    def __init__(self, counts: dict[tuple[int, int], int]):
        self.counts = dict(counts)
        self.heap = [(-n, *pair) for pair, n in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[tuple[int, int] | None, int]:
        while self.heap:
            n, l, r = self.heap[0]
            now = self.counts.get((l, r), 0)
            if now == -n and now > 0:
                return (l, r), now
            heapq.heappop(self.heap)
            if 0 < now < -n:
                heapq.heappush(self.heap, (-now, l, r))
        return None, 0

    def add(self, changes: dict[tuple[int, int], int], known) -> None:
        for pair, d in changes.items():
            if d and known(pair):
                n = self.counts.get(pair, 0)
                self.counts[pair] = n + d
                if d > 0:
                    heapq.heappush(self.heap, (-(n + d), *pair))


def _word_sample(words: DataFrame, size: int) -> tuple[list[str], np.ndarray]:
    """Up to about ``size`` words for guesses: the most frequent half, and a weighted hash sample of the others."""
    total = words.count()
    if total <= size:
        all_words = words.toArrow()
        return all_words.column("word").to_pylist(), all_words.column("n").to_numpy()
    top = words.orderBy(F.desc("n"), F.asc("word")).limit(size // 2).toArrow()
    floor = top.column("n")[-1].as_py()
    step = -(-total // (size // 2))
    rest = words.filter((F.col("n") <= floor) & (F.pmod(F.xxhash64("word"), F.lit(step)) == 0)).toArrow()
    n = top.column("n").to_numpy()
    return [w for w, k in zip(top.column("word").to_pylist(), n) if k > floor] + rest.column("word").to_pylist(), np.r_[n[n > floor], rest.column("n").to_numpy() * step]


def train_bpe(
    df: DataFrame,
    text: str,
    vocab_size: int = K.VOCAB_SIZE,
    min_frequency: int = K.MIN_FREQUENCY,
    limit_alphabet: int = K.LIMIT_ALPHABET,
    specials: Sequence[str] = K.SEQUENCE_SPECIALS,
    checkpoint_every: int = 20,
    merges_per_round: int = 1024,
    sample_words: int = 200_000,
    most_pairs: int = 200_000,
    rewrite_every: int = 64,
) -> BpeModel:
    """E1 end to end; returns the vocabulary and the ranked merge list.

    Words are stored once as blocks of symbol arrays (``operators.merges``). A
    round guesses up to ``merges_per_round`` merges from the exact pair counts
    and a sample of words, and one pass over the blocks gives the exact change
    of the pair counts at each of them, going only to the places where a pair
    stands. The driver replays the changes and commits the merges that are the
    best pair by exact counts, up to the first wrong guess. The result equals one
    merge at a time, for every ``merges_per_round`` and sample. After
    ``rewrite_every`` commits the blocks are written anew with the merges done.
    The driver holds the ``most_pairs`` best pairs and counts anew when the best
    is no better than those left out. ``checkpoint_every`` has no effect: rounds
    start from stored blocks, so no lineage grows.
    """
    spark = df.sparkSession
    words = stored(word_counts(df, text).repartition(shuffle_partitions(spark)))
    top = mg.character_totals(words).orderBy(F.desc("n"), F.asc("ch")).limit(limit_alphabet)  # ≤ limit_alphabet rows
    alpha = {c: len(specials) + i for i, c in enumerate(sorted(r["ch"] for r in top.collect()))}

    # id → token text: specials + alphabet (≤ limit_alphabet rows), grown by one per merge
    token_of = {i: t for i, t in enumerate(specials)}
    token_of.update({i: t for t, i in alpha.items()})
    first_id = len(token_of)
    guessed = mg.WordTable(*mg.encode_words(*_word_sample(words, sample_words), alpha))
    base, based = stored(mg.blocks(words, alpha)), 0  # blocks, and how many merges they hold
    discard(words)
    done: list[tuple[int, int]] = []
    exact, floor, fresh, ahead_max = None, 0, 0, min(merges_per_round, 128)
    while first_id + len(done) < vocab_size:
        if len(done) - based >= rewrite_every:
            newer = stored(mg.rewritten(base, done[based:], first_id + based))
            discard(base)
            base, based = newer, len(done)
        if exact is None or exact.best()[1] <= floor:
            if exact is not None and floor < min_frequency:
                break
            top = mg.pair_totals(base, done[based:], first_id + based).filter(F.col("n") >= min_frequency)
            top = top.orderBy(F.desc("n"), "left", "right").limit(most_pairs + 1).collect()
            floor = max(r["n"] for r in top[most_pairs:]) if len(top) > most_pairs else min_frequency - 1
            exact, fresh = _Ranked({(r["left"], r["right"]): r["n"] for r in top if r["n"] > floor}), first_id + len(done)
            if exact.best()[0] is None:
                if floor >= min_frequency:
                    most_pairs *= 2  # more pairs tie than are held
                    exact = None
                    continue
                break
        # pairs held, and all pairs with symbols made since the count, are known exactly
        known = lambda q: q in exact.counts or q[0] >= fresh or q[1] >= fresh  # noqa: B023,E731
        # guess ahead
        guess, ahead = _Ranked(exact.counts), []
        held = guessed.copy()
        while len(ahead) < min(ahead_max, vocab_size - first_id - len(done)):
            pair, n = guess.best()
            if pair is None or n <= floor:
                break
            guess.add(held.merge(pair, first_id + len(done) + len(ahead)), known)
            guess.counts[pair] = 0
            ahead.append(pair)
        # at most merges_per_round × twice the symbols rows, as four arrays
        found = mg.changes(base, done[based:], ahead, first_id + based).toArrow().sort_by("step")
        step, left, right, n_change = (found.column(c).to_numpy() for c in ("step", "left", "right", "n"))
        cut = np.searchsorted(step, np.arange(len(ahead) + 1))
        committed = 0
        for k, pair in enumerate(ahead):
            best, n = exact.best()
            if best != pair or n <= floor:
                break
            mine = slice(cut[k], cut[k + 1])
            exact.add(dict(zip(zip(left[mine].tolist(), right[mine].tolist()), n_change[mine].tolist())), known)
            guessed.merge(pair, first_id + len(done), report=False)
            done.append(pair)
            committed += 1
        ahead_max = min(merges_per_round, max(64, 3 * committed))
    discard(base)

    merges = []
    for k, (l, r) in enumerate(done):
        token_of[first_id + k] = token_of[l] + token_of[r]
        merges.append((token_of[l], token_of[r], k))
    # both tables are bounded by vocab_size rows
    vocab = spark.createDataFrame(sorted(((t, i) for i, t in token_of.items()), key=lambda x: x[1]), "token string, id int")
    merge_table = spark.createDataFrame(merges, "left string, right string, rank int")
    return BpeModel(vocab, merge_table)


# ------------------------------------------------------------------ encoding
def _bpe_word(word: str, ranks: dict, alphabet: set, memo: dict) -> list[str]:
    """Pieces of one word: the lowest-ranked pair first, leftmost first. A heap of pairs over a linked
    list of parts, so a word of n characters costs n log n. Characters outside the alphabet are ``<unk>``."""
    got = memo.get(word)
    if got is not None:
        return got
    parts = [c if c in alphabet else K.UNK for c in word]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else n
        if j >= n or parts[j] != b:
            continue  # a neighbour was merged away meanwhile
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (parts[i], parts[k]) in ranks:
                heapq.heappush(heap, (ranks[parts[i], parts[k]], i, parts[i], parts[k]))
        h = before[i]
        if h >= 0 and (parts[h], parts[i]) in ranks:
            heapq.heappush(heap, (ranks[parts[h], parts[i]], h, parts[h], parts[i]))
    out = [p for p in parts if p is not None]
    if len(memo) < MEMO_WORDS and len(word) <= 64:  # a text without spaces is one word: not kept
        out = memo[word] = [sys.intern(p) for p in out]  # a piece is held once, however many words have it
    return out


def _bpe_pieces(text: str | None, ranks: dict, alphabet: set, memo: dict) -> list[str]:
    return [p for w in text.split(" ") for p in _bpe_word(MARK + w, ranks, alphabet, memo)] if text else []


def bpe_encoder(spark: SparkSession, model: BpeModel):
    """An Arrow UDF ``text → array<string>`` of subword pieces.

    The merge table and alphabet are bounded by ``vocab_size`` and shipped once
    as a broadcast variable.
    """
    merges = model.merges.orderBy("rank").collect()  # ≤ vocab_size rows
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges}
    alpha = {r["token"] for r in model.vocab.filter(F.length("token") == 1).collect()}
    bc = spark.sparkContext.broadcast((ranks, alpha))

    def encode():
        ranks_, alpha_ = bc.value
        memo: dict = {}  # lives as long as the task
        return lambda texts: pa.array([_bpe_pieces(t, ranks_, alpha_, memo) for t in texts.to_pylist()], pa.list_(pa.string()))

    return sliced_udf(T.ArrayType(T.StringType()), encode)


def bpe_id_encoder(spark: SparkSession, model: BpeModel, unk_id: int = K.UNK_ID):
    """E4 + E5 in one pass: an Arrow UDF ``text → array<int>`` of subword ids.

    Merge list and vocabulary are both bounded by ``vocab_size`` and shipped
    once as a broadcast variable, so the corpus is encoded row by row without
    the explode / join / regroup shuffle of ``encode.lookup_ids`` – the path
    for the large MLM job and for streams.
    """
    merges = model.merges.orderBy("rank").collect()  # ≤ vocab_size rows
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges}
    vocab = {r["token"]: r["id"] for r in model.vocab.collect()}  # ≤ vocab_size rows
    alpha = {t for t in vocab if len(t) == 1}
    bc = spark.sparkContext.broadcast((ranks, alpha, vocab))

    def encode_ids():
        ranks_, alpha_, vocab_ = bc.value
        memo: dict = {}  # lives as long as the task
        return lambda texts: pa.array([[vocab_.get(p, unk_id) for p in _bpe_pieces(t, ranks_, alpha_, memo)] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return sliced_udf(T.ArrayType(T.IntegerType()), encode_ids)


def bpe_pair_encoder(spark: SparkSession, model: BpeModel, unk_id: int = K.UNK_ID):
    """E4 + E5: an Arrow UDF ``text → struct<pieces: array<string>, ids: array<int>>``; broadcast as in ``bpe_id_encoder``."""
    merges = model.merges.orderBy("rank").collect()  # ≤ vocab_size rows
    ranks = {(r["left"], r["right"]): r["rank"] for r in merges}
    vocab = {r["token"]: r["id"] for r in model.vocab.collect()}  # ≤ vocab_size rows
    bc = spark.sparkContext.broadcast((ranks, {t for t in vocab if len(t) == 1}, vocab))

    def encode_pairs():
        ranks_, alpha_, vocab_ = bc.value
        memo: dict = {}  # lives as long as the task

        def coded(texts: pa.Array) -> pa.Array:
            pieces = [_bpe_pieces(t, ranks_, alpha_, memo) for t in texts.to_pylist()]
            return pieces_and_ids(pieces, [[vocab_.get(p, unk_id) for p in row] for row in pieces])

        return coded

    return sliced_udf("struct<pieces: array<string>, ids: array<int>>", encode_pairs)


# ------------------------------------------------------------------ dumps, filters
def vocab_lines(vocab: DataFrame) -> DataFrame:
    """``f"{id:<6} --- {token}"`` lines ordered by id."""
    return vocab.orderBy("id").select(F.format_string("%-6d --- %s", "id", "token").alias("line"))


def save_vocabulary(model: BpeModel, directory: str, prefix: str | None = None) -> tuple[str, str]:
    """Write vocabulary and merges under ``directory`` (which must exist
    as a directory); names get ``<prefix>-`` when a prefix is given."""
    if not os.path.isdir(directory) and "://" not in directory:
        raise NotADirectoryError(directory)
    stem = f"{prefix}-" if prefix else ""
    vpath = os.path.join(directory, stem + "vocab")
    mpath = os.path.join(directory, stem + "merges")
    model.vocab.write.mode("overwrite").parquet(vpath)
    model.merges.write.mode("overwrite").parquet(mpath)
    return vpath, mpath


def _write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file at an exact name, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def save_vocabulary_files(model: BpeModel, directory: str, prefix: str | None = None) -> tuple[str, str]:
    """``vocab.json`` (token → id, by id) and ``merges.txt`` (one ``left right`` a line, by rank),
    the files other tokenizers read. Both are bounded by ``vocab_size``."""
    spark = model.vocab.sparkSession
    stem = f"{directory.rstrip('/')}/{prefix + '-' if prefix else ''}"
    vocab = {r["token"]: r["id"] for r in model.vocab.orderBy("id").collect()}
    _write_file(spark, stem + "vocab.json", json.dumps(vocab, ensure_ascii=False))
    lines = [f"{r['left']} {r['right']}\n" for r in model.merges.orderBy("rank").collect()]
    _write_file(spark, stem + "merges.txt", "#version: 0.2\n" + "".join(lines))
    return stem + "vocab.json", stem + "merges.txt"


def load_vocabulary_files(spark: SparkSession, directory: str, prefix: str | None = None) -> BpeModel:
    """A model from ``vocab.json`` and ``merges.txt``."""
    stem = f"{directory.rstrip('/')}/{prefix + '-' if prefix else ''}"
    read = lambda name: spark.read.text(stem + name, wholetext=True).first()[0]
    vocab = sorted(json.loads(read("vocab.json")).items(), key=lambda x: x[1])
    pairs = [line.split(" ") for line in read("merges.txt").split("\n") if line and not line.startswith("#version")]
    return BpeModel(spark.createDataFrame(vocab, "token string, id int"), spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "rank int, left string, right string"))


def with_social_tokens(vocab: DataFrame, tokens: Sequence[str] = K.SOCIAL_TOKENS) -> DataFrame:
    """Vocabulary entries that contain any social special token."""
    cond = None
    for t in tokens:
        c = F.col("token").contains(t)
        cond = c if cond is None else cond | c
    return vocab.filter(cond)


def exclude_ids(vocab: DataFrame, ids: Sequence[int]) -> DataFrame:
    """P14."""
    return vocab.filter(~F.col("id").isin(list(ids)))


def first_ids(vocab: DataFrame, k: int = 20) -> DataFrame:
    """The first k ids (a bounded top-k)."""
    return vocab.orderBy("id").limit(k)


def vocab_alphabet(vocab: DataFrame) -> DataFrame:
    """Sorted distinct characters over all tokens."""
    return vocab.select(F.explode(F.split("token", "", -1)).alias("ch")).filter(F.length("ch") > 0).distinct().orderBy("ch")


def load_model(spark: SparkSession, directory: str, prefix: str | None = None) -> BpeModel:
    """Read a vocabulary saved by ``save_vocabulary`` (S13) back as a model."""
    stem = f"{prefix}-" if prefix else ""
    vocab = spark.read.parquet(os.path.join(directory, stem + "vocab"))
    merges = spark.read.parquet(os.path.join(directory, stem + "merges"))
    return BpeModel(vocab.select("token", F.col("id").cast("int")), merges.select("left", "right", F.col("rank").cast("int")))
