"""Encoding and array operators.

Sequences are ``array<int>`` columns; every step is a native higher-order
function (``transform`` / ``slice`` / ``concat`` / ``array_repeat``) so it runs
inside whole-stage codegen without leaving the JVM.

Token → id lookups go through the vocabulary, which is bounded by its size and
broadcast once; an Arrow UDF maps whole arrays inside the task, so no token row
is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.slices import LARGE_SLICE, sliced_udf
from .indexing import hash_below, hash_int, portable_hash


#: Entries of a vocabulary that a task may hold whole (some hundred MB).
MAX_VOCABULARY = 2_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ tokens and vocabulary
def word_tokens(text) -> Column:
    """Whitespace tokens of the tidied, lower-cased text (empty text → [])."""
    # a tidied text has an empty token only if it is empty; so written, the text is tidied once
    return F.array_remove(F.split(tx.tidy(F.lower(_c(text))), " ", -1), "")


def specials_table(spark, specials: Sequence[str] = K.SEQUENCE_SPECIALS) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id int")


def build_word_vocab(df: DataFrame, tokens: str, size: int, specials: Sequence[str] = K.SEQUENCE_SPECIALS) -> DataFrame:
    """E2 (word level): specials first, then the ``size − len(specials)`` most
    frequent tokens (count desc, token asc). The result has at most ``size``
    rows – the bound that makes every later broadcast of it safe."""
    # explode_outer + null filter: a plain explode makes Catalyst infer
    # size(tokens) > 0 and evaluate the whole token expression twice
    toks = df.select(F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(F.broadcast(specials_table(df.sparkSession, specials).select("token")), "token", "left_anti")
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(size - len(specials))
    ranked = top.select(
        "token", (F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token"))) - 1 + len(specials)).cast("int").alias("id")
    )
    return specials_table(df.sparkSession, specials).unionByName(ranked)


def array_lookup(vocab: DataFrame, src: str, dst: str, miss, elem: str):
    """A UDF over arrays: every element goes through the vocabulary, in the task, with no shuffle.

    The vocabulary (at most ``MAX_VOCABULARY`` rows, else an error) is collected and broadcast once. Elements are
    looked up in Arrow, so no element becomes a Python object."""
    if vocab.limit(MAX_VOCABULARY + 1).count() > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary to broadcast has at most {MAX_VOCABULARY} entries")
    bc = vocab.sparkSession.sparkContext.broadcast({r[src]: r[dst] for r in vocab.select(src, dst).collect()})

    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[elem]

    def look_up():
        known, found = pa.array(list(bc.value)), pa.array([*bc.value.values(), miss], kind)  # the last answers for misses

        def mapped(arrays: pa.Array) -> pa.Array:
            items = arrays.flatten()
            at = pc.index_in(items, value_set=known.cast(items.type))
            ends = np.cumsum(pc.list_value_length(arrays).fill_null(0).to_numpy())
            return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), found.take(at.fill_null(len(known))), mask=arrays.is_null())

        return mapped

    return sliced_udf(f"array<{elem}>", look_up, LARGE_SLICE)


def lookup_ids(df: DataFrame, key: str, tokens: str, vocab: DataFrame, out: str = "ids", unk: int = K.UNK_ID) -> DataFrame:
    """E5: (key, tokens) → (key, ids), unknown → ``unk``, order kept, whole sequences."""
    return df.select(key, array_lookup(vocab, "token", "id", unk, "int")(tokens).alias(out))


def lookup_tokens(df: DataFrame, key: str, ids: str, vocab: DataFrame, out: str = "tokens", unk: str = K.UNK) -> DataFrame:
    """(key, ids) → (key, tokens), unknown id → ``<unk>``, order kept, whole sequences."""
    return df.select(key, array_lookup(vocab, "id", "token", unk, "string")(ids).alias(out))


def add_missing_tokens(vocab: DataFrame, required: Sequence[str]) -> DataFrame:
    """Append required tokens missing from the vocabulary, in list order,
    with ids after the current maximum."""
    spark = vocab.sparkSession
    req = spark.createDataFrame([(t, i) for i, t in enumerate(required)], "token string, _ord int")
    missing = req.join(vocab.select("token"), "token", "left_anti")
    top = vocab.agg(F.max("id")).scalar()
    added = missing.select(
        "token", (top + F.row_number().over(Window.orderBy("_ord"))).cast("int").alias("id")
    )
    return vocab.unionByName(added)


# ------------------------------------------------------------------ sequence assembly
def build_inputs(a, b=None, cls: int = K.CLS_ID, sep: int = K.SEP_ID) -> Column:
    """``<s> A </s>`` or ``<s> A </s></s> B </s>``."""
    if b is None:
        return F.concat(F.array(F.lit(cls)), _c(a), F.array(F.lit(sep)))
    return F.concat(F.array(F.lit(cls)), _c(a), F.array(F.lit(sep), F.lit(sep)), _c(b), F.array(F.lit(sep)))


def special_tokens_mask(a, b=None, already_has_special_tokens: bool = False, cls: int = K.CLS_ID, sep: int = K.SEP_ID) -> Column:
    """1 on special positions. With ``already_has_special_tokens`` the ids
    are scanned for cls / sep (pad is *not* marked); a second sequence then is an error."""
    if already_has_special_tokens:
        if b is not None:
            raise ValueError("second sequence given with already_has_special_tokens")
        return F.transform(_c(a), lambda x: (x.isin(cls, sep)).cast("int"))
    zeros_a = F.array_repeat(F.lit(0), F.size(_c(a)))
    if b is None:
        return F.concat(F.array(F.lit(1)), zeros_a, F.array(F.lit(1)))
    zeros_b = F.array_repeat(F.lit(0), F.size(_c(b)))
    return F.concat(F.array(F.lit(1)), zeros_a, F.array(F.lit(1), F.lit(1)), zeros_b, F.array(F.lit(1)))


def attention_mask(ids, pad: int = K.PAD_ID) -> Column:
    """1 where the id is not padding."""
    return F.transform(_c(ids), lambda x: (x != pad).cast("int"))


def token_type_ids(ids) -> Column:
    """All zeros, one per position."""
    return F.array_repeat(F.lit(0), F.size(_c(ids)))


def token_length(mask) -> Column:
    """sum(attention_mask) − 2."""
    return F.aggregate(_c(mask), F.lit(0), lambda acc, x: acc + x) - 2


def effective_max_length(requested: int | None, model_max: int | None = None, cap: int = 1024) -> int:
    """The length sequences are cut to – min(requested, model maximum);
    without a request the model maximum, itself capped at ``cap``."""
    limit = min(model_max, cap) if model_max else cap
    return min(requested, limit) if requested else limit


def truncate(body, max_len: int = K.MAX_LENGTH, n_special: int = 2) -> Column:
    """Keep the first ``max_len − n_special`` ids of the body."""
    return F.slice(_c(body), 1, max_len - n_special)


def pair_lengths(la: Column, lb: Column, max_len: int) -> tuple[Column, Column]:
    """E11 closed form of ``longest_first`` for a pair (4 specials)."""
    budget = F.lit(max_len - 4)
    fits = (la + lb) <= budget
    a_short = la <= lb  # on a tie the second counts as the longer one
    short = F.least(F.when(a_short, la).otherwise(lb), F.floor(budget / 2).cast("int"))
    keep_a = F.when(fits, la).when(a_short, short).otherwise(budget - short)
    keep_b = F.when(fits, lb).when(a_short, budget - short).otherwise(short)
    return keep_a.cast("int"), keep_b.cast("int")


def truncate_pair(a, b, max_len: int) -> tuple[Column, Column]:
    """Slice both sides to the ``longest_first`` lengths."""
    ka, kb = pair_lengths(F.size(_c(a)), F.size(_c(b)), max_len)
    return F.slice(_c(a), 1, ka), F.slice(_c(b), 1, kb)


def pad(ids, length, pad_id: int = K.PAD_ID) -> Column:
    """Right-pad to ``length`` (a negative count yields no padding)."""
    n = F.lit(length) if isinstance(length, int) else _c(length)
    return F.concat(_c(ids), F.array_repeat(F.lit(pad_id), F.greatest(n - F.size(_c(ids)), F.lit(0))))


def round_up(n: Column, multiple: int | None) -> Column:
    if not multiple:
        return n
    return (F.ceil(n / F.lit(multiple)) * F.lit(multiple)).cast("int")


# ------------------------------------------------------------------ masking
def mlm_mask(ids, special_mask, row_id, seed: int, vocab_size: int, probability: float = K.MLM_PROBABILITY, mask_id: int = K.MASK_ID):
    """Choose ``probability`` of the non-special positions; of those 80 %
    become ``<mask>``, 10 % a random id, 10 % stay. Labels are the original id
    on chosen positions and −100 elsewhere.

    Randomness is the portable hash of (seed, row, position), so it is
    reproducible and can be recomputed in SQL: eight hex digits choose, the next
    eight pick what happens, the next eight pick the random id.
    """
    pairs = F.arrays_zip(_c(ids).alias("x"), _c(special_mask).alias("s"))

    # one md5 per position, in a step of its own so that it is not written out at each use
    pairs = F.transform(pairs, lambda z, i: F.struct(z["x"].alias("x"), z["s"].alias("s"), portable_hash(row_id, seed, i).alias("h")))

    def one(z):
        h = z["h"]
        chosen = (z["s"] == 0) & hash_below(h, probability)
        new = (
            F.when(~chosen, z["x"])
            .when(hash_below(h, 0.8, 8), F.lit(mask_id))
            .when(hash_below(h, 0.9, 8), F.pmod(hash_int(h, 16), F.lit(vocab_size)).cast("int"))
            .otherwise(z["x"])
        )
        lab = F.when(chosen, z["x"]).otherwise(F.lit(K.IGNORE_INDEX))
        return F.struct(new.cast("int").alias("i"), lab.cast("int").alias("l"))

    both = F.transform(pairs, one)
    return F.transform(both, lambda s: s["i"]), F.transform(both, lambda s: s["l"])


# ------------------------------------------------------------------ checks and shapes
def labels_vector(cols: Sequence[str]) -> Column:
    """Category columns → one array."""
    return F.array(*[F.col(c).cast("int") for c in cols])


def model_columns(df: DataFrame, wanted: Sequence[str] = ("input_ids", "attention_mask", "token_type_ids", "labels")) -> DataFrame:
    """The model-facing column set, optional ones only when present."""
    return df.select(*[c for c in wanted if c in df.columns])


def encodings_equal(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per-field equality of two encodings joined on ``key``."""
    j = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(
        b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key, "full"
    )
    return j.agg(*[F.bool_and(F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias(f"{f}_equal") for f in fields])


def assert_single_length(df: DataFrame, ids: str, first: int = 20000, order: str | None = None) -> DataFrame:
    """The first ``first`` examples all have one length (fails the job otherwise)."""
    head = df.orderBy(order).limit(first) if order else df.limit(first)
    n = head.agg(F.count_distinct(F.size(ids)).alias("n_lengths"))
    # a filter keeps the check in the plan (a dropped column would be pruned)
    return n.filter(F.assert_true(F.col("n_lengths") <= 1, F.lit("encoded lengths differ")).isNull())
