"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) teach a linear numpy
classifier with the class-prior-corrected risk

    R(f) = prior * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)])

with the logistic loss. Minibatches whose corrected negative part falls below
zero take a step back on that part (the non-negative rule). Negative labels are
never used as negatives; they only count in the prior, the share of toxic ids
among labelled ones.

A text's features are its distinct lower-cased words, each counted under its
whole form and under its first letters (``PREFIX``). Only the
``max_features`` whose document shares in P and U differ most, and which by the
prior mark a toxic text more often than not, get a weight.

Learning uses at most ``max_positive`` confirmed and ``max_unlabelled`` other
texts (smallest hash of the id) of the folds that are not held out: both bounds
are parameters, and so is what the driver holds (the kept features of those
texts). Scoring covers whole texts of
all rows. Labels, lang, source and doc_id are never features. Null text is the
empty text; it scores by the bias alone. Ties and repeated rows get equal
scores. Without a confirmed text every score is 0. Extra columns pass through;
``score`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, null_safe_text, stored, worker_cached
from .quality import training_ids

WORD = re.compile(r"\w+")
PREFIX = (4, 5, 6)
BITS = 20


def _features(word: str) -> list[int]:
    """Hashed features of a word: the whole word, and its first letters where it is longer."""
    mask = (1 << BITS) - 1
    return [crc32(("w:" + word).encode()) & mask, *(crc32((f"p{k}:" + word[:k]).encode()) & mask for k in PREFIX if len(word) >= k)]


@dataclass
class Model:
    """Weights of the kept hashed features and a bias."""

    weights: dict[int, float]
    bias: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(i, 0.0) for i in _features(word))


def _rescale(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 1500, step: float = 0.02) -> tuple[float, float]:
    """Scale and bias of a one-dimensional score under the non-negative risk."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    x, m, v = np.array([1.0, np.log(prior / (1 - prior))]), np.zeros(2), np.zeros(2)
    for t in range(1, steps + 1):
        fp, fu = x[0] * p + x[1], x[0] * u + x[1]
        dp, du = prior * sigmoid(fp), sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g = np.array([(du * u).mean() - (dp * p).mean(), du.mean() - dp.mean()])
        if negative >= 0:
            g -= prior * np.array([((1 - sigmoid(fp)) * p).mean(), (1 - sigmoid(fp)).mean()])
        else:
            g = -g
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x[0] = max(x[0], 1e-3)
    return float(x[0]), float(x[1])


def _boundary(p: np.ndarray, u: np.ndarray, prior: float, missed: float = 0.01) -> float:
    """Where the share of unlabelled texts above is the prior, but no lower than all but ``missed`` of
    the confirmed texts lie; half way to the next unlabelled text below. A text without a kept feature is below."""
    at = max(np.quantile(u, 1 - prior), np.quantile(p, missed))
    above = np.r_[p, u]
    at = max(at, above[above > 0].min()) if (above > 0).any() else at + 1.0
    return float((at + u[u < at].max()) / 2) if (u < at).any() else float(at)


def fit_rows(rows: np.ndarray, cols: np.ndarray, n_p: int, n_u: int, kept: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, step: float = 0.1, decay: float = 1e-2, back: float = 1.0, seed: int = 2) -> Model:
    """Minibatch Adam on the non-negative risk. ``rows`` (ascending; the first ``n_p`` texts are
    confirmed) and ``cols`` list the kept features of each text, once for each of its distinct words."""
    if not n_p or not n_u:
        return Model({}, -30.0)
    if not len(kept):
        return Model({}, float(np.log(prior / (1 - prior))))
    first = np.searchsorted(rows, np.arange(n_p + n_u + 1))

    def take(ids):
        size = first[ids + 1] - first[ids]
        at = np.repeat(first[ids] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.repeat(np.arange(len(ids)), size), cols[at]

    rng = np.random.default_rng(seed)
    w, m, v, t = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), 0
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    per = max(1, -(-n_u // batch))
    half, mean = epochs * per // 2, np.zeros(len(kept) + 1)  # the average of the second half is steadier than its last step
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(n_p), per), np.array_split(rng.permutation(n_u), per)
        for a, b in zip(ps, us):
            if not len(a):
                a = rng.integers(0, n_p, 64)
            (ra, ca), (rb, cb) = take(a), take(b + n_p)
            fa, fb = np.bincount(ra, w[ca], len(a)) + w[-1], np.bincount(rb, w[cb], len(b)) + w[-1]
            negative = np.logaddexp(0, fb).mean() - prior * np.logaddexp(0, fa).mean()
            # slopes of the positive part and of the corrected negative part by f
            pos_a = -prior * (1 - sigmoid(fa)) / len(a)
            neg_a, neg_b = -prior * sigmoid(fa) / len(a), sigmoid(fb) / len(b)
            if negative >= 0:
                da, db = pos_a + neg_a, neg_b
            else:
                da, db = -back * neg_a, -back * neg_b
            g = np.bincount(ca, da[ra], len(w)) + np.bincount(cb, db[rb], len(w))
            g[-1] = da.sum() + db.sum()
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)  # every kept feature speaks for toxicity
            if t > half:
                mean += (w - mean) / (t - half)
    # the same risk once more over all texts, without decay, for the scale; the bias follows from the prior
    total = np.bincount(rows, mean[cols], n_p + n_u)
    scale, _ = _rescale(total[:n_p], total[n_p:], prior)
    return Model({int(k): float(scale * x) for k, x in zip(kept, mean) if x}, -scale * _boundary(total[:n_p], total[n_p:], prior))


def _texts_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashed features of each text, once for each distinct word that has them."""
    for b in batches:
        seen = [[i for w in set(WORD.findall(t.lower())) for i in _features(w)] for t in b["text"]]
        yield pd.DataFrame({"y": b["y"], "content": b["content"], "features": [np.array(x, dtype=np.int32) for x in seen]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_positive: int = 4_000, max_unlabelled: int = 8_000, max_features: int = 1024, min_positive: int = 4, min_z: float = 4.0, seed: int = 2, **params) -> Model:
    """Learn from confirmed texts and from others whose labels, if any, are not looked at.

    Features are made and counted on the executors; the driver gets only the kept ones of each sampled text.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    prior = float(np.clip((toxic or 0) / n if n else 0.0, 0.01, 0.9))
    positive = training_ids(labels.where(F.col(label) == 1), label, max_positive, seed).select("doc_id", F.lit(1).alias("y"))
    others = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    others = others.orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("y"))
    # both sides are bounded by the parameters
    want = F.broadcast(positive.unionByName(others))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text("text").alias("text")).join(want, "doc_id")
    rows = rows.withColumn("content", F.xxhash64("text")).mapInPandas(_texts_features, "y int, content long, features array<int>")
    rows = stored(rows.dropDuplicates(["y", "content"]))  # copies teach once
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    df = rows.select("y", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count_if(F.col("y") == 1).alias("in_p"), F.count_if(F.col("y") == 0).alias("in_u"))
    p, u = F.col("in_p") / F.lit(float(max(n_p, 1))), F.col("in_u") / F.lit(float(max(n_u, 1)))
    spread = F.sqrt((p * (1 - p) + 1e-3) / max(n_p, 1) + (u * (1 - u) + 1e-3) / max(n_u, 1))
    # Bayes: of unlabelled texts with the feature, prior * p / u are toxic; weaker features only follow length or language
    good = df.select("feature", "in_p", ((p - u) / spread).alias("z"), (F.lit(prior) * p >= F.lit(0.5) * u).alias("marks"))
    good = good.where(F.col("marks") & (F.col("in_p") >= min_positive) & (F.col("z") >= min_z)).orderBy(F.desc("z"), "feature").limit(max_features)
    kept = np.sort(np.array([r["feature"] for r in good.collect()], dtype=np.int64))
    place = {int(k): i for i, k in enumerate(kept)}

    def only_kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "content": b["content"], "at": [[place[i] for i in x if i in place] for x in b["features"]]})

    got = rows.mapInPandas(only_kept, "y int, content long, at array<int>").orderBy(F.desc("y"), "content").limit(2 * (max_positive + max_unlabelled)).toPandas()
    size = got["at"].map(len).to_numpy(dtype=np.int64) if len(got) else np.zeros(0, dtype=np.int64)
    cols = np.concatenate([np.sort(np.asarray(x, dtype=np.int64)) for x in got["at"]]) if size.sum() else np.zeros(0, dtype=np.int64)
    return fit_rows(np.repeat(np.arange(len(got)), size), cols, n_p, n_u, kept, prior, seed=seed, **params)


def scorer(model: Model):
    """Column function: the score (0 to 1) of a text column."""
    name = ("toxicity", crc32(repr(sorted(model.weights.items())).encode()), model.bias)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model  # at most max_features weights, shipped with the task
        memo: dict[str, float] = worker_cached(name, dict)
        weight = m.word_weight

        def one(text: str) -> float:
            total = m.bias
            for w in set(WORD.findall(text.lower())):
                x = memo.get(w)
                if x is None:
                    if len(memo) >= 500_000:
                        memo.clear()
                    x = memo[w] = weight(w)
                total += x
            return total

        for texts in batches:
            f = np.array([one(t) for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(f, -30, 30))))

    return lambda text: scored(null_safe_text(text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of every whole text."""
    return docs.withColumn("score", scorer(model)("text"))
