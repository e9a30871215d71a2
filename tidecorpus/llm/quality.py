"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a fixed set of numeric features (lengths, character classes,
repetition). Cyclic boosting visits the features in turn; a shallow tree on the
feature's binned values is added, at a small step, to the feature's lookup
table. Then the feature pairs that explain most of what is left get tables of
their own, boosted by two-level trees. A score is the logistic of a sum of
lookups, done for a whole batch at once.

Learning uses at most ``max_rows`` labelled rows (smallest hash of the id) of
the folds that are not held out; features of those rows alone reach the driver
(``max_rows`` x number of features). Labels, lang, source and doc_id are never
features. Null text is the empty text, which gets a score like any other; ties
and repeated rows get equal scores. Without any labelled row, or with one class
only, every score is the share of label 1 (0.5 if there is no label). Rows whose
label is null do not teach. Extra columns pass through; ``score`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, null_safe_text

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "marked_words", "bar_words", "distinct_words",
    "top_word", "repeats", "repeated_lines", "words_a_line", "sentence_marks", "white_space", "beyond_ascii", "upper_words", "repeated_text",
)
_CLASS = np.zeros(256, dtype=np.int64)  # of a UTF-8 byte: 1 upper, 2 digit, 3 punctuation, 4 white space, 5 beyond ASCII, 0 other
_CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 1, 2, 4, 5
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
MARKS = "!#$%&*|"


def features(text: str) -> list[float]:
    """The numbers of one whole text, in the order of ``FEATURES``."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(_CLASS[raw], minlength=6) / n
    words = text.split()
    m = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    dense = text.count(" ") + 1
    marked = sum(c for w, c in count.items() if w[-1] in MARKS)
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m, kinds[1], kinds[2], kinds[3], marked / m, count.get("|", 0) / m, len(count) / m,
        max(count.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))),
        text.count(".") / m, kinds[4], kinds[5], sum(c for w, c in count.items() if w.isupper()) / m, 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if dense else 0.0,
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([features(t or "") for t in texts], dtype=float).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Bin edges and lookup tables: one per feature, one per chosen pair."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            out += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, t in self.pairs:
            out += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, float]:
    """Best split point of a histogram (0: none) and its gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(gl, hl, ridge) + _gain(g.sum() - gl, h.sum() - hl, ridge) - _gain(g.sum(), h.sum(), ridge)
    gain[(hl < 1e-6) | (h.sum() - hl < 1e-6)] = 0
    if not len(gain) or gain.max() <= 1e-9:
        return 0, 0.0
    return int(gain.argmax()) + 1, float(gain.max())


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Lookup table of a shallow tree on one histogram: the best splits one after the other."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((_cut(g[a:b], h[a:b], ridge), (a, b)) for a, b in parts), key=lambda x: x[0][1])
        if not best[0][0]:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, a + best[0][0]), (a + best[0][0], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Two-level tree on a grid (split one axis, then each side by the other); its table and gain."""
    best = (np.zeros_like(g), 0.0)
    whole = _gain(g.sum(), h.sum(), ridge)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for c in range(1, len(gg)):
            table, gain = np.zeros_like(gg), -whole
            for a, b in ((0, c), (c, len(gg))):
                gs, hs = gg[a:b].sum(0), hh[a:b].sum(0)
                k = _cut(gs, hs, ridge)[0]
                for u, v in ((0, k), (k, len(gs))):
                    if v > u:
                        table[a:b, u:v] = _leaf(gs[u:v].sum(), hs[u:v].sum(), ridge)
                        gain += _gain(gs[u:v].sum(), hs[u:v].sum(), ridge)
            if gain > best[1]:
                best = (table if axis == 0 else table.T, gain)
    return best


def fit_arrays(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 5, bins: int = 64, pair_bins: int = 8, step: float = 0.15, leaves: int = 3, ridge: float = 5.0) -> Model:
    """Cyclic boosting of main effects, then of the best pairs; logistic loss, Newton leaves."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Model(float(np.log(p / (1 - p))))
    p = y.mean()
    model = Model(float(np.log(p / (1 - p))), [_edges(c, bins) for c in x.T])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    f = np.full(len(y), model.base)

    def slopes():
        q = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j, b in enumerate(at):
            if len(model.edges[j]):
                g, h = slopes()
                add = step * _tree(np.bincount(b, g, len(model.tables[j])), np.bincount(b, h, len(model.tables[j])), leaves, ridge)
                model.tables[j] += add
                f += add[b]
    model.pair_edges = [_edges(c, pair_bins) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def grid(a, b, v):
        return np.bincount(coarse[a] * shape[b] + coarse[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])

    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(a, b, g), grid(a, b, h), ridge)[1], a, b) for a in range(len(at)) for b in range(a) if shape[a] > 1 and shape[b] > 1), reverse=True)
    chosen = [(a, b, np.zeros((shape[a], shape[b]))) for _, a, b in ranked[:pairs]]
    for _ in range(pair_rounds):
        for a, b, t in chosen:
            g, h = slopes()
            add = step * _pair_tree(grid(a, b, g), grid(a, b, h), ridge)[0]
            t += add
            f += add[coarse[a], coarse[b]]
    model.pairs = chosen
    return model


def training_ids(labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, y): one label per id outside the held-out fold, at most ``max_rows`` by smallest hash."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, seed: int = 5, **params) -> Model:
    """Learn from the labelled rows outside the held-out fold."""
    # at most max_rows narrow rows, so the broadcast is bounded by the parameter
    want = F.broadcast(training_ids(labels, label, max_rows, seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(_matrix(b["text"]))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text("text").alias("text")).join(want, "doc_id").mapInPandas(run, "doc_id long, y int, x array<double>")
    got = rows.orderBy("doc_id", F.hash("x")).limit(2 * max_rows).toPandas()
    return fit_arrays(np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES)), got["y"].to_numpy(dtype=float), **params)


def scorer(model: Model):
    """Column function: the score (0 to 1) of a text column."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.predict(_matrix(texts)), dtype=float)

    return lambda text: scored(null_safe_text(text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of every whole text."""
    return docs.withColumn("score", scorer(model)("text"))
