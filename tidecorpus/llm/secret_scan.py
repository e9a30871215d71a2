"""Operator 11: secret scan by a character convolutional network over every candidate.

Candidates are the findings of three fixed rules, the values of assignments that
fail the rules' length, and every maximal run of 8 or more key characters that
holds a digit. Each is read by a small convolutional network in numpy: embedded
characters of the value and its surroundings, one convolution of width 5, the
maximum of every filter over the left context, the value and the right context
and its mean over the value, one hidden layer, one logit. A long value is read
in tiles, whole, and takes its highest tile.

The network learns from labelled findings: rows (id, start, end, secret). In
half of the training steps a window's context is blanked, so that the value
alone must decide as well. A quarter of the labelled windows (by hash) is kept
from the fit; on it Platt scaling turns logits into probabilities, and the
threshold of each group of candidates (``named``: stands after an assignment;
``bare``: does not) is the highest one that still finds ``recall`` of the kept
secrets of that group (of all groups where it has fewer than 20).

The rules' findings always stay. The method adds a span of kind ``neural`` for
each further candidate at or over its threshold that overlaps no rule's finding.

In Spark: one pass gives the labelled windows (distinct, all of them teach or
calibrate). Shards of them, by hash, learn side by side in rounds that start from
the mean of all shards' weights; the sums of Platt scaling are added up in tasks,
and each threshold is found by counting bits of the logits. One more pass scores
every candidate of every whole text. Only the network, some 4,000 numbers, goes
out with the tasks; nothing is shuffled but the labelled windows and the findings
joined to their texts.

Results in the corner cases: null text is the empty text: no findings. Null ids
and repeated rows are scored row by row (labelled findings join on the id; a
null id teaches nothing). Places are code points, ends exclusive; ties of start
go in the order of kinds. A very long text or value is read whole. Labels of one
kind only, or none, or an empty table: no network, and only the rules' findings
remain. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, null_safe_text, pick, stored

# The rules of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "neural")

RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
DIGIT = re.compile(r"[0-9]")
MIN_VALUE = 6

LEFT, TILE, RIGHT = 24, 40, 16
WIDTH = LEFT + TILE + RIGHT
BATCH = 128
#: Windows that one task learns from in a round, on average, and rounds over several such shards.
SHARD_ROWS, ROUNDS = 20_000, 4
OTHER_CONTROL, OTHER_LETTER, N_CHARS = 96, 97, 98
EMBED, TAPS, FILTERS, HIDDEN = 8, 5, 24, 16
SPAN_TYPE = "array<struct<kind: string, start: long, end: long, score: double>>"


def rule_findings(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The rules' findings by (start, kind), and the values of assignments under the rule's length."""
    found, short = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_ASSIGN:
            found.append(("assign", m.start(), m.end()))
        elif m.end(2) - m.start(2) >= MIN_VALUE:
            short.append((m.start(2), m.end(2)))
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return found, short


def other_candidates(text: str, found, short) -> list[tuple[int, int, bool]]:
    """(start, end, named) of all candidates that overlap no rule's finding, by start."""
    taken = sorted([(a, b) for _, a, b in found] + short)
    out, i, reach = [(a, b, True) for a, b in short if not any(x < b and a < y for _, x, y in found)], 0, 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > a or not DIGIT.search(text, a, b):
            continue
        out.append((a, b, False))
    return sorted(out)


def value_of(text: str, kind: str, start: int, end: int) -> tuple[int, int, bool]:
    """The value a rule's finding holds: an assignment's second part, else the finding."""
    if kind == "assign":
        m = ASSIGN.match(text, start)
        return m.start(2), m.end(2), True
    return start, end, False


def windows_of(text: str, start: int, end: int) -> list[tuple[str, int]]:
    """(characters, length of the value part) of the tiles of one candidate: 24 characters before, at most 40
    of the value, 16 after, with NUL where the text ends."""
    out = []
    for a in range(start, max(end, start + 1), TILE):
        a = max(start, min(a, end - TILE))  # the last tile ends with the value
        left, right = text[max(0, a - LEFT) : a], text[a : a + TILE + RIGHT]
        out.append((left.rjust(LEFT, "\0") + right.ljust(TILE + RIGHT, "\0"), min(end - a, TILE)))
    return out


def codes_of(windows: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WIDTH).astype(np.int64)
    return np.where(raw == 0, 0, np.where(raw < 32, OTHER_CONTROL, np.where(raw < 127, raw - 31, OTHER_LETTER)))


# --- network -----------------------------------------------------------------


def start_weights(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)

    def normal(*shape, fan):
        return (r.standard_normal(shape) * np.sqrt(2.0 / fan)).astype(np.float32)

    c = EMBED + 1
    return {
        "embed": normal(N_CHARS, EMBED, fan=EMBED), "conv": normal(TAPS * c, FILTERS, fan=TAPS * c), "conv_b": np.zeros(FILTERS, np.float32),
        "hide": normal(4 * FILTERS, HIDDEN, fan=4 * FILTERS), "hide_b": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, fan=HIDDEN), "out_b": np.zeros(1, np.float32),
    }


def _segments(lengths: np.ndarray) -> np.ndarray:
    """(rows, 3, WIDTH): left context, value, right context."""
    at = np.arange(WIDTH)
    left = np.broadcast_to(at < LEFT, (len(lengths), WIDTH))
    value = (at >= LEFT) & (at < LEFT + lengths[:, None])
    return np.stack([left, value, ~left & ~value], axis=1)


def forward(w: dict, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
    seg = _segments(lengths)
    x = np.concatenate([w["embed"][codes], seg[:, 1, :, None].astype(w["embed"].dtype)], axis=2)
    half = TAPS // 2
    padded = np.pad(x, ((0, 0), (half, half), (0, 0)))
    cols = np.concatenate([padded[:, t : t + WIDTH] for t in range(TAPS)], axis=2)
    act = np.maximum(cols @ w["conv"] + w["conv_b"], 0)
    masked = [act * seg[:, s, :, None] for s in range(3)]
    n_value = lengths[:, None].astype(act.dtype)
    pooled = np.concatenate([*(m.max(axis=1) for m in masked), masked[1].sum(axis=1) / n_value], axis=1)
    hidden = np.maximum(pooled @ w["hide"] + w["hide_b"], 0)
    return hidden @ w["out"] + w["out_b"][0], (codes, seg, cols, act, [m.argmax(axis=1) for m in masked], n_value, pooled, hidden)


def backward(w: dict, kept: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    codes, seg, cols, act, peaks, n_value, pooled, hidden = kept
    g = {"out": hidden.T @ d_logit, "out_b": np.array([d_logit.sum()])}
    d_hidden = d_logit[:, None] * w["out"] * (hidden > 0)
    g["hide"], g["hide_b"] = pooled.T @ d_hidden, d_hidden.sum(axis=0)
    d_pool = d_hidden @ w["hide"].T
    n = len(codes)
    d_act = seg[:, 1, :, None] * (d_pool[:, None, 3 * FILTERS :] / n_value[:, None])
    rows, filters = np.arange(n)[:, None], np.arange(FILTERS)[None]
    for s in range(3):
        d_act[rows, peaks[s], filters] += d_pool[:, s * FILTERS : (s + 1) * FILTERS] * seg[rows, s, peaks[s]]
    d_z = d_act * (act > 0)
    flat = d_z.reshape(-1, FILTERS)
    g["conv"], g["conv_b"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(axis=0)
    d_cols = (flat @ w["conv"].T).reshape(n, WIDTH, TAPS, EMBED + 1)
    half = TAPS // 2
    d_x = np.zeros((n, WIDTH + 2 * half, EMBED + 1), d_cols.dtype)
    for t in range(TAPS):
        d_x[:, t : t + WIDTH] += d_cols[:, :, t]
    d_embed = np.zeros_like(w["embed"])
    np.add.at(d_embed, codes.ravel(), d_x[:, half : half + WIDTH, :EMBED].reshape(-1, EMBED))
    g["embed"] = d_embed
    return g


def logits(w: dict, codes: np.ndarray, lengths: np.ndarray, step: int = 1024) -> np.ndarray:
    parts = [forward(w, codes[a : a + step], lengths[a : a + step])[0] for a in range(0, len(codes), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.float32)


def train(codes: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int, seed, batch: int = BATCH, rate: float = 2e-3, start: dict | None = None, share: float | None = None) -> dict[str, np.ndarray]:
    """Adam on the logistic loss, both labels weighing alike (``share``: the part of secrets, if not that of ``y``)."""
    w, r = start_weights(seed) if start is None else dict(start), np.random.default_rng(seed)
    share = (y == 1).mean() if share is None else share
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    while t < steps:
        order = r.permutation(len(y))
        for a in range(0, len(order), batch):
            i = order[a : a + batch]
            blank = r.random(len(i)) < 0.5
            c = np.where(blank[:, None] & ~_segments(lengths[i])[:, 1], 0, codes[i])
            z, kept = forward(w, c, lengths[i])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = backward(w, kept, ((p - y[i]) * weight[i] / len(i)).astype(np.float32))
            t += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


# --- calibration ---------------------------------------------------------------


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of ``1 / (1 + exp(-(slope * z + shift)))``, Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return newton(lambda a, b: platt_sums(z, y, n1, n0, a, b), rounds)


def platt_sums(z: np.ndarray, y: np.ndarray, n1: int, n0: int, a: float, b: float) -> tuple[float, ...]:
    """Loss, its two slopes and three curvatures at (a, b), over some of the logits."""
    target = np.where(y == 1, (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0))
    z = z.astype(np.float64)
    s = a * z + b
    p = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
    d, q = p - target, np.maximum(p * (1 - p), 1e-12)
    return tuple(float(x.sum()) for x in (np.logaddexp(0, s) - target * s, d * z, d, q * z * z, q * z, q))


def newton(sums, rounds: int = 60) -> tuple[float, float]:
    """The least loss from (1, 0): Newton steps, halved while the loss grows."""
    a, b = 1.0, 0.0
    now = sums(a, b)
    for _ in range(rounds):
        step = np.linalg.solve([[now[3] + 1e-6, now[4]], [now[4], now[5] + 1e-6]], [now[1], now[2]])
        size, new = 1.0, sums(a - step[0], b - step[1])
        while size > 1e-6 and new[0] > now[0]:
            size /= 2
            new = sums(a - size * step[0], b - size * step[1])
        a, b, before, now = a - size * step[0], b - size * step[1], now, new
        if before[0] - now[0] < 1e-9 * max(1.0, abs(now[0])):
            break
    return float(a), float(b)


def recall_threshold(p: np.ndarray, recall: float) -> float:
    """The highest threshold that finds a share ``recall`` of these secrets."""
    return float(np.sort(p)[recall_place(len(p), recall)])


def recall_place(n: int, recall: float) -> int:
    """How many of ``n`` secrets may stay under the threshold."""
    return int(np.floor((1 - recall) * n + 1e-9))


@dataclass
class Network:
    weights: dict
    slope: float
    shift: float
    thresholds: dict[bool, float]  # by named

    def scores(self, windows: list[str], lengths: list[int]) -> np.ndarray:
        z = logits(self.weights, codes_of(windows), np.array(lengths)) if windows else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z.astype(np.float64) + self.shift, -500, 500)))


# --- Spark ----------------------------------------------------------------------


def rule_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled findings (id, start, end, secret) as the rules see them: their findings' values are secrets,
    all other candidates are not. Stand-in where no reviewed findings exist."""
    src = pick(docs, id=id_col, _text=text_col).select(F.col("id").cast("long"), null_safe_text("_text").alias("_text"))

    def task(frames: Iterator[pd.DataFrame]):
        for f in frames:
            out = []
            for i, t in zip(f["id"], f["_text"]):
                found, short = rule_findings(t)
                for kind, a, b in found:
                    out.append((i, *value_of(t, kind, a, b)[:2], 1))
                out += [(i, a, b, 0) for a, b, _ in other_candidates(t, found, short)]
            yield pd.DataFrame(out, columns=["id", "start", "end", "secret"]).astype({"id": "Int64", "start": "int64", "end": "int64", "secret": "int32"})

    return src.mapInPandas(task, "id long, start long, end long, secret int")


def labelled_windows(docs: DataFrame, findings: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """Distinct (chars, length, named, secret) of all labelled findings. Without a table of findings the
    rules label the texts in the same pass."""
    src = pick(docs, id=id_col, _text=text_col).select(F.col("id").cast("long"), null_safe_text("_text").alias("_text"))
    if findings is not None:
        marks = findings.where(F.col("id").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("secret").isNotNull())
        marks = marks.select(F.col("id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.col("secret").cast("int"))
        src = src.join(marks, "id")

    def task(frames: Iterator[pd.DataFrame]):
        for f in frames:
            out = []
            if "start" in f:
                for t, a, b, y in zip(f["_text"], f["start"], f["end"], f["secret"]):
                    if 0 <= a < b <= len(t):
                        named = any(m.start(2) == a for m in ASSIGN.finditer(t, max(0, a - 64), min(len(t), b)))
                        out += [(c, n, named, int(y)) for c, n in windows_of(t, int(a), int(b))]
            else:
                for t in f["_text"]:
                    found, short = rule_findings(t)
                    for kind, a, b in found:
                        a, b, named = value_of(t, kind, a, b)
                        out += [(c, n, named, 1) for c, n in windows_of(t, a, b)]
                    for a, b, named in other_candidates(t, found, short):
                        out += [(c, n, named, 0) for c, n in windows_of(t, a, b)]
            yield pd.DataFrame(out, columns=["chars", "length", "named", "secret"]).astype({"length": "int32", "named": "bool", "secret": "int32"})

    return src.mapInPandas(task, "chars string, length int, named boolean, secret int").distinct()


def _fitted(windows: DataFrame, learn, n: int, share: float, steps: int, seed: int) -> dict[str, np.ndarray]:
    """Weights learnt from all windows with ``learn``: in every round each shard of about ``SHARD_ROWS`` (by hash)
    goes on from the shared weights over all its rows, and the results are averaged by rows. One shard: one round."""
    shards = -(-n // SHARD_ROWS)
    rounds = 1 if shards == 1 else ROUNDS
    dealt = windows.where(learn).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    weights = start_weights(seed)
    shapes = {k: v.shape for k, v in weights.items()}
    ends = np.cumsum([v.size for v in weights.values()])

    def pass_of(number: int, start: dict):
        def task(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["h", "secret", "named"])
            shard = int(rows["shard"].iloc[0])
            own = seed if rounds == 1 else [seed, number, shard]
            whole = max(-(-steps // rounds), -(-len(rows) // BATCH))  # each row at least once
            w = train(codes_of(rows["chars"].tolist()), rows["length"].to_numpy(), rows["secret"].to_numpy(), whole, own, start=start, share=share)
            flat = np.concatenate([v.ravel() for v in w.values()]).astype("<f4")
            return pd.DataFrame({"shard": [shard], "n": [len(rows)], "weights": [flat.tobytes()]})

        return task

    for number in range(rounds):
        total, seen = np.zeros(ends[-1]), 0
        got = dealt.groupBy("shard").applyInPandas(pass_of(number, weights), "shard int, n long, weights binary")
        for r in got.orderBy("shard").toLocalIterator():  # some 20 kB a shard, one after the other
            total += r["n"] * np.frombuffer(r["weights"], "<f4").astype(np.float64)
            seen += r["n"]
        weights = {k: v.reshape(shapes[k]).astype(np.float32) for k, v in zip(shapes, np.split(total / seen, ends[:-1]))}
    return weights


def _held_logits(windows: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(z, secret, named, place): logits of all windows; ``place`` orders as z does, in 32 bits."""

    def task(frames: Iterator[pd.DataFrame]):
        for f in frames:
            z = logits(w, codes_of(f["chars"].tolist()), f["length"].to_numpy()).astype(np.float32)
            bits = z.view(np.uint32).astype(np.int64)
            place = np.where(bits >> 31, bits ^ 0xFFFFFFFF, bits ^ 0x80000000)
            yield pd.DataFrame({"z": z, "secret": f["secret"], "named": f["named"], "place": place})

    return windows.select("chars", "length", "named", "secret").mapInPandas(task, "z float, secret int, named boolean, place long")


def _platt_over(held: DataFrame, n1: int, n0: int) -> tuple[float, float]:
    """:func:`platt` with its sums added up in tasks."""

    def sums(a: float, b: float) -> np.ndarray:
        def task(frames: Iterator[pd.DataFrame]):
            for f in frames:
                yield pd.DataFrame([platt_sums(f["z"].to_numpy(), f["secret"].to_numpy(), n1, n0, a, b)], columns=list("abcdef"))

        cols = [F.sum(c) for c in "abcdef"]
        return np.array(held.select("z", "secret").mapInPandas(task, "a double, b double, c double, d double, e double, f double").agg(*cols).first(), float)

    return newton(sums)


def _nth_logit(held: DataFrame, n: int) -> float:
    """The logit with ``n`` others before it in ascending order, by counts of its upper, then of its lower 16 bits."""
    at, known = n, 0
    for shift in (16, 0):
        part = held if shift else held.where(F.shiftright("place", 16) == known)
        digit = F.shiftright("place", shift).bitwiseAND(0xFFFF).alias("digit")
        for r in sorted(part.groupBy(digit).count().collect()):  # at most 65,536 rows
            if at < r["count"]:
                known = known << 16 | r["digit"]
                break
            at -= r["count"]
    bits = known ^ 0x80000000 if known >> 31 else known ^ 0xFFFFFFFF
    return float(np.uint32(bits).view(np.float32))


def fit(docs: DataFrame, findings: DataFrame | None = None, recall: float = 0.95, steps: int = 800, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Network, calibration and thresholds from all labelled findings (see :func:`rule_labels`)."""
    windows = labelled_windows(docs, findings, id_col, text_col).withColumn("h", F.md5(F.concat("chars", F.lit(":"), F.col("length").cast("string"))))
    windows = stored(windows)
    kept = F.pmod(F.conv(F.substring("h", 1, 2), 16, 10).cast("int"), F.lit(4)) == 0
    held = None
    try:
        count = {(r[0], r[1]): r[2] for r in windows.groupBy(kept, "secret").count().collect()}
        of = lambda y, parts=(True, False): sum(count.get((k, y), 0) for k in parts)
        if not (of(0) and of(1)):
            return None
        split = all(count.get((k, y)) for k in (True, False) for y in (0, 1))  # else too few: all teach, all calibrate
        learn, parts = (~kept, (False,)) if split else (F.lit(True), (True, False))
        n1, n0 = of(1, parts), of(0, parts)
        w = _fitted(windows, learn, n1 + n0, n1 / (n1 + n0), steps, seed)
        parts = (True,) if split else (True, False)
        held = stored(_held_logits(windows.where(kept) if split else windows, w))
        a, b = _platt_over(held, of(1, parts), of(0, parts))
        net = Network(w, a, b, {})
        secrets = held.where(F.col("secret") == 1)
        size = {r[0]: r[1] for r in secrets.groupBy("named").count().collect()}
        for group in (False, True):
            enough = size.get(group, 0) >= 20
            mine, n = (secrets.where(F.col("named") == group), size[group]) if enough else (secrets, sum(size.values()))
            at = recall_place(n, recall)
            z = _nth_logit(mine, at if a >= 0 else n - 1 - at)
            net.thresholds[group] = float(1 / (1 + np.exp(-np.clip(a * z + b, -500, 500))))
        return net
    finally:
        discard(windows)
        discard(held)


def scan(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found: spans of the rules and of the network, by start, then kind). Every span has the
    network's score (null without one)."""
    src = pick(docs, doc_id=id_col, _text=text_col).select("doc_id", null_safe_text("_text").alias("_text"))

    def task(frames: Iterator[pd.DataFrame]):
        for f in frames:
            spans, at, chars, lengths = [], [], [], []
            for t in f["_text"]:
                found, short = rule_findings(t)
                mine = [(k, a, b, value_of(t, k, a, b)) for k, a, b in found]
                mine += [("neural", a, b, (a, b, named)) for a, b, named in other_candidates(t, found, short)] if net else []
                mine.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                spans.append(mine)
                for _, _, _, (a, b, _n) in mine if net else []:
                    tiles = windows_of(t, a, b)
                    at.append(len(tiles))
                    chars += [c for c, _ in tiles]
                    lengths += [n for _, n in tiles]
            best = np.maximum.reduceat(net.scores(chars, lengths), np.cumsum([0, *at[:-1]])) if at else []
            best, out = iter(best), []
            for mine in spans:
                row = []
                for kind, a, b, (_a, _b, named) in mine:
                    score = float(next(best)) if net else None
                    if kind != "neural" or score >= net.thresholds[named]:
                        row.append({"kind": kind, "start": a, "end": b, "score": score})
                out.append(row)
            yield pd.DataFrame({"doc_id": f["doc_id"], "found": out})

    return src.mapInPandas(task, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, found {SPAN_TYPE}")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts and hash of the rules' findings, all spans as text."""

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "neural")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), count("neural"))
