"""Operator 11: rules against a character-by-character scan, network against numeric gradients, thresholds, held-out recall."""

import hashlib
import string
from itertools import takewhile

import numpy as np
import pytest

from helpers import SF01
from tidecorpus.llm import queries, secret_scan as ss

KEY = set(string.ascii_letters + string.digits + "+/_.=-")
NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def slow_rules(t):
    """The rules by hand, one place at a time."""
    out, i = [], 0
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    while i < len(t):
        hit = None
        for name in NAMES:
            if low.startswith(name, i):
                for q1 in (1, 0):
                    j = i + len(name)
                    if q1 and not (j < len(t) and t[j] in "\"'"):
                        continue
                    j += q1
                    while j < len(t) and t[j] == " ":
                        j += 1
                    if j < len(t) and t[j] in ":=":
                        j += 1
                        while j < len(t) and t[j] == " ":
                            j += 1
                        for q2 in (1, 0):
                            if q2 and not (j < len(t) and t[j] in "\"'"):
                                continue
                            v = j + q2
                            n = len(list(takewhile(KEY.__contains__, t[v:])))
                            if n:
                                hit = (v, v + n)
                                break
                    if hit:
                        break
            if hit:
                break
        if hit:
            if hit[1] - hit[0] >= 12:
                out.append(("assign", i, hit[1]))
            i = hit[1]
        else:
            i += 1
    for kind, head, chars, least in (("access", "AKIA", set(string.ascii_uppercase + string.digits), 18), ("hex", "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(t):
            n = len(list(takewhile(chars.__contains__, t[i + len(head) :]))) if t.startswith(head, i) else 0
            if n and n + len(head) >= least:
                out.append((kind, i, i + n + len(head)))
            i += n + len(head) if n else 1
    return sorted(out, key=lambda f: (f[1], ("assign", "access", "hex").index(f[0])))


def test_rules_by_hand():
    r = np.random.default_rng(0)
    bits = [*NAMES, "PassWord", "toKen", "ſecret", "toKen", '"', "'", " ", ":", "=", "AKIA", "AKIAAKIA", "ABCDEFGHIJ1234567890", "0123456789abcdef", "abc", "é", "😀", "secret", "\n", "x" * 14]
    texts = ["".join(r.choice(bits, r.integers(0, 14))) for _ in range(3000)]
    for t in [*texts, "", "token: secret: abcdefghijkl", "password=" + "q" * 100_000]:
        assert ss.rule_findings(t)[0] == slow_rules(t), t[:200]


def test_gradients():
    r = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in ss.start_weights(3).items()}
    w["conv_b"] += 0.05
    w["hide_b"] += 0.3  # keep the hidden units off their kink
    codes, lengths = r.integers(0, ss.N_CHARS, (5, ss.WIDTH)), np.array([1, 6, 17, 40, 12])
    y = np.array([1, 0, 1, 0, 1.0])

    def loss():
        z = ss.forward(w, codes, lengths)[0]
        return float((np.logaddexp(0, z) - y * z).sum())

    z, kept = ss.forward(w, codes, lengths)
    g = ss.backward(w, kept, 1 / (1 + np.exp(-z)) - y)
    for k in w:
        for _ in range(8):
            at = tuple(r.integers(0, s) for s in w[k].shape)
            if k == "embed":
                at = (int(codes[r.integers(5), r.integers(ss.WIDTH)]), at[1])
            old = w[k][at]
            w[k][at] = old + 1e-6
            up = loss()
            w[k][at] = old - 1e-6
            down = loss()
            w[k][at] = old
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), k


def test_threshold_and_calibration():
    p = np.arange(1, 101) / 100
    t = ss.recall_threshold(p, 0.95)
    assert (p >= t).mean() == pytest.approx(0.95) and ss.recall_threshold(p, 1.0) == 0.01
    r = np.random.default_rng(2)
    z = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.7 * z - 1)))).astype(int)
    a, b = ss.platt(z, y)
    assert abs(a - 0.7) < 0.08 and abs(b + 1) < 0.12


def test_long_values_are_read_whole():
    t = "k=" + "a1" * 5000 + " end"
    tiles = ss.windows_of(t, 2, 10_002)
    assert len(tiles) == 250 and "".join(c[ss.LEFT : ss.LEFT + n] for c, n in tiles) == t[2:10_002]
    assert ss.windows_of("x1" * 25, 0, 50)[-1] == (("x1" * 25)[: 10].rjust(24, "\0")[-24:] + ("x1" * 20).ljust(56, "\0"), 40)


LARGER = "/root/testdata/sf0.1"  # some hundred findings


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    return ss.fit(docs.where(~queries.held_out()))


def test_held_out_findings(spark, net):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").where(queries.held_out())
    rows = ss.labelled_windows(docs, None, "doc_id", "text").toPandas()
    p = net.scores(rows["chars"].tolist(), rows["length"].tolist())
    at = np.array([net.thresholds[bool(n)] for n in rows["named"]])
    secret = rows["secret"] == 1
    assert secret.sum() > 50 and (~secret).sum() > 50
    assert (p >= at)[secret].mean() >= 0.9 and (p >= at)[~secret].mean() <= 0.05


def test_query_digest(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_secret_scan(spark, SF01).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        base = slow_rules(docs[r.doc_id]) if len(docs[r.doc_id]) < 3000 else ss.rule_findings(docs[r.doc_id])[0]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ss.KINDS[:3]]
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert [f"{k}:{a}:{b}" for k, a, b in spans if k != "neural"] == (joined.split(",") if joined else [])
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
        for k, a, b in spans:
            assert k != "neural" or not any(int(a) < y and x < int(b) for _, x, y in base)


def test_labelled_findings_teach(spark):
    """Reviewed findings decide: here tickets of one form are secrets, others are not."""
    r = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(400):
        good = i % 2
        v = ("ZX-" if good else "QV-") + "".join(r.choice(list("0123456789ABCDEF"), 18))
        rows.append((i, f"see ticket {v} in the log"))
        marks.append((i, 11, 11 + len(v), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = ss.fit(docs, spark.createDataFrame(marks, "id long, start long, end long, secret int"))
    new = spark.createDataFrame([(1, "a ZX-00FF00FF11AA22BB33 b"), (2, "a QV-00FF00FF11AA22BB33 b"), (3, "plain words only")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in ss.scan(new, net).collect()}
    assert got == {1: [("neural", 2, 23)], 2: [], 3: []}


def test_awkward_and_empty(spark, awkward, nothing, net):
    assert ss.digest(ss.scan(awkward, net)).count() == awkward.count()
    assert ss.scan(nothing, net).count() == 0 and ss.fit(nothing) is None
    got = ss.digest(ss.scan(awkward, None)).collect()
    assert {(r.spans, r.n_neural) for r in got if r.doc_id in (2, 3)} == {("", 0)}


def test_every_labelled_window_teaches(spark, monkeypatch):
    """More windows than one shard holds: all of them reach a shard, none is left out, and the result separates."""
    monkeypatch.setattr(ss, "SHARD_ROWS", 120)
    r = np.random.default_rng(5)
    rows = [(i, f"see ticket {'ZX-' if i % 2 else 'QV-'}{''.join(r.choice(list('0123456789ABCDEF'), 18))} in the log") for i in range(480)]
    marks = [(i, 11, 32, i % 2) for i in range(480)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "id long, start long, end long, secret int")
    seen, real = [], ss._fitted
    monkeypatch.setattr(ss, "_fitted", lambda windows, learn, n, *a: seen.append((n, windows.where(learn).count(), windows.count())) or real(windows, learn, n, *a))
    net = ss.fit(docs, marks)
    (n, taught, known), = seen
    assert known == 480 and taught == n > 3 * ss.SHARD_ROWS * 0.9
    new = spark.createDataFrame([(1, "see ticket ZX-00FF00FF11AA22BB33 in the log"), (2, "see ticket QV-00FF00FF11AA22BB33 in the log")], "doc_id long, text string")
    assert {x.doc_id: len(x.found) for x in ss.scan(new, net).collect()} == {1: 1, 2: 0}


def test_sums_and_places_in_tasks(spark):
    """Calibration and threshold over a table equal those over arrays."""
    r = np.random.default_rng(6)
    z = r.normal(0, 2, 900).astype(np.float32)
    y = (r.random(900) < 1 / (1 + np.exp(-z))).astype(int)
    bits = z.view(np.uint32).astype(np.int64)
    place = np.where(bits >> 31, bits ^ 0xFFFFFFFF, bits ^ 0x80000000)
    held = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(z, y, place)], "z float, secret int, place long").repartition(3)
    assert ss._platt_over(held, int(y.sum()), int((1 - y).sum())) == pytest.approx(ss.platt(z, y), rel=1e-6)
    for n in (0, 45, 450, 899):
        assert ss._nth_logit(held, n) == float(np.sort(z)[n])
