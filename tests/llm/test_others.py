import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from helpers import SF001, SF01
from tidecorpus.llm import ann, fingerprint, license_scan, mixing, queries, token_count, toolcalls

TABLES = "documents embeddings conversations labels".split()


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    want = c.execute(queries.ORACLES[name])
    cols = [d[0] for d in want.description]
    order = [cols.index(x) for x in sorted(cols)]
    got = queries.QUERIES[name](spark, SF01)
    assert sorted(got.columns) == sorted(cols)
    assert rows(got) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


# ---- mixing


def waterfill(children, budget):
    """children: name -> (limit, weight). Deals again until nothing changes."""
    got, open_ = dict.fromkeys(children, 0.0), {k for k, (c, w) in children.items() if c > 0 and w > 0}
    left = budget
    while left > 1e-9 and open_:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] - got[k] <= left * children[k][1] / total + 1e-9}
        if not full:
            for k in open_:
                got[k] += left * children[k][1] / total
            return got
        for k in full:
            left -= children[k][0] - got[k]
            got[k] = children[k][0]
        open_ -= full
    return got


@pytest.mark.parametrize("seed", range(4))
def test_budgets_by_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = [(d, la, s, rng.choice((0, 5, 100, 1000, 20_000))) for d in "abc" for la in "xy" for s in "12" if rng.random() < 0.9]
    weights = {"a": 5.0, "b": 0.0 if seed == 3 else 2.0, "a/x": 3.0, "a/x/1": 0.25, "c/y": 4.0}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, weights, 0.9, 3).collect()}

    def w(*path):
        return weights.get("/".join(path), 1.0)

    def limit(prefix):
        return sum(3 * t for *p, t in leaves if tuple(p[: len(prefix)]) == prefix and all(w(*p[: i + 1]) > 0 for i in range(3)))

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({p[len(prefix)] for *p, _ in leaves if tuple(p[: len(prefix)]) == prefix})
        shares = waterfill({n: (limit((*prefix, n)), w(*prefix, n)) for n in names}, budget)
        return {k: v for n in names for k, v in down((*prefix, n), shares[n]).items()}

    want = down((), min(0.9 * sum(x[3] for x in leaves), limit(())))
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) <= 6 for k in got)  # rounding down at three levels
    assert all(got[(d, la, s)] <= 3 * t for d, la, s, t in leaves)


def test_drawn_prefixes_and_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a", "x", f"s{i % 3}") for i in range(300)], "doc_id long, text string, domain string, lang string, source string")
    out = mixing.draw(docs, {"a/x/s1": 4.0, "a/x/s2": 0.1}, 1.0, 2).toPandas()
    leaf = out.groupby("source").apply(lambda g: (g.n_tokens * g.copies).sum())
    assert leaf["s1"] == 2 * out[out.source == "s1"].n_tokens.sum()  # short: two epochs
    assert leaf.sum() <= out.n_tokens.sum() and leaf.sum() > 0.97 * out.n_tokens.sum()
    assert set(out.copies) <= {0, 1, 2}
    assert mixing.mixed(docs, {"a/x/s1": 4.0, "a/x/s2": 0.1}, 1.0, 2).count() == out.copies.sum()


def test_mixing_awkward(spark, awkward, nothing):
    out = mixing.mixed(awkward, **mixing.PRODUCTION)
    assert out.columns == awkward.columns
    assert out.where(F.col("text") == " \n\t ").count() == 0  # no tokens: never drawn
    assert mixing.mixed(nothing, **mixing.PRODUCTION).count() == 0
    a = mixing.draw(awkward, {}, 1.0, 1).collect()
    assert all(r["copies"] == (1 if r["n_tokens"] else 0) or r["n_tokens"] == 0 for r in a)


# ---- token counts


def unigram():
    v = token_count.vocabulary(P.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v))] + v, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)  # best path of the whole text
    return v, t


def test_counts_equal_the_tokenizer(spark, awkward, nothing):
    v, t = unigram()
    c = token_count.Counter(v)
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choice(" ab▁\n漢字😀é  the") for _ in range(rng.randint(0, 30)))
        assert c.count(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)
    out = token_count.with_counts(awkward, P.path("piece_bpe_32k.model"))
    assert all(r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in out.collect())
    assert token_count.with_counts(nothing, P.path("piece_bpe_32k.model")).count() == 0


def test_ties_by_brute_force():
    pieces = [(p, float(s)) for p, s in (("▁", -1), ("a", -1), ("b", -1), ("aa", -2), ("aaa", -3), ("ab", -2), ("▁a", -2), ("ba", -1))]
    t = Tokenizer(models.Unigram([("<unk>", -3.0)] + pieces, unk_id=0))
    c = token_count.Counter(pieces)
    for n in range(1, 8):
        for w in itertools.product("abz", repeat=n):
            word = "▁" + "".join(w)
            assert c.count_word(word) == len(t.encode(word).ids), word


# ---- fingerprints


def test_edited_texts_and_neighbours(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    x = docs.toPandas().sort_values("doc_id", ascending=False)
    ids, texts = x.doc_id.tolist(), x.text.tolist()
    for per_range in (7, 4000):
        near = {r["doc_id"]: r for r in fingerprint.neighbour_texts(docs, per_range).collect()}
        assert len(near) == len(ids)
        for i, d in enumerate(ids):
            assert near[d]["next_id"] == ids[(i + 1) % len(ids)] and near[d]["next_text"] == texts[(i + 1) % len(ids)]
    out = fingerprint.edited_fingerprints(awkward).collect()
    assert len(out) == awkward.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    same = {r["fingerprint"] for r in out if r["doc_id"] in (1, 11)}
    assert len(same) == 1  # equal texts
    assert fingerprint.edited_fingerprints(nothing).count() == 0
    one = fingerprint.edited_fingerprints(awkward.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_within_by_brute_force(spark):
    rng = random.Random(6)
    f = []
    for _ in range(60):
        x = rng.getrandbits(128)
        f.append(x)
        for _ in range(3):
            y = x
            for b in rng.sample(range(128), rng.randint(1, 5)):
                y ^= 1 << b
            f.append(y)
    f = sorted(set(f))
    s = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(s(x >> 64), s(x & (1 << 64) - 1)) for x in f], "hi long, lo long")
    got = {(r.hi, r.lo, r.hi2, r.lo2) for r in fingerprint.within(df, 3).collect()}
    want = {(s(a >> 64), s(a & (1 << 64) - 1), s(b >> 64), s(b & (1 << 64) - 1)) for a in f for b in f if a != b and (a ^ b).bit_count() <= 3}
    assert got == want


def test_fingerprint_is_native(spark):
    plan = fingerprint.fingerprints(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- tool calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_linking_order_validation_and_canonical_json(spark):
    ok = '{ "text" : "hi\\u0041", "n_words": 1 }'
    calls = [(1, "c", 5, "search", ok, "b"), (1, "b", 9, "search", ok, "a"), (1, "a", 7, "search", ok, None), (1, "x", 1, "search", ok, "y"), (1, "y", 2, "search", ok, "x"),
             (2, "r", 1, "search", '{"n_words": 0, "text": 3, "zz": {}}', "gone"), (2, "r", 2, "none", "[1]", None), (2, "q", 3, "search", None, None), (None, None, None, None, "no json", None)]
    results = [(1, "a", 8, 'say "x"'), (2, "r", 3, "first"), (2, "r", 4, "second"), (2, "r", 5, "third"), (1, "zzz", 1, None)]
    out = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), toolcalls.TOOLS).collect()
    by = {(r.conv_id, r.call_id, r.occurrence): r for r in out}
    assert len(out) == len(by) == 11
    order = [r.call_id for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)]
    assert order[:3] == ["a", "b", "c"] and set(order[3:]) == {"x", "y", "zzz"}
    assert by[1, "x", 0].errors == "cycle" and by[1, "zzz", 0].status == "orphan" and by[1, "b", 0].status == "unanswered"
    assert by[1, "a", 0].json == '{"arguments":{"n_words":1,"text":"hiA"},"id":"a","name":"search","occurrence":0,"result":"say \\"x\\""}'
    assert by[2, "r", 0].errors == "bounds of n_words,type of text,unknown field,unknown after"
    assert by[2, "r", 1].errors == "no object,unknown tool,unknown after" and '"result":"second"' in by[2, "r", 1].json and by[2, "r", 2].status == "orphan"
    assert by[2, "q", 0].errors == "no object" and by[None, "", 0].errors == "no object,unknown tool"


def test_deep_chain_takes_few_rounds(spark):
    n = 3000
    calls = spark.createDataFrame([(1, f"k{i:05}", n - i, "search", "{}", f"k{i - 1:05}" if i else None) for i in range(n)], CALLS)
    got = {r.call_id: r.depth for r in toolcalls.depths(calls).collect()}
    assert got == {f"k{i:05}": i for i in range(n)}


def test_tool_calls_empty(spark):
    assert toolcalls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), toolcalls.TOOLS).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", None), (None, None, None, None), (1, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.from_turns(turns), toolcalls.TOOLS).count() == 1


# ---- nearest neighbours


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = df.toPandas()
    m, ids = np.vstack(x.embedding).astype(float), x.vec_id.to_numpy()
    index = ann.build(df, list_rows=100, block_rows=64)
    got = ann.search(index, index.rows.where("vec_id % 20 = 0"), 20, query_rows=16).toPandas()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        s = m @ m[ids == q][0]
        s[ids == q] = -9
        best = np.lexsort((ids, -s))[:20]
        hit, total = hit + len(set(ids[best]) & set(g.vec_id)), total + 20
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and g.score.is_monotonic_decreasing
        assert np.allclose(g.score, s[[int(np.flatnonzero(ids == v)[0]) for v in g.vec_id]], rtol=0, atol=1e-12)
    assert got.query_id.nunique() == (ids % 20 == 0).sum() and hit / total >= 0.9


def test_vectors_that_take_no_part_ties_and_copies(spark):
    inf, nan = float("inf"), float("nan")
    good = [[1.0, 0.0], [0.0, 2.0], [0.5, 0.5]]
    data = [(i, good[i % 3]) for i in range(90)] + [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [None, 1.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in data], "vec_id long, embedding array<double>, list string, block int")
    got = ann.neighbours(df, 20, 20, list_rows=30).toPandas()
    assert sorted(got.query_id.unique()) == [0, 20, 40, 60, 80]
    vec = {i: np.array(good[i % 3]) for i in range(90)}
    vec[20] = min([np.array(good[2]), np.array(good[1])], key=lambda v: tuple(v))
    for q, g in got.groupby("query_id"):
        s = {i: float(v @ vec[q]) for i, v in vec.items() if i != q}
        want = sorted(s, key=lambda i: (-s[i], i))[:20]
        assert g.sort_values("rank").vec_id.tolist() == want
    assert ann.neighbours(df.limit(0), 20, 20).count() == 0
    assert ann.neighbours(df.where("vec_id = 120"), 20, 20).count() == 0


# ---- licences


def test_base_columns_by_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in c.execute(license_scan.oracle_base_sql()).fetchall()}
    got = {r[0]: tuple(r[1:6]) for r in license_scan.scan(spark.read.parquet(f"{SF01}/documents.parquet")).collect()}
    assert got == want


def test_matching_statistics_by_brute_force():
    rng = random.Random(7)
    seqs = [[rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(5)]
    a = license_scan.Automaton(seqs)
    subs = {tuple(s[i:j]): set() for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for t, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                subs[tuple(s[i:j])].add((t, j - 1))
    for sub, ends in subs.items():
        at = 0
        for w in sub:
            at = a.next[at][w]
        assert a.len[a.link[at]] < len(sub) <= a.len[at] and set(a.ends[at]) == ends


def test_places_by_brute_force():
    base = {"a b": "1", "b": "2", "b c a": "3"}
    s = license_scan.Scanner(base, {"t": ["a b c a b c", "c c"]}, 2, 0.8)
    rng = random.Random(8)
    for _ in range(1500):
        w = [rng.choice("abcz") for _ in range(rng.randint(0, 14))]
        places = sorted((i, k) for k, p in enumerate(base) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        got = s.scan(" ".join(w))
        assert got[:4] == (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None)), w
        assert ("t" in got[5].split(",")) >= ("a b c a b c" in " ".join(w)), w


def test_licence_with_gaps_and_awkward_rows(spark, awkward, nothing):
    notice = license_scan.TEMPLATES["mit"][2]
    holed = notice.replace("free of charge", "FREE of all charge").replace("merge,", "")
    got = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES, 2, 0.8).scan("Some words before. " + holed + " and after")
    assert "mit" in got[5] and got[7][0][0] == "mit" and got[6] >= 0.8
    out = license_scan.scan(awkward).collect()
    assert len(out) == awkward.count()
    assert {r["base_labels"] for r in out if r["doc_id"] in (1, 11)} == {"reserved"}
    assert all(r["n_words"] == 0 and r["labels"] == "" and r["score"] == 0 and r["first_word"] is None for r in out if r["doc_id"] in (2, 3, 7))
    assert license_scan.scan(nothing).count() == 0
