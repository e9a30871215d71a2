"""Operator 7: order on random graphs against a plain longest path, one spelling of numbers, null conversations."""

import json
import random
from decimal import Decimal

from tidecorpus.llm import toolcalls as tc

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def plain_depths(parents):
    """id -> longest way from a root; None on or behind a cycle."""
    out = {}
    for _ in parents:
        for i, ps in parents.items():
            if i not in out and all(p in out for p in ps):
                out[i] = max((out[p] + 1 for p in ps), default=0)
    return {i: out.get(i) for i in parents}


def test_random_graphs(spark):
    r, rows, want = random.Random(0), [], {}
    for conv in range(25):
        ids = [f"c{i}" for i in range(r.randint(1, 14))]
        parents = {i: set() for i in ids}
        for k, i in enumerate(ids):
            for _ in range(r.randint(1, 2)):  # an id given twice joins what it comes after
                some = r.sample(ids[:k] if conv % 3 else ids, min(k if conv % 3 else len(ids), r.choice([0, 1, 1, 2, 3])))
                parents[i] |= set(some)
                rows.append((conv, i, r.randint(0, 9), "search", "{}", [*some, *(["nowhere"] if r.random() < 0.1 else [])] or None))
        want |= {(conv, i): d for i, d in plain_depths(parents).items()}
    df = spark.createDataFrame(rows, CALLS)
    got = {(x.conv_id, x.call_id): (x.depth, x.note) for x in tc.depths(df).collect()}
    assert {k: None if note == "cycle" else d for k, (d, note) in got.items()} == want
    out = tc.link(df, spark.createDataFrame([], RESULTS), tc.TOOLS).collect()
    at = {}
    for x in out:
        at.setdefault((x.conv_id, x.call_id), []).append(x.position)
    for conv, i, _, _, _, after in rows:
        for p in after or []:
            if p != "nowhere" and want[conv, i] is not None:
                assert max(at[conv, p]) < min(at[conv, i])


def test_dependencies_of_the_report(spark):
    rows = [(1, "a", 5, "search", "{}", None), (1, "c", 1, "search", "{}", ["b"]), (1, "c", 2, "search", "{}", ["a"]), (1, "b", 9, "search", "{}", ["a"])]
    out = tc.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), tc.TOOLS).collect()
    assert [x.call_id for x in sorted(out, key=lambda x: x.position)] == ["a", "b", "c", "c"]


def test_one_spelling_of_numbers():
    for group in (["1", "1.0", "1e0", "10e-1", "1.000"], ["100", "1e2", "100.0"], ["0", "-0", "0.0", "0e9"], ["0.001", "1e-3"], ["12345678901234567890123456789012345678901234567890", "12345678901234567890123456789012345678901234567890.0"], ["1e400", "10e399"]):
        spelt = {tc.canonical_text(g) for g in group}
        assert len(spelt) == 1 and Decimal(spelt.pop()) == Decimal(group[0])
    assert tc.canonical_text(' { "b" : [1.50, "\\u0041/", null], "a": {"z":true,"y":-2E+1} } ') == '{"a":{"y":-20,"z":true},"b":[1.5,"A/",null]}'
    for bad in ("", "{", "NaN", "Infinity", "[1,]", "{'a':1}", "[" * 100_000, None):
        assert tc.canonical_text(bad) is None
    r = random.Random(1)
    for _ in range(500):
        text = f"{r.choice(['', '-'])}{r.randint(0, 10**r.randint(1, 30))}{r.choice(['', '.' + str(r.randint(0, 999))])}{r.choice(['', 'e' + str(r.randint(-60, 60))])}"
        assert Decimal(tc.canonical_text(text)) == Decimal(text) and tc.canonical_text(tc.canonical_text(text)) == tc.canonical_text(text)
    assert json.loads(tc.canonical_text('{"k": "\\u2028\\n"}')) == {"k": "\u2028\n"}


def test_null_conversation_stands_apart(spark):
    calls = [(None, "x", 0, "search", "{}", None), (-1, "x", 0, "search", "{}", None)]
    out = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(None, "x", 1, "r")], RESULTS), tc.TOOLS).collect()
    assert sorted((str(x.conv_id), x.occurrence, x.status, x.position) for x in out) == [("-1", 0, "unanswered", 0), ("None", 0, "linked", 0)]
