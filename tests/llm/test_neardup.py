import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidecorpus.llm import neardup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits):
    f, root = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def planted(n=400, seed=1):
    """64-bit values: random ones, and chains and dense groups a few bits apart."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(rng.choice((3, 60))):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("groups,cell_rows", [(None, 50_000), (5, 50_000), (8, 7)])
def test_links_give_the_components_of_all_pairs(spark, groups, cell_rows):
    prints = planted()
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r["id"]: r["root"] for r in neardup.components(neardup.links(nodes, 4, cell_rows, groups)).collect()}
    want = components(prints, 4)
    classes = {}
    for s, r in zip(signed, want):
        classes.setdefault(r, []).append(s)
    for members in classes.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_bound_is_under_the_distance():
    a = np.array(planted(50), dtype=np.uint64)
    e = neardup._counts(a)
    for x, ex in zip(a, e):
        near = set(neardup._near(a, e, x, ex, 4))
        assert near == set(np.flatnonzero(np.bitwise_count(a ^ x) <= 4))


def test_fingerprints_and_components_by_brute_force(spark, awkward):
    rows = awkward.collect()
    prints = [simhash(r["text"]) for r in rows]
    got = neardup.near_duplicates(awkward).select("doc_id", neardup.hex64(F.col("fingerprint")).alias("f"), "component_id").collect()
    root = components(prints, 4)
    ids = {}
    for r, c in zip(rows, root):
        if r["doc_id"] is not None:
            ids[c] = min(ids.get(c, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{p:016x}", str(ids.get(c))) for r, p, c in zip(rows, prints, root))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def test_more_votes_than_a_lane_holds(spark):
    text = " ".join(f"t{i}" for i in range(70_000))
    got = neardup.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["fingerprint"]
    assert got % (1 << 64) == simhash(text)


def test_deduplicated_keeps_the_smallest_id_of_each_group(spark, awkward):
    kept = neardup.deduplicated(awkward)
    assert kept.columns == awkward.columns
    rows = awkward.collect()
    found = neardup.near_duplicates(awkward).collect()
    want = {r["component_id"] for r in found if r["component_id"] is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want)
    assert len(rows) > kept.count()


def test_empty(spark, nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.deduplicated(nothing).count() == 0
