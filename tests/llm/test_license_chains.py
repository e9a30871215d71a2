"""Chains of runs over licence templates: stray words before a notice, best chains by brute force."""

import itertools
import random

import pytest

from tidecorpus.llm import license_scan as ls

SCANNER = ls.Scanner(ls.BASE, ls.TEMPLATES, ls.MIN_RUN, ls.COVERAGE)
NOTICES = [(name, notice) for name, notices in ls.TEMPLATES.items() for notice in notices]


@pytest.mark.parametrize("stray", ["to the", "of the", "in the", "the software", "to the of the in the", "of the x in the y to the z"])
def test_stray_words_before_a_notice_hide_nothing(stray):
    for name, notice in NOTICES:
        got = SCANNER.scan(f"{stray} zzz {notice} zzz {stray}")
        total, first = len(ls.words_of(notice)), len(ls.words_of(stray)) + 1
        assert name in got[5].split(",") and got[6] == 1.0, (stray, notice)
        assert (name, first, first + total - 1, 1.0) in got[7], (stray, notice)


def test_notices_repeated_are_spans_of_their_own():
    mit = ls.TEMPLATES["mit"][2]
    got = SCANNER.scan(f"to the zzz {mit} of the zzz {mit} zzz {mit}")
    assert [x for x in got[7] if x[0] == "mit" and x[3] == 1.0] == [("mit", 3, 89, 1.0), ("mit", 93, 179, 1.0), ("mit", 181, 267, 1.0)]


def test_best_chain_by_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        matches = []
        for _ in range(rng.randint(1, 6)):
            size = rng.randint(2, 6)
            matches.append((size - 1 + rng.randint(0, 25), size - 1 + rng.randint(0, 12), size))
        gap, want = 10, 0
        for n in range(1, len(matches) + 1):
            for chain in itertools.combinations(sorted(matches), n):
                covered, ok = chain[0][2], True
                for (pl, pe, _), (l, e, size) in itertools.pairwise(chain):
                    start, at = l - size + 1, e - size + 1
                    ok &= pl < l and pe < e and start - pl <= gap
                    covered += size - max(0, pl - start + 1, pe - at + 1)
                if ok:
                    want = max(want, covered)
        assert ls.Scanner._best(matches, gap)[0][0] == want, matches


def test_template_inside_a_longer_run_of_another():
    apache = ls.TEMPLATES["apache-2.0"][1]
    got = SCANNER.scan("zzz " + " ".join(apache.split()[:16]) + " zzz")
    assert "apache-2.0" in got[5].split(",") and ("apache-2.0", 1, 8, 1.0) in got[7] and got[6] == 1.0
    s = ls.Scanner({}, {"whole": ["a b c d e f g h i j k"], "head": ["a b c"], "middle": ["d e f"], "end": ["i j k"]}, 2, 0.8)
    got = s.scan("z a b c d e f g z")
    assert got[5] == "head,middle" and got[7] == [("head", 1, 3, 1.0), ("middle", 4, 6, 1.0)]
    assert s.scan("a b c d e f g h i j k")[5] == "end,head,middle,whole"

    for kind in ("nc", "sa"):
        text = ls.TEMPLATES[f"cc-by-{kind}-4.0"]
        assert all(f"cc-by-{kind}-4.0" in (x := SCANNER.scan(notice)[5].split(",")) and "cc-by-4.0" not in x for notice in text)


def test_whole_templates_by_brute_force():
    rng = random.Random(6)
    for _ in range(600):
        templates = [[rng.choice("abc") for _ in range(rng.randint(2, 7))] for _ in range(4)]
        words = [rng.choice("abcz") if rng.random() < 0.4 else None for _ in range(4)]
        words = [w for x in words for w in ([x] if x else rng.choice(templates))]
        s = ls.Scanner({"a b": "base"}, {str(t): [" ".join(x)] for t, x in enumerate(templates)}, 2, 1.0)
        found = s.scan(" ".join(words))[5].split(",")
        for t, x in enumerate(templates):
            if any(words[i : i + len(x)] == x for i in range(len(words))):
                assert str(t) in found, (words, x)
