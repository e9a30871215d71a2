"""Operator 9: no licence earns the label of a sister licence."""

import itertools

import pytest

from tidecorpus.llm import license_scan as ls

SCANNER = ls.Scanner(ls.BASE, ls.TEMPLATES, ls.MIN_RUN, ls.COVERAGE)
BASE = set(ls.BASE.values())


@pytest.mark.parametrize("name", sorted(ls.TEMPLATES))
def test_each_notice_alone(name):
    for notice in ls.TEMPLATES[name]:
        for text in (notice, f"some words before {notice} and after", notice.upper()):
            got = SCANNER.scan(text)
            assert set(got[5].split(",")) - BASE == {name} and got[6] == 1.0, (text, got[5])


def test_unlisted_variants():
    for text in ("Licensed under CC BY-XX 4.0", "Licensed under CC BY-NC-XX 4.0", "This work is licensed under the GNU General Public License, version 1",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 2.0 International License", "Licensed under the Apache License, Version 1.1"):
        assert not set(SCANNER.scan(text)[5].split(",")) - BASE - {""}, text


def test_two_notices_side_by_side():
    for (a, xs), (b, ys) in itertools.permutations(ls.TEMPLATES.items(), 2):
        got = SCANNER.scan(f"{xs[0]}. {ys[0]}.")
        assert set(got[5].split(",")) - BASE == {a, b}, (a, b, got[5])


def test_long_notice_with_lost_and_stray_words():
    mit = ls.words_of(ls.TEMPLATES["mit"][2])
    broken = [w for i, w in enumerate(mit) if i % 17 != 5]
    for i in range(10, len(broken), 20):
        broken.insert(i, "rem")
    assert SCANNER.scan(" ".join(broken))[5] == "mit"
