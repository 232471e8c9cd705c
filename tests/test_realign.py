"""Realignment against the standard library's blocks."""

import difflib
import random
import time

import pytest

from phonoweave.functions.text import compatibility, matching_blocks, realign


@pytest.mark.parametrize("seed", range(6))
def test_blocks_equal_the_library(seed):
    r = random.Random(seed)
    for _ in range(150):
        old, new = ("".join(r.choice("abc中"[: r.randrange(1, 5)]) for _ in range(r.randrange(40))) for _ in range(2))
        want = [tuple(b) for b in difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks() if b.size]
        merged = []
        for i, j, n in matching_blocks(old, new):
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert merged == want


def test_equal_characters_keep_their_spans_at_any_length():
    middle = "".join(random.Random(1).choice("0123456789") for _ in range(300))
    old, new = f"x{middle}y", f"X{middle}Y"
    spans = [(k, k + 1) for k in range(len(old))]
    assert realign(old, new, spans) == spans
    r = random.Random(2)
    old = "".join(r.choice("abcdefghij ") for _ in range(20_000))
    new = "".join("É" if k % 997 == 5 else c for k, c in enumerate(old))
    began = time.time()
    got = realign(old, new, [(k, k + 1) for k in range(len(old))])
    assert got == [(k, k + 1) for k in range(len(old))] and time.time() - began < 30


def test_changes_share_a_span():
    spans = [(k, k + 1) for k in range(5)]
    assert realign("ab5cd", "ab五十cd", spans) == [(0, 1), (1, 2), (2, 3), (2, 3), (3, 4), (4, 5)]
    assert realign("ab", "axb", spans[:2]) == [(0, 1), (0, 2), (1, 2)] and realign("", "x", []) == [(0, 0)] and realign("abc", "", spans[:3]) == []
    text, sources = compatibility("a" * 900 + "ﬁ" + "é" + "가" + "b" * 500)
    assert text[900:902] == "fi" and len(text) == len(sources) and sources[0] == (0, 1) and sources[-1][1] == len("a" * 900 + "ﬁ" + "é" + "가" + "b" * 500)
