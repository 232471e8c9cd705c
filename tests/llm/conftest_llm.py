"""Prose for the tests."""

import random

WORDS = "the of and to in that river stone copper lantern meadow window harvest signal paper crystal morning thunder gentle narrow".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))
