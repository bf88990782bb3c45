"""The bit matcher against the standard library's."""

import random
from difflib import SequenceMatcher

from ledgerlens.functions.text import BitMatcher


def test_same_blocks_as_the_library(monkeypatch):
    rng = random.Random(5)
    for signs, popular in (("ab", 0), ("abcdefgh ", 0), ("营业收入abc\U0001f600 ", 0), ("abcdefghijklmnopqrstuvwxyz0123456789", 200)):
        for _ in range(60):
            b = "".join(rng.choices(signs, k=rng.randrange(popular, popular + 120)))
            a = "".join(b[(lo := rng.randrange(len(b) + 1)) : lo + rng.randrange(30)] + "".join(rng.choices(signs + "xyz", k=rng.randrange(9))) for _ in range(rng.randrange(30)))
            for small in (0, 4000):
                monkeypatch.setattr(BitMatcher, "SMALL", small)
                got, want = BitMatcher(a, b), SequenceMatcher(None, a, b)
                assert got.get_matching_blocks() == want.get_matching_blocks() and got.ratio() == want.ratio()


def test_long_text_against_an_item(monkeypatch):
    """A text of 40,000 characters took the library one look at every one of them for each block that it found."""
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(300)]
    a, b = " ".join(rng.choices(words, k=7000)), " ".join(rng.choices(words, k=40))[:190]
    assert BitMatcher(a, b).ratio() == SequenceMatcher(None, a, b).ratio()
    looked = []
    own = SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda self, alo, ahi, blo, bhi: looked.append(ahi - alo) or own(self, alo, ahi, blo, bhi))
    BitMatcher(a, b).ratio()
    assert sum(looked) < len(a)
