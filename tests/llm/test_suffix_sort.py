"""Suffix sorting against brute force, with little memory so that files and deeper levels are used."""

import numpy as np
import pytest

from ledgerlens.llm import suffix_sort as S


def brute(text, window, usable):
    seen = {}
    for p in np.flatnonzero(usable):
        seen.setdefault(text[p : p + window].tobytes(), []).append(p)
    out = np.zeros(len(text), bool)
    for at in seen.values():
        if len(at) > 1:
            out[at] = True
    return out


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("base", [2, 50, 10_000])
@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_repeated_windows(base, letters, kind, monkeypatch):
    monkeypatch.setattr(S.CharQueue.__init__, "__defaults__", (64,))
    rng = np.random.default_rng(letters)
    for n, window in ((60, 5), (800, 12), (3000, 30)):
        parts = [rng.integers(1, letters + 1, rng.integers(1, n)).astype(kind) for _ in range(4)]
        parts += [parts[0], parts[1][: len(parts[1]) // 2], np.tile(parts[2][:7], 9), np.full(3 * window, 1, kind)]
        text, usable = [], []
        for p in parts:
            text += [p, np.zeros(1, kind)]
            ok = np.zeros(len(p) + 1, bool)
            ok[: max(0, len(p) - window + 1)] = True
            usable.append(ok)
        text, usable = np.concatenate(text), np.concatenate(usable)
        assert (S.repeated_windows(text, window, usable, base) == brute(text, window, usable)).all()


@pytest.mark.parametrize("base", [3, 1000])
def test_order(base):
    rng = np.random.default_rng(3)
    for letters in (1, 2, 3, 30):
        text = rng.integers(1, letters + 1, 500).astype(np.int64)
        got = S.sort_suffixes(text, 10_000, None, base)
        assert got.tolist() == sorted(range(500), key=lambda i: text[i:].tolist())
