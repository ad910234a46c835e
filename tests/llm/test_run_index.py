"""Matching statistics against a plain search."""

import numpy as np
import pytest

from askwell.llm.run_index import RunIndex


def longest(pattern, texts):
    out = []
    for i in range(len(pattern)):
        n = 0
        while i + n < len(pattern) and any(pattern[i : i + n + 1] in t for t in texts):
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_matches_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    kinds = [b"ab", b"abc\x00\xff", b"abcdefgh"][seed % 3]
    word = lambda n: bytes(rng.choice(list(kinds), n))
    base = [word(60) for _ in range(3)]

    def piece():
        b = base[rng.integers(3)]
        i, j = sorted(rng.integers(0, 61, 2))
        return b[i:j] + word(rng.integers(0, 20)) + base[rng.integers(3)][: rng.integers(0, 40)]

    pieces, classes = [piece() for _ in range(25)], rng.integers(0, 3, 25)
    patterns, wanted = [piece() for _ in range(25)], rng.integers(0, 4, 25)
    flat = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in xs])]))
    index = RunIndex(*flat(pieces), classes)
    data, at = flat(patterns)
    big = np.where(wanted > classes.max(), 0, wanted)
    got = index.statistics(data, at, big)
    for i, p in enumerate(patterns):
        assert got[at[i] : at[i + 1]].tolist() == longest(p, [t for t, c in zip(pieces, classes) if c == big[i]]), (i, p)
