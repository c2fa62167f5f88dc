"""Word and shingle hashes of texts, vectorised over flat bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random 64-bit number for each byte, A-Z as a-z; the six blanks are marked apart.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
#: Longest stretch of text whose words are hashed at once.
STRETCH = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, BASE)]), dtype=np.uint64)
    return _powers


def _stretch(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and how many there are before each offset in ``at``."""
    word = ~BLANK[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[:-1][at[:-1] < len(raw)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    kept = np.flatnonzero(word)
    ordinal = np.searchsorted(kept, starts)
    length = np.diff(np.append(ordinal, len(kept)))
    place = np.arange(len(kept)) - np.repeat(ordinal, length)
    values = BYTE[raw[kept]] * _pow(int(length.max()))[place]
    return mix(np.add.reduceat(values, ordinal) + length.astype(np.uint64)), np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes other than blanks, A-Z lower-cased), and each text's bounds among them."""
    if len(at) != 2 or len(raw) <= STRETCH:
        return _stretch(raw, at)
    out, here = [], 0
    while here < len(raw):  # one long text: cut it at blanks
        to = min(len(raw), here + STRETCH)
        while to < len(raw) and not BLANK[raw[to]]:
            gap = np.flatnonzero(BLANK[raw[to : to + 65536]])
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + 65536)
        out.append(_stretch(raw[here:to], np.array([0, to - here]))[0])
        here = to
    words = np.concatenate(out)
    return words, np.array([0, len(words)])


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``n`` adjacent words; fewer words count as one shingle, none as no set."""
    words, bound = word_hashes(raw, at)
    counts = np.diff(bound)
    rows = len(words) - n + 1
    run = np.zeros(max(rows, 0), np.uint64)
    for j in range(n if rows > 0 else 0):
        run = mix((run ^ words[j : j + rows]) + BASE)
    out = []
    for i, c in enumerate(counts):
        a = bound[i]
        if c >= n:
            out.append(np.unique(run[a : a + c - n + 1]))
        elif c:
            h = np.array([c], np.uint64)
            for w in words[a : a + c]:
                h = mix((h ^ w) + BASE)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
