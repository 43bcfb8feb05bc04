"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Values of the byte values with A-Z lower-cased.
_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are worked off at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: hashes, first bytes and ends (within their text); and each text's first word's place
    among them (and the total). Words are runs of other bytes than ASCII white space, A-Z lower-cased."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, np.zeros(len(texts) + 1, dtype=np.int64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.flatnonzero(~space)
    power = _powers(int(lengths.max()))[np.arange(len(inside)) - np.repeat(firsts, lengths)]
    hashes = mix(np.add.reduceat(_VALUE[data[inside]] * power, firsts) + lengths.astype(np.uint64))
    place = np.searchsorted(starts, base)
    own = np.repeat(base[:-1], np.diff(place))
    return hashes, starts - own, ends - own, place


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours."""
    n = len(h) - k + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j : j + n]
    return mix(out)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= SLICE or i == len(texts) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's set of k-word shingles, sorted; with fewer words the whole sequence is the only one; without words
    the set is empty."""
    for a, b in slices(texts):
        h, _, _, place = words(texts[a:b])
        runs = rolled(h, k)
        for i in range(b - a):
            lo, hi = place[i], place[i + 1]
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            elif hi > lo:
                yield rolled(h[lo:hi], int(hi - lo)) + np.uint64(hi - lo)
            else:
                yield np.empty(0, np.uint64)
