"""Sets of word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A well-mixed permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _ODD[0]
        h = (h ^ (h >> np.uint64(27))) * _ODD[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where each text's words start and the last end): A-Z lower-cased, words parted by white space."""
    each = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in each])
    data = _LOWER[np.frombuffer(b"\n".join(each) + b"\n", np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.concatenate(([0], np.searchsorted(first, ends)))
    if not len(first):
        return np.empty(0, np.uint64), starts
    length = last - first
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), _BASE))
        return mixed(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[place], begin)), starts


def shingle_sets(texts: list[str | None], width: int = 3) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted. A text of fewer words than `width` has its whole sequence as its only one,
    which equals no shingle of full width; without words (or null) the set is empty."""
    h, starts = word_hashes(texts)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            full = (full + h[k : k + len(full)]) * _BASE
        full = mixed(full + np.uint64(width))
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                short = np.uint64(0)
                for x in h[a:b]:
                    short = (short + x) * _BASE
                yield mixed(np.array([short + np.uint64(b - a)]))
            else:
                yield np.empty(0, np.uint64)
