"""Word shingles of many texts at once, as 56-bit numbers, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

WORDS = 5
#: Bits of a shingle's number; with the place of a text in its run it fills 64.
BITS = 56
TEXTS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 19
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
MIX = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25))


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        out = np.full(size, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[3]
    x = (x ^ (x >> np.uint64(29))) * MIX[4]
    return x ^ (x >> np.uint64(32))


def _run(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle numbers of each of at most TEXTS_AT_ONCE texts, which are in lower case already."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    size = 1 << max(12, (len(data) - 1).bit_length())
    up, down = (p[:len(data)] for p in _powers(size))
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # word starts and ends in turn
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    sums = np.cumsum(np.where(blank, np.uint64(0), _byte_values()[data]) * up)
    words = _mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, borders)  # words of text i: first[i] to first[i + 1]
    counts = np.diff(first)
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(WORDS):  # a text with fewer words is one shingle of all it has; nothing is read past its end
        part = np.zeros(len(words), dtype=np.uint64)
        part[:len(words) - k] = words[k:]
        text = np.repeat(np.arange(len(texts)), counts)
        inside = np.arange(len(words)) + k < first[text + 1]
        total = _mixed(total * MIX[0] + np.where(inside, part + MIX[1], np.uint64(0)) + np.uint64(k))
    begins = np.arange(len(words)) - first[text]
    whole = begins <= np.maximum(counts[text] - WORDS, 0)
    keys = (text[whole].astype(np.uint64) << np.uint64(BITS)) | (total[whole] >> np.uint64(64 - BITS))
    keys = np.sort(keys)
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    cuts = np.searchsorted(keys, np.arange(1, len(texts)).astype(np.uint64) << np.uint64(BITS))
    return [part & np.uint64((1 << BITS) - 1) for part in np.split(keys, cuts)]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle numbers of each text (UTF-8); A-Z are lower-cased, words stand between ASCII blanks."""
    run, size = [], 0
    for text in texts:
        if run and (len(run) == TEXTS_AT_ONCE or size + len(text) > BYTES_AT_ONCE):
            yield from _run(run)
            run, size = [], 0
        run.append(text.lower())
        size += len(text) + 1
    if run:
        yield from _run(run)
