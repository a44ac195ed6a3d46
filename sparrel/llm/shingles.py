"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed with numpy.

Words are runs of bytes other than space and bytes 9 to 13, after A-Z were lower-cased; this
is the same as the pattern ``[^\\x20\\x09-\\x0D]+`` over characters, since UTF-8 keeps those bytes
for those characters alone.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_WORD = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        m = max(n, 2 * len(_POWERS))
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, _WORD, dtype=np.uint64), dtype=np.uint64)])
    return _POWERS[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word, in order."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    if not len(edge):
        return np.empty(0, dtype=np.uint64)
    starts, ends = edge[::2], edge[1::2]
    # polynomial in the place within the word: each byte is scrambled and weighted by a power
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if not starts[0] else None
    if place is None:
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        raw, inside, shift = raw[starts[0] :], inside[starts[0] :], starts[0]
    else:
        shift = 0
    value = (raw.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts - shift) + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; with fewer words, of the one whole
    sequence; empty without words or text."""
    words = word_hashes(text or b"")
    n = min(size, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    grams = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        grams = mix(grams * _GRAM + words[k : len(words) - n + 1 + k])
    return np.unique(grams)
