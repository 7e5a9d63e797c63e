"""Sets of word shingles, hashed to 64 bits with whole-array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xCA9B0C7EBA1DA115)
    return h ^ (h >> _U(32))


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, A-Z as a-z; and which bytes are white space."""
    value = mix(np.arange(1, 257, dtype=_U))
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return value, space


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        p = np.full(n, base, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the sorted distinct hashes[bounds[i]:bounds[i + 1]].

    A text of one to four words has one shingle, its whole sequence; one
    without words has none.
    """
    value, space = _bytes()
    a = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(a):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    blank = space[a]
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
    first, last = edge[::2], edge[1::2]
    power, inverse = _powers(1 << int(len(a)).bit_length())
    total = np.zeros(len(a) + 1, _U)
    np.cumsum(value[a] * power[: len(a)], out=total[1:])
    word = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(_U))
    starts = np.cumsum(sizes) - sizes
    doc = np.searchsorted(starts, first, "right") - 1
    per_doc = np.bincount(doc, minlength=len(texts))
    at = np.cumsum(per_doc) - per_doc
    n = max(0, len(word) - WORDS + 1)
    same = doc[:n] == doc[WORDS - 1 :]
    h = np.zeros(n, _U)
    for k in range(WORDS):
        h = mix(h + word[k : n + k])
    h, owner = h[same], doc[:n][same]
    short = np.flatnonzero((per_doc > 0) & (per_doc < WORDS))
    if len(short):
        whole = np.zeros(len(short), _U)
        for k in range(WORDS - 1):
            more = per_doc[short] > k
            whole[more] = mix(whole[more] + word[at[short[more]] + k])
        h = np.concatenate([h, mix(whole + per_doc[short].astype(_U))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)
