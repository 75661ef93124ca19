"""Word shingles of many texts at once, in numpy on Arrow's text buffers.

Words follow the benchmark rule: runs of digits, ASCII letters (A-Z as a-z)
and non-ASCII characters.  All of a slab's bytes are hashed with one running
polynomial, so that no word becomes a Python object.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Odd multiplier of the running polynomial and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What each byte weighs, and the longest range that the polynomial hashes.
WEIGHTS, LONG = np.random.default_rng(3).integers(1, 2**63, 256, np.uint64), 200


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _lowered() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            table[b] = b
        elif 65 <= b <= 90:
            table[b] = b + 32
    return table


LOWERED = _lowered()


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64; the longest so far are kept."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n] if n else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the first word of each text (one more than
    texts).  ``starts`` are byte offsets of the texts in ``data``."""
    low = LOWERED[data]
    inside = low > 0
    edge = np.zeros(len(low) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[False], inside[:-1]]) if len(low) else inside
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(low) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return range_hashes(low, begins, ends), np.searchsorted(begins, starts)


def range_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from one running polynomial; ranges
    above ``LONG`` bytes, where such polynomials can be made to collide, are
    hashed by themselves."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(WEIGHTS[data] * _powers(P, len(data)), dtype=np.uint64)])
    out = (total[ends] - total[begins]) * _powers(P_INV, len(data))[begins]
    out = mix64(out + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - begins > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[begins[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within each text, and the first of
    each text.  A text of 1 to k - 1 words has one shingle: all its words."""
    n = np.diff(first)
    many = np.maximum(n - k + 1, 0) + ((n > 0) & (n < k))
    at = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(n)), many)
    pos = first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    long = np.minimum(n[owner], k)
    out = np.zeros(len(pos), np.uint64)
    for j in range(k):
        use = j < long
        out[use] = mix64(out[use] * np.uint64(P) + words[pos[use] + j] + np.uint64(j))
    return out, at


def sequence_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole sequence of words."""
    n = np.diff(first)
    pos = (np.arange(len(words)) - np.repeat(first[:-1], n)).astype(np.uint64)
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words + (pos + np.uint64(1)) * np.uint64(c)), dtype=np.uint64)]) for c in (P, 0xC2B2AE3D27D4EB4F)]
    return tuple((t[first[1:]] - t[first[:-1]]).view(np.int64) for t in total)


def distinct(shingles: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct shingles."""
    return [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:])]


def signatures(shingles: np.ndarray, at: np.ndarray, t: int, seed: int = 11) -> np.ndarray:
    """(texts, t) minima as uint32: one permutation cut into ``t`` ranges.  An
    empty range borrows from a random range that is not, the same for all
    texts, so that equal positions agree as often as sets are similar."""
    out = np.full(((len(at) - 1) * t,), EMPTY, np.uint64)
    h = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    np.minimum.at(out, owner * t + (h % np.uint64(t)).astype(np.int64), h >> np.uint64(8))
    out = out.reshape(-1, t)
    got = out.copy()
    r = np.random.default_rng(seed)
    some = np.diff(at) > 0
    for attempt in range(4 * t):
        empty = (got == EMPTY) & some[:, None]
        if not empty.any():
            break
        # after many random tries, go round the ranges in order
        source = r.integers(0, t, t) if attempt < 3 * t else (np.arange(t) + attempt) % t
        lent = out[:, source]
        got = np.where(empty & (lent != EMPTY), mix64(lent + np.uint64(attempt + 1)) >> np.uint64(8), got)
    return mix64(got).astype(np.uint32)
