"""Word shingles of a text as 64-bit hashes, and SuperMinHash signatures of shingle sets."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import xxhash

WIDTH = 5
LONG_WORD = 512  # bytes; longer words are hashed one by one, not by the polynomial
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TERM = _rng.integers(1, 2 ** 63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2 ** 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, _BASE, np.uint64))
        down = np.cumprod(np.full(size, _UNBASE, np.uint64))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^(i+1) and base^-(i+1) modulo 2^64 for i < n."""
    up, down = _powers(1 << max(12, n.bit_length()))
    return up[:n], down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    up, down = powers(len(joined) + 1)
    total = np.concatenate(([_U(0)], np.cumsum(_BYTE[joined] * up[:-1])))
    out = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(words[i])
    return out


def shingle_set(text: str) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles (of the whole word sequence, if it is
    shorter; empty without words).  A-Z are lower-cased."""
    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(words) - WIDTH + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(words))):
        s += h[k: k + n] * _TERM[k]
    return np.unique(mix64(s + _U(min(len(words), WIDTH))))


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def superminhash(sets: list[np.ndarray], slots: int, chunk: int = 65_536) -> np.ndarray:
    """SuperMinHash signatures (rows: sets; slots <= 256).  Every element ranks the slots by a
    random permutation of its own; a slot keeps the least (rank, random) over the elements,
    which correlates the slots and lowers the variance of the share of equal slots.

    Ranks are dealt level by level for many sets at once: level j is one Fisher-Yates step
    of every element.  A set stops as soon as all its slots hold a value of the levels dealt
    so far, since later levels only give larger ones; large sets stop after a few."""
    out = np.full((len(sets), slots), ~_U(0))
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (size == 0 or size + len(sets[last]) <= chunk):
            size += len(sets[last])
            last += 1
        _deal(sets[first:last], out[first:last], slots)
        first = last
    return out


def _deal(sets: list[np.ndarray], sig: np.ndarray, slots: int) -> None:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return
    item = np.concatenate(sets)
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(item), 1))
    row = np.arange(len(item))
    flat = sig.reshape(-1)
    open_sets = np.unique(owner)
    for level in range(slots):
        draw = mix64(item + _U((level + 1) * _BASE & 0xFFFFFFFFFFFFFFFF))
        at = level + ((draw >> _U(32)) * _U(slots - level) >> _U(32)).astype(np.int64)
        slot = perm[row, at]
        perm[row, at] = perm[row, level]
        value = (mix64(draw ^ _U(_UNBASE)) >> _U(8)) | _U(level << 56)
        np.minimum.at(flat, owner * slots + slot, value)
        full = (sig[open_sets].max(axis=1) >> _U(56)) <= level
        if full.any():
            open_sets = open_sets[~full]
            if not len(open_sets):
                return
            still = np.zeros(len(sets), bool)
            still[open_sets] = True
            go_on = still[owner]
            if go_on.mean() < 0.75:
                owner, item, perm = owner[go_on], item[go_on], perm[go_on]
                row = np.arange(len(item))


def same_share(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
