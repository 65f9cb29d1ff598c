"""Words, hashes and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from .common import MIX_1, mixed

#: Cutting bytes: space and 0x09 to 0x0D (fixed by the contract).
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, from a fixed seed.
VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E6C63D0876A9A47
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, raised to 0 .. n - 1."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(n, np.uint64(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Polynomial sums: the hash of raw[a:b] is (s[b] - s[a]) * inverse ** a."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUE[raw] * powers(len(raw))[0], out=out[1:])
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's document (a place in offsets), first byte, end, and hash."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    visible = ~WHITE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], visible[:-1]]) & ~cut[:-1]
    after = np.concatenate([visible[1:], [False]]) & ~cut[1:]
    start = np.flatnonzero(visible & ~before)
    end = np.flatnonzero(visible & ~after) + 1
    sums = prefix_sums(LOWER[raw] if lower else raw)
    h = mixed((sums[end] - sums[start]) * powers(len(raw))[1][start] + (end - start).astype(np.uint64) * MIX_1)
    return np.searchsorted(offsets, start, "right") - 1, start, end, h


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each document, ascending, one after
    another, and where each document's begin. With fewer than `width` words
    the whole sequence is the one shingle; without words there is none."""
    doc, _, _, h = words_of(raw, offsets)
    n_docs = len(offsets) - 1
    n = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    if len(h) >= width:
        full = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            full += mixed(h[k : k + len(full)] + np.uint64(k)) * np.uint64(2 * k + 1)
        full = mixed(full)
    else:
        full = np.zeros(0, np.uint64)
    sets, begin = [], np.zeros(n_docs + 1, np.int64)
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = np.array([b - a], np.uint64)
            for k in range(a, b):
                s = mixed(s * MIX_1 + h[k])
        else:
            s = full[:0]
        sets.append(s)
        begin[d + 1] = begin[d] + len(s)
    return (np.concatenate(sets) if sets else full[:0]), begin
