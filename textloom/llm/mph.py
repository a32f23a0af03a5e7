"""Minimal perfect hashing of distinct 64-bit keys.

Levels of bit arrays: a key takes its bit of a level if no other key asks for
the same bit, and goes on to the next level otherwise. The number of set bits
before a key's bit is its slot, so slots are gapless from 0. Keys that are left
after the last level get the slots behind, by their order.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LEVELS = 24
#: Bits of a level for each key that reaches it.
ROOM = 2
ODD = 0x9E3779B97F4A7C15


def places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = keys + U((level + 1) * ODD % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x % U(bits)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """The function of distinct uint64 ``keys`` as plain arrays."""
    words, sizes, left = [], [], keys.astype(U)
    for level in range(LEVELS):
        if not len(left):
            break
        bits = -(-len(left) * ROOM // 64) * 64
        at = places(left, level, bits)
        alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(bits)
        left = left[~alone[at.astype(np.int64)]]
    flat = np.concatenate([np.empty(0, "<u8"), *words])
    counts = np.bitwise_count(flat).astype(np.int64)
    return {"bits": flat, "before": np.cumsum(counts) - counts, "sizes": np.array(sizes, np.int64), "rest": np.sort(left), "total": np.array([len(keys)], np.int64)}


def slots(f: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that was not there gets any slot or -1, so
    compare the key kept at the slot."""
    out = np.full(len(keys), -1, np.int64)
    open_, first = np.arange(len(keys)), 0
    for level, bits in enumerate(f["sizes"].tolist()):
        if not len(open_):
            return out
        at = places(keys[open_], level, bits)
        word, bit = first + (at >> U(6)).astype(np.int64), at & U(63)
        own = f["bits"][word]
        hit = (own >> bit & U(1)).astype(bool)
        low = own[hit] & ((U(1) << bit[hit]) - U(1))
        out[open_[hit]] = f["before"][word[hit]] + np.bitwise_count(low).astype(np.int64)
        open_ = open_[~hit]
        first += bits // 64
    rest = f["rest"]
    if len(open_) and len(rest):
        at = np.minimum(np.searchsorted(rest, keys[open_]), len(rest) - 1)
        known = rest[at] == keys[open_]
        out[open_[known]] = int(f["total"][0]) - len(rest) + at[known]
    return out
