"""Hashes of all words of many texts at once, by running polynomials."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U = np.uint64
BASE = 0xD6E8FEB86659FD93
#: Which bytes belong to words: all but the six ASCII white-space characters.
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
#: A value per byte, well mixed.
VALUE = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i])) for i in range(256)), "<u8").astype(U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as asked."""

    def __init__(self):
        self.up = self.down = np.empty(0, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> U(32)
    x *= U(BASE)
    x ^= x >> U(29)
    return x


def running(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """A mixed polynomial hash of each run values[start:end], alike wherever the
    run lies: differences of one running sum, shifted back to the start."""
    up, down = powers.upto(len(values) + 1)
    run = np.empty(len(values) + 1, U)
    run[0] = 0
    np.cumsum(values * up[: len(values)], dtype=U, out=run[1:])
    return mixed((run[end] - run[start]) * down[start])


def word_spans(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes begins and ends."""
    edge = np.diff(WORD[code].view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)


def word_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and where each word begins and ends."""
    code = np.frombuffer(data, np.uint8)
    start, end = word_spans(code)
    return running(VALUE[code], start, end, powers), start, end


def grouped(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) of about ``size`` bytes; a longer text comes
    alone."""
    own, n, first = [], 0, 0
    for i, t in enumerate(texts):
        if own and n + len(t) > size:
            yield first, own
            own, n, first = [], 0, i
        own.append(t)
        n += len(t)
    if own:
        yield first, own
