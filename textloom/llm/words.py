"""Words of letters, digits and characters beyond ASCII, as bytes.

A-Z are lower-cased and every other ASCII character separates, which is one
byte table; so a text's words are two calls on its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import regex

#: Each byte as it stands in a word, or a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
APART = regex.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text that are split at once; a longer text goes by such pieces.
PIECE = 1 << 22


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that cut no word."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = APART.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end] if at or end < len(data) else data
        at = end


def word_ids(data: bytes, known: dict[bytes, int], kind: type = np.int32) -> np.ndarray:
    """The number of each word of a text in ``known``, 0 for any other word."""
    out = []
    for own in pieces(data):
        words = own.translate(FOLD).split()
        out.append(np.fromiter(map(known.get, words, repeat(0)), kind, len(words)))
    return np.concatenate([np.empty(0, kind), *out])
