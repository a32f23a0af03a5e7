"""Files that tasks write to and read from the shared folder.

``file:`` paths are memory-mapped; any other store is read through Arrow.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def local(path: str) -> str | None:
    at = urlparse(path)
    return unquote(at.path) if at.scheme in ("", "file") else None


def put(path: str, data: bytes) -> None:
    """Write a whole file; a repeated task replaces it by the same bytes."""
    if at := local(path):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        own = f"{at}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, at)
    else:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_output_stream(at) as f:
            f.write(data)


def opened(path: str):
    """A seekable input file."""
    if at := local(path):
        return open(at, "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays in one file: a header of names, types and places, then the data
    aligned to eight bytes."""
    body, head = b"", {}
    parts, at = [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = (a.dtype.str, at, len(a))
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    body = b"".join(parts)
    return len(text).to_bytes(8, "little") + text + body


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped where the store allows."""
    if at := local(path):
        raw = np.memmap(at, np.uint8, "r")
    else:
        with opened(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    return unpacked(raw)


def unpacked(raw: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays behind the bytes that ``packed`` gives."""
    size = int(raw[:8].view("<u8")[0])
    head = json.loads(bytes(raw[8 : 8 + size]))
    base = 8 + size
    return {k: raw[base + at : base + at + n * np.dtype(t).itemsize].view(t) for k, (t, at, n) in head.items()}
