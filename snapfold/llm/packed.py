"""Arrays of numbers as compressed bytes: narrow types, one plane for each byte, so that a shuffle moves few bytes a number."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_SIZES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays (integers that are not negative, booleans or doubles) in one value."""
    head, planes = [], []
    for a in arrays:
        if a.dtype.kind == "f":
            code, a = 9, np.ascontiguousarray(a, np.float64)
        else:
            top = int(a.max()) if len(a) else 0
            code = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            a = np.ascontiguousarray(a.astype(_SIZES[code]))
        head.append(struct.pack("<BI", code, len(a)))
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([struct.pack("<H", len(arrays)), *head, *planes]))


def unpack(blob: bytes) -> list[np.ndarray]:
    """What pack() was given; integers come back in the least type that holds them."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    (count,) = struct.unpack_from("<H", data)
    at, out = 2 + 5 * count, []
    for i in range(count):
        code, n = struct.unpack_from("<BI", data, 2 + 5 * i)
        size, kind = (8, np.float64) if code == 9 else (code, _SIZES[code])
        flat = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(flat.T).view(kind).reshape(n))
        at += n * size
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers as steps, which pack better; np.cumsum undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))
