"""Arrays of numbers as bytes that a codec makes small: all lowest bytes first, then all second ones, and so on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def written(x: np.ndarray, steps: bool = False, kind: str = "<u4") -> bytes:
    """Numbers that fit into ``kind``; as differences if ``steps``, for sorted ones. Bytes that are zero throughout take next to no room."""
    x = x.astype(kind)
    if steps:
        x = np.diff(x, prepend=x.dtype.type(0))
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def read(raw: bytes, steps: bool = False, kind: str = "<u4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0]
    return np.cumsum(x, dtype=x.dtype) if steps else x


def read_all(column: pa.ChunkedArray, steps: bool = False, kind: str = "<u4") -> list[np.ndarray]:
    return [read(x.as_py(), steps, kind) for x in column]


def squeezed(raw: bytes) -> bytes:
    """Compressed with its length in front; unlike the codec of a shuffle, this one also shortens bytes by how often they occur."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
