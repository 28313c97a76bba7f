"""Arrays of integers as compact bytes, for rows that carry many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(values: np.ndarray) -> bytes:
    """Integers of four bytes: how many, then zstd over their byte planes, most of which hold little."""
    own = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(own, "zstd", asbytes=True)


def from_planes(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    parts = np.frombuffer(pa.decompress(packed[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(parts.T).view("<u4").reshape(-1)


def low_bytes(keys: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each 64-bit key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(packed: bytes, width: int) -> np.ndarray:
    some = np.frombuffer(packed, np.uint8).reshape(-1, width)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, :width] = some
    return out.view("<u8").reshape(-1)
