"""Compact bytes for arrays of numbers."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def pack_ranks(x: np.ndarray) -> bytes:
    """Mostly small numbers below 2**32: their first, second, .. bytes are packed apart."""
    return pack(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T)


def unpack_ranks(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
