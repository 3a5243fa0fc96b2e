"""Hilbert keys of many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows) with bits bits a coordinate.

    Each coordinate is undone from its highest bit down (the rotation that a cell's
    corner asks for), then the bits are Gray-decoded and interleaved. bits times
    the number of coordinates is 62 at most.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    if bits * dims > 62:
        raise ValueError("bits times dimensions must be 62 at most")
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for d in range(dims):
            inverted = (x[d] & q) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << one) | ((x[d] >> np.uint64(b)) & one)
    return key.astype(np.int64)
