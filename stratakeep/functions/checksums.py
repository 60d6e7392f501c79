"""CRC-32C of many byte ranges at once, in numpy: neither Spark nor Python has it built in."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy

_STRIDE = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of a byte, and for each of the four bytes of a state what ``_STRIDE`` zero bytes make of it."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):  # fixed value: the Castagnoli polynomial, reflected
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0x82F63B78), one >> np.uint32(1))
    skip = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_STRIDE):
        skip = one[skip & 0xFF] ^ (skip >> np.uint32(8))
    return one, skip


_ONE, _SKIP = _tables()


def crc32c(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32C of each range of at least four bytes of ``data`` (uint8).

    A sum that starts from zero does not see leading zeros, so ranges are filled up in front to whole strides; the
    start from all ones is the complement of a range's first four bytes. Work goes in slices of about 8 MB.
    """
    out = np.empty(len(begin), np.uint32)
    strides = -(-(end - begin) // _STRIDE)
    first = np.append(0, np.cumsum(strides))
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(first, first[a] + (1 << 17), "right")) - 1)
        n = strides[a:b]
        at = first[a:b] - first[a]
        block = np.zeros(int(n.sum()) * _STRIDE, np.uint8)
        for p, x, y in zip(((at + n) * _STRIDE).tolist(), begin[a:b].tolist(), end[a:b].tolist()):
            block[p - (y - x) : p] = data[x:y]
        head = (at + n) * _STRIDE - (end[a:b] - begin[a:b])
        for k in range(4):
            block[head + k] ^= 0xFF
        block = block.reshape(-1, _STRIDE)
        own = np.zeros(len(block), np.uint32)
        for k in range(_STRIDE):
            own = _ONE[(own ^ block[:, k]) & 0xFF] ^ (own >> np.uint32(8))
        crc = np.zeros(b - a, np.uint32)
        left = np.arange(b - a)
        for k in range(int(n.max(initial=0))):
            left = left[n[left] > k]
            c = crc[left]
            crc[left] = _SKIP[0][c & 0xFF] ^ _SKIP[1][(c >> 8) & 0xFF] ^ _SKIP[2][(c >> 16) & 0xFF] ^ _SKIP[3][c >> 24] ^ own[at[left] + k]
        out[a:b] = ~crc
        a = b
    return out
