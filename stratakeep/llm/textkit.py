"""Vectorised tokenising and hashing of Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D. In UTF-8 no multi-byte character
holds such a byte, so work on bytes splits exactly as the character class does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = (1 << 20) - 1
_BASE = 0x9E3779B97F4A7C13 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """The words of some texts: byte spans, hashes, and where each text's words begin."""

    body: np.ndarray
    text_off: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def words(column: pa.Array, lower: bool = False, mapping: np.ndarray | None = None) -> Words:
    """Words of each text, after mapping its bytes (A-Z to a-z with ``lower``)."""
    body, text_off = raw(column)
    if lower or mapping is not None:
        body = (LOWER if mapping is None else mapping)[body]
    n = len(body)
    inside = ~SPACE[body]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = text_off[(text_off < n) & (text_off > 0)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[body] * power[:n], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(body, text_off, starts, ends, np.searchsorted(starts, text_off), hashes)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries, for every start that has one."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    source = mix(hashes + np.uint64(seed)) if seed else hashes
    if width <= 6:
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * np.uint64(_BASE) + source[k : k + n]
        return mix(out)
    power, inverse = _power_tables(len(source) + 1)
    run = np.zeros(len(source) + 1, np.uint64)
    np.cumsum(source * power[: len(source)], out=run[1:])
    return mix((run[width:] - run[:-width]) * inverse[:n])


def sequence_hashes(w: Words, seed: int = 0) -> np.ndarray:
    """One hash for the whole word sequence of each text (of its length too)."""
    power, inverse = _power_tables(len(w.hashes) + 1)
    source = mix(w.hashes + np.uint64(seed))
    run = np.zeros(len(source) + 1, np.uint64)
    np.cumsum(source * power[: len(source)], out=run[1:])
    a, b = w.off[:-1], w.off[1:]
    return mix((run[b] - run[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text at most; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step)[:n] > 0


def grid(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``sizes`` entries dealt to rows of ``width`` places, the last row of a run filled up with one place behind all; and each run's first row."""
    rows = -(-sizes // width)
    first = np.cumsum(rows) - rows
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    out = np.full(int(rows.sum()) * width, n)
    out[np.arange(n) + np.repeat(first * width - begin, sizes)] = np.arange(n)
    return out.reshape(-1, width), first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def as_binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets, np.int32)), pa.array(values))
