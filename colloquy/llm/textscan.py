"""Whole texts of an Arrow batch as one byte array, scanned with numpy.

Helpers that run inside Spark tasks. Words are the maximal runs of bytes
outside ``[\\x20\\x09-\\x0D]``; since those are ASCII, scanning the UTF-8 bytes
gives the same words as scanning the code points.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 19
STRETCH = 1 << 22
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE_CODE = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64)
#: The low bytes of a lane that a range of 0 to 8 bytes fills.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer ranges are rare; the library hashes them one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def fold(code: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``code`` with one more 64-bit value in it; for a given code, different values give different results."""
    return mix((code ^ value) * _STEP)


def lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place of ``data`` on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def range_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit codes of ranges of bytes. Different ranges of one length up to 8 bytes never share a code."""
    size = end - start
    code = mix(size.astype(np.uint64) * _STEP)
    every = lanes(data)
    open_ = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = start[open_], size[open_]
    while len(open_):
        code[open_] = fold(code[open_], every[at] & _FILLED[np.minimum(left, 8)])
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        code[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return code


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64, and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every place on, after one linear pass. Equal hashes do not prove equal bytes."""
    power, inverse = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(data) - gram + 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row starts (one more entry at the end). Null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text (a longer row stands alone) with their bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each row (one more entry at the end)."""
    n = len(data)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, n, STRETCH):  # so that what is held for each byte stays small beside a very long text
        b = min(n, a + STRETCH)
        inside = np.zeros(b - a + 2, bool)
        inside[a == 0 : len(inside) - (b == n)] = ~SPACE[data[max(a - 1, 0) : b + 1]]
        edge = np.zeros(b - a + 1, bool)
        edge[off[np.searchsorted(off, a) : np.searchsorted(off, b, "right")] - a] = True
        here = inside[1:-1]
        starts.append(a + np.flatnonzero(here & (~inside[:-2] | edge[:-1])))
        ends.append(a + 1 + np.flatnonzero(here & (~inside[2:] | edge[1:])))
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, np.searchsorted(start, off)


def shingles(codes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``size`` consecutive words of a row; a shorter row with a word has one shingle of all its words."""
    count = np.diff(first)
    n_out = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.zeros(len(first), np.int64)
    np.cumsum(n_out, out=out[1:])
    row = np.repeat(np.arange(len(count)), n_out)
    at = np.arange(out[-1]) - out[row] + first[row]
    width = np.minimum(size, count[row])
    made = mix(width.astype(np.uint64) * _STEP)
    for k in range(size):
        if (width > k).all():
            made = fold(made, codes[at + k])
        else:
            some = np.flatnonzero(width > k)
            made[some] = fold(made[some], codes[at[some] + k])
    return made, out
