"""Text columns as byte arrays: word spans and 64-bit hashes without one Python object per word."""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a piece of its own.
PIECE = 1 << 19


#: What a count in one byte stands for: up to 32 itself, then eighths of powers of two.
COUNT = np.where(np.arange(256) <= 32, np.arange(256), 32 * 2.0 ** ((np.arange(256) - 32) / 8))


def small(n: np.ndarray) -> np.ndarray:
    """Counts in one byte; see ``COUNT``."""
    return np.where(n <= 32, n, np.minimum(255, 32 + np.rint(8 * np.log2(np.maximum(n, 1) / 32)))).astype(np.uint8)


def _mixed(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE = _mixed(256, 7)
BASE = 0x5851F42D4C957F2D
UNBASE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; remembered by the process, and outside this module, which travels with every function."""
    kept = sys.modules.setdefault("tidemark_llm_powers", ModuleType("tidemark_llm_powers")).__dict__
    if base not in kept or len(kept[base]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        kept[base] = np.multiply.accumulate(out)
    return kept[base][:n]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the row offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(buf: np.ndarray, offsets: np.ndarray, most: int = PIECE):
    """(first row, end row, bytes, offsets) of consecutive rows with about ``most`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` (bool per byte) and the first run of every row; no run crosses a row or one of ``cuts``."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def words(buf: np.ndarray, offsets: np.ndarray):
    """Spans of the words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~SPACE[buf], offsets)


def prefix(buf: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Running polynomial hash; ``span_hashes`` takes differences of it."""
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(table[buf] * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, independent of where it lies."""
    return mix((running[end] - running[start]) * powers(UNBASE, len(running))[start])


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive hashes from each position that has so many."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i : i + n]
    return mix(out)


def in_row(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for each of ``n - k + 1`` positions whose ``k`` items lie in one row; ``first``: first item of every row."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    if len(ok) and k > 1:
        inner = first[(first > 0) & (first < n)]
        for i in range(1, k):
            at = inner - i
            ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after the other in a new buffer, and their offsets in it."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    index = np.repeat(start - offsets[:-1], length)
    index += np.arange(offsets[-1])
    return buf[index], offsets


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for a row without any."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def string_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """Arrow texts or binaries over ``data``."""
    if offsets[-1] >= 1 << 31:
        kind = pa.large_string() if kind == pa.string() else pa.large_binary()
        return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
