"""Vectorised words and hashes over the UTF-8 bytes of Arrow string columns.

Every function works on whole texts.  A chunk is a run of consecutive rows whose
texts hold about ``CHUNK`` bytes together (one longer text makes a chunk of its own),
so the working arrays stay small however large an Arrow batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
WORD5 = 5

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: One odd multiplier for each place of a sequence of words.
_PLACE = np.array([(0xA0761D6478BD642F * (2 * k + 1) ** 3 + 2 * k) & _MASK | 1 for k in range(64)], dtype=np.uint64)

#: Bytes of words that end at ASCII white space: all but U+0020 and U+0009 to U+000D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words of digits, lower-case a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of rows."""
    data, at = column_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lowered; every other byte as it is."""
    return np.frombuffer(data.tobytes().translate(_LOWER.tobytes()), np.uint8)  # a third of the time of an index


def spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each row the number of its first word (len rows + 1)."""
    n = len(data)
    inside = np.frombuffer(data.tobytes().translate(table.tobytes()), bool)
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    before[at[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(n + 1, dtype=bool)
    after[:-1] = inside
    after[n] = False
    after[at[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


_powers: list[np.ndarray] = []


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd number, one for each place of a long sequence."""
    if not _powers or len(_powers[0]) < n:
        out = np.full(max(n, 1 << 16), np.uint64(0xD1342543DE82EF95), dtype=np.uint64)
        _powers[:] = [np.multiply.accumulate(out, out=out)]
    return _powers[0]


_EIGHTH = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # from every byte on
    size = ends - starts
    out = size.astype(np.uint64) * _MUL + (eight[starts] & _EIGHTH[np.minimum(size, 8)]) * _PLACE[0]
    at, on = 8, np.flatnonzero(size > 8)
    while len(on):
        out[on] = mix(out[on]) + (eight[starts[on] + at] & _EIGHTH[np.minimum(size[on] - at, 8)]) * _PLACE[1]
        at += 8
        on = on[size[on] > at]
    return mix(out)


def sequences(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a row, and the row of each.  A row of fewer words, but not none, has one: all of them."""
    n, rows = len(words), len(first) - 1
    counts = np.diff(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), counts)
    left = first[1:][row] - np.arange(n)
    size = np.minimum(counts, k)[row]
    short = bool((counts < k).any())
    out = size.astype(np.uint64) * _MUL
    for j in range(min(k, n)):
        part = words[j:] * _PLACE[j]
        if short:
            part = np.where(size[: n - j] > j, part, np.uint64(0))
        out[: n - j] += part
    good = left >= size
    return mix(out[good]), row[good]


def distinct(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, one row after another, and rows + 1 offsets.  row is in order."""
    edges = np.searchsorted(row, np.arange(rows + 1))
    order = np.lexsort((values, row)) if len(values) else np.zeros(0, np.int64)
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    if len(values) > 1:
        keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    edges = np.searchsorted(row[keep], np.arange(rows + 1))
    return values[keep], edges
