"""Words of whole texts as arrays: what the Arrow-based operators share.

Texts arrive as Arrow batches and are read as one byte buffer with offsets, so
words are found and hashed for many documents at once, without a Python object
per word. Batches are taken apart into pieces of about PIECE bytes; a longer
document is a piece of its own, so memory follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)  # words [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(i: int) -> np.uint64:
    return np.uint64((i * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            table = np.full(max(n, PIECE + 1), self.base, np.uint64)
            table[0] = 1
            self.table = np.multiply.accumulate(table)
        return self.table[:n]


UP, DOWN = _Powers(BASE), _Powers(INVERSE)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * UP.upto(len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes give equal hashes wherever they lie."""
    value = (sums[end] - sums[start]) * DOWN.upto(len(sums))[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about PIECE bytes."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    rows, low = len(offsets) - 1, 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """Words of a piece: byte spans, the row of each, counts and first words of rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        inside = table[self.data]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        after[edge[edge > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # first word of each row, then the total
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix(self.data), self.start, self.end)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted within rows, and offsets of rows.

    A shingle is ``size`` consecutive words; a row with fewer, but not none,
    has its whole sequence as one shingle.
    """
    hashed = mix(words.hashes())
    n = len(hashed)
    value, row = np.zeros(max(0, n - size + 1), np.uint64), words.row[: max(0, n - size + 1)]
    for i in range(size):
        value += hashed[i : i + len(value)] * (salt(i) | np.uint64(1))
    whole = words.row[size - 1 :] == row if n >= size else np.zeros(0, bool)
    values, rows = [mix(value[whole])], [row[whole]]
    for count in range(1, size):
        short = np.flatnonzero(words.count == count)
        value = np.full(len(short), salt(100 + count), np.uint64)
        for i in range(count):
            value += hashed[words.first[short] + i] * (salt(i) | np.uint64(1))
        values.append(mix(value))
        rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(words.count) + 1))


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
