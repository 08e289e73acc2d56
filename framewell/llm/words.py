"""Words and word n-grams of an Arrow text column, as NumPy arrays over whole pieces of a batch.

A word is a run of bytes other than 0x20 and 0x09-0x0D; UTF-8 keeps those bytes out of other
characters, so splitting bytes equals splitting code points. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes worked on at once; a longer text stands alone.
PIECE = 1 << 21
#: The same for steps of a long job, whose workers share an executor with what other steps need.
SMALL_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
STEP = U(0xD6E8FEB86659FD93)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(1 << 16, 1 << n.bit_length()), base, U)  # more than n; doubled as longer pieces come
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch, cut between rows."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: none) and the n + 1 borders of its rows."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    borders = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[borders[0] : borders[-1]] if raw is not None and len(col) else np.zeros(0, np.uint8)
    return data, borders - borders[0]


@dataclass
class Words:
    data: np.ndarray  # bytes of all rows
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # after its last byte
    row: np.ndarray  # its row
    first: np.ndarray  # n + 1 borders: the words of row i are first[i] up to first[i + 1]
    hash: np.ndarray


def words(col: pa.Array, lower: bool = False) -> Words:
    """lower: A-Z count as a-z."""
    data, borders = text_bytes(col)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[borders] = True
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    after = np.ones(n, bool)
    after[:-1] = blank[1:]
    start = np.flatnonzero(~blank & (before | edge[:-1]))
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        power, inverse = _powers_to(n)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))
    first = np.searchsorted(start, borders, side="left")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(data, start, end, row, first, h)


def ngrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the hash of it and the k - 1 words after it, and whether all are of one row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U)
        for i in range(k):
            h = h * STEP + w.hash[i : i + n]
        return mix(h), w.row[:n] == w.row[k - 1 :]


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of k words of each row, in order of row and hash: (row, hash). A row of fewer words has its whole sequence as one shingle, a row without words none."""
    h, whole = ngrams(w, k)
    rows, hashes = [w.row[: len(h)][whole]], [h[whole]]
    counts = np.diff(w.first)
    with np.errstate(over="ignore"):
        for m in range(1, k):
            if len(r := np.flatnonzero(counts == m)):
                at, x = w.first[r], np.full(len(r), m, U)
                for i in range(m):
                    x = x * STEP + w.hash[at + i]
                rows.append(r)
                hashes.append(mix(x))
    row, hash_ = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hash_, row))
    row, hash_ = row[order], hash_[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
    return row[new], hash_[new]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
