"""Vectorised words, word hashes and shingles over Arrow string columns.

Texts are handled as UTF-8 bytes: both word definitions separate words at ASCII bytes only, so byte classes are
exact for any script. Rows are taken in blocks of about ``BLOCK_BYTES``; a longer text is a block of its own, so
the memory of a task follows the longest text, never the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20


def _byte_table(separator) -> np.ndarray:
    return np.array([not separator(b) for b in range(256)])


#: Words ``[^\x20\x09-\x0D]+``.
BLANK_WORDS = _byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a to z and everything beyond ASCII.
PLAIN_WORDS = _byte_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed + 1)) * _STEP) | np.uint64(1)


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        base = np.full(max(n, 2 * len(_POWERS[0])), constants(1, 77)[0])
        base[0] = 1
        _POWERS[0] = np.cumprod(base)
    return _POWERS[0]


def hash_pieces(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the consecutive non-empty pieces that make up ``data``."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(len(data)) - np.repeat(first, lengths)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _STEP)


@dataclass
class Block:
    """Some consecutive rows: their bytes, and where each row begins (one offset more than rows)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Block:
        return Block(self.first, _LOWER[self.data], self.offsets)


@dataclass
class Words:
    """Words of a block: byte span, row inside the block, hash; and the first word of each row (one entry more)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.offsets)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column, in row order; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.zeros(0, np.uint8) if body is None else np.frombuffer(body, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield Block(row, data[at[row]:at[stop]], at[row:stop + 1] - at[row])
        row = stop


def words(block: Block, table: np.ndarray) -> Words:
    """Maximal runs of word bytes inside each row."""
    data, at = block.data, block.offsets
    inside = table[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    offsets = np.searchsorted(start, at, "left")
    row = np.repeat(np.arange(len(block)), np.diff(offsets))
    return Words(start, end, row, hash_pieces(data[inside], end - start), offsets)


def prefix_hashes(block: Block, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``n`` characters or more (their places) and the 64-bit hash of their first ``n`` characters."""
    begins = np.append(np.flatnonzero((block.data & 0xC0) != 0x80), len(block.data))
    after = np.minimum(np.searchsorted(begins, w.start) + n, len(begins) - 1)
    end = begins[after]
    at = np.flatnonzero(end <= w.end)
    lengths = end[at] - w.start[at]
    first = np.cumsum(lengths) - lengths
    return at, hash_pieces(block.data[np.repeat(w.start[at] - first, lengths) + np.arange(lengths.sum())], lengths)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``k`` words inside a row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for j, c in enumerate(constants(k, 1000)):
        value += w.hash[j:j + n] * c
    first = np.flatnonzero(w.row[:n] == w.row[k - 1:])
    return first, mix(value[first])


def sequence_hash(w: Words, row: int) -> np.ndarray:
    """One hash for all words of a row."""
    h = w.hash[w.offsets[row]:w.offsets[row + 1]]
    return mix((h * constants(len(h), 2000)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def int_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
