"""Periodic runs of words by internal pattern matching: dyadic blocks and range successors over a suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.words import BLANK_WORDS, Block, Words, blocks, words

#: A run has at least this many words, and this many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Bytes of text whose words are indexed together; a longer text is indexed alone.
INDEX_BYTES = 1 << 18
#: Words that one step of an extension compares.
STEP = 32


def stride(size: int) -> int:
    """Distance of the dyadic blocks of ``size`` words.

    Blocks of ``size`` answer for periods p with size / 2 < p <= size. A run of at least max(6, 4 p) words then holds a
    whole block and the same block p words later; blocks at most ``size`` apart overlap enough to be chained.
    """
    return size if size <= 8 else size // 2


@dataclass
class Blocks:
    """Dyadic blocks that occur more than once in their text: first word, size, and their interval of the suffix array."""

    start: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


def suffix_array(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, Blocks]:
    """Suffixes sorted by text and words, and the repeated dyadic blocks.

    ``code`` ascends from text to text, ``first`` and ``last`` bound the text of each word. Ranks are doubled: a round
    sorts by the rank of a suffix and of the one ``size`` words on, and only suffixes that still share their rank take part.
    Suffixes with the same first ``size`` words are then one interval of the final array, which later rounds only refine.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    rank = np.zeros(n, np.int64)
    heads = np.flatnonzero(np.append(True, code[order[1:]] != code[order[:-1]])) if n else np.zeros(0, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    live = np.arange(n)  # places of the array whose suffix shares its rank
    found: list[np.ndarray] = []
    size = 1
    while True:
        # groups of the live places by rank; a rank is the first place of its group
        suffix = order[live]
        group = rank[suffix]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(live) else live
        length = np.diff(np.append(begin, len(live)))
        many = np.repeat(length > 1, length)
        live, suffix, group, width = live[many], suffix[many], group[many], np.repeat(length, length)[many]
        whole = ((suffix - first[suffix]) % stride(size) == 0) & (suffix + size <= last[suffix])
        found.append(np.stack([suffix[whole], np.full(whole.sum(), size), group[whole], group[whole] + width[whole]]))
        if not len(live):
            break
        after = np.full(len(suffix), -1)
        inside = suffix + size < last[suffix]
        after[inside] = rank[suffix[inside] + size]
        by = np.lexsort((after, group))
        order[live] = suffix = suffix[by]
        group, after = group[by], after[by]
        fresh = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        head = np.flatnonzero(fresh)
        rank[suffix] = np.repeat(live[head], np.diff(np.append(head, len(live))))
        size *= 2
    return order, Blocks(*np.concatenate(found, axis=1))


class WaveletTree:
    """Values of an array bit by bit from the top, each level stably parted by its bit, with the number of zeros before a place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~one, dtype=np.int32)))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value of places low to high that is at least ``least``, or -1: counts the smaller values, then takes the next."""
        smaller = self._smaller(low, high, least)
        out = np.full(len(low), -1)
        some = np.flatnonzero(smaller < high - low)
        out[some] = self._kth(low[some], high[some], smaller[some])
        return out

    def _smaller(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        count = np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - level) & 1).astype(bool)
            below, above = zeros[low], zeros[high]
            count += np.where(one, above - below, 0)
            low, high = np.where(one, zeros[-1] + low - below, below), np.where(one, zeros[-1] + high - above, above)
        return count

    def _kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros(len(low), np.int64)
        for zeros in self.zeros:
            below, above = zeros[low], zeros[high]
            one = k >= above - below
            k = np.where(one, k - (above - below), k)
            value = value << 1 | one
            low, high = np.where(one, zeros[-1] + low - below, below), np.where(one, zeros[-1] + high - above, above)
        return value


def _chained(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that share a period's length or more are one progression."""
    order = np.lexsort((start, period))
    start, stop, period = start[order], stop[order], period[order]
    head = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (start[1:] + period[1:] > stop[:-1]))) if len(start) else start
    return (start[head], np.maximum.reduceat(stop, head), period[head]) if len(head) else (start, stop, period)


def _extended(code: np.ndarray, at: np.ndarray, period: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """Moves ``at`` on, while the word there equals the one a period before (or, going down, after) it, up to ``edge``."""
    at = at.copy()
    live = np.arange(len(at))
    ahead = np.arange(STEP) * step
    while len(live):
        place = at[live, None] + ahead
        other = place - step * period[live, None]
        inside = (edge[live, None] - place) * step > 0
        same = inside & (code[np.where(inside, place, 0)] == code[np.where(inside, other, 0)])
        n = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
        at[live] += n * step
        live = live[n == STEP]
    return at


def runs(code: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of every run, by start and period; the arguments are those of ``suffix_array``.

    Where a block lies in a run whose period is not longer than itself, its next occurrence is exactly one period on. So
    the block asks for the smallest place beyond its own in its interval of the suffix array. A distance of at most its
    size is a candidate; progressions of candidates are chained and extended to both sides.
    """
    order, dyadic = suffix_array(code, first, last)
    follows = WaveletTree(order).successor(dyadic.low, dyadic.high, dyadic.start + 1)
    period = follows - dyadic.start
    near = (follows >= 0) & (period <= dyadic.size) & (2 * period > dyadic.size)
    start, period = dyadic.start[near], period[near]
    start, stop, period = _chained(start, start + dyadic.size[near] + period, period)
    stop = _extended(code, stop, period, last[start], 1)
    start = _extended(code, start - 1, period, first[start] - 1, -1) + 1
    long = stop - start >= np.maximum(min_words, min_exponent * period)
    kept = np.unique(np.stack([start[long], period[long], stop[long]], axis=1), axis=0)
    return kept[:, 0], kept[:, 2], kept[:, 1]


def _codes(block: Block, w: Words) -> np.ndarray:
    """A number for each word, equal inside a text where the words are, ascending from text to text."""
    known = np.unique(w.hash, return_inverse=True)[1].astype(np.int64)
    return w.row * (len(known) + 1) + known


def _collapsed(block: Block, w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by single spaces."""
    length = w.end - w.start
    lead = np.zeros(len(keep), np.int64)  # the byte before a word, except before the first one kept of a row
    place = np.flatnonzero(keep)
    lead[place] = np.append(False, w.row[place[1:]] == w.row[place[:-1]]) if len(place) else 0
    edge = np.zeros(len(block.data) + 1, np.int8)
    edge[(w.start - lead)[keep]] += 1
    edge[w.end[keep]] -= 1
    data = np.where(BLANK_WORDS[block.data], block.data, 0x20).astype(np.uint8)[np.cumsum(edge[:-1]).astype(bool)]
    size = np.bincount(w.row[place], (length + lead)[place], len(block)).astype(np.int64)
    offsets = np.append(0, np.cumsum(size))
    return pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(offsets), pa.py_buffer(data))


def _periodic(min_words: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), INDEX_BYTES):
                w = words(block, BLANK_WORDS)
                code = _codes(block, w)
                first, last = w.offsets[w.row], w.offsets[w.row + 1]
                start, stop, period = runs(code, first, last, min_words, min_exponent)
                surplus = np.zeros(len(code) + 1, np.int64)
                np.add.at(surplus, start + period, 1)
                np.add.at(surplus, stop, -1)
                keep = np.cumsum(surplus[:-1]) == 0
                row = w.row[start]
                offsets = np.searchsorted(row, np.arange(len(block) + 1))
                fields = pa.StructArray.from_arrays([pa.array(start - w.offsets[row]), pa.array(stop - start), pa.array(period)], names=["start", "length", "period"])
                found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), fields)
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(w.count().astype(np.int64)), found, _collapsed(block, w, keep).cast(pa.string())],
                                                 names=[*rows.schema.names[1:], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (all columns, or those named) with ``n_words``, ``runs`` and ``collapsed``.

    A run is a longest stretch of consecutive words in which words ``period`` apart are identical, of at least
    ``max(min_words, 4 * period)`` words (``min_words`` of 6 or more), ``period`` being its smallest; ``runs`` lists (start, length, period) by start and
    period, words counted from 0. ``collapsed`` holds the words that no run has after its first period, joined by spaces.

    Words are separated by blanks and compared as they stand. Null texts and texts without words have no words, no runs and
    an empty ``collapsed``. Texts are indexed whole, about a quarter of a MB at a time; a longer one is indexed alone, so
    memory follows the longest text. Rows are judged one by one, so repeated rows and ids all stay, and nothing is
    shuffled; columns that clash with the result names are replaced; an empty table gives an empty result.
    """
    if min_words < MIN_WORDS:
        raise ValueError(f"runs of fewer than {MIN_WORDS} words may lie between two blocks")
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in results]
    source = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*source.schema.fields[1:], *T.StructType.fromDDL(
        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").fields])
    return source.mapInArrow(_periodic(min_words, MIN_EXPONENT), schema).toDF(*kept, *results)
