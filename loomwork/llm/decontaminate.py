"""Benchmark passages in documents: a set join on the rarest shingle of each item window, exactly verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.words import PLAIN_WORDS, blocks, int_lists, signed, words
from loomwork.session import keep, stage, staging, unstage

WINDOW_WORDS = 10
#: Shingles that are ordered by rarity; a window of fewer words is ordered by its words.
TOKEN_WORDS = 3
#: Item windows that one pass over the documents compares with (about 120 bytes each in every task).
WINDOWS_PER_PASS = 250_000


def _windows(size: int):
    """Item rows -> one row per window: item, words of the window as hashes, tokens with their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                w = words(block.lower(), PLAIN_WORDS)
                rows = []
                for r in range(len(block)):
                    h = signed(w.hash[w.offsets[r]:w.offsets[r + 1]])
                    length = min(size, len(h))
                    for i in range(len(h) - length + 1) if length else ():
                        rows.append((ids[block.first + r], h[i:i + length].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], batch.column(0).type), pa.array([x[1] for x in rows], pa.binary())], names=["item", "window"])

    return run


def _token_hashes(h: np.ndarray) -> np.ndarray:
    """Tokens of a window or text given as word hashes: shingles of three words, or single words."""
    if len(h) < TOKEN_WORDS:
        return h
    n = len(h) - TOKEN_WORDS + 1
    return _fold(h[:n], h[1:n + 1], h[2:n + 2])


def _fold(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F) + c


def _window_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window) -> (window, token, offset), a row per token."""
    for batch in batches:
        windows, tokens, offsets = [], [], []
        for value in batch.column(0).to_pylist():
            t = _token_hashes(np.frombuffer(value, np.uint64))
            windows += [value] * len(t)
            tokens.append(t)
            offsets.append(np.arange(len(t)))
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        at = np.concatenate(offsets).astype(np.int32) if offsets else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(signed(flat)), pa.array(at)], names=["window", "token", "offset"])


def _block_tokens(w) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(first word, hash) of the single words and of the three-word shingles of a block's rows."""
    n = max(0, len(w.hash) - TOKEN_WORDS + 1)
    same = np.flatnonzero(w.row[:n] == w.row[TOKEN_WORDS - 1:]) if n else np.zeros(0, np.int64)
    return (np.arange(len(w.hash)), w.hash), (same, _fold(w.hash[same], w.hash[same + 1], w.hash[same + 2]) if n else w.hash[:0])


class _Table:
    """Sorted hash values with a quick test for absence: a bitmap over the hashes' upper bits."""

    BITS = 22

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self._slot(self.values)] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def present(self, values: np.ndarray) -> np.ndarray:
        """Positions in ``values`` that hold a value of the table."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[self._slot(values)])
        at = np.searchsorted(self.values, values[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == values[maybe]]


def _count_tokens(shared):
    """Texts -> (token, n): occurrences of the wanted tokens, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Table(shared.value)
        counts = np.zeros(len(wanted.values), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                for _, value in _block_tokens(words(block.lower(), PLAIN_WORDS)):
                    hit = value[wanted.present(value)]
                    np.add.at(counts, np.searchsorted(wanted.values, hit), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(signed(wanted.values[some])), pa.array(counts[some])], names=["token", "n"])

    return run


class _Matcher:
    """Compares texts with one block of windows."""

    def __init__(self, rows: list[tuple[int, bytes, int, int]]):
        self.window = np.array([r[0] for r in rows], np.int64)
        self.length = np.array([len(r[1]) // 8 for r in rows], np.int64)
        self.token = np.array([r[2] for r in rows], np.int64).view(np.uint64)
        self.offset = np.array([r[3] for r in rows], np.int64)
        width = int(self.length.max()) if rows else 1
        self.words = np.zeros((len(rows), width), np.uint64)
        for i, r in enumerate(rows):
            self.words[i, :self.length[i]] = np.frombuffer(r[1], np.uint64)
        order = np.argsort(self.token, kind="stable")
        for name in ("window", "length", "token", "offset", "words"):
            setattr(self, name, getattr(self, name)[order])
        single = self.length < TOKEN_WORDS
        self.tables = (_Table(self.token[single]), _Table(self.token[~single]))

    def hits(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, window) of every window found in the rows of ``w``."""
        starts, lengths, found = [], [], []
        for single, (at, value), table in zip((True, False), _block_tokens(w), self.tables):
            some = table.present(value)
            at, value = at[some], value[some]
            low, high = np.searchsorted(self.token, value, "left"), np.searchsorted(self.token, value, "right")
            for step in range(int((high - low).max()) if len(low) else 0):
                live = low + step < high
                entry, position = low[live] + step, at[live]
                entry, position = entry[(self.length[entry] < TOKEN_WORDS) == single], position[(self.length[entry] < TOKEN_WORDS) == single]
                start = position - self.offset[entry]
                row = w.row[position]
                fits = (start >= w.offsets[row]) & (start + self.length[entry] <= w.offsets[row + 1])
                entry, start = entry[fits], start[fits]
                same = np.ones(len(entry), bool)
                for j in range(self.words.shape[1]):
                    inside = j < self.length[entry]
                    same[inside] &= w.hash[start[inside] + j] == self.words[entry[inside], j]
                starts.append(start[same])
                lengths.append(self.length[entry[same]])
                found.append(self.window[entry[same]])
        if not starts:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)


def _match(shared, with_text: bool):
    """Rows with text, spans and windows so far -> the same rows with those of one more block of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(shared.value)
        for batch in batches:
            for block in blocks(batch.column(0)):
                w = words(block.lower(), PLAIN_WORDS)
                start, length, window = matcher.hits(w)
                rows = batch.slice(block.first, len(block))
                row = w.row[start]
                order = np.lexsort((start, row))
                start, length, window, row = start[order] - w.offsets[row[order]], length[order], window[order], row[order]
                found = []
                for old, values in ((rows.column(2), start), (rows.column(3), start + length), (rows.column(4), window)):
                    cuts = np.searchsorted(row, np.arange(len(block) + 1))
                    new = int_lists(values.astype(np.int64), cuts)
                    found.append(_joined(old, new))
                columns = [rows.column(0), pa.array(w.count().astype(np.int64)), *found, *rows.columns[5:]]
                yield pa.RecordBatch.from_arrays(columns[not with_text:], names=rows.schema.names[not with_text:])

    return run


def _joined(old: pa.Array, new: pa.Array) -> pa.Array:
    """Row by row the values of two list columns."""
    if not len(old.flatten()):
        return new
    both = [x + y for x, y in zip(old.to_pylist(), new.to_pylist())]
    return pa.array(both, new.type)


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, size: int = WINDOW_WORDS) -> DataFrame:
    """(item, window): every window of ``size`` words, or the whole item where it is shorter; none without words."""
    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("_text")).mapInArrow(_windows(size), f"item {kind}, window binary")


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  size: int = WINDOW_WORDS, columns: list[str] | None = None, list_items: bool = True) -> DataFrame:
    """``docs`` (all columns, or those named) with ``n_words``, ``n_hit`` (words inside any occurrence of an item window) and ``item_ids``.

    Words are runs of letters, digits and other non-ASCII characters of the lower-cased text. The tokens of a window
    are its three-word shingles; tokens are ordered by how often they occur in all documents, and as containment is
    required in full, the rarest token of a window is its whole necessary prefix. A document position is a candidate
    if it holds that token; length and position must leave room for the window inside the text, and the window's
    words are then compared one by one. ``item_ids`` lists the items with an occurring window as sorted strings.

    The items' windows are taken in blocks of ``WINDOWS_PER_PASS``; a block is what travels to the tasks. After each
    block but the last the rows are written, so a task holds one block however large the benchmark is, and texts are
    never shuffled. Texts are read whole, about 1 MB at a time; a longer one alone. Null texts have no words. Items that
    are repeated, or share windows, are all reported; items with a null id are compared and counted as hits but
    not listed. Without ``list_items`` that column is left out, and rows pass without a shuffle. Empty documents or an empty benchmark give no hits. Columns of ``docs`` that clash with the result
    names are replaced.
    """
    spark = docs.sparkSession
    with staging(spark):
        windows = stage(benchmark_windows(items, item_col, item_text_col, size), "windows")
        distinct = stage(windows.select("window").distinct(), "distinct")
        tokens = stage(distinct.mapInArrow(_window_tokens, "window binary, token bigint, offset int"), "tokens")
        frequency = _frequencies(docs.select(text_col), tokens)
        rarest = tokens.join(frequency, "token", "left").groupBy("window").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("t"))
        chosen = rarest.where("t.n > 0").select(F.xxhash64("window").alias("w"), "window", "t.token", "t.offset")
        chosen = keep(stage(chosen, "chosen"))
        names = keep(stage(windows.where("item is not null").join(chosen.select("window", "w"), "window").select(
            "w", F.col("item").cast("string").alias("item")).distinct(), "names"))
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("n_words", "n_hit", "item_ids")]
    source = {c: "_text" if c == text_col else f"_c{i}" for i, c in enumerate(kept)}
    spans = docs.select(F.col(text_col).alias("_text"), F.lit(0).cast("bigint").alias("_n"), *[F.lit(None).cast("array<bigint>").alias(c) for c in ("_from", "_to", "_w")],
                        *[F.col(f"`{c}`").alias(s) for c, s in source.items() if s != "_text"])
    written = None
    for block, last in _blocks(chosen):
        with_text = text_col in kept or not last
        spans = spans.mapInArrow(_match(block, with_text), T.StructType(spans.schema.fields[not with_text:]))
        if not last:
            # written, so that a task holds one block at a time
            spans, before = stage(spans, "pass"), written
            unstage(before)
            written = spans
    counted = _counted(spans, source)
    return _named(counted, names) if list_items else counted.drop("_w")


def _frequencies(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, n) over all documents for the benchmark's tokens, in passes of bounded size."""
    spark = texts.sparkSession
    distinct = tokens.select("token").distinct()
    total, passes = distinct.count(), None
    n = max(1, -(-total // (4 * WINDOWS_PER_PASS)))
    for i in range(n):
        part = np.array([r[0] for r in distinct.where(F.pmod("token", F.lit(n)) == i).collect()], np.int64)
        counted = texts.mapInArrow(_count_tokens(spark.sparkContext.broadcast(part.view(np.uint64))), "token bigint, n bigint")
        passes = counted if passes is None else passes.unionByName(counted)
    return passes.groupBy("token").agg(F.sum("n").alias("n"))


def _blocks(chosen: DataFrame):
    """Broadcasts of at most about ``WINDOWS_PER_PASS`` chosen windows each, one after the other, and whether it is the last."""
    spark = chosen.sparkSession
    n = max(1, -(-chosen.count() // WINDOWS_PER_PASS))
    for i in range(n):
        rows = chosen.where(F.pmod("w", F.lit(n)) == i).select("w", "window", "token", "offset").collect()
        yield spark.sparkContext.broadcast([(r[0], bytes(r[1]), r[2], r[3]) for r in rows]), i + 1 == n


def _counted(spans: DataFrame, source: dict[str, str]) -> DataFrame:
    """Words covered by the union of the spans, which are sorted by their start."""
    pairs = F.array_sort(F.arrays_zip("_from", "_to"))
    state = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(pairs, state, lambda s, x: F.struct(
        F.greatest(s["end"], x["_to"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0).cast("bigint"), x["_to"] - F.greatest(s["end"], x["_from"]))).alias("n")))["n"]
    return spans.select(*[F.col(s).alias(c) for c, s in source.items()], F.col("_n").alias("n_words"),
                        F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_hit"), F.array_distinct(F.coalesce("_w", F.array().cast("array<bigint>"))).alias("_w"))


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Replace the windows of each row by the items they belong to.

    Windows have a median of one item; rows without a hit stay out of the join, and a row number of the written
    table brings the items of a row together again.
    """
    with staging(rows.sparkSession):
        rows = keep(stage(rows.withColumn("_row", F.monotonically_increasing_id()), "contamination"))
        hits = rows.where(F.size("_w") > 0).select("_row", F.explode("_w").alias("w"))
        items = hits.join(names, "w").groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
        return rows.drop("_w").join(items, "_row", "left").drop("_row").withColumn(
            "item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
