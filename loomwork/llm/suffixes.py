"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted, windows around equal anchors counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.words import BLANK_WORDS, blocks, constants, mix, shingles, signed, words
from loomwork.session import keep, stage, staging

#: A passage has at least this many words.
MIN_WORDS = 50
#: A suffix is retained where its first SEED_WORDS words hash lowest among SPREAD consecutive positions. A passage of
#: MIN_WORDS words therefore holds a retained suffix within its first SPREAD words, with ANCHOR_WORDS words to go.
SEED_WORDS, SPREAD = 12, 16
ANCHOR_WORDS = MIN_WORDS - SPREAD + 1
#: Words that a suffix row carries before and after the anchor.
LEFT, RIGHT = SPREAD - 1, SPREAD - 1

_ROW = "anchor bigint, right binary, left binary, v {kind}, pos bigint"


def retained(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the minimisers: the leftmost lowest seed of each run of SPREAD seeds inside a row."""
    n = len(hashes) - SPREAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.lib.stride_tricks.sliding_window_view(hashes, SPREAD).argmin(axis=1) + np.arange(n)
    return np.unique(best[row[:n] == row[SPREAD - 1:]])


def _suffixes(w) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor hash of every retained suffix with a full anchor."""
    at, seed = shingles(w, SEED_WORDS)
    here = at[retained(seed, w.row[at])] if len(at) else at
    anchor_at, anchor = shingles(w, ANCHOR_WORDS)
    place = np.searchsorted(anchor_at, here)
    place[place == len(anchor_at)] = 0
    full = anchor_at[place] == here if len(anchor_at) else np.zeros(len(here), bool)
    return here[full], anchor[place[full]] if len(anchor_at) else anchor


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            w = words(block, BLANK_WORDS)
            at, anchor = _suffixes(w)
            ids = batch.column(0).slice(block.first, len(block)).take(pa.array(w.row[at]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at - w.offsets[w.row[at]]), pa.array(signed(anchor))], names=["v", "pos", "anchor"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, text, positions) -> suffix rows: words as 32-bit hashes; a missing word is 0."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            w = words(block, BLANK_WORDS)
            rows = batch.slice(block.first, len(block))
            lists = rows.column(2)
            pos = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(block)), np.diff(lists.offsets.to_numpy()))
            first, last = w.offsets[row], w.offsets[row + 1]
            at = first + pos
            short = np.append((w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))

            def around(begin: np.ndarray, n: int) -> list[bytes]:
                index = begin[:, None] + np.arange(n)
                index = np.where((index >= first[:, None]) & (index < last[:, None]), index, len(short) - 1)
                flat = short[index].astype(">u4").tobytes()
                return [flat[i:i + 4 * n] for i in range(0, len(flat), 4 * n)]

            anchor_at, anchor = shingles(w, ANCHOR_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor[np.searchsorted(anchor_at, at)])), pa.array(around(at + ANCHOR_WORDS, RIGHT), pa.binary()),
                 pa.array(around(at - LEFT, LEFT), pa.binary()), rows.column(0).take(pa.array(row)), pa.array(pos)],
                names=["anchor", "right", "left", "v", "pos"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(len(column), n)


def _window_hashes(anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of MIN_WORDS words that contains the anchor, by how many words it has before the anchor (a
    column each), and whether the text has all of its words."""
    before = np.zeros((len(anchor), LEFT + 1), np.uint64)
    after = np.zeros((len(anchor), RIGHT + 1), np.uint64)
    np.cumsum(left * constants(LEFT, 3000), axis=1, out=before[:, 1:])
    np.cumsum(right * constants(RIGHT, 3100), axis=1, out=after[:, 1:])
    whole = np.ones(before.shape, bool)
    whole[:, 1:] = left != 0
    whole[:, :-1] &= right[:, ::-1] != 0
    return mix(anchor[:, None] + before + after[:, ::-1] + constants(LEFT + 1, 3200)), whole


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix and words before the anchor of every whole window, and its hash."""
    left, right = _matrix(rows.column(2), LEFT)[:, ::-1], _matrix(rows.column(1), RIGHT)
    window, whole = _window_hashes(rows.column(0).to_numpy().view(np.uint64), left.astype(np.uint64), right.astype(np.uint64))
    suffix, back = np.nonzero(whole)
    return suffix, back, window[suffix, back]


def _shared(rows: pa.Table, edge: bool) -> Iterator[pa.RecordBatch]:
    """Suffix rows of whole anchor groups -> the span of every suffix over its windows that another document holds too.

    Equal windows are neighbours once sorted. Of a group at an ``edge``, which other tasks may hold more of, the windows seen
    come out too: one row for each that two documents here hold, and every place of the others.
    """
    suffix, back, window = _unpacked(rows)
    kind = rows.schema.field(3).type
    code, ids = pd.factorize(rows.column(3).to_pandas(), sort=True)
    pos = rows.column(4).to_numpy()
    order = np.argsort(window, kind="stable")
    group = np.flatnonzero(np.diff(window[order], prepend=~window[order[:1]]))
    sizes = np.diff(group, append=len(order))
    v = code[suffix[order]]
    lo, hi = (f.reduceat(v, group) if len(v) else v for f in (np.minimum, np.maximum))
    if edge:
        both, alone = np.flatnonzero(lo < hi), order[np.repeat(lo == hi, sizes)]
        none = pa.nulls(len(both), pa.int64())
        yield _found(ids[lo[both]], none, none, ids[hi[both]], window[order[group[both]]], kind)
        start = pos[suffix[alone]] - back[alone]
        yield _found(ids[code[suffix[alone]]], start, start + MIN_WORDS, None, window[alone], kind)
    lo, hi = np.repeat(lo, sizes), np.repeat(hi, sizes)
    at = np.flatnonzero(lo < hi)
    suffix, back, other = suffix[order[at]], back[order[at]], np.where(lo[at] < v[at], lo[at], hi[at])
    order = np.argsort(suffix, kind="stable")
    suffix, back, other = suffix[order], back[order], other[order]
    first = np.flatnonzero(np.diff(suffix, prepend=-1))
    pos = pos[suffix[first]]
    # windows of one suffix all hold its anchor, so together they are one span
    start, stop, other = (f.reduceat(x, first) if len(first) else x for f, x in ((np.maximum, back), (np.minimum, back), (np.minimum, other)))
    yield _found(ids[code[suffix[first]]], pos - start, pos - stop + MIN_WORDS, ids[other], None, kind)


def _found(v, start, stop, other, window, kind: pa.DataType) -> pa.RecordBatch:
    n = len(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kind), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.nulls(n, kind) if other is None else pa.array(other, kind),
         pa.nulls(n, pa.int64()) if window is None else pa.array(signed(window))], names=["v", "start", "stop", "other", "window"])


#: Suffixes of one anchor that are compared at once; a larger group is cut as if it went on in another task.
GROUP_ROWS = 1 << 15


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffix rows -> spans of all anchor groups, and the windows seen in the groups that go on elsewhere."""
    edge, held, cut = None, [], False  # held: rows of the last anchor so far; cut: some of them came out already
    for batch in batches:
        if not len(batch):
            continue
        anchor = batch.column(0).to_numpy()
        edge = anchor[0] if edge is None else edge
        if held and held[0].column(0)[0].as_py() == anchor[0]:
            inside = int(np.searchsorted(anchor, anchor[0], "right"))
            held, batch, anchor = [*held, batch.slice(0, inside)], batch.slice(inside), anchor[inside:]
        if held and (len(anchor) or sum(map(len, held)) >= GROUP_ROWS):
            last = held[0].column(0)[0].as_py()
            cut = cut or not len(anchor)
            yield from _shared(pa.Table.from_batches(held).combine_chunks(), cut or last == edge)
            held, cut = [], not len(anchor)
        if len(anchor):
            first, begins = int(np.searchsorted(anchor, edge, "right")), int(np.searchsorted(anchor, anchor[-1]))
            if min(first, begins):
                yield from _shared(pa.Table.from_batches([batch.slice(0, min(first, begins))]).combine_chunks(), True)
            if first < begins:
                yield from _shared(pa.Table.from_batches([batch.slice(first, begins - first)]).combine_chunks(), False)
            held = [batch.slice(begins)]
    if held:
        yield from _shared(pa.Table.from_batches(held).combine_chunks(), True)


def _across(seen: DataFrame) -> DataFrame:
    """(v, start, stop, other) of the windows that one document holds in a task and others hold elsewhere."""
    held = seen.groupBy("window").agg(F.min("v").alias("first"), F.max(F.coalesce("other", "v")).alias("last"), F.max(F.col("start").isNotNull()).alias("alone"))
    found = seen.where("start is not null").join(held.where("alone and first <> last"), "window")
    return found.select("v", "start", "stop", F.when(F.col("first") < F.col("v"), F.col("first")).otherwise(F.col("last")).alias("other"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words, other_id): passages of ``MIN_WORDS`` words or more that another document holds too.

    Words are separated by blanks and compared as they stand. Retained suffixes whose first ``ANCHOR_WORDS`` words
    occur in one document only are dropped by a count; of the rest, the words before and after the anchor are fetched
    from the texts and the suffixes are sorted over all tasks by anchor. Every window of ``MIN_WORDS`` words lies around
    an anchor with the same words in all its holders, so in each group of equal anchors the windows are counted, and those
    of two documents or more give a span to each holder: a passage is found whatever other texts hold parts of it.
    Overlapping spans of a document are one passage; ``other_id`` is another holder of one of its windows. An anchor that
    thousands of documents share spreads over as many tasks as its rows fill, as ids are part of the order, and a task
    compares at most ``GROUP_ROWS`` of them at once; windows that such a part holds for one document only are looked up
    among those that all parts have seen.

    Null and short texts and rows with a null id have no passages; repetitions inside one document only are not
    reported; rows that repeat an id are one document; other columns are not looked at; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    with staging(spark):
        texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("v"), F.col(text_col).alias("t"))
        rows = stage(texts.mapInArrow(_anchors, f"v {kind}, pos bigint, anchor bigint"), "anchors")
        twice = rows.groupBy("anchor").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("anchor")
        # written first, so that both sides of the join are plain shuffles and a hot anchor can be split
        left = rows.join(stage(twice, "twice"), "anchor").groupBy("v").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
        suffixes = texts.join(left, "v").select("v", "t", "positions").mapInArrow(_contexts, _ROW.format(kind=kind))
        order = ["anchor", "v", "pos"]
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = suffixes.repartitionByRange(width, *order).sortWithinPartitions(*order)
        compared = stage(ranged.mapInArrow(_compare, f"v {kind}, start bigint, stop bigint, other {kind}, window bigint"), "compared")
        inside = compared.where("window is null").select("v", "start", "stop", "other")
        spans = inside.unionByName(_across(compared.where("window is not null"))).distinct()
        before = Window.partitionBy("v").orderBy("start", "stop", "other").rowsBetween(Window.unboundedPreceding, -1)
        here = Window.partitionBy("v").orderBy("start", "stop", "other")
        spans = spans.withColumn("fresh", F.coalesce((F.col("start") > F.max("stop").over(before)).cast("int"), F.lit(0)))
        passages = spans.withColumn("run", F.sum("fresh").over(here)).groupBy("v", "run").agg(
            F.min("start").alias("first_word"), (F.max("stop") - F.min("start")).alias("n_words"), F.min("other").alias("other_id")).drop("run")
        return keep(stage(passages, "passages")).withColumnRenamed("v", id_col)
