"""Repeated passages by content-defined chunking: a gear rolling hash cuts, digests find equal chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.words import Block, blocks, constants, hash_pieces, signed
from loomwork.session import keep, stage, staging

#: The rolling hash covers 16 bytes; a cut follows every position where its 5 highest bits are 0, so chunks have 32
#: bytes on average; cuts within MIN_CHUNK bytes after another are dropped, and gaps beyond MAX_CHUNK are cut evenly.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 5, 12, 96
#: Least bytes of consecutive repeated chunks that make a repeated passage: about 25 words. A passage of 50 words loses
#: a chunk or less at each end, a common phrase or line stays below.
MIN_BYTES = 120

_GEAR = (constants(256, 400) >> np.uint64(48)).astype(np.uint16)


def cuts(block: Block) -> np.ndarray:
    """Ends of the chunks of a block's rows (the last byte's position plus one), row ends included.

    The hash of a position depends on the 16 bytes before it and the decision on the bytes shortly before, so an
    insertion moves cuts near it only.
    """
    data, at = block.data, block.offsets
    if not len(data):
        return np.zeros(0, np.int64)
    rolling, span = _GEAR[data], 1
    while span < 16:  # after each doubling the hash covers twice as many bytes
        older = rolling.copy()
        rolling[span:] += older[:-span] << np.uint16(span)
        span *= 2
    found = np.flatnonzero((rolling >> np.uint16(16 - CUT_BITS)) == 0) + 1
    ends = at[1:][np.diff(at) > 0]
    begins = at[:-1][np.diff(at) > 0]
    row_begin = begins[np.searchsorted(begins, found - 1, "right") - 1]
    found = found[found - row_begin >= 16]
    near = np.zeros(len(found), bool)
    near[1:] = (np.diff(found) < MIN_CHUNK) & (np.searchsorted(ends, found[1:] - 1, "right") == np.searchsorted(ends, found[:-1] - 1, "right"))
    all_ends = np.union1d(found[~near], ends)
    first = np.concatenate([[0], all_ends[:-1]])
    pieces = -(-(all_ends - first) // MAX_CHUNK)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(np.repeat(first, pieces) + (number + 1) * MAX_CHUNK, np.repeat(all_ends, pieces))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            end = cuts(block)
            length = np.diff(end, prepend=0)
            digest = hash_pieces(block.data, length) if len(end) else np.zeros(0, np.uint64)
            row = np.searchsorted(block.offsets, end - 1, "right") - 1
            ids = batch.column(0).slice(block.first, len(block)).take(pa.array(row))
            start = end - length - block.offsets[row]
            for i in range(0, len(end), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, 100_000), pa.array(signed(digest[part].copy())), pa.array(start[part]), pa.array(length[part].astype(np.int32))],
                    names=["v", "digest", "start", "length"])


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(v, digest, start, length) of every chunk of every text; byte offsets."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_chunks, f"v {kind}, digest bigint, start bigint, length int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, start, n_bytes, removable_bytes, n_places, first_id): passages that other documents hold too.

    Texts are cut into chunks, chunks are counted by digest (summed before they travel), and chunks of two or more
    documents are joined back; consecutive ones make a passage, reported from ``min_bytes`` on. A chunk alone is no
    passage, so an accidental agreement of two 64-bit digests is never reported. Its chunks are ``removable`` where a
    document with a lower id has them, so that removing them keeps one copy of everything. ``n_places`` is the
    smallest number of places that hold a chunk of it, ``first_id`` the lowest id that has its first chunk.

    Offsets are UTF-8 bytes. A copy of a whole text is a passage as long as the text. Null and empty texts and rows
    with a null id have no passages; rows that repeat an id are one document; other columns are not looked at; an
    empty table gives an empty result.
    """
    with staging(docs.sparkSession):
        texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("v"), F.col(text_col).alias("t"))
        chunks = stage(chunked(texts, "v", "t"), "chunks")
        shared = chunks.groupBy("digest", "length").agg(
            F.min("v").alias("first"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last")
        marked = chunks.join(shared.drop("last"), ["digest", "length"]).select("v", "start", "length", "first", "n")
        here = Window.partitionBy("v").orderBy("start")
        apart = F.coalesce((F.lag(F.col("start") + F.col("length")).over(here) != F.col("start")).cast("int"), F.lit(0))
        runs = marked.withColumn("_apart", apart).withColumn("run", F.sum("_apart").over(here))
        passages = runs.groupBy("v", "run").agg(
            F.min("start").alias("start"), F.sum("length").cast("bigint").alias("n_bytes"),
            F.sum(F.when(F.col("first") < F.col("v"), F.col("length")).otherwise(0)).cast("bigint").alias("removable_bytes"),
            F.min("n").alias("n_places"), F.min_by("first", "start").alias("first_id")).where(F.col("n_bytes") >= min_bytes).drop("run")
        return keep(stage(passages, "passages")).withColumnRenamed("v", id_col)
