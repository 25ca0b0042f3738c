"""Near-duplicate documents: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import lowest_reachable
from loomwork.llm.words import BLANK_WORDS, Block, blocks, constants, int_lists, mix, sequence_hash, shingles, signed, words
from loomwork.session import broadcast_if_small, keep, stage, staging, unstage

SHINGLE_WORDS = 5
SIMILARITY = 0.75
BANDS, ROWS_PER_BAND = 48, 5
BINS = BANDS * ROWS_PER_BAND
#: Most ids that are sent to the tasks to pick their documents (of 8 bytes each).
LOCAL_IDS = 4_000_000
#: Bits of the finer sketch that open candidates are compared by, and how many may differ: similarity 0.75 differs in
#: 256 of 2048 on average with a deviation of 15, so 333 leaves out a link with probability below 3e-7.
BITS, MAX_DIFFERENT = 2048, 333

_FAST_PROBES = 16
_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower hash bound of every bin; for each bin, the fixed random order in which it looks for a filled one, if it is
    empty; and the place of every bin in that order."""
    if bins not in _TABLES:
        edges = np.array([-(-(j << 32) // bins) for j in range(bins)], np.uint64) << np.uint64(32)
        probes = np.argsort(mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(9_000_000)).reshape(bins, bins), axis=1).astype(np.int16)
        _TABLES[bins] = edges, probes, np.argsort(probes, axis=1).astype(np.int16)
    return _TABLES[bins]


def shingle_sets(block: Block, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; a shorter text is one shingle, a text without words none."""
    w = words(block.lower(), BLANK_WORDS)
    first, value = shingles(w, size)
    cuts = np.searchsorted(first, w.offsets)
    counts = w.count()
    return [np.unique(value[cuts[r]:cuts[r + 1]]) if counts[r] >= size else sequence_hash(w, r) if counts[r] else value[:0]
            for r in range(len(block))]


def densified(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation sketch of each set: the least hash of every bin, empty bins filled by optimal densification.

    An empty bin copies the first filled bin of its own fixed random order, so two sets agree in a bin with a
    probability equal to their similarity, also for very small sets.
    """
    edges, probes, rank = _tables(bins)
    sizes = np.array([len(s) for s in sets])
    sketch = np.zeros((len(sets), bins), np.uint64)
    if not sizes.sum():
        return sketch
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    cell = row * bins + (np.searchsorted(edges, flat, "right") - 1)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    filled = np.zeros(sketch.size, bool)
    filled[cell[first]] = True
    sketch.ravel()[cell[first]] = flat[first]
    filled = filled.reshape(sketch.shape)
    open_ = ~filled & (sizes > 0)[:, None]
    for step in range(_FAST_PROBES):
        r, b = np.nonzero(open_)
        source = probes[b, step]
        hit = filled[r, source]
        sketch[r[hit], b[hit]] = sketch[r[hit], source[hit]]
        open_[r[hit], b[hit]] = False
    for r in np.flatnonzero(open_.any(axis=1)):
        have, empty = np.flatnonzero(filled[r]), np.flatnonzero(open_[r])
        sketch[r, empty] = sketch[r, have[rank[np.ix_(empty, have)].argmin(axis=1)]]
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One bucket key per row and band."""
    folded = (mix(sketch).reshape(len(sketch), BANDS, ROWS_PER_BAND) * constants(ROWS_PER_BAND, 31)).sum(axis=2, dtype=np.uint64)
    return mix(folded + constants(BANDS, 53))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            sets = shingle_sets(block)
            sizes = np.array([len(s) for s in sets])
            bands = band_keys(densified(sets))[sizes > 0]
            digests = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)] for s in sets], np.uint64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, len(block)), pa.array(sizes.astype(np.int64)), pa.array(signed(digests[:, 0].copy())),
                 pa.array(signed(digests[:, 1].copy())), int_lists(signed(bands.ravel()), offsets)],
                names=["v", "n", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            sets = [signed(s).tobytes() for s in shingle_sets(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(sets, pa.binary())], names=["v", "members"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, near) from two sets: 100 * common >= 75 * together."""
    for batch in batches:
        near = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            near.append(100 * common >= round(100 * SIMILARITY) * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])


def confirm(edges: DataFrame, docs: DataFrame, id_type: str) -> DataFrame:
    """``edges`` (a, b) with ``near``: whether the whole shingle sets of the two documents are similar enough."""
    wanted = edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).distinct()
    sets = _those(docs, wanted).mapInArrow(_sets, f"v {id_type}, members binary")
    pairs = (
        edges.join(sets.select(F.col("v").alias("a"), F.col("members").alias("x")), "a")
        .join(sets.select(F.col("v").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    )
    return stage(pairs.mapInArrow(_similar, f"a {id_type}, b {id_type}, near boolean"), "confirmed")


def _those(rows: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose ``v`` is wanted (or is not). Up to ``LOCAL_IDS`` ids, which are counted, go to the rows; beyond, both are shuffled."""
    return rows.join(broadcast_if_small(wanted, LOCAL_IDS), "v", how)


def bits(sets: list[np.ndarray]) -> np.ndarray:
    """A fine sketch of 2048 bins with one bit for each, packed: similar sets differ in few bits."""
    sketch = densified(sets, BITS)
    one = (mix(sketch ^ constants(BITS, 91)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(one, axis=1).view(np.int64)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            sets = shingle_sets(block)
            short = (band_keys(densified(sets)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, len(block)), int_lists(short.ravel(), np.arange(len(block) + 1) * BANDS),
                 *map(pa.array, np.ascontiguousarray(bits(sets).T))], names=["v", "bands", *_WORDS])


_WORDS = [f"w{i}" for i in range(BITS // 64)]


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, band, v, n, root) of the buckets whose members are not yet in one component."""
    labelled = members.drop("root").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    open_ = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return stage(labelled.join(open_, "key"), "open")


def _star(centres: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct edges (a, b) from the centre of a bucket to its members of fitting size in other components."""
    centres = centres.select("key", *[F.col(c).alias(f"{c}_a") for c in ("v", "n", "root")])
    return members.join(centres, "key").where("root <> root_a and 100 * least(n, n_a) >= 75 * greatest(n, n_a)").select(
        F.least("v_a", "v").alias("a"), F.greatest("v_a", "v").alias("b")).distinct()


def _rest(members: DataFrame, texts: DataFrame, id_type: str) -> DataFrame:
    """Distinct edges between bucket members of fitting size, in different components, that also look alike finely.

    A pair leaves the join in the first band that the two share only.
    """
    fine = _those(texts, members.select("v").distinct()).mapInArrow(
        _bits, f"v {id_type}, bands array<int>, " + ", ".join(f"{w} bigint" for w in _WORDS))
    known = members.join(stage(fine, "bits"), "v")
    other = known.drop("band").select("key", *[F.col(c).alias(f"{c}_a") for c in known.columns if c not in ("key", "band")])
    different = " + ".join(f"bit_count({w} ^ {w}_a)" for w in _WORDS)
    return known.join(other, "key").where(
        f"v_a < v and root <> root_a and 100 * least(n, n_a) >= 75 * greatest(n, n_a) and {different} <= {MAX_DIFFERENT} "
        "and not arrays_overlap(slice(bands, 1, band), slice(bands_a, 1, band))").select(F.col("v_a").alias("a"), F.col("v").alias("b")).distinct()


def _compared(edges: DataFrame, before: DataFrame | None, texts: DataFrame, id_type: str) -> DataFrame:
    """``before`` (a, b, near) and the edges that are not in it, confirmed."""
    if before is not None:
        edges = edges.join(before.select("a", "b"), ["a", "b"], "left_anti")
    edges = stage(edges, "edges")
    fresh = confirm(edges, texts, id_type)
    unstage(edges)
    return fresh if before is None else before.unionByName(fresh)


def _bucket_links(members: DataFrame, texts: DataFrame, id_type: str) -> DataFrame:
    """(a, b): links that connect whatever bucket members confirmed links connect. See ``near_duplicates``."""
    members = members.select("key", "band", "v", "n", F.col("v").alias("root"))
    lowest = members.groupBy("key").agg(F.min(F.struct("v", "n", "root")).alias("c")).select("key", "c.*")
    done = _compared(_star(lowest, members), None, texts, id_type)
    links = done.where("near").select("a", "b")
    roots = lowest_reachable(links)
    open_ = _open_buckets(members, roots)
    if open_.isEmpty():
        return roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    ends = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v")))
    met = open_.join(ends.groupBy("v").agg(F.count(F.lit(1)).alias("met")), "v")
    most = met.groupBy("key").agg(F.max(F.struct("met", "v", "n", "root")).alias("c")).select("key", "c.*")
    known = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    done = _compared(_star(most, open_), done, texts, id_type)
    roots = lowest_reachable(known.unionByName(done.where("near").select("a", "b")))
    open_ = _open_buckets(open_, roots)
    known = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    return known.unionByName(_compared(_rest(open_, texts, id_type), done, texts, id_type).where("near").select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): every document with the smallest id it reaches over confirmed links.

    Two documents are linked when 100 * common shingles >= 75 * all their shingles (five blank-separated words,
    A-Z lower-cased, whole texts). 48 bands of 5 bins miss a pair of similarity 0.75 with probability 2e-6.
    Equal sets are one vertex. In a bucket, candidates form stars: the first centre is the lowest id, the second
    the document that most confirmed links meet, which settles groups of near copies at two edges a member. Members
    that are still in different components are compared by a fine sketch inside the join, and only pairs that look
    alike there leave it. No bucket is capped.

    Null or wordless texts have no shingles and are linked with nothing; rows with a null id are returned with a
    null component. Rows that repeat an id share a vertex and a component. Other columns, whatever their names,
    are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("v"), F.col(text_col).alias("_text"))
    with staging(spark):
        sketches = stage(docs.mapInArrow(_sketches, f"v {id_type}, n bigint, d1 bigint, d2 bigint, bands array<bigint>"), "sketches")
        sized = sketches.where("v is not null and n > 0")
        reps = sized.groupBy("d1", "d2", "n").agg(F.min("v").alias("rep"))
        same = stage(sized.select("v", "n", "d1", "d2").join(reps, ["d1", "d2", "n"]).select("v", "rep"), "same")
        copies = same.groupBy("v").agg(F.bool_and(F.col("v") != F.col("rep")).alias("copy")).where("copy").select("v")
        members = _those(sized, copies, "left_anti").select("v", "n", F.posexplode("bands").alias("band", "key"))
        shared = members.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("key")
        members = stage(members.join(shared, "key"), "members")
        links = same.where("v <> rep").select(F.col("v").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(_bucket_links(members, docs.where("v is not null"), id_type))
        roots = keep(lowest_reachable(links))
        return keep(sketches).select("v", "n").join(roots, "v", "left").select(
            F.col("v").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "v").alias("component_id"))
