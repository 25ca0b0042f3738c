"""Neighbours of wide vectors by hash tables of hyperplanes.

A table cuts space by ``bits`` orthonormal hyperplanes through the centre of the data; the signs are a vector's bucket. A
query looks into the buckets whose planes it is nearest to. Because the planes are orthonormal, the squared distances to
the planes between a query and a bucket add up to a lower bound of its distance to everything in that bucket: so buckets
have an order of promise, and a bound that says when no unseen bucket can hold a nearer vector. ``calibrated_probes``
measures how many buckets a wanted recall takes, ``nearest`` compares with those, and ``nearest(..., exact=True)`` goes on
until the bound closes. Vectors that are compared are re-ranked by their true distance.

Buckets are stored in blocks of bounded size, however many vectors a bucket holds; equal vectors are stored once, so a pile
of copies costs no more than any other vector. Parts of the index meet parts of the queries in groups of bounded size, where
blocks are compared by matrix products; a query travels once to every part of the index, however many buckets it probes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import join_small, keep, stage, staging

#: Doubles of a block of stored vectors.
BLOCK_DOUBLES = 65_536
#: Doubles of the stored vectors and of the queries that meet in one group, on average.
STORED_DOUBLES, QUERY_DOUBLES = 2_000_000, 500_000
#: Vectors a bucket should hold, and the most planes of a table; beyond that buckets grow, in more blocks.
BUCKET_ROWS, MAX_BITS = 64, 14
#: Vectors whose exact neighbours are sought to choose the number of probes, and what is added to the wanted recall.
CALIBRATION_ROWS, RECALL_MARGIN = 200, 0.02
_STORED = "table int, code int, loc bigint, x array<double>"


@dataclass
class HashIndex:
    """Hash tables over the distinct vectors of a table."""

    centre: np.ndarray
    planes: np.ndarray  # table, coordinate, plane
    blocks: DataFrame  # table, code, part, locs, xs
    copies: DataFrame  # loc (the lowest id of a vector), id
    rows: int

    @property
    def tables(self) -> int:
        return self.planes.shape[0]

    @property
    def width(self) -> int:
        return self.planes.shape[1]

    @property
    def bits(self) -> int:
        return self.planes.shape[2]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))


def _margins(x: np.ndarray, centre: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Signed distances to the planes: table, row, plane."""
    return np.matmul(x - centre, planes)


def _code(margins: np.ndarray) -> np.ndarray:
    return (margins > 0) @ (1 << np.arange(margins.shape[-1]))


def _bounds(margins: np.ndarray) -> np.ndarray:
    """Lower bound of the squared distance to every bucket, by the planes that lie between (bits of the column)."""
    out = np.zeros((len(margins), 1))
    for i in range(margins.shape[1]):
        out = np.concatenate([out, out + margins[:, i:i + 1] ** 2], axis=1)
    return out


def _hashed(centre: np.ndarray, planes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _vectors(batch.column(1), planes.shape[1])
            for table, margins in enumerate(_margins(x, centre, planes)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), table, np.int32)), pa.array(_code(margins).astype(np.int32)), batch.column(0), _lists(x)],
                                                 names=["table", "code", "loc", "x"])

    return run


def _limited(centre: np.ndarray, planes: np.ndarray, probes: int) -> Callable:
    """(loc, x, reach) -> loc, x and for every table the bound up to which buckets are searched: that of the ``probes``-th, or ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) >> planes.shape[2])
            for begin in range(0, len(batch), step):
                rows = batch.slice(begin, step)
                x, reach = _vectors(rows.column(1), planes.shape[1]), rows.column(2).to_numpy(zero_copy_only=False)
                limits = np.repeat(reach[:, None], len(planes), axis=1)
                if probes:
                    for table, margins in enumerate(_margins(x, centre, planes)):
                        bound = _bounds(margins)
                        at = min(probes, bound.shape[1]) - 1
                        limits[:, table] = np.maximum(reach, np.partition(bound, at, axis=1)[:, at])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _lists(limits)], names=["loc", "x", "limits"])

    return run


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """(table, code, part, locs, xs): at most about ``most`` rows of a bucket together; the hash of the row says where."""
    rows = stage(rows, "hashed")
    sizes = rows.groupBy("table", "code").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    dealt = join_small(rows, sizes, ["table", "code"]).withColumn("part", F.pmod(F.xxhash64("loc"), "parts"))
    packed = dealt.groupBy("table", "code", "part").agg(F.array_sort(F.collect_list(F.struct("loc", "x"))).alias("p"))
    return packed.select("table", "code", "part", F.col("p.loc").alias("locs"), F.flatten("p.x").alias("xs"))


def build_index(points: DataFrame, width: int, tables: int = 2, seed: int = 42, bits: int | None = None) -> HashIndex:
    """Index all rows of ``points`` (``id`` bigint, unique; ``x`` array of ``width`` finite doubles; others are an error).

    The planes are drawn at random by ``seed`` and are orthonormal within a table; the centre is the mean of the distinct
    vectors. Nothing else is fitted. The number of planes grows with the number of vectors. Empty tables make an empty index.
    """
    odd = points.where(F.col("id").isNull() | F.col("x").isNull() | (F.size("x") != width) | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).count()
    if odd:
        raise ValueError(f"{odd} points have no id, or not {width} finite coordinates")
    with staging(points.sparkSession):
        points = stage(points.select("id", F.col("x").cast("array<double>").alias("x")), "points")
        locations = stage(points.groupBy("x").agg(F.min("id").alias("loc")), "locations")
        whole = locations.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(width)]).first()
        n = whole[0]
        bits = bits or max(1, min(MAX_BITS, width, round(math.log2(max(2, n / BUCKET_ROWS)))))
        draws = np.random.default_rng(seed)
        planes = np.stack([np.linalg.qr(draws.normal(size=(width, width)))[0][:, :bits] for _ in range(tables)])
        centre = np.array([c or 0.0 for c in whole[1:]])
        stored = locations.select("loc", "x").mapInArrow(_hashed(centre, planes), _STORED)
        blocks = keep(stage(_in_blocks(stored, max(1, BLOCK_DOUBLES // width)), "blocks"))
        copies = keep(stage(points.join(locations, "x").select("loc", "id"), "copies"))
    return HashIndex(centre, planes, blocks, copies, n)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = q - x
    return np.einsum("ij,ij->i", d, d)


def _close(q: np.ndarray, x: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of rows within ``far`` of a query, among them its k nearest as far as those are within."""
    q2, x2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    rough = q2[:, None] + x2[None, :] - 2 * (q @ x.T)
    if k < len(x) and not np.isfinite(far).all():
        far = np.minimum(far, np.partition(rough, k - 1, axis=1)[:, k - 1])
    query, row = np.nonzero(rough <= (far + 1e-11 * (q2 + x2.max()))[:, None])
    return query, row, _distances(q[query], x[row])


def _searched(centre: np.ndarray, planes: np.ndarray, k: int) -> Callable:
    """Queries and blocks that meet in a cell -> the k nearest stored vectors of every query in the buckets within its limits."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        query, loc, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        asked, n = asked.combine_chunks(), asked.num_rows
        if n and stored.num_rows:
            x = _vectors(asked["x"].combine_chunks(), planes.shape[1])
            limits, far = _vectors(asked["limits"].combine_chunks(), len(planes)), np.full(n, np.inf)
            margins = _margins(x, centre, planes)
            own, cost, places, new = margins > 0, margins ** 2, np.arange(planes.shape[2]), 0
            for table, code, locs, xs in zip(*(stored[c] for c in ("table", "code", "locs", "xs"))):
                t = table.as_py()
                crossed = own[t] != (code.as_py() >> places & 1).astype(bool)
                bound = np.where(crossed, cost[t], 0.0).sum(axis=1) * (1 - 1e-9)
                wanted = np.flatnonzero((bound <= limits[:, t]) & (bound <= far))
                if not len(wanted):
                    continue
                there = locs.values.to_numpy(zero_copy_only=False)
                a, b, c = _close(x[wanted], xs.values.to_numpy(zero_copy_only=False).reshape(len(there), -1), far[wanted], k)
                query, loc, d2, new = np.append(query, wanted[a]), np.append(loc, there[b]), np.append(d2, c), new + len(a)
                if 2 * new >= n * k:
                    (query, loc, d2), new = _cut(query, loc, d2, far, k), 0
            query, loc, d2 = _cut(query, loc, d2, far, k)
            query = asked["loc"].to_numpy()[query]
        return pa.table({"q": pa.array(query, pa.int64()), "loc": pa.array(loc, pa.int64()), "d2": pa.array(d2, pa.float64())})

    return run


def _cut(query: np.ndarray, loc: np.ndarray, d2: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different locations of every query, ties by location; ``far`` takes the distance of the k-th."""
    order = np.lexsort((loc, d2, query))
    query, loc, d2 = query[order], loc[order], d2[order]
    once = np.append(True, (query[1:] != query[:-1]) | (loc[1:] != loc[:-1]))[:len(query)]
    query, loc, d2 = query[once], loc[once], d2[once]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    far[query[rank == k - 1]] = d2[rank == k - 1]
    return query[rank < k], loc[rank < k], d2[rank < k]


def _first(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def _nearest_vectors(index: HashIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(q, rank, loc, d2): the k nearest stored vectors among those in the probed buckets or within reach; ``queries`` has loc, x, reach.

    Parts of the index meet parts of the queries, each pair of parts in one group of bounded size; what a query need not see
    is skipped there. Without ``probes`` one table is searched: it holds every vector.
    """
    stored, tables = (index.blocks, index.tables) if probes else (index.blocks.where("table = 0"), 1)
    parts = math.ceil(max(1, index.rows * tables * index.width) / STORED_DOUBLES)
    sheets = math.ceil(max(1, queries.count() * index.width) / QUERY_DOUBLES)
    asked = queries.select("loc", "x", "reach").mapInArrow(_limited(index.centre, index.planes, probes), "loc bigint, x array<double>, limits array<double>")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), F.pmod(F.xxhash64("loc"), F.lit(sheets)).cast("int").alias("j"), "*")
    stored = stored.select(F.pmod(F.xxhash64("table", "code", "part"), F.lit(parts)).cast("int").alias("i"),
                           F.explode(F.sequence(F.lit(0), F.lit(sheets - 1))).alias("j"), "table", "code", "locs", "xs")
    met = asked.groupBy("i", "j").cogroup(stored.groupBy("i", "j")).applyInArrow(_searched(index.centre, index.planes, k), "q bigint, loc bigint, d2 double")
    return _first(met.distinct(), "q", ["d2", "loc"], k)


def nearest(index: HashIndex, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
    """(id, rank, neighbour, d2): the k nearest indexed rows of every query (``id``, ``x``) but itself, ties by id.

    A query sees ``probes`` buckets of every table; with ``exact`` a second round sees all buckets whose bound does not
    exceed the distance of its k-th neighbour so far, so that nothing nearer is missed. A row of the index with the query's
    id is left out. Queries with equal vectors are searched once. Fewer rows than ``k`` come back where the probed buckets
    (or the index) hold fewer. Null or misshapen query vectors are an error in the task that reads them.
    """
    with staging(queries.sparkSession):
        rows = stage(queries.select("id", F.col("x").cast("array<double>").alias("x")), "queries")
        distinct = stage(rows.groupBy("x").agg(F.min("id").alias("loc")).withColumn("reach", F.lit(-1.0)), "asked")
        best = stage(_nearest_vectors(index, distinct, k + 1, probes), "best")
        if exact:
            known = best.groupBy(F.col("q").alias("loc")).agg(F.max("d2").alias("far"), F.count(F.lit(1)).alias("n"))
            reach = F.when(F.col("n") > k, F.col("far")).otherwise(F.lit(float("inf")))
            again = distinct.drop("reach").join(known, "loc", "left").select("loc", "x", reach.alias("reach"))
            best = stage(_nearest_vectors(index, again, k + 1, 0), "best")
        stand_ins = _first(index.copies, "loc", ["id"], k + 1).select("loc", F.col("id").alias("neighbour"))
        lists = best.select("q", "loc", "d2").join(stand_ins, "loc")
        members = rows.join(distinct.select("x", F.col("loc").alias("q")), "x").select("id", "q")
        per_query = members.join(lists, "q").where("id <> neighbour")
        return keep(stage(_first(per_query, "id", ["d2", "neighbour"], k).select("id", "rank", "neighbour", "d2"), "nearest"))


def calibrated_probes(index: HashIndex, k: int, recall: float = 0.95, rows: int = CALIBRATION_ROWS) -> int:
    """The fewest buckets a table that bring the share of true neighbours found to ``recall`` and a margin.

    A sample of at most ``rows`` indexed vectors, spread by the hash of their id, is compared with all vectors; of each true neighbour the place of its bucket in the query's order is known, the best table counting.
    """
    stored = index.blocks.where("table = 0")
    flat = stored.select(F.explode(F.arrays_zip("locs", F.sequence(F.lit(0), F.size("locs") - 1).alias("at"))).alias("e"), "xs").select(
        F.col("e.locs").alias("loc"), F.slice("xs", F.col("e.at") * index.width + 1, index.width).alias("x"))
    sample = flat.orderBy(F.xxhash64("loc"), "loc").limit(rows).collect()
    if not sample:
        return 1
    x = np.array([r["x"] for r in sample])
    asked = index.blocks.sparkSession.createDataFrame([(r["loc"], r["x"], float("inf")) for r in sample], "loc bigint, x array<double>, reach double")
    found = _nearest_vectors(index, asked, k + 1, 0).where("q <> loc").select("q", "loc", "d2")
    true = flat.join(F.broadcast(_first(found, "q", ["d2", "loc"], k)), "loc").select("q", "x").collect()  # at most rows * k
    if not true:
        return 1
    number = {r["loc"]: i for i, r in enumerate(sample)}
    q, other = np.array([number[r["q"]] for r in true]), np.array([r["x"] for r in true])
    mine, theirs = _margins(x, index.centre, index.planes), _margins(other, index.centre, index.planes)
    place = np.full(len(q), 1 << index.bits)
    for table in range(index.tables):
        bound = _bounds(mine[table])
        crossed = _code(mine[table])[q] ^ _code(theirs[table])
        for i, (a, c) in enumerate(zip(q, crossed)):
            place[i] = min(place[i], int((bound[a] < bound[a, c]).sum()))
    wanted = min(len(place), math.ceil(min(1.0, recall + RECALL_MARGIN) * len(place)))
    return int(np.sort(place)[wanted - 1]) + 1


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(queries, recall): share of the true neighbours (id, neighbour) that ``found`` has."""
    hit = found.select("id", "neighbour").withColumn("hit", F.lit(1))
    return true.select("id", "neighbour").join(hit, ["id", "neighbour"], "left").agg(
        F.count_distinct("id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
