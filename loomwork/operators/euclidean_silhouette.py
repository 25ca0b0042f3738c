"""Silhouettes in true Euclidean distance, with proven bounds, without pairs of rows.

Rows are summed up in cells: those of one cluster that are nearest to one of ``cells`` centres. For n rows with mean c and
scatter S the distances from a row x add up to at least n |x - c|, because distance is convex, and to at most
n sqrt(|x - c|^2 + S / n), because the root is concave. Both hold for any cells, so the centres may come from a sample of
bounded size. One pass over the rows gives every row its bounds; more cells make them closer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.features import fit_sample
from loomwork.session import stage

#: Most rows that the centres are fitted on; the bounds hold whatever they are.
CENTRE_ROWS = 50_000
#: Distances that a task holds at a time.
BLOCK = 4_000_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of all rows to all points; points are taken one feature at a time, so that near ones lose no digits."""
    out = np.zeros((len(x), len(c)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - c[None, :, i]) ** 2
    return np.sqrt(out)


def _blocks(x: np.ndarray, points: int) -> Iterator[slice]:
    step = max(1, BLOCK // max(1, points))
    return (slice(i, i + step) for i in range(0, len(x), step))


def _cell_sums(centres: np.ndarray):
    """Per (cluster, cell) rows, and first and second moments about the centre, added up in the task."""
    width = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, cluster = _matrix(batch.column(1), width), batch.column(0).to_numpy(zero_copy_only=False)
            nearest = np.concatenate([_distances(x[s], centres).argmin(axis=1) for s in _blocks(x, len(centres))] or [np.zeros(0, int)])
            pairs, which = np.unique(np.stack([cluster, nearest], axis=1), axis=0, return_inverse=True)
            away = x - centres[nearest]
            added = np.zeros((len(pairs), width + 2))
            np.add.at(added, which.ravel(), np.column_stack([np.ones(len(x)), away, (away ** 2).sum(axis=1)]))
            for pair, row in zip(map(tuple, pairs.tolist()), added):
                sums[pair] = sums[pair] + row if pair in sums else row
        keys = np.array(list(sums), np.int32).reshape(-1, 2)
        values = np.stack(list(sums.values())) if sums else np.zeros((0, width + 2))
        places = values.shape[1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(keys[:, 0], places)), pa.array(np.repeat(keys[:, 1], places)), pa.array(np.tile(np.arange(places, dtype=np.int32), len(keys))),
            pa.array(values.ravel())], names=["cluster", "cell", "place", "value"])

    return run


def _bounds(clusters: np.ndarray, sizes: np.ndarray, n: np.ndarray, middle: np.ndarray, scatter: np.ndarray, starts: np.ndarray):
    """Per row low and high silhouette; cells are sorted by cluster, ``starts`` is the first cell of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch.column("x"), middle.shape[1]), np.searchsorted(clusters, batch.column("cluster").to_numpy(zero_copy_only=False))
            low, high = np.empty(len(x)), np.empty(len(x))
            for s in _blocks(x, len(n)):
                d = _distances(x[s], middle)
                least = np.add.reduceat(n * d, starts, axis=1)
                most = np.add.reduceat(n * np.sqrt(d * d + scatter / n), starts, axis=1)
                at, mine = np.arange(len(d)), own[s]
                others = np.maximum(sizes[mine] - 1, 1)
                a_low, a_high = least[at, mine] / others, most[at, mine] / others
                least, most = least / sizes, most / sizes
                least[at, mine] = most[at, mine] = np.inf
                b_low, b_high = least.min(axis=1), most.min(axis=1)
                for out, a, b in ((low, a_high, b_low), (high, a_low, b_high)):
                    top = np.maximum(a, b)
                    out[s] = np.where((sizes[mine] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))
            kept = [batch.column(c) for c in batch.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(low), pa.array(high)], names=[*[c for c in batch.schema.names if c != "x"], "low", "high"])

    return run


def euclidean_silhouettes(df: DataFrame, keys: list[str], cells: int = 256, features: str = "features", prediction: str = "prediction", seed: int = 42) -> DataFrame:
    """(keys, cluster, low, high, silhouette): bounds of every row's silhouette and their middle.

    A row that is a cluster by itself has 0, as has one whose distances are all 0. With fewer than two clusters there is no
    silhouette and no row. Rows without features or cluster are left out; drop noise first. The cells, at most ``cells`` times
    the number of clusters, reach every task.
    """
    there = df.where(F.col(features).isNotNull() & F.col(prediction).isNotNull())
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = stage(there.select(*named, F.col(prediction).cast("int").alias("cluster"), vector_to_array(features).alias("x"), F.col(features).alias("point")), "points")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name.startswith("_k"))
    schema = ", ".join(p for p in (kinds, "cluster int, low double, high double") if p)
    back = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]

    def shaped(out: DataFrame) -> DataFrame:
        return out.select(*back, "cluster", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("silhouette"))

    if rows.select("cluster").distinct().limit(2).count() < 2:
        return shaped(df.sparkSession.createDataFrame([], schema))
    sample = stage(fit_sample(rows.select("point"), CENTRE_ROWS), "sample")
    centres = np.array(KMeans(k=max(2, cells), maxIter=5, seed=seed, featuresCol="point").fit(sample).clusterCenters())
    sums = rows.select("cluster", "x").mapInArrow(_cell_sums(centres), "cluster int, cell int, place int, value double")
    added: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.groupBy("cluster", "cell", "place").agg(F.sum("value").alias("value")).collect():  # numbers of the cells, not of the rows
        added.setdefault((r["cluster"], r["cell"]), np.zeros(centres.shape[1] + 2))[r["place"]] = r["value"]
    order = sorted(added)
    table = np.stack([added[p] for p in order])
    n, first = table[:, 0], table[:, 1:-1] / table[:, :1]
    middle = centres[[cell for _, cell in order]] + first
    scatter = np.maximum(table[:, -1] - n * (first ** 2).sum(axis=1), 0.0)
    clusters, starts = np.unique(np.array([c for c, _ in order]), return_index=True)
    sizes = np.add.reduceat(n, starts)
    return shaped(rows.drop("point").mapInArrow(_bounds(clusters, sizes, n, middle, scatter, starts), schema))


def euclidean_silhouette(df: DataFrame, tolerance: float = 0.02, cells: int = 64, most_cells: int = 4096, **options) -> DataFrame:
    """(silhouette, low, high, rows, cells): the mean silhouette and its bounds.

    The number of cells grows fourfold until the bounds are within ``tolerance`` of each other or ``most_cells`` are reached;
    the bounds say how good the answer is. Nulls with fewer than two clusters.
    """
    while True:
        out = stage(euclidean_silhouettes(df, [], cells, **options).agg(
            F.avg("silhouette").alias("silhouette"), F.avg("low").alias("low"), F.avg("high").alias("high"), F.count(F.lit(1)).alias("rows"), F.lit(cells).alias("cells")), "silhouette")
        r = out.first()
        if r["low"] is None or r["high"] - r["low"] <= tolerance or cells >= most_cells:
            return out
        cells = min(cells * 4, most_cells)
