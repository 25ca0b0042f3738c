"""Rows summed up in cells before trees are fitted.

A tree tells rows apart only by the bins of their features, so rows with equal bins (a cell) may take part as one row that
carries their number as weight: node sums, gains and leaves stay what they were. Every bin stands for a value, and a row
belongs to the nearest one; Spark cuts half way between neighbouring values, which is where the bins end, so the fitted trees
read plain rows. A feature with at most ``max_bins`` values keeps them all, another gets values at even quantiles. There are
never more cells than rows, nor more than bins allow, however many rows a table has.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.session import shuffle_width, stage, staging

#: Fits of fewer rows take the rows as they are: the passes saved would not pay for the summing up.
CELL_ROWS = 1_000_000
#: Rows a cell must hold on average, else the rows are fitted as they are.
LEAST_ROWS = 3
#: If even all cells the bins allow would hold so many rows, they are not estimated.
SURE_ROWS = 100
#: Cells of one task of a fit.
TASK_CELLS = 20_000
WEIGHT = "cell_weight"


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def bin_values(rows: DataFrame, columns: list[str], max_bins: int) -> list[list[float]]:
    """Values the bins of every column stand for, in order: all of them up to ``max_bins``, else values at even quantiles."""
    probs = [(i + 0.5) / max_bins for i in range(max_bins)]
    value = {c: F.when(_finite(F.col(c)), F.col(c)) for c in columns}
    about = rows.agg(*[F.approx_count_distinct(v).alias(c) for c, v in value.items()]).first()
    few, seen = [c for c in columns if about[c] <= 2 * max_bins], {c: set() for c in columns}
    if few:  # at most about 2 * max_bins values a column reach the driver
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), value[c].alias("v")) for c in few])).alias("p")
        for r in rows.select(pairs).select("p.*").where("v is not null").distinct().collect():
            seen[r["c"]].add(r["v"])
    many = [c for c in columns if c not in few or len(seen[c]) > max_bins]
    if many:
        found = rows.agg(*[F.percentile_approx(value[c], probs, 20_000).alias(c) for c in many]).first()
        seen |= {c: set(found[c] or ()) for c in many}
    return [sorted(seen[c]) for c in columns]


def _snapped(rows: DataFrame, columns: list[str], values: list[list[float]]) -> DataFrame:
    """Every column moved to the nearest of its values; on a cut to the lower one, as trees do. NaN and infinity stay."""
    for c, v in zip(columns, values):
        if not v:
            continue
        if len(v) == 1:
            near = F.lit(v[0])
        else:
            cuts = [np.nextafter((a + b) / 2, np.inf) for a, b in zip(v, v[1:])]
            rows = Bucketizer(splits=[-np.inf, *map(float, cuts), np.inf], inputCol=c, outputCol=f"{c}_bin", handleInvalid="keep").transform(rows)
            near = F.get(F.lit([float(x) for x in v]), F.col(f"{c}_bin").cast("int"))
        rows = rows.withColumn(c, F.when(_finite(F.col(c)), near).otherwise(F.col(c)))
    return rows


def cells(rows: DataFrame, total: int, max_bins: int, keys: list[str], summed: Callable[[DataFrame, list[str]], DataFrame],
          features: str = "features", least: int = LEAST_ROWS) -> DataFrame | None:
    """One row per cell and ``keys``: keys, ``features`` and what ``summed`` adds up by them, written once and dealt over tasks of bounded size.

    None if the ``total`` rows lie in too many cells for that to pay (fewer than ``least`` rows a cell on average), which is
    estimated before any row is moved.
    """
    first = rows.first()
    columns = [f"_x{i}" for i in range(len(first[features]))]
    meta = rows.schema[features].metadata
    rest = [F.col(c) for c in rows.columns if c != features]
    x = rows.select(*rest, vector_to_array(features).alias("_x")).select(*rest, *[F.col("_x")[i].alias(c) for i, c in enumerate(columns)])
    values = bin_values(x, columns, max_bins)
    snapped = _snapped(x, columns, values)
    found = math.prod(len(v) + 1 for v in values)
    if found * SURE_ROWS > total:
        found = snapped.agg(F.approx_count_distinct(F.xxhash64(*keys, *columns))).first()[0]
    if found * least > total:
        return None
    grouped = summed(snapped, [*keys, *columns])
    named = [c for c in grouped.columns if c not in columns]
    out = stage(grouped.select(*named, array_to_vector(F.array(*columns)).alias(features, metadata=meta)), "cells")
    return out.repartition(max(1, min(shuffle_width(rows.sparkSession), -(-found // TASK_CELLS))))


class _OnCells:
    """Spark's booster, fitted on cells instead of rows where rows are many and only counted and summed."""

    def _summed(self) -> bool:
        return (self.getSubsamplingRate() == 1.0 and self.getMinInstancesPerNode() == 1 and not self.isSet(self.weightCol)
                and not self.isSet(self.validationIndicatorCol) and self.getLossType() in ("logistic", "squared"))

    def _fit(self, dataset):
        label, features = self.getLabelCol(), self.getFeaturesCol()
        rows = dataset.select(F.col(label).cast("double").alias(label), features)
        total, whole = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label).isNotNull() & F.col(features).isNotNull())).first() if self._summed() else (0, 0)
        if total < CELL_ROWS or whole < total:  # Spark refuses nulls
            return super()._fit(dataset)
        count = F.count(F.lit(1)).cast("double").alias(WEIGHT)
        keys, sums = ([label], [count]) if isinstance(self, GBTClassifier) else ([], [F.avg(label).alias(label), count])

        def summed(part, by):
            return part.groupBy(*by).agg(*sums)

        with staging(dataset.sparkSession):
            found = cells(rows, total, self.getMaxBins(), keys, summed, features)
            return super()._fit(dataset) if found is None else super(_OnCells, self.copy({self.weightCol: WEIGHT}))._fit(found)


#: Forests of fewer rows take the rows as they are: every tree on cells is a fit of its own, which costs about as much as some four million rows.
FOREST_ROWS = 5_000_000
#: Parts that a cell's rows are cut into before they are drawn, so that no task gets all rows of a frequent cell.
CELL_PARTS = 8
#: Trees on cells that are fitted at the same time.
TREES_AT_ONCE = 8


def drawn(rows: DataFrame, by: list[str], label: str, trees: int, rate: float, seed: int) -> DataFrame:
    """Per cell and tree: the sum ``w<t>`` of a Poisson number of draws of every row, and the mean label ``y<t>`` of what was drawn."""
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("y", T.ArrayType(T.DoubleType()))])

    def sums(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in by])
            # rows come in the order of their cells; NaN differs from itself, which only makes more sums of one cell
            first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            draws = rng.poisson(rate, (batch.num_rows, trees)).astype(float)
            w = np.add.reduceat(draws, first)
            draws *= batch.column(label).to_numpy(zero_copy_only=False)[:, None]
            y = np.add.reduceat(draws, first)
            lists = [pa.ListArray.from_arrays(np.arange(0, v.size + 1, trees, dtype=np.int32), v.ravel()) for v in (w, y)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in by], *lists], names=[*by, "w", "y"])

    parts = F.pmod(F.monotonically_increasing_id(), F.lit(CELL_PARTS))
    dealt = rows.select(*by, label).repartition(shuffle_width(rows.sparkSession), *by, parts).sortWithinPartitions(*by)
    total = dealt.mapInArrow(sums, schema).groupBy(*by)
    w, y = ([F.sum(F.get(c, F.lit(t))) for t in range(trees)] for c in "wy")
    return total.agg(*[w[t].alias(f"w{t}") for t in range(trees)], *[F.try_divide(y[t], w[t]).alias(f"y{t}") for t in range(trees)])


def forest_trees(forest: RandomForestRegressor, rows: DataFrame) -> list | None:
    """Trees of a regression forest, each fitted by Spark on cells with draws of its own; None where the rows are better fitted as they are.

    Every row is drawn a Poisson number of times for every tree, as in Spark's forests, and a cell counts as often as its rows were drawn.
    """
    label, features, trees = forest.getLabelCol(), forest.getFeaturesCol(), forest.getNumTrees()
    plain = (trees > 1 and forest.getBootstrap() and forest.getMinInstancesPerNode() == 1 and forest.getMinWeightFractionPerNode() == 0.0
             and not forest.isSet(forest.weightCol))
    if not plain:
        return None
    rows = rows.select(F.col(label).cast("double").alias(label), features)
    total, whole = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label).isNotNull() & F.col(features).isNotNull())).first()
    if total < FOREST_ROWS or whole < total:  # Spark refuses nulls
        return None
    strategy = forest.getFeatureSubsetStrategy()

    def summed(part, by):
        return drawn(part, by, label, trees, forest.getSubsamplingRate(), forest.getSeed())

    with staging(rows.sparkSession):
        # a cell carries two numbers a tree, Spark's row beside them one count a tree
        table = cells(rows, total, forest.getMaxBins(), [], summed, features, least=max(LEAST_ROWS, trees // 4))
        if table is None:
            return None
        table = table.cache()

        def tree(t: int):
            one = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.subsamplingRate: 1.0, forest.labelCol: f"y{t}", forest.weightCol: f"w{t}",
                               forest.seed: forest.getSeed() + t, forest.featureSubsetStrategy: "onethird" if strategy == "auto" else strategy})
            return super(type(forest), one)._fit(table.where(F.col(f"w{t}") > 0)).trees[0]

        try:
            with ThreadPool(TREES_AT_ONCE) as pool:
                return pool.map(inheritable_thread_target(rows.sparkSession)(tree), range(trees))
        finally:
            table.unpersist()


class CellBoostingClassifier(_OnCells, GBTClassifier):
    pass


class CellBoostingRegressor(_OnCells, GBTRegressor):
    pass
