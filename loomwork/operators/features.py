"""Feature ranking and selection."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import correlation
from loomwork.operators import cells as ce
from loomwork.session import spread, staging

# Variance floor and limits of the selection rules.
VARIANCE_FLOOR = 1e-6
CHUNK, KEEP_PER_CHUNK = 100, 30
FALLBACK_TOP = 10
SAVED_TOP, REPORT_TOP = 30, 10


def feature_variances(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance): sample variance of every feature from one aggregate."""
    return df.agg(*[F.var_samp(F.col(f).cast("double")).alias(f) for f in features]).unpivot(
        [], features, "feature", "variance")


def target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, correlation): absolute Pearson correlation with the target, one aggregate for all features."""
    y = F.col(target).cast("double")
    return df.agg(*[F.abs(correlation(F.col(f), y)).alias(f) for f in features]).unpivot(
        [], features, "feature", "correlation")


def variance_importance(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance, rank): share of each feature in the total variance. One row per feature."""
    shares = feature_variances(df, features)
    total = shares.agg(F.sum("variance").alias("t")).scalar()
    order = Window.orderBy(F.col("importance").desc(), "feature")
    return shares.select("feature", F.coalesce(F.try_divide(F.col("variance"), total), F.lit(0.0)).alias("importance")
                         ).withColumn("rank", F.row_number().over(order))


def statistical_filter(df: DataFrame, features: list[str], target: str, keep: int,
                       floor: float = VARIANCE_FLOOR) -> DataFrame:
    """The ``keep`` features with variance above ``floor`` that correlate most with the target.

    All features are judged; variance and correlation come from the same pass over the rows.
    """
    y = F.col(target).cast("double")
    both = df.agg(*[
        F.struct(F.var_samp(F.col(f).cast("double")).alias("v"), F.abs(correlation(F.col(f), y)).alias("c")).alias(f)
        for f in features
    ]).unpivot([], features, "feature", "s")
    strength = F.coalesce(F.nanvl("s.c", F.lit(0.0)), F.lit(0.0))
    return both.where(F.col("s.v") > floor).select("feature", F.col("s.v").alias("variance"), strength.alias("correlation")
        ).orderBy(F.col("correlation").desc(), "feature").limit(keep)


def top_by_importance(importances: DataFrame, max_features: int, threshold: float = 0.01,
                      fallback: int = FALLBACK_TOP) -> DataFrame:
    """Features at or above the threshold, at most ``max_features``; if none qualifies, the top few."""
    order = Window.orderBy(F.col("importance").desc(), "feature")  # one row per feature
    ranked = importances.withColumn("rank", F.row_number().over(order)).withColumn(
        "_any", F.max(F.col("importance") >= threshold).over(Window.partitionBy(F.lit(1))))
    keep = F.when(F.col("_any"), (F.col("importance") >= threshold) & (F.col("rank") <= max_features)).otherwise(
        F.col("rank") <= min(fallback, max_features))
    return ranked.where(keep).select("feature", "importance", "rank")


def report_top(importances: DataFrame, top: int = REPORT_TOP) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(top)


#: Rows that are put in order inside one task at the edge of a sample.
EDGE_ROWS = 65_536


def smallest(df: DataFrame, value: Column, n: int) -> DataFrame:
    """The ``n`` rows of the lowest ``value`` (bigint), as an ordered limit would give them, without ordering the table.

    Rows are counted by the upper 16 bits of the value, then by 16 more inside the one bucket that the sample ends in, until
    that bucket is small or holds one value only. All lower rows are taken where they lie; only the rest of the sample comes
    from an ordered limit over the last bucket. At most 65,536 counts reach the driver a step.
    """
    rows = df.withColumn("_v", value)
    edge, missing, shift = F.lit(True), n, 64
    below = F.lit(False)
    while shift > 0 and missing > 0:
        shift -= 16
        part = F.shiftright("_v", shift)
        counts = sorted((r[0], r[1]) for r in rows.where(edge).groupBy(part.alias("part")).count().collect())
        for at, size in counts:
            if size > missing:
                below, edge = below | (edge & (part < at)), edge & (part == at)
                break
            missing -= size
        else:
            return rows.where(below | edge).drop("_v")
        if size <= EDGE_ROWS:
            break
    taken = rows.where(below)
    return (taken.unionByName(rows.where(edge).orderBy("_v").limit(missing)) if missing > 0 else taken).drop("_v")


def fit_sample(df: DataFrame, max_fit_rows: int | None, seed: int = 42) -> DataFrame:
    """All rows, or, where a bound is given, that many of them in the order of a hash of the whole row."""
    if max_fit_rows is None:
        return df
    return smallest(df, F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), max_fit_rows)


def named_importances(model, features: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted tree model: one row per feature, zipped with the column names."""
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def _forest(kind: str, **params):
    cls = RandomForestClassifier if kind == "classification" else RandomForestRegressor
    return cls(featuresCol="features", **{"seed": 42, **params})


#: Trees on cells that are fitted at the same time.
TREES_AT_ONCE = 4


def _poisson(u: Column, rate: float) -> Column:
    """The Poisson number that belongs to ``u``, which is even in [0, 1)."""
    k, chance = 0, math.exp(-rate)
    below, draw = chance, F.when(u < chance, 0)
    while below < 1 - 1e-12:
        k, chance = k + 1, chance * rate / (k + 1)
        below += chance
        draw = draw.when(u < below, k)
    return draw.otherwise(k + 1)


def _importances_from_cells(data: DataFrame, total: int, kind: str, numTrees: int, subsamplingRate: float = 1.0,  # noqa: N803
                            featureSubsetStrategy: str = "auto", **params) -> np.ndarray | None:  # noqa: N803
    """Importances of a forest whose trees read cells; None if the rows make too many.

    Every row is drawn a Poisson number of times for every tree, as in Spark's forests; a cell's weight in a tree is the sum of
    these draws, so each tree is a single one fitted by Spark on weights of its own.
    """
    strategy = {"classification": "sqrt", "regression": "onethird"}[kind] if featureSubsetStrategy == "auto" else featureSubsetStrategy
    each = range(numTrees)
    keys = ["label"] if kind == "classification" else []

    def summed(rows: DataFrame, by: list[str]) -> DataFrame:
        drawn = rows.select("*", F.explode(F.array(*[F.lit(t) for t in each])).alias("tree")).withColumn("u", F.rand(42))
        drawn = drawn.withColumn("draws", _poisson(F.col("u"), subsamplingRate)).where("draws > 0")
        sums = drawn.groupBy(*by, "tree").agg(F.sum("draws").cast("double").alias("w"), *[] if keys else [F.sum(F.col("draws") * F.col("label")).alias("y")])
        mean = [] if keys else [F.max(F.when(F.col("tree") == t, F.col("y") / F.col("w"))).alias(f"y{t}") for t in each]
        return sums.groupBy(*by).agg(*[F.max(F.when(F.col("tree") == t, F.col("w"))).alias(f"w{t}") for t in each], *mean)

    with staging(data.sparkSession):
        table = ce.cells(data, total, params.get("maxBins", 32), keys, summed)
        if table is None:
            return None
        table = table.cache()

        def share(t: int) -> np.ndarray:
            tree = _forest(kind, numTrees=1, bootstrap=False, featureSubsetStrategy=strategy, labelCol="label" if kind == "classification" else f"y{t}",
                           weightCol=f"w{t}", **{**params, "seed": 42 + t})
            return tree.fit(table.where(F.col(f"w{t}") > 0)).featureImportances.toArray()

        try:
            with ThreadPool(TREES_AT_ONCE) as pool:
                shares = sum(pool.map(inheritable_thread_target(data.sparkSession)(share), each))
        finally:
            table.unpersist()
    return shares / shares.sum() if shares.sum() > 0 else shares


def forest_importances(df: DataFrame, features: list[str], target: str, kind: str = "classification",
                       adaptive: bool = False, max_bins: int = 100, max_fit_rows: int | None = None) -> DataFrame:
    """Random-forest importances from all rows, or for a classifier from at most ``max_fit_rows``.

    The adaptive form sizes trees by the number of features. From a million rows on, trees are fitted on cells of rows where these
    are few (``cells``).
    """
    if max_fit_rows is not None and kind != "classification":
        raise ValueError("only a classifier may be fitted on a bounded sample")
    if adaptive:  # fixed values: tree counts and depths
        params = dict(numTrees=min(10, max(5, 50 // max(1, len(features) // 50))),
                      maxDepth=min(10, max(3, 20 - len(features) // 20)),
                      subsamplingRate=0.8, featureSubsetStrategy="sqrt")
    else:
        params = dict(numTrees=10, maxDepth=5, maxBins=max_bins)
    slim = fit_sample(df.select(target, *features), max_fit_rows).select(F.col(target).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(slim)
    data = data.select("label", "features")
    total, labelled = data.agg(F.count(F.lit(1)), F.count("label")).first()
    if total >= ce.CELL_ROWS and labelled == total:
        shares = _importances_from_cells(data, total, kind, **params)
        if shares is not None:
            return df.sparkSession.createDataFrame(list(zip(features, shares.tolist())), "feature string, importance double")
    model = _forest(kind, labelCol="label", **params).fit(spread(data))
    return named_importances(model, features, df.sparkSession)


def select_features(df: DataFrame, features: list[str], target: str, max_features: int,
                    kind: str = "classification", threshold: float = 0.01, max_fit_rows: int | None = None) -> list[str]:
    """Random-forest selection with importance threshold, cap and fallback."""
    picked = top_by_importance(forest_importances(df, features, target, kind, max_fit_rows=max_fit_rows), max_features, threshold)
    return [r["feature"] for r in picked.orderBy("rank").collect()]


def sequential_selection(df: DataFrame, features: list[str], target: str, max_features: int,
                         kind: str = "classification", chunk: int = CHUNK, keep: int = KEEP_PER_CHUNK) -> list[str]:
    """Wide tables: rank chunks of columns, keep the best of each chunk, repeat until one chunk is left."""
    while len(features) > max(chunk, max_features):
        kept = []
        for start in range(0, len(features), chunk):
            part = features[start:start + chunk]
            best = report_top(forest_importances(df, part, target, kind, adaptive=True), min(keep, len(part)))
            kept += [r["feature"] for r in best.collect()]
        if len(kept) >= len(features):
            break
        features = kept
    best = report_top(forest_importances(df, features, target, kind, adaptive=True), max_features)
    return [r["feature"] for r in best.collect()]
