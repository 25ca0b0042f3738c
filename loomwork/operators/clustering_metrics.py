"""Clustering indices from per-cluster moments.

One pass gives, per cluster, the row count, the centre and the within-cluster sum of squares W. With these,
the mean squared distance of a row x to cluster C is ``|x - c|^2 + W / n``, so silhouettes need no pairs of
rows. Silhouettes here use squared Euclidean distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.rank import with_group_position
from loomwork.session import stage

NOISE = -1
# 4 million doubles (32 MB) of cluster centres travel to the tasks at a time; more centres take more rounds.
CENTRE_DOUBLES = 4_000_000


def cluster_summary(df: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """(cluster, n, center, wcss): one row per cluster."""
    s = Summarizer.metrics("mean", "variance").summary(F.col(features))
    per = df.groupBy(F.col(cluster).alias("cluster")).agg(s.alias("s"), F.count(F.lit(1)).alias("n"))
    var = vector_to_array("s.variance")
    return per.select("cluster", "n", F.col("s.mean").alias("center"),
                      (F.aggregate(var, F.lit(0.0), lambda a, v: a + v) * (F.col("n") - 1)).alias("wcss"))


@dataclass
class _Centres:
    ids: np.ndarray
    n: np.ndarray
    w: np.ndarray
    c: np.ndarray


def _centre_chunks(summary: DataFrame) -> Iterator[_Centres]:
    """Cluster table in pieces of bounded size, ordered by cluster."""
    width = len(summary.first()["center"])
    per_chunk = max(1, CENTRE_DOUBLES // max(1, width))
    if summary.count() <= per_chunk:
        pieces = [summary]
    else:
        placed = stage(with_group_position(summary, [], [F.col("cluster")], "rn", "n_clusters"), "centres")
        total = placed.first()["n_clusters"]
        pieces = [placed.where((F.col("rn") > a) & (F.col("rn") <= a + per_chunk)) for a in range(0, total, per_chunk)]
    for piece in pieces:
        rows = piece.orderBy("cluster").select("cluster", "n", "wcss", "center").collect()
        yield _Centres(np.array([r["cluster"] for r in rows]), np.array([r["n"] for r in rows], dtype=float),
                       np.array([r["wcss"] for r in rows]), np.array([r["center"].toArray() for r in rows]))


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by explicit differences (no cancellation for far-off centres)."""
    out = np.empty((len(x), len(c)))
    for j, centre in enumerate(c):
        d = x - centre
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


# Largest distance matrix held at once inside a task (cells).
BLOCK_CELLS = 4_000_000


def _in_blocks(measure, columns: list[str], centres: int, *series: pd.Series) -> pd.DataFrame:
    """Apply ``measure`` to row blocks so that rows x centres stays within ``BLOCK_CELLS``."""
    step, n = max(1, BLOCK_CELLS // max(1, centres)), len(series[0])
    parts = [measure(*[s.iloc[a:a + step] for s in series]) for a in range(0, n, step)]
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in columns})


def _row_measure(k: _Centres):
    def block(x: pd.Series, label: pd.Series) -> pd.DataFrame:
        mine, rows = label.to_numpy(), np.arange(len(x))
        d = _square_distances(np.vstack(x.to_numpy()), k.c)
        at = np.minimum(np.searchsorted(k.ids, mine), len(k.ids) - 1)
        here = k.ids[at] == mine
        own, n, w = d[rows, at], k.n[at], k.w[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(here & (n > 1), (n * own + w) / (n - 1), np.nan)
        mean = d + k.w / k.n
        mean[rows[here], at[here]] = np.inf
        return pd.DataFrame({"own": np.where(here, own, np.nan), "inside": inside, "outside": mean.min(axis=1)})

    @F.pandas_udf("struct<own double, inside double, outside double>")
    def measure(x: pd.Series, label: pd.Series) -> pd.DataFrame:
        return _in_blocks(block, ["own", "inside", "outside"], len(k.ids), x, label)

    return measure


def _centre_measure(k: _Centres):
    """Like ``_row_measure`` for a row that is itself a centre; ``k.w`` holds the densities."""
    def block(x: pd.Series, label: pd.Series, spread: pd.Series) -> pd.DataFrame:
        d = np.sqrt(_square_distances(np.vstack(x.to_numpy()), k.c))
        same = label.to_numpy()[:, None] == k.ids[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (spread.to_numpy()[:, None] + k.w[None, :]) / d
        ratio = np.where(same, -np.inf, np.where(np.isnan(ratio), 0.0, ratio))
        return pd.DataFrame({
            "lo": np.where(same, np.inf, d).min(axis=1), "hi": np.where(same, -np.inf, d).max(axis=1),
            "total": np.where(same, 0.0, d).sum(axis=1), "ratio": ratio.max(axis=1)})

    @F.pandas_udf("struct<lo double, hi double, total double, ratio double>")
    def measure(x: pd.Series, label: pd.Series, spread: pd.Series) -> pd.DataFrame:
        return _in_blocks(block, ["lo", "hi", "total", "ratio"], len(k.ids), x, label, spread)

    return measure


def with_centre_distances(df: DataFrame, summary: DataFrame, features: str = "features",
                          cluster: str = "prediction") -> DataFrame:
    """Add ``own`` (squared distance to the own centre), ``inside`` and ``outside``.

    ``inside`` is the mean squared distance to the other rows of the own cluster (null for a singleton),
    ``outside`` the smallest mean squared distance to another cluster.
    """
    out = df.withColumns({"own": F.lit(None).cast("double"), "inside": F.lit(None).cast("double"),
                          "outside": F.lit(None).cast("double")})
    for k in _centre_chunks(summary):
        measure = _row_measure(k)

        def known(c: Column) -> Column:
            return F.when(~F.isnan(c), c)

        out = out.withColumn("_m", measure(vector_to_array(features), F.col(cluster))).withColumns({
            "own": F.coalesce("own", known(F.col("_m.own"))),
            "inside": F.coalesce("inside", known(F.col("_m.inside"))),
            "outside": F.least("outside", F.col("_m.outside")),
        }).drop("_m")
    return out


def row_silhouettes(df: DataFrame, features: str = "features", cluster: str = "prediction",
                    summary: DataFrame | None = None) -> DataFrame:
    """Add ``silhouette`` to every row; a row alone in its cluster gets 0."""
    summary = stage(cluster_summary(df, features, cluster), "summary") if summary is None else summary
    a, b = F.col("inside"), F.col("outside")
    value = F.when(a.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return with_centre_distances(df, summary, features, cluster).withColumn("silhouette", value)


def ranked_silhouettes(df: DataFrame, keys: list[str], features: str = "features",
                       cluster: str = "prediction") -> DataFrame:
    """Row silhouettes with their position inside the cluster, lowest first."""
    rows = row_silhouettes(df, features, cluster).select(*keys, F.col(cluster).alias("cluster"), "silhouette")
    return with_group_position(rows, ["cluster"], [F.col("silhouette")] + [F.col(k) for k in keys],
                               "position", "cluster_rows")


def spread_indices(summary: DataFrame) -> DataFrame:
    """(num_clusters, rows, inertia, calinski_harabasz) from the cluster table alone."""
    whole = summary.select(F.col("center"), F.col("n").cast("double").alias("w"), "n", "wcss").agg(
        Summarizer.metrics("mean", "variance").summary(F.col("center"), F.col("w")).alias("s"),
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.sum("wcss").alias("inertia"),
        F.sum(F.col("w") * F.col("w")).alias("w2"))
    # weighted variance of the centres times (W - sum(w^2)/W) is the between-cluster sum of squares
    between = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, v: a + v) * (
        F.col("rows") - F.col("w2") / F.col("rows"))
    ch = F.try_divide(between / (F.col("k") - 1), F.nullif(F.col("inertia"), F.lit(0.0)) / (F.col("rows") - F.col("k")))
    return whole.select(F.col("k").alias("num_clusters"), "rows", "inertia",
                        F.when((F.col("k") > 1) & (F.col("rows") > F.col("k")), ch).alias("calinski_harabasz"))


def cluster_density(rows: DataFrame, cluster: str = "prediction") -> DataFrame:
    """(cluster, density): mean Euclidean distance of the rows to their centre."""
    return rows.groupBy(F.col(cluster).alias("cluster")).agg(F.avg(F.sqrt("own")).alias("density"))


def centre_distances(summary: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """Per cluster: nearest, farthest and summed distance to the other centres, and the Davies-Bouldin ratio.

    Centres meet each other inside the tasks, block by block; no pair of centres becomes a row.
    """
    base = summary.select("cluster", "center", "n", "wcss")
    spreads = density if density is not None else summary.select("cluster", F.lit(0.0).alias("density"))
    table = stage(base.join(spreads, "cluster"), "centre_table")
    out = table.select("cluster", "center", "density", F.lit(None).cast("double").alias("nearest"),
                       F.lit(None).cast("double").alias("farthest"), F.lit(0.0).alias("total"),
                       F.lit(None).cast("double").alias("ratio"))
    for k in _centre_chunks(table.select("cluster", "center", "n", F.col("density").alias("wcss"))):
        measure = _centre_measure(k)
        out = out.withColumn("_m", measure(vector_to_array("center"), F.col("cluster"), F.col("density"))).withColumns({
            "nearest": F.least("nearest", "_m.lo"), "farthest": F.greatest("farthest", "_m.hi"),
            "total": F.col("total") + F.col("_m.total"), "ratio": F.greatest("ratio", "_m.ratio")}).drop("_m")
    return out.drop("center", "density")


def inter_cluster_distance(distances: DataFrame) -> DataFrame:
    """Smallest, largest and mean distance between two different centres."""
    k = F.count(F.lit(1))
    return distances.agg(F.min("nearest").alias("min_distance"), F.max("farthest").alias("max_distance"),
                         F.try_divide(F.sum("total"), k * (k - 1)).alias("mean_distance"))


def davies_bouldin(distances: DataFrame) -> DataFrame:
    return distances.agg(F.avg("ratio").alias("davies_bouldin"))


def cluster_sizes(df: DataFrame, cluster: str = "prediction") -> DataFrame:
    """(cluster, n) in cluster order: the scoring summary."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n")).orderBy("cluster")


def size_balance(sizes: DataFrame) -> DataFrame:
    mean = F.avg("n")
    return sizes.agg(F.min("n").alias("min_size"), F.max("n").alias("max_size"), mean.alias("mean_size"),
                     F.stddev_pop("n").alias("std_size"), F.try_divide(F.stddev_pop("n"), mean).alias("balance"))


def cluster_centres(summary: DataFrame) -> DataFrame:
    """(cluster, feature, value): one row per cluster and feature."""
    return summary.select("cluster", F.posexplode(vector_to_array("center")).alias("feature", "value"))


def all_indices(df: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """One row: num_clusters, rows, inertia, calinski_harabasz, davies_bouldin, silhouette, sizes, distances."""
    summary = stage(cluster_summary(df, features, cluster), "summary")
    rows = row_silhouettes(df.select(features, cluster), features, cluster, summary)
    per = stage(rows.groupBy(F.col(cluster).alias("cluster")).agg(
        F.avg(F.sqrt("own")).alias("density"), F.sum("silhouette").alias("s"), F.count(F.lit(1)).alias("n")), "per_cluster")
    distances = stage(centre_distances(summary, per.select("cluster", "density")), "distances")
    parts = [spread_indices(summary), davies_bouldin(distances), inter_cluster_distance(distances), size_balance(per),
             per.agg((F.sum("s") / F.sum("n")).alias("silhouette"))]
    one = [p.select(F.struct("*").alias("s")).scalar() for p in parts]
    frame = df.sparkSession.range(1).select(*[c.alias(f"p{i}") for i, c in enumerate(one)])
    return frame.select(*[f"p{i}.*" for i in range(len(parts))])


def silhouette(df: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    return row_silhouettes(df.select(features, cluster), features, cluster).agg(F.avg("silhouette").alias("silhouette"))


def noise_aware_silhouette(df: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """Silhouette without noise rows; -1 unless there are two clusters of two rows and all values are finite."""
    kept = df.where(F.col(cluster) != NOISE).select(features, cluster)
    sizes = kept.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.max(
        F.exists(vector_to_array(features), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).alias("bad"))
    check = sizes.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"), F.max("bad").alias("bad")).first()
    if check["k"] < 2 or check["smallest"] < 2 or check["bad"]:
        return df.sparkSession.createDataFrame([(-1.0,)], "silhouette double")
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("silhouette")))
    return silhouette(kept, features, cluster).select(F.coalesce(bounded, F.lit(-1.0)).alias("silhouette"))


def compare_datasets(frames: dict[str, DataFrame], features: str = "features", cluster: str = "prediction") -> DataFrame:
    """(dataset, silhouette, rows, num_clusters, best, silhouette_std, total_rows)."""
    parts = []
    for name, df in frames.items():
        parts.append(all_indices(df, features, cluster).select(
            F.lit(name).alias("dataset"), "silhouette", "rows", "num_clusters"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = stage(table, "datasets")
    whole = Window.partitionBy(F.lit(1))  # one row per dataset
    return table.withColumns({
        "best": F.max_by("dataset", F.struct("silhouette", "dataset")).over(whole) == F.col("dataset"),
        "silhouette_std": F.stddev_pop("silhouette").over(whole), "total_rows": F.sum("rows").over(whole)})


def project_2d(df: DataFrame, keys: list[str], features: str = "features", cluster: str = "prediction") -> DataFrame:
    """First two principal components of every row; each component's largest loading is made positive."""
    model = PCA(k=2, inputCol=features, outputCol="_p").fit(df.select(features))
    loads = model.pc.toArray()
    signs = [float(np.sign(loads[np.argmax(np.abs(loads[:, j])), j]) or 1.0) for j in range(2)]
    p = vector_to_array("_p")
    return model.transform(df).select(*keys, F.col(cluster).alias("cluster"), (p[0] * signs[0]).alias("x"),
                                      (p[1] * signs[1]).alias("y"))


def projected_centres(projection: DataFrame) -> DataFrame:
    return projection.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def attach_labels(df: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster labels joined to the input rows by key."""
    return df.join(labels.select(*keys, F.col("prediction").alias("cluster")), keys)
