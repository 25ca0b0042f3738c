"""Cluster profiles: per-cluster statistics of numeric and categorical variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.rank import exact_quantiles

# Categories listed by name, and the shares / differences worth reporting (percent).
TOP_CATEGORIES = 3
OTHER = "Other"
DOMINATED_ABOVE = 60.0
MOSTLY_ABOVE = 70.0
NOTABLE_DIFFERENCE = 20.0


def _numeric_long(df: DataFrame, variables: list[str], cluster: str) -> DataFrame:
    return df.select(F.col(cluster).alias("cluster"), *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(
        ["cluster"], variables, "variable", "value")


def _numeric_stats(df: DataFrame, variables: list[str], cluster: str) -> DataFrame:
    stats = _numeric_long(df, variables, cluster).groupBy("variable", "cluster").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.count(F.lit(1)).alias("count"), F.sum("value").alias("_sum"),
        F.count("value").alias("_known"))
    whole = Window.partitionBy("variable")  # one row per cluster
    overall = F.sum("_sum").over(whole) / F.sum("_known").over(whole)
    return stats.withColumn("overall_mean", overall).withColumn(
        "pct_diff", F.try_divide(F.col("mean") - F.col("overall_mean"), F.col("overall_mean")) * 100).drop("_sum", "_known")


def numeric_profile(df: DataFrame, variables: list[str], cluster: str = "cluster") -> DataFrame:
    """(variable, cluster, mean, std, median, min, max, count, pct_diff): difference to the overall mean in percent."""
    medians = exact_quantiles(_numeric_long(df, variables, cluster), ["variable", "cluster"], "value", {"median": 0.5})
    return _numeric_stats(df, variables, cluster).join(medians, ["variable", "cluster"], "left").select(
        "variable", "cluster", "mean", "std", "median", "min", "max", "count", "pct_diff")


def _category_counts(df: DataFrame, variables: list[str], cluster: str) -> DataFrame:
    long = df.select(F.col(cluster).alias("cluster"), *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(
        ["cluster"], variables, "variable", "category")
    return long.groupBy("variable", "cluster", "category").agg(F.count(F.lit(1)).alias("n"))


def top_categories(counts: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """Most frequent categories of every variable, ties by name."""
    overall = counts.where(F.col("category").isNotNull()).groupBy("variable", "category").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("variable").orderBy(F.col("n").desc(), "category")
    return overall.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def categorical_profile(df: DataFrame, variables: list[str], cluster: str = "cluster",
                        top: int = TOP_CATEGORIES) -> DataFrame:
    """(variable, cluster, category, count, percentage, is_top_3) for the top categories and the rest."""
    counts = _category_counts(df, variables, cluster)
    best = top_categories(counts, top)
    named = counts.join(best.select("variable", "category", F.lit(True).alias("_top")), ["variable", "category"], "left")
    slot = F.when(F.col("_top"), F.col("category")).otherwise(OTHER)
    is_top = F.coalesce("_top", F.lit(False))
    # at most ``top`` + 1 entries per variable and cluster
    slots = named.groupBy("variable", "cluster", is_top.alias("is_top"), slot.alias("slot")).agg(F.sum("n").alias("n"))
    entry = F.struct(F.struct("is_top", "slot"), "n")
    packed = slots.groupBy("variable", "cluster").agg(
        F.map_from_entries(F.collect_list(entry)).alias("counts"), F.sum("n").alias("size"))
    listed = best.groupBy("variable").agg(F.collect_list(F.struct(F.lit(True).alias("is_top"), F.col("category").alias("slot"))).alias("tops"))
    other = F.array(F.struct(F.lit(False).alias("is_top"), F.lit(OTHER).alias("slot")))
    rows = packed.join(listed, "variable", "left").select(
        "variable", "cluster", "size", "counts",
        F.explode(F.concat(F.coalesce("tops", F.array().cast("array<struct<is_top:boolean,slot:string>>")), other)).alias("k"))
    n = F.coalesce(F.try_element_at("counts", F.col("k")), F.lit(0))
    return rows.select("variable", "cluster", F.col("k.slot").alias("category"), n.alias("count"),
                       (n / F.col("size") * 100).alias("percentage"), F.col("k.is_top").alias("is_top_3"))


def dominant_category(df: DataFrame, variables: list[str], cluster: str = "cluster") -> DataFrame:
    """(variable, cluster, category, percentage, kind): the most common category of each cluster."""
    counts = _category_counts(df, variables, cluster).where(F.col("category").isNotNull())
    known = counts.groupBy("variable", "cluster").agg(F.sum("n").alias("known"))
    order = Window.partitionBy("variable", "cluster").orderBy(F.col("n").desc(), "category")
    first = counts.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    pct = F.col("n") / F.col("known") * 100
    return first.join(known, ["variable", "cluster"]).select(
        "variable", "cluster", "category", pct.alias("percentage"),
        F.when(pct > DOMINATED_ABOVE, "dominated").otherwise("most common").alias("kind"))


def distinctive_variables(df: DataFrame, variables: list[str], cluster: str = "cluster") -> DataFrame:
    """(variable, score): population deviation of the cluster means over their mean; needs two clusters."""
    means = _numeric_stats(df, variables, cluster)
    return means.groupBy("variable").agg(
        F.coalesce(F.try_divide(F.stddev_pop("mean"), F.avg("mean")), F.lit(0.0)).alias("score"),
        F.count("mean").alias("_k")).where(F.col("_k") > 1).drop("_k")


def cluster_insights(df: DataFrame, numeric: list[str], categorical: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, kind, insight): size, notable numeric differences and dominant categories, as sentences."""
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / sizes.agg(F.sum("n")).scalar() * 100
    parts = [sizes.select("cluster", F.lit("size").alias("kind"),
                          F.format_string("Size: %d samples (%.1f%% of data)", "n", share).alias("insight"))]
    if numeric:
        d = F.col("pct_diff")
        word = F.when(d > 0, "higher").otherwise("lower")
        parts.append(_numeric_stats(df, numeric, cluster).where(F.abs(d) > NOTABLE_DIFFERENCE).select(
            "cluster", F.lit("numeric").alias("kind"),
            F.format_string("%s: %.0f%% %s than average", "variable", F.abs(d), word).alias("insight")))
    if categorical:
        parts.append(dominant_category(df, categorical, cluster).where(F.col("percentage") > MOSTLY_ABOVE).select(
            "cluster", F.lit("categorical").alias("kind"),
            F.format_string("%s: Mostly %s (%.0f%%)", "variable", "category", "percentage").alias("insight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def category_pivot(profile: DataFrame, clusters: list) -> DataFrame:
    """Categories as rows, clusters as columns ``cluster_<id>``, percentages, 0 where absent."""
    wide = profile.groupBy("variable", "category").pivot("cluster", clusters).agg(F.sum("percentage"))
    return wide.na.fill(0.0).toDF("variable", "category", *[f"cluster_{c}" for c in clusters])
