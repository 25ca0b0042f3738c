"""Exact order statistics without a single-task window.

A global window puts the whole table in one task. Here rows are range-partitioned on the full order, each
partition is sorted, and the position of a row is its place inside its partition plus the number of rows in
earlier partitions. The table of earlier counts has one row per shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import join_small, shuffle_width, stage

_ROW_BITS = 33


def _group_window(groups: list[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))


def _before(groups: list[str]):
    """Earlier partitions of the same group. Rows here are (group, partition) pairs, not table rows."""
    return _group_window(groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def with_group_position(df: DataFrame, groups: list[str], order: list[Column], name: str = "rn",
                        total: str = "n", drop: list[str] | None = None) -> DataFrame:
    """Add the 1-based position of every row inside its group, in the given total order, and the group size.

    A group may span many partitions: the share of each (group, partition) pair is counted and summed up. Columns
    in ``drop`` only order the rows: they are sorted by, but not written.
    """
    keys = [F.col(g) for g in groups] + order
    placed = (
        df.repartitionByRange(shuffle_width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .drop(*[c for c in drop or [] if c not in groups])
    )
    placed = stage(placed, "position").withColumns({
        "_part": F.shiftright("_id", _ROW_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_id")
    pieces = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    pieces = pieces.select(*groups, "_part", "_from", F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)).alias("_earlier"),
                           F.sum("_n").over(_group_window(groups)).alias(total))
    return (
        join_small(placed, pieces, [*groups, "_part"])
        .withColumn(name, F.col("_earlier") + F.col("_at") - F.col("_from") + 1)
        .drop("_part", "_at", "_from", "_earlier")
    )


def with_position(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Add the 1-based position of every row in the given total order."""
    return with_group_position(df, [], order, name, "_total").drop("_total")


def ntile_of(position: Column, total: Column, tiles: int) -> Column:
    """The tile that ``ntile(tiles)`` gives to a row at ``position`` among ``total`` rows."""
    q = F.floor(total / F.lit(tiles))
    r = total % F.lit(tiles)
    big = r * (q + 1)
    in_big = F.ceil(position / (q + 1))
    in_rest = r + F.ceil((position - big) / F.greatest(q, F.lit(1)))
    return F.when(position <= big, in_big).otherwise(in_rest).cast("int")


def with_ntile(df: DataFrame, groups: list[str], order: list[Column], tiles: int = 10,
               name: str = "decile", drop: list[str] | None = None) -> DataFrame:
    placed = with_group_position(df, groups, order, name="_rn", total="_total", drop=drop)
    return placed.withColumn(name, ntile_of(F.col("_rn"), F.col("_total"), tiles)).drop("_rn", "_total")


def _in_ranges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Range-partitioned copy with the partition number as a column."""
    placed = df.repartitionByRange(shuffle_width(df.sparkSession), *keys).withColumn("_part", F.spark_partition_id())
    return stage(placed, "ranges")


def running_sums(df: DataFrame, groups: list[str], order: list[Column], sums: list[str], suffix: str = "_cum",
                 total: str = "_total") -> DataFrame:
    """Inclusive running totals inside each group (``<name>_cum``) and group totals (``<name>_total``).

    Rows should be pre-aggregated to distinct (group, order) keys.
    """
    placed = _in_ranges(df, [F.col(g) for g in groups] + order)
    pieces = placed.groupBy(*groups, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    pieces = pieces.select(
        *groups, "_part", *[F.coalesce(F.sum(s).over(_before(groups)), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(_group_window(groups)).alias(f"{s}{total}") for s in sums])
    inside = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_small(placed, pieces, [*groups, "_part"])
    return out.withColumns({f"{s}{suffix}": F.sum(s).over(inside) + F.col(f"_before_{s}") for s in sums}).drop(
        "_part", *[f"_before_{s}" for s in sums])


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group (one output column per named probability).

    Distinct values are counted and range-partitioned; the counts per (group, partition) tell which partitions
    hold the wanted ranks, and only those are walked through. A group of any size is never held in one task.
    Null values are ignored.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = _in_ranges(counted, [F.col(g) for g in groups] + [F.col(value)])
    pieces = placed.groupBy(*groups, "_part").agg(F.sum("_c").alias("_s"))
    pieces = pieces.withColumn("_first", F.coalesce(F.sum("_s").over(_before(groups)), F.lit(0))).withColumn(
        "_size", F.sum("_s").over(_group_window(groups)))

    def touched(w: Column, first: Column, last: Column) -> Column:
        low, high = F.floor(w["at"]), F.ceil(w["at"])
        return ((low >= first) & (low <= last)) | ((high >= first) & (high <= last))

    wanted = F.array(*[F.struct(F.lit(n).alias("q"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("at"))
                       for n, p in probabilities.items()])
    last = F.col("_first") + F.col("_s") - 1
    chosen = pieces.withColumn("_w", wanted).select(
        *groups, "_part", "_first", F.filter("_w", lambda w: touched(w, F.col("_first"), last)).alias("_w")).where(F.size("_w") > 0)
    inside = Window.partitionBy(*groups, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    walked = join_small(placed, chosen, [*groups, "_part"]).withColumn("_upto", F.sum("_c").over(inside) + F.col("_first"))
    hits = walked.select(*groups, value, F.explode(F.filter(
        "_w", lambda w: touched(w, F.col("_upto") - F.col("_c"), F.col("_upto") - 1))).alias("_hit"))
    # at most two rows per group and quantile remain; the lower value has weight 1 - fraction
    cols = []
    for n in probabilities:
        v = F.when(F.col("_hit.q") == n, F.col(value))
        at = F.max(F.when(F.col("_hit.q") == n, F.col("_hit.at")))
        cols.append((F.min(v) + (F.max(v) - F.min(v)) * (at - F.floor(at))).alias(n))
    return hits.groupBy(*groups).agg(*cols)
