"""Splitting and over-sampling that do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import key_bucket
from loomwork.operators.profile import class_distribution
from loomwork.session import broadcast_if_small, stage

# Fixed value: fewer rows than this ask for cross-validation, unless the caller says otherwise.
SMALL_FOR_SPLIT = 5_000
#: Copies made by one step of ``repeat_rows``.
_FAN = 4096


def _cut(bucket: Column, shares: dict[str, float]) -> Column:
    total, upto, out = sum(shares.values()), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name] / total
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def assign_split(df: DataFrame, keys: list[str], shares: dict[str, float], seed: int = 42,
                 name: str = "dataset") -> DataFrame:
    """Tag every row with train / valid / test by the hash of its key; shares are normalised."""
    return df.withColumn(name, _cut(key_bucket([F.col(k) for k in keys], seed), shares))


def split_frames(df: DataFrame, keys: list[str], shares: dict[str, float], seed: int = 42) -> dict[str, DataFrame]:
    tagged = assign_split(df, keys, shares, seed, "_split")
    return {name: tagged.where(F.col("_split") == name).drop("_split") for name in shares}


def random_split(df: DataFrame, shares: dict[str, float], seed: int = 12345) -> dict[str, DataFrame]:
    """Spark's own seeded split: rows depend on the partitioning of the input."""
    parts = df.randomSplit([float(v) for v in shares.values()], seed)
    return dict(zip(shares, parts))


def assign_fold(df: DataFrame, keys: list[str], folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    bucket = key_bucket([F.col(k) for k in keys], seed)
    return df.withColumn(name, F.floor(bucket * folds).cast("int"))


def use_cross_validation(rows: Column, mode: str, has_holdout: bool, small: int = SMALL_FOR_SPLIT) -> Column:
    """always / never / auto; auto means no hold-out given or few rows."""
    if mode == "always":
        return F.lit(True)
    if mode == "never":
        return F.lit(False)
    return F.lit(not has_holdout) | (rows < small)


def oversample_plan(df: DataFrame, target: str, max_ratio: float = 0.3) -> DataFrame:
    """(class, count, wanted, extra): rows to add so that a small class reaches ``max_ratio`` of the largest."""
    dist = class_distribution(df, target)
    goal = F.floor(dist.agg(F.max("count").alias("m")).scalar() * F.lit(float(max_ratio)))
    small = (F.col("share") < max_ratio) & (F.col("count") < F.col("wanted"))
    return dist.withColumn("wanted", goal).select(
        "class", "count", "wanted", F.when(small, F.col("wanted") - F.col("count")).otherwise(0).alias("extra"))


def oversample(df: DataFrame, target: str, keys: list[str], max_ratio: float = 0.3, seed: int = 12345,
               copy: str | None = None) -> DataFrame:
    """Repeat rows of small classes so that their expected size is the wanted one.

    Every row is repeated ``floor(extra / count)`` times and once more when its key hash falls below the
    fraction: the same rows whatever the partitioning, and no row of any class is lost.
    """
    plan = stage(oversample_plan(df, target, max_ratio).where("extra > 0").select(
        F.col("class").alias("_class"), (F.col("extra") / F.col("count")).alias("_rate")), "plan")
    tagged = df.join(broadcast_if_small(plan, 100_000), F.col(target).cast("string") == F.col("_class"), "left")
    rate = F.coalesce("_rate", F.lit(0.0))
    bucket = key_bucket([F.col(k) for k in keys], seed)
    extra = F.floor(rate) + F.when(bucket < rate - F.floor(rate), 1).otherwise(0)
    name = copy or "_copy"
    out = repeat_rows(tagged.withColumn("_extra", extra), "_extra", name).drop("_class", "_rate")
    return out if copy else out.drop(name)


def repeat_rows(df: DataFrame, extra: str, name: str) -> DataFrame:
    """Every row with its copies 1 to ``extra`` beside the original, numbered from 0 in ``name``; ``extra`` is dropped.

    Copies come in three steps of at most 4096 each, and the first two are dealt out anew, so the copies of one row fill
    many tasks and no row ever carries a long list.
    """
    wide = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    e = F.col(extra).cast("bigint")
    steps = df.withColumn("_high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"cast({extra} as bigint) div {_FAN * _FAN}"))))
    left = F.least(e - F.col("_high") * _FAN * _FAN, F.lit(_FAN * _FAN - 1).cast("bigint"))
    steps = steps.withColumn("_left", left).withColumn("_mid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"_left div {_FAN}"))))
    many = steps.where(F.col(extra) >= _FAN).repartition(int(wide))
    steps = steps.where(F.col(extra) < _FAN).unionByName(many)
    low = F.least(F.col("_left") - F.col("_mid") * _FAN, F.lit(_FAN - 1).cast("bigint"))
    out = steps.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("bigint"), low)))
    number = F.col("_high") * _FAN * _FAN + F.col("_mid") * _FAN + F.col("_low")
    return out.withColumn("_number", number).drop("_high", "_left", "_mid", "_low", extra).withColumnRenamed("_number", name)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out
