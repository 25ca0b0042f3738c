"""Synthetic minority rows between a row and one of its nearest neighbours."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.columns import key_bucket
from loomwork.operators.spatial import nearest_neighbours, numbered
from loomwork.operators.split import oversample_plan
from loomwork.session import stage, with_row

NEIGHBOURS = 5


def class_neighbours(df: DataFrame, features: list[str], keys: list[str], k: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """Numbered rows and their exact k nearest rows by Euclidean distance."""
    rows = stage(numbered(df, keys), "minority")
    points = rows.select("id", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    return rows, nearest_neighbours(points, len(features), k)


def synthetic_rows(df: DataFrame, features: list[str], keys: list[str], needed: int, k: int = NEIGHBOURS,
                   seed: int = 42, key_tops: dict[str, int] | None = None) -> DataFrame:
    """``needed`` new rows: base + alpha * (neighbour - base); integer columns are rounded.

    Base row, neighbour and alpha of the j-th row come from the hash of j, so the result does not depend on
    the partitioning. Columns that are neither features nor keys are copied from the base row; key columns
    of text type get ``#<j>`` appended, whole-number keys continue after the largest of ``key_tops``, so keys stay unique.
    """
    rows, near = class_neighbours(df, features, keys, k)
    near = stage(near.select("id", F.col("rank"), "neighbour"), "neighbours")
    m = rows.count()
    have = min(k, m - 1)
    j = F.col("j")

    def draw(tag: str) -> Column:
        return key_bucket([j, F.lit(tag)], seed)

    draws = df.sparkSession.range(1, needed + 1).withColumnRenamed("id", "j").select(
        "j", (F.floor(draw("base") * m) + 1).alias("id"), (F.floor(draw("neighbour") * have) + 1).cast("int").alias("rank"),
        draw("alpha").alias("alpha"))
    other = rows.select(F.col("id").alias("neighbour"), *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    mixed = draws.join(near, ["id", "rank"]).join(rows, "id").join(other, "neighbour")

    def value(c: str) -> Column:
        t = df.schema[c].dataType
        if c in features:
            v = F.col(c).cast("double") + F.col("alpha") * (F.col(f"_{c}") - F.col(c).cast("double"))
            return (F.rint(v) if isinstance(t, T.IntegralType) else v).cast(t).alias(c)
        if c in keys and isinstance(t, T.StringType):
            return F.concat(F.col(c), F.lit("#"), j.cast("string")).alias(c)
        if c in keys and isinstance(t, T.IntegralType):
            return (F.lit((key_tops or {}).get(c, 0)) + j).cast(t).alias(c)
        return F.col(c)

    return mixed.select(*[value(c) for c in df.columns])


def smote(df: DataFrame, target: str, features: list[str], keys: list[str], max_ratio: float = 0.3,
          k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """The input plus synthetic rows so that every small class reaches ``max_ratio`` of the largest.

    A class with fewer rows than ``k`` uses the neighbours it has; a single row is repeated. Copies get keys of their own.
    """
    whole = [c for c in keys if isinstance(df.schema[c].dataType, T.IntegralType)]
    tops = df.agg(*[F.max(c).alias(c) for c in whole]).first().asDict() if whole else {}
    out = df
    for r in oversample_plan(df, target, max_ratio).where("extra > 0").collect():
        part = df.where(F.col(target).cast("string") == r["class"])
        if r["count"] > 1:
            out = out.unionByName(synthetic_rows(part, features, keys, r["extra"], min(k, r["count"] - 1), seed, tops))
        else:
            numbers = df.sparkSession.range(1, r["extra"] + 1).withColumnRenamed("id", "_j")
            single = with_row(numbers, part)
            out = out.unionByName(single.select(*[_copied_key(df, c, keys, tops) for c in df.columns]))
        tops = {c: v + r["extra"] for c, v in tops.items()}
    return out


def smote_vectors(df: DataFrame, target: str, vector: str, keys: list[str], width: int, max_ratio: float = 0.3,
                  k: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """``smote`` on a vector column of ``width`` features; returns keys, target and vector."""
    names = [f"_x{i}" for i in range(width)]
    x = vector_to_array(vector)
    flat = stage(df.select(*keys, target, *[x[i].alias(n) for i, n in enumerate(names)]), "coordinates")
    return smote(flat, target, names, keys, max_ratio, k, seed).select(*keys, target, array_to_vector(F.array(*names)).alias(vector))


def _copied_key(df: DataFrame, c: str, keys: list[str], tops: dict[str, int]) -> Column:
    t = df.schema[c].dataType
    if c in keys and isinstance(t, T.StringType):
        return F.concat(F.col(c), F.lit("#"), F.col("_j").cast("string")).alias(c)
    return (F.lit(tops[c]) + F.col("_j")).cast(t).alias(c) if c in tops else F.col(c)
