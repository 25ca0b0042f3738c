"""Exact Shapley values of tree models against a whole background table.

A tree is the list of its leaves, a leaf a value and one condition per feature on its path. Whether a mixture of an
explained row and a background row reaches a leaf depends only on which of the leaf's conditions either of them meets: a
bit mask each. So the background is counted once per (leaf, mask), the contributions of every pair of masks follow from two
factorials, and a row looks its own masks up. Rows never meet background rows one by one, and nothing is sampled; the size of
all tables between the two passes follows the model, not the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.boosting import BoostedTrees
from loomwork.session import stage, staging


@dataclass(frozen=True)
class Condition:
    """``low < x <= high``, or membership in ``categories``; ``missing`` says whether NaN meets it."""

    low: float = -math.inf
    high: float = math.inf
    missing: bool = False
    categories: frozenset | None = None

    def both(self, other: Condition) -> Condition:
        sets = [c for c in (self.categories, other.categories) if c is not None]
        return Condition(max(self.low, other.low), min(self.high, other.high), self.missing and other.missing,
                         frozenset.intersection(*sets) if sets else None)

    def holds(self, x: np.ndarray) -> np.ndarray:
        inside = (x > self.low) & (x <= self.high)
        if self.categories is not None:
            inside &= np.isin(x, list(self.categories))
        return np.where(np.isnan(x), self.missing, inside)


@dataclass(frozen=True)
class Leaf:
    """Value of a leaf and its condition on every feature (by place) that its path asks for."""

    value: float
    path: tuple[tuple[int, Condition], ...]

    @classmethod
    def of(cls, value: float, path: list[tuple[int, Condition]]) -> Leaf:
        merged: dict[int, Condition] = {}
        for f, c in path:
            merged[f] = merged[f].both(c) if f in merged else c
        return cls(value, tuple(sorted(merged.items(), key=lambda e: e[0])))


def _walk(node, path: list, value, weight: float) -> Iterator[Leaf]:
    """Leaves of a Spark tree; a missing value fails every comparison and goes right."""
    if node.getClass().getSimpleName() == "LeafNode":
        yield Leaf.of(weight * value(node), path)
        return
    split = node.split()
    f = split.featureIndex()
    if split.getClass().getSimpleName() == "CategoricalSplit":
        sides = [Condition(categories=frozenset(side)) for side in (split.leftCategories(), split.rightCategories())]
    else:
        t = split.threshold()
        sides = [Condition(high=t), Condition(low=t, missing=True)]
    for child, c in zip((node.leftChild(), node.rightChild()), sides):
        yield from _walk(child, [*path, (f, c)], value, weight)


def _share(label: int):
    def value(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[label] / sum(stats)

    return value


def model_leaves(model: Model, label: int = 1) -> list[Leaf]:
    """Leaves whose values add up to the model's score, up to a constant: the prediction of a regression tree, forest or boosted
    model, the probability of class ``label`` of a tree or forest, the margin of a boosted classifier (for several
    classes, that of ``label``). A pipeline stands for its last stage."""
    if isinstance(model, PipelineModel):
        return model_leaves(model.stages[-1], label)
    if isinstance(model, BoostedTrees):
        wanted = label if model.objective == "softmax" else 0
        return [leaf for t in model.trees if t.label == wanted for leaf in _boosted(t, 0, [])]
    name = type(model).__name__
    value = _share(label) if name in ("DecisionTreeClassificationModel", "RandomForestClassificationModel") else lambda node: node.prediction()
    if hasattr(model, "trees"):
        weights = model.treeWeights if name.startswith("GBT") else [1 / len(model.trees)] * len(model.trees)
        return [leaf for t, w in zip(model.trees, weights) for leaf in _walk(t._java_obj.rootNode(), [], value, w)]
    if name.startswith("DecisionTree"):
        return list(_walk(model._java_obj.rootNode(), [], value, 1.0))
    raise TypeError(f"{name} is not a tree model")


def _boosted(t, node: int, path: list) -> Iterator[Leaf]:
    f = t.feature[node]
    if f < 0:
        yield Leaf.of(t.value[node], path)
        return
    lost = t.missing_left[node]
    yield from _boosted(t, t.left[node], [*path, (f, Condition(high=t.threshold[node], missing=lost))])
    yield from _boosted(t, t.right[node], [*path, (f, Condition(low=t.threshold[node], missing=not lost))])


def _masks(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(x), np.int64)
    for bit, (f, c) in enumerate(leaf.path):
        mask |= c.holds(x[:, f]).astype(np.int64) << bit
    return mask


def _values(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _counted(leaves: list[Leaf], width: int):
    """Rows -> (leaf, mask, n) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            if len(batch):
                x = _values(batch.column(0), width)
                for i, leaf in enumerate(leaves):
                    for mask, n in zip(*np.unique(_masks(leaf, x), return_counts=True)):
                        counts[i, int(mask)] = counts.get((i, int(mask)), 0) + int(n)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([counts[k] for k in keys], pa.int64())],
                                         names=["leaf", "mask", "n"])

    return run


def mask_counts(leaves: list[Leaf], rows: DataFrame, features: list[str]) -> DataFrame:
    """(leaf, mask, n): how many rows meet which of a leaf's conditions; summed in the tasks before it travels."""
    counted = _numbers(rows, features).mapInArrow(_counted(leaves, len(features)), "leaf int, mask bigint, n bigint")
    return counted.groupBy("leaf", "mask").agg(F.sum("n").alias("n"))


def _numbers(rows: DataFrame, features: list[str], *keys: str) -> DataFrame:
    missing = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]
    return rows.select(F.array(*missing).alias("_x"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])


def mask_contributions(spark: SparkSession, leaves: list[Leaf], asked: DataFrame, background: DataFrame) -> DataFrame:
    """(leaf, mask, feature, phi) for the masks of ``asked``, from the counts of the background's masks.

    Of the conditions on a path, those that only the row meets (a of them) speak for the leaf and those that only the
    background row meets (b) against it; the leaf is reached by some mixture if no condition is met by neither. In all
    orders of the features, one of the former is decisive in (a-1)! b! / (a+b)! of them, one of the latter in a! (b-1)! / (a+b)!.
    """
    table = spark.createDataFrame([(i, (1 << len(leaf.path)) - 1, leaf.value, [f for f, _ in leaf.path]) for i, leaf in enumerate(leaves)],
                                  "leaf int, whole bigint, value double, path array<int>")
    x, z = F.col("mask"), F.col("z")
    pairs = asked.select("leaf", "mask").join(background.select("leaf", F.col("mask").alias("z"), "n"), "leaf").join(F.broadcast(table), "leaf")
    pairs = pairs.where(x.bitwiseOR(z) == F.col("whole"))
    only_x, only_z = x.bitwiseAND(F.bitwise_not(z)), z.bitwiseAND(F.bitwise_not(x))
    a, b = F.bit_count(only_x), F.bit_count(only_z)

    def orders(p, q):  # p! q! / (p + q + 1)!, by logarithms' exact counterpart: 1 / ((p + q + 1) * C(p + q, p))
        return 1.0 / ((p + q + 1) * _choose(p + q, p))

    bits = pairs.withColumns({"only_x": only_x, "only_z": only_z, "a": a, "b": b}).select(
        "leaf", "mask", "value", "n", "only_x", "only_z", "a", "b", F.posexplode("path").alias("bit", "feature"))
    mine, theirs = F.getbit("only_x", F.col("bit")) == 1, F.getbit("only_z", F.col("bit")) == 1
    share = F.when(mine, orders(F.col("a") - 1, F.col("b"))).when(theirs, -orders(F.col("a"), F.col("b") - 1)).otherwise(0.0)
    return bits.groupBy("leaf", "mask", "feature").agg(F.sum(F.col("value") * F.col("n") * share).alias("phi"))


def _choose(n, k):
    """Binomial coefficient as a product, so that it stays in range for any path."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda p, i: p * (n - k + i) / i)


def _looked_up(leaves: list[Leaf], width: int, shared):
    """Rows with their keys -> the keys and the contribution of every feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            x = _values(batch.column(0), width) if len(batch) else np.zeros((0, width))
            phi = np.zeros((len(x), width))
            for i, leaf in enumerate(leaves):
                if len(x) and i in known:
                    masks, values = known[i]
                    path = [f for f, _ in leaf.path]
                    phi[:, path] += values[np.searchsorted(masks, _masks(leaf, x))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists], names=[*batch.schema.names[1:], "phi"])

    return run


def exact_shapley_values(leaves: list[Leaf], rows: DataFrame, background: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys..., feature, phi): per row the contributions add up to its score less the mean score of the whole background.

    ``leaves`` come from ``model_leaves`` or are written by hand; ``features`` are the columns their places name, in order.
    Null and NaN are missing values. Repeated keys each give their rows; rows without a key value keep null keys. Only masks
    that some row has are looked at. An empty background is an error, an empty table of rows gives no rows.
    """
    spark = rows.sparkSession
    with staging(spark):
        there = stage(mask_counts(leaves, background, features), "background")
        total = there.where("leaf = 0").agg(F.sum("n")).first()[0] if leaves else 1
        if not total:
            raise ValueError("the background is empty")
        asked = stage(mask_counts(leaves, rows, features), "masks")
        found = mask_contributions(spark, leaves, asked, there)
        known: dict[int, dict[int, np.ndarray]] = {}
        for r in asked.select("leaf", "mask").collect():  # at most the leaves times the masks of their paths
            known.setdefault(r["leaf"], {})[r["mask"]] = np.zeros(len(leaves[r["leaf"]].path))
        for r in found.collect():
            place = [f for f, _ in leaves[r["leaf"]].path].index(r["feature"])
            known[r["leaf"]][r["mask"]][place] = r["phi"] / total
    lookup = {i: (np.array(sorted(m)), np.array([m[k] for k in sorted(m)]).reshape(len(m), -1)) for i, m in known.items()}
    source = _numbers(rows, features, *keys)
    schema = T.StructType([*source.schema.fields[1:], T.StructField("phi", T.ArrayType(T.DoubleType()))])
    wide = source.mapInArrow(_looked_up(leaves, len(features), spark.sparkContext.broadcast(lookup)), schema)
    names = F.array(*[F.lit(f) for f in features])
    return wide.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.explode(F.arrays_zip(names.alias("feature"), "phi")).alias("e")).select(
        *keys, "e.feature", "e.phi")
