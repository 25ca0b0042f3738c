"""Exact neighbour search on tables of points.

Points are sorted into a tree of boxes: every over-full box is cut along its widest side at approximate
quantiles until it holds few points, so dense regions get small boxes and no box can grow with the data. A
node is named by its path, one character per level; its ancestors are the prefixes of its name. Searches
walk down from the root with equi-joins on the parent and drop what lies too far away; only leaf boxes that
may really touch are compared, point by point, inside the tasks. Approximate cuts affect speed only, never
results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.rank import with_position
from loomwork.session import broadcast_if_small, stage

FAN = 16
LEAF_DOUBLES = 2048
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
SMALL_TABLE = 10_000


def min_distance2(a: str, b: str) -> Column:
    """Smallest squared distance between the boxes of two nodes (columns ``<a>_lo``, ``<a>_hi``, ...)."""
    gap = F.zip_with(F.zip_with(f"{a}_lo", f"{b}_hi", lambda x, y: x - y), F.zip_with(f"{b}_lo", f"{a}_hi", lambda x, y: x - y),
                     lambda u, v: F.greatest(u, v, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)


def max_distance2(a: str, b: str) -> Column:
    """Largest squared distance between points of the two boxes."""
    reach = F.zip_with(F.zip_with(f"{a}_hi", f"{b}_lo", lambda x, y: x - y), F.zip_with(f"{b}_hi", f"{a}_lo", lambda x, y: x - y),
                       lambda u, v: F.greatest(u, v))
    return F.aggregate(reach, F.lit(0.0), lambda s, g: s + g * g)


def leaf_capacity(width: int, at_least: int = 2) -> int:
    return max(at_least, min(256, LEAF_DOUBLES // max(1, width)))


def _box(width: int) -> list[Column]:
    return [F.array(*[F.min(F.col("x")[i]) for i in range(width)]).alias("lo"),
            F.array(*[F.max(F.col("x")[i]) for i in range(width)]).alias("hi")]


def build_leaves(points: DataFrame, width: int, capacity: int) -> DataFrame:
    """Add the column ``leaf``. ``points`` has an array column ``x`` of ``width`` finite doubles; others are an error.

    NaN and infinity have no place in a box, and cutting would never end.
    """
    odd = points.where(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).count()
    if odd:
        raise ValueError(f"{odd} points have a coordinate that is null, NaN or infinite; impute or leave them out first")
    placed = stage(points.withColumn("leaf", F.lit("")).withColumn("done", F.lit(False)), "tree")
    while True:
        stats = placed.where(~F.col("done")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *_box(width))
        sides = F.zip_with("hi", "lo", lambda h, o: h - o)
        stats = stats.withColumn("side", F.array_max(sides)).withColumn("dim", F.array_position(sides, F.col("side")).cast("int"))
        full = stage(stats.where((F.col("n") > capacity) & (F.col("side") > 0)).select(
            "leaf", "dim", F.element_at("lo", F.col("dim")).alias("low"), F.element_at("hi", F.col("dim")).alias("high")), "full")
        if full.isEmpty():
            return placed.drop("done")
        probs = [i / FAN for i in range(1, FAN)]
        full = broadcast_if_small(full, SMALL_TABLE)
        value = F.element_at("x", F.col("dim"))
        cuts = placed.where(~F.col("done")).join(full, "leaf").groupBy("leaf").agg(
            F.first("dim").alias("dim"), F.first("low").alias("low"), F.first("high").alias("high"),
            F.percentile_approx(value, probs, 1000).alias("q"))
        # the smallest value and the middle are cuts too, so every over-full box really splits
        cuts = stage(cuts.select("leaf", "dim", F.array_distinct(F.concat(
            "q", F.array("low", (F.col("low") + F.col("high")) / 2))).alias("q")), "cuts")
        digit = F.size(F.filter("q", lambda c: c < F.element_at("x", F.col("dim"))))
        moved = placed.join(broadcast_if_small(cuts, SMALL_TABLE), "leaf", "left").withColumn(
            "done", F.col("q").isNull()).withColumn(
            "leaf", F.when(F.col("done"), F.col("leaf")).otherwise(F.concat("leaf", F.substring(F.lit(_DIGITS), digit + 1, F.lit(1)))))
        placed = stage(moved.drop("dim", "q"), "tree")


def roll_up(leaves: DataFrame, width: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """All nodes from the points: (node, parent, is_leaf, n, lo, hi, ...); ``extra`` adds aggregates over leaf columns.

    Leaves are aggregated first; the climb to the ancestors multiplies leaf rows, not points.
    """
    extra = extra or {}
    per_leaf = leaves.groupBy("leaf").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("points"), *_box(width),
                                          *[c.alias(n) for n, c in extra.items()])
    paths = per_leaf.withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("leaf"))))
    paths = paths.withColumn("node", F.substring("leaf", F.lit(1), F.col("depth")))
    nodes = paths.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("points").alias("points"), F.max((F.col("node") == F.col("leaf"))).alias("is_leaf"),
        F.array(*[F.min(F.col("lo")[i]) for i in range(width)]).alias("lo"),
        F.array(*[F.max(F.col("hi")[i]) for i in range(width)]).alias("hi"),
        *[F.min(n).alias(n) for n in extra])
    parent = F.when(F.col("node") != "", F.substring("node", F.lit(1), F.length("node") - 1))
    return stage(nodes.withColumn("parent", parent), "nodes")


def named(nodes: DataFrame, prefix: str, *extra: str) -> DataFrame:
    """Node columns renamed for one side of a pair."""
    cols = ["node", "parent", "is_leaf", "n", "lo", "hi", *extra]
    return nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in cols])


def descend(pairs: DataFrame, side: str, nodes: DataFrame, *extra: str) -> DataFrame:
    """Replace the non-leaf node of one side of every pair by its children."""
    cols = [f"{side}_{c}" for c in ("node", "parent", "is_leaf", "n", "lo", "hi", *extra)]
    others = [c for c in pairs.columns if c not in cols]
    children = broadcast_if_small(named(nodes, side, *extra), SMALL_TABLE)
    inner = pairs.where(~F.col(f"{side}_is_leaf")).select(*others, F.col(f"{side}_node").alias("_up"))
    opened = inner.join(children, F.col("_up") == F.col(f"{side}_parent")).drop("_up")
    return pairs.where(F.col(f"{side}_is_leaf")).unionByName(opened)


def packed(leaves: DataFrame, prefix: str, *extra: str) -> DataFrame:
    """One row per leaf with its points as flat arrays; a leaf is bounded, so is the row."""
    entry = F.array_sort(F.collect_list(F.struct("id", "x", *extra)))
    rows = leaves.groupBy("leaf").agg(entry.alias("p"))
    return rows.select(F.col("leaf").alias(f"{prefix}_node"), F.col("p.id").alias(f"{prefix}_ids"),
                       F.flatten("p.x").alias(f"{prefix}_x"), *[F.col(f"p.{e}").alias(f"{prefix}_{e}") for e in extra])


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i][:, None] - b[:, i][None, :]
        out += d * d
    return out


def _nearest_in_leaf(k: int, width: int):
    kind = "array<struct<loc bigint, id bigint, d2 double>>"

    @F.pandas_udf(kind)
    def nearest(qx: pd.Series, qloc: pd.Series, qr: pd.Series, cx: pd.Series, cid: pd.Series, cloc: pd.Series) -> pd.Series:
        out = []
        for x, loc, r, y, ids, where in zip(qx, qloc, qr, cx, cid, cloc):
            q, c = np.asarray(x).reshape(-1, width), np.asarray(y).reshape(-1, width)
            loc, ids, where, r = np.asarray(loc), np.asarray(ids), np.asarray(where), np.asarray(r)
            loc, first = np.unique(loc, return_index=True)
            d = square_distances(q[first], c)
            d[loc[:, None] == where[None, :]] = np.inf
            found = []
            for i in range(len(loc)):
                ok = np.flatnonzero(d[i] <= min(r[first[i]], np.finfo(float).max))
                best = ok[np.lexsort((ids[ok], d[i][ok]))[:k]]
                found += [{"loc": int(loc[i]), "id": int(ids[j]), "d2": float(d[i][j])} for j in best]
            out.append(found)
        return pd.Series(out)

    return nearest


def nearest_neighbours(points: DataFrame, width: int, k: int, capacity: int | None = None) -> DataFrame:
    """(id, rank, neighbour, d2): the exact k nearest other points of every point, ties by id.

    ``points`` has ``id`` (bigint, unique) and ``x``. Copies of one location are searched once and need at most
    k + 1 stand-ins, so a pile of equal points costs no more than any other location.
    """
    points = stage(points.select("id", "x"), "points")
    locations = points.groupBy("x").agg(F.min("id").alias("loc"))

    order = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    stand_ins = points.withColumn("_i", order).where(F.col("_i") <= k + 1).drop("_i").join(locations, "x")
    cap = capacity or leaf_capacity(width, 2 * k + 2)
    leaves = build_leaves(stand_ins.withColumn("weight", F.lit(1)), width, cap)
    nodes = roll_up(leaves, width)
    search = _nearest_in_leaf(k, width)
    infinite = F.lit(float("inf"))
    pack = stage(packed(leaves, "b", "loc"), "packed")
    mine = pack.select(F.col("b_node").alias("a_node"), F.col("b_x").alias("a_x"), F.col("b_loc").alias("a_loc"))

    # first round: every leaf against itself
    own = mine.join(pack, F.col("a_node") == F.col("b_node")).withColumn("r", F.transform("a_loc", lambda _: infinite))
    own = own.select(F.explode(search("a_x", "a_loc", "r", "b_x", "b_ids", "b_loc")).alias("e")).select("e.*")
    own = stage(own, "own")
    reach = own.groupBy("loc").agg(F.count(F.lit(1)).alias("c"), F.max("d2").alias("far"))

    # every leaf has k other locations within the box of any ancestor of 2k + 1 stand-ins
    leaf_box = named(nodes.where("is_leaf"), "a")
    above = leaf_box.withColumn("_up", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("a_node")), lambda i: F.substring(F.col("a_node"), F.lit(1), i))))
    above = above.join(named(nodes.where(F.col("points") >= 2 * k + 1), "b"), F.col("_up") == F.col("b_node"))
    bound = above.groupBy("a_node").agg(F.min(max_distance2("a", "b")).alias("bound"))
    where = leaves.select("loc", "leaf").distinct()
    radius = where.join(reach, "loc", "left").join(bound, where["leaf"] == bound["a_node"], "left").select(
        "loc", "leaf", F.least(F.when(F.col("c") >= k, F.col("far")).otherwise(infinite), F.coalesce("bound", infinite)).alias("r"))
    radius = stage(radius, "radius")
    leaf_radius = radius.groupBy(F.col("leaf").alias("a_node")).agg(F.max("r").alias("r"))

    # walk down: leaf boxes against the tree, keep what may hold a nearer point
    pairs = leaf_box.join(leaf_radius, "a_node").select("a_node", "a_lo", "a_hi", "r")
    root = nodes.where("node = ''").select(F.struct("node", "parent", "is_leaf", "n", "lo", "hi").alias("s")).scalar()
    pairs = pairs.withColumn("_s", root).select("*", *[F.col(f"_s.{c}").alias(f"b_{c}") for c in ("node", "parent", "is_leaf", "n", "lo", "hi")]).drop("_s")
    pairs = stage(pairs, "pairs")
    while not pairs.where(~F.col("b_is_leaf")).isEmpty():
        pairs = stage(descend(pairs, "b", nodes).where(min_distance2("a", "b") <= F.col("r")), "pairs")
    pairs = pairs.where(F.col("a_node") != F.col("b_node")).select("a_node", "b_node")

    # second round: touching leaves, each query limited to its own radius
    limits = radius.groupBy(F.col("leaf").alias("a_node")).agg(F.map_from_entries(F.collect_list(F.struct("loc", "r"))).alias("m"))
    queries = mine.join(limits, "a_node").withColumn("r", F.transform("a_loc", lambda v: F.col("m")[v])).drop("m")
    other = pairs.join(queries, "a_node").join(pack, "b_node")
    other = other.select(F.explode(search("a_x", "a_loc", "r", "b_x", "b_ids", "b_loc")).alias("e")).select("e.*")

    best = Window.partitionBy("loc").orderBy("d2", "id")
    per_loc = own.unionByName(other).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    far = per_loc.groupBy("loc").agg(F.array_sort(F.collect_list(F.struct("d2", "id"))).alias("far"))
    near = stand_ins.groupBy("loc").agg(F.array_sort(F.collect_list(F.struct(F.lit(0.0).alias("d2"), "id"))).alias("near"))
    lists = near.join(far, "loc", "left").select("loc", "near", F.coalesce("far", F.array().cast("array<struct<d2:double,id:bigint>>")).alias("far"))
    # a crowded location makes one large key here; the adaptive skew join splits it
    joined = points.join(locations, "x").join(lists, "loc")
    chosen = F.slice(F.concat(F.filter("near", lambda e: e["id"] != F.col("id")), "far"), 1, k)
    return joined.select("id", F.posexplode(chosen).alias("rank", "e")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("neighbour"), F.col("e.d2").alias("d2"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Dense bigint ``id`` 1..n in key order."""
    return with_position(df, [F.col(c) for c in order], "id").withColumn("id", F.col("id").cast("long"))
