"""Density clustering as Spark jobs, exact for any number of rows.

Built on the box tree of ``spatial``. Two facts keep dense regions cheap: when a whole box lies within eps of
another, its row count is added without looking at its points, and all core points inside a box whose diagonal
is at most eps (a *clique*) belong to one cluster, so edges are only needed between cliques.

Cluster membership of core points is the usual one. A border point goes to the lowest-numbered cluster with a
core point within eps (order-free; single-machine implementations take whichever cluster came first).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.clustering_metrics import NOISE, noise_aware_silhouette
from loomwork.operators.rank import with_position
from loomwork.operators.spatial import (SMALL_TABLE, build_leaves, descend, leaf_capacity, max_distance2, min_distance2,
                                        named, packed, roll_up, square_distances)
from loomwork.session import broadcast_if_small, stage

# The parameter grid, and the careful grid used when none of it works.
GRID = ([0.1, 0.3, 0.5, 0.7, 1.0], [3, 5, 7, 10])
GRID_CAREFUL = ([0.05, 0.1, 0.15, 0.2], [2, 3])
MOST_NOISE = 80.0


def standardise(df: DataFrame, features: str = "features") -> tuple[DataFrame, int]:
    """Add ``x``: features minus mean over population deviation (constant features keep their centred value)."""
    arr = vector_to_array(features)
    width = df.select(F.size(arr).alias("n")).first()["n"]
    stats = df.agg(*[F.struct(F.avg(arr[i]).alias("m"), F.stddev_pop(arr[i]).alias("s")).alias(f"f{i}") for i in range(width)]).first()
    xs = [(arr[i] - F.lit(stats[f"f{i}"]["m"])) / F.lit(stats[f"f{i}"]["s"] or 1.0) for i in range(width)]
    return df.withColumn("x", F.array(*xs)), width


class PointTree:
    """Distinct locations of a point table with their row counts, in a box tree. Built once, used for any eps."""

    def __init__(self, points: DataFrame, width: int, capacity: int | None = None):
        """``points`` has ``id`` (bigint, unique) and the array column ``x``."""
        self.width = width
        self.points = points
        where = points.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
        self.leaves = stage(build_leaves(where, width, capacity or leaf_capacity(width)), "leaves")
        self.nodes = roll_up(self.leaves, width)


def _with_root(pairs: DataFrame, nodes: DataFrame, side: str, *extra: str) -> DataFrame:
    cols = ["node", "parent", "is_leaf", "n", "lo", "hi", *extra]
    root = nodes.where("node = ''").select(F.struct(*cols).alias("s")).scalar()
    return pairs.withColumn("_s", root).where(F.col("_s").isNotNull()).select(
        "*", *[F.col(f"_s.{c}").alias(f"{side}_{c}") for c in cols]).drop("_s")


def _per_unit(width: int, eps2: float, what: str):
    """Compare the points of two leaves. Result entries are (id, value).

    ``count``: rows of b within eps of each point of a. ``label``: lowest label of b within eps.
    ``edge``: a spanning set of links between groups of a and groups of b (never all pairs).
    """

    @F.pandas_udf("array<struct<id bigint, value bigint>>")
    def unit(ax: pd.Series, aid: pd.Series, bx: pd.Series, bval: pd.Series) -> pd.Series:
        out = []
        for x, ids, y, val in zip(ax, aid, bx, bval):
            near = square_distances(np.asarray(x).reshape(-1, width), np.asarray(y).reshape(-1, width)) <= eps2
            ids, val = np.asarray(ids), np.asarray(val)
            if what == "count":
                res = near @ val
                keep = res > 0
            elif what == "label":
                big = np.iinfo(np.int64).max
                res = np.where(near, val[None, :], big).min(axis=1)
                keep = res < big
            else:
                out.append(_spanning(ids, val, near))
                continue
            out.append([{"id": int(i), "value": int(v)} for i, v in zip(ids[keep], res[keep])])
        return pd.Series(out)

    return unit


def _spanning(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> list[dict]:
    """Links that connect the same groups as all near pairs do."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    links = []
    for i, j in zip(*np.nonzero(near)):
        p, q = find(int(a[i])), find(int(b[j]))
        if p != q:
            up[max(p, q)] = min(p, q)
            links.append({"id": int(a[i]), "value": int(b[j])})
    return links


def neighbour_cores(tree: PointTree, eps: float, min_points: int) -> DataFrame:
    """(id, core) per location: whether at least ``min_points`` rows, itself included, lie within eps."""
    eps2 = float(eps) * float(eps)
    start = named(tree.nodes.where("is_leaf"), "a")
    pairs = stage(_with_root(start, tree.nodes, "b"), "pairs")
    sure, units = None, None
    while True:
        near = pairs.where(min_distance2("a", "b") <= eps2).withColumn("_whole", max_distance2("a", "b") <= eps2)
        near = stage(near, "near")
        inside = near.where("_whole").groupBy("a_node").agg(F.sum("b_n").alias("sure"))
        sure = inside if sure is None else sure.unionByName(inside).groupBy("a_node").agg(F.sum("sure").alias("sure"))
        sure = stage(sure, "sure")
        settled = sure.where(F.col("sure") >= min_points).select("a_node")
        open_ = near.where(~F.col("_whole")).drop("_whole").join(settled, "a_node", "left_anti")
        leaf = open_.where("b_is_leaf").select("a_node", "b_node")
        units = leaf if units is None else units.unionByName(leaf)
        inner = open_.where(~F.col("b_is_leaf"))
        if inner.isEmpty():
            break
        pairs = descend(inner, "b", tree.nodes)
    units = units.join(settled, "a_node", "left_anti")
    a = packed(tree.leaves, "a")
    b = packed(tree.leaves, "b", "weight").select("b_node", "b_x", "b_weight")
    counted = units.join(a, "a_node").join(b, "b_node").select(
        F.explode(_per_unit(tree.width, eps2, "count")("a_x", "a_ids", "b_x", "b_weight")).alias("e")).select("e.*")
    counted = counted.groupBy("id").agg(F.sum("value").alias("seen"))
    total = F.coalesce("sure", F.lit(0)) + F.coalesce("seen", F.lit(0))
    return tree.leaves.select("id", "leaf").join(sure.withColumnRenamed("a_node", "leaf"), "leaf", "left").join(
        counted, "id", "left").select("id", (total >= min_points).alias("core"))


def _diagonal2() -> Column:
    return F.aggregate(F.zip_with("hi", "lo", lambda h, o: h - o), F.lit(0.0), lambda s, g: s + g * g)


def _core_groups(core: DataFrame, nodes: DataFrame, eps2: float) -> DataFrame:
    """Core locations with their group: the lowest id in the largest clique box above them, else themselves."""
    tight = nodes.where(_diagonal2() <= eps2).select(F.col("node").alias("_up"), F.col("first_id").alias("_g"))
    per_leaf = core.select("leaf").distinct().withColumn("_up", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("leaf")), lambda i: F.substring(F.col("leaf"), F.lit(1), i))))
    group = per_leaf.join(tight, "_up").groupBy("leaf").agg(F.min_by("_g", F.length("_up")).alias("clique"))
    return core.join(group, "leaf", "left").withColumn("grp", F.coalesce("clique", "id"))


def _links(core: DataFrame, width: int, eps2: float) -> DataFrame:
    """(a, b): links between groups that connect exactly the groups joined by core pairs within eps."""
    nodes = roll_up(core, width, {"clique": F.min("clique")})
    # a node lies in one clique when all its leaves name the same one
    same = core.withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("leaf")))).groupBy(
        F.substring("leaf", F.lit(1), F.col("depth")).alias("node")).agg(
        F.when((F.count("clique") == F.count(F.lit(1))) & (F.min("clique") == F.max("clique")), F.min("clique")).alias("clique"))
    nodes = stage(nodes.drop("clique").join(same, "node"), "core_nodes")
    none = F.lit(-1)

    def side(s: str) -> Column:
        return F.coalesce(f"{s}_clique", none)

    root = named(nodes.where("node = ''"), "a", "clique")
    pairs = stage(_with_root(root, nodes, "b", "clique"), "pairs")
    links, units = None, None
    both = (side("a") >= 0) & (side("b") >= 0)
    while True:
        near = pairs.where((F.col("a_node") <= F.col("b_node")) & (min_distance2("a", "b") <= eps2)
                           & ~(both & (side("a") == side("b"))))
        near = stage(near.withColumn("_link", both & (max_distance2("a", "b") <= eps2)), "near")
        found = near.where("_link").select(F.least("a_clique", "b_clique").alias("a"), F.greatest("a_clique", "b_clique").alias("b")).distinct()
        links = stage(found if links is None else links.unionByName(found).distinct(), "links")
        known = links.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        open_ = near.where(~F.col("_link")).drop("_link").join(
            known, (F.least(side("a"), side("b")) == F.col("_a")) & (F.greatest(side("a"), side("b")) == F.col("_b")), "left_anti")
        leaf = open_.where(F.col("a_is_leaf") & F.col("b_is_leaf")).select("a_node", "b_node")
        units = leaf if units is None else units.unionByName(leaf)
        inner = open_.where(~(F.col("a_is_leaf") & F.col("b_is_leaf")))
        if inner.isEmpty():
            break
        pairs = descend(descend(inner, "a", nodes, "clique"), "b", nodes, "clique")
    pack = stage(packed(core, "a", "grp"), "packed")
    other = pack.select(F.col("a_node").alias("b_node"), F.col("a_x").alias("b_x"), F.col("a_grp").alias("b_grp"))
    fine = units.join(pack, "a_node").join(other, "b_node").select(
        F.explode(_per_unit(width, eps2, "edge")("a_x", "a_grp", "b_x", "b_grp")).alias("e")).select(
        F.least("e.id", "e.value").alias("a"), F.greatest("e.id", "e.value").alias("b"))
    return stage(links.unionByName(fine).where("a <> b").distinct(), "links")


def connected_components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root): lowest vertex of each component.

    Every vertex points to its lowest neighbour, pointers are doubled until they end at roots, and the links
    are contracted to the roots; the graph shrinks every round. Every step is written out, so lineage stays
    short and a lost executor costs one step. ``vertices`` has ``v``; ``links`` has ``a`` and ``b``.
    """
    labels = vertices.select("v", F.col("v").alias("root"))
    edges = stage(links.where("a <> b").select("a", "b"), "edges")
    while not edges.isEmpty():
        arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "pointers")
        while True:
            above = up.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
            twice = stage(up.join(above, F.col("p") == F.col("_a")).select("a", F.col("_p").alias("p"), F.col("p").alias("old")), "pointers")
            up = twice.select("a", "p")
            if twice.where("p <> old").isEmpty():
                break
        labels = stage(labels.join(up, F.col("root") == F.col("a"), "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        left = up.select(F.col("a").alias("_a"), F.col("p").alias("_pa"))
        right = up.select(F.col("a").alias("_b"), F.col("p").alias("_pb"))
        edges = stage(edges.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).where("_pa <> _pb").select(
            F.least("_pa", "_pb").alias("a"), F.greatest("_pa", "_pb").alias("b")).distinct(), "edges")
    return labels


def _border(tree: PointTree, cores: DataFrame, labelled: DataFrame, eps2: float) -> DataFrame:
    """(id, cluster) of non-core locations within eps of a core one: the lowest cluster number in reach."""
    loose = tree.leaves.join(cores.where(~F.col("core")).select("id"), "id", "left_semi")
    a_nodes = named(roll_up(loose, tree.width).where("is_leaf"), "a")
    nodes = roll_up(labelled, tree.width, {"label": F.min("cluster")})
    pairs = stage(_with_root(a_nodes, nodes, "b", "label"), "pairs")
    whole, units = None, None
    while True:
        near = stage(pairs.where(min_distance2("a", "b") <= eps2).withColumn("_whole", max_distance2("a", "b") <= eps2), "near")
        part = near.where("_whole").select("a_node", "b_label")
        whole = part if whole is None else whole.unionByName(part)
        open_ = near.where(~F.col("_whole")).drop("_whole")
        leaf = open_.where("b_is_leaf").select("a_node", "b_node")
        units = leaf if units is None else units.unionByName(leaf)
        inner = open_.where(~F.col("b_is_leaf"))
        if inner.isEmpty():
            break
        pairs = descend(inner, "b", nodes, "label")
    a = packed(loose, "a")
    b = packed(labelled, "b", "cluster").select("b_node", "b_x", "b_cluster")
    fine = units.join(a, "a_node").join(b, "b_node").select(
        F.explode(_per_unit(tree.width, eps2, "label")("a_x", "a_ids", "b_x", "b_cluster")).alias("e")).select(
        F.col("e.id").alias("id"), F.col("e.value").alias("cluster"))
    lowest = whole.groupBy("a_node").agg(F.min("b_label").alias("cluster"))
    coarse = loose.select("id", "leaf").join(lowest, F.col("leaf") == F.col("a_node")).select("id", "cluster")
    return fine.unionByName(coarse).groupBy("id").agg(F.min("cluster").alias("cluster"))


def dbscan_locations(tree: PointTree, eps: float, min_points: int) -> DataFrame:
    """(x, prediction, core) for every distinct location of the tree's points; noise is -1.

    Clusters are numbered from 0 in the order of their lowest core id.
    """
    eps2 = float(eps) * float(eps)
    cores = stage(neighbour_cores(tree, eps, min_points), "cores")
    core = tree.leaves.join(cores.where("core").select("id"), "id", "left_semi")
    boxes = roll_up(core, tree.width, {"first_id": F.min("id")})
    core = stage(_core_groups(core, boxes, eps2), "core")
    roots = connected_components(core.select(F.col("grp").alias("v")).distinct(), _links(core, tree.width, eps2))
    rooted = core.join(roots, F.col("grp") == F.col("v"))
    first = rooted.groupBy("root").agg(F.min("id").alias("first"))
    order = with_position(first, [F.col("first")], "no").select("root", (F.col("no") - 1).alias("cluster"))
    labelled = stage(rooted.join(order, "root").select("id", "x", "weight", "leaf", "cluster"), "labelled")
    border = _border(tree, cores, labelled, eps2)
    known = labelled.select("id", "cluster").unionByName(border)
    return tree.leaves.select("id", "x").join(cores, "id").join(known, "id", "left").select(
        "x", "core", F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("prediction"))


def _numbered_points(df: DataFrame, keys: list[str], features: str) -> tuple[DataFrame, int]:
    scaled, width = standardise(df.select(*keys, features), features)
    placed = with_position(scaled.select(*keys, "x"), [F.col(k) for k in keys], "id")
    return stage(placed, "points"), width


def dbscan(df: DataFrame, keys: list[str], eps: float, min_points: int, features: str = "features",
           capacity: int | None = None) -> DataFrame:
    """(keys..., prediction, core) of density clustering on standardised features."""
    placed, width = _numbered_points(df, keys, features)
    out = dbscan_locations(PointTree(placed.select("id", "x"), width, capacity), eps, min_points)
    return placed.select(*keys, "x").join(out, "x").select(*keys, "prediction", "core")


def dbscan_search(df: DataFrame, keys: list[str], features: str = "features", eps_values: list[float] | None = None,
                  min_points_values: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Best (keys..., prediction) over a parameter grid, and the table of all trials.

    A trial is valid with two clusters and less than 80 % noise; the best has the highest silhouette without
    noise. When none is valid a careful grid is tried and its first valid trial (two clusters) is taken.
    """
    placed, width = _numbered_points(df, keys, features)
    tree = PointTree(placed.select("id", "x"), width)
    total = placed.count()
    eps_grid, point_grid = GRID
    raw = df.select(*keys, features)

    def attempt(eps: float, points: int):
        labels = stage(placed.select(*keys, "x").join(dbscan_locations(tree, eps, points), "x").select(*keys, "prediction"), "trial")
        facts = labels.agg(F.count_distinct(F.when(F.col("prediction") != NOISE, F.col("prediction"))).alias("k"),
                           F.count_if(F.col("prediction") == NOISE).alias("noise")).first()
        score = noise_aware_silhouette(raw.join(labels, keys), features).first()["silhouette"]
        return labels, (float(eps), int(points), float(score), int(facts["k"]), 100.0 * facts["noise"] / total)

    best, rows = None, []
    for e in eps_values or eps_grid:
        for p in min_points_values or point_grid:
            labels, row = attempt(e, p)
            valid = row[3] >= 2 and row[2] > -1.0 and row[4] < MOST_NOISE
            rows.append((*row, valid))
            if valid and (best is None or row[2] > best[1]):
                best = (labels, row[2])
    if best is None:
        for e in GRID_CAREFUL[0]:
            for p in GRID_CAREFUL[1]:
                labels, row = attempt(e, p)
                valid = row[3] >= 2 and row[2] > -1.0
                rows.append((*row, valid))
                if valid:
                    best = (labels, row[2])
                    break
            if best is not None:
                break
    table = df.sparkSession.createDataFrame(
        rows, "eps double, min_points int, silhouette double, num_clusters int, noise_percentage double, valid boolean")
    if best is None:
        raise ValueError("no parameter combination gives two clusters")
    return best[0], table
