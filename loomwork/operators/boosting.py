"""Second-order boosting of histogram trees.

Features are cut into at most ``max_bins`` bins at approximate quantiles, and the binned rows are written once. A pass over
them sums gradient, hessian and rows per (class, node, feature, bin) inside the tasks; only these sums are shuffled, and
their number depends on the model, never on the rows. The best split of every node is found by a running sum over the
bins, once with the missing values on the left and once on the right, so each split learns where missing values go. All
trees of a round (one per class) grow together, one pass a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.session import stage, staging, unstage

#: Bin of a missing value.
MISSING = 255
#: Rounds whose trees a pass adds up by itself before the margins of all rows are written anew.
ROUNDS_PER_STAGE = 8
OBJECTIVES = ("squared", "logistic", "softmax")


@dataclass
class Tree:
    """One tree: ``feature`` is -1 in a leaf; a value of at most ``threshold`` goes left, a missing one where ``missing_left`` says."""

    round: int
    label: int
    feature: list[int]
    bin: list[int]
    threshold: list[float]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    @classmethod
    def root(cls, round_: int, label: int) -> Tree:
        return cls(round_, label, [-1], [0], [0.0], [False], [0], [0], [0.0], [0.0])

    def leaf(self, value: float) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("missing_left", False), ("left", 0), ("right", 0), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def places(self, values: np.ndarray, missing: np.ndarray, cuts: list) -> np.ndarray:
        """The node where each row ends; ``cuts`` are bins or thresholds, as the values are."""
        feature, cut, left, right, lost = (np.array(x) for x in (self.feature, cuts, self.left, self.right, self.missing_left))
        node, rows = np.zeros(len(values), np.int64), np.arange(len(values))
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            at, f = node[inner], f[inner]
            low = np.where(missing[rows[inner], f], lost[at], values[rows[inner], f] <= cut[at])
            node[inner] = np.where(low, left[at], right[at])


def _outputs(trees: list[Tree], values: np.ndarray, missing: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(values), classes))
    for t in trees:
        out[:, t.label] += np.array(t.value)[t.places(values, missing, t.threshold)]
    return out


def _walk(tree: Tree) -> Callable[[np.ndarray], np.ndarray]:
    """``places`` for rows of bins: each step looks the next node up by node and bin, for all rows at once."""
    feature, depth = np.array(tree.feature), [0] * len(tree.feature)
    for node, f in enumerate(tree.feature):  # children come after their parent
        if f >= 0:
            depth[tree.left[node]] = depth[tree.right[node]] = depth[node] + 1
    low = np.arange(MISSING + 1)[None, :] <= np.array(tree.bin)[:, None]
    low[:, MISSING] = tree.missing_left
    following = np.where(feature[:, None] < 0, np.arange(len(feature))[:, None], np.where(low, np.array(tree.left)[:, None], np.array(tree.right)[:, None])).ravel()
    asked = np.maximum(feature, 0)

    def places(bins: np.ndarray) -> np.ndarray:
        node, first, flat = np.zeros(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1], bins.ravel()
        for _ in range(max(depth)):
            node = following[node * (MISSING + 1) + flat[first + asked[node]]]
        return node

    return places


def _binned_outputs(trees: list[Tree], classes: int) -> Callable[[np.ndarray], np.ndarray]:
    walks = [(t.label, np.array(t.value), _walk(t)) for t in trees]

    def outputs(bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), classes))
        for label, value, places in walks:
            out[:, label] += value[places(bins)]
        return out

    return outputs


def _slopes(objective: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the loss at every margin."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    p = _probabilities(objective, margin)
    seen = y[:, None] == np.arange(margin.shape[1])[None, :] if objective == "softmax" else y[:, None]
    return p - seen, p * (1 - p)


def _probabilities(objective: str, margin: np.ndarray) -> np.ndarray:
    if objective == "logistic":
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """Rows of equal width from a binary or a list column."""
    if pa.types.is_binary(column.type):
        if not len(column) or not width:
            return np.zeros((len(column), width), dtype)
        begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
        return np.frombuffer(column.buffers()[2], dtype, len(column) * width, begin).reshape(len(column), width)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _binned(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(edges), np.float64)
            bins = np.empty(x.shape, np.uint8)
            for i, cuts in enumerate(edges):
                bins[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(cuts, x[:, i]))
            flat, width = bins.tobytes(), len(edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[i:i + width] for i in range(0, len(flat), width)], pa.binary()), batch.column(2)],
                                             names=["label", "bins", "margins"])

    return run


def _raised(trees: list[Tree], width: int, classes: int):
    """(label, bins, margins) with the outputs of some trees added to the margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs = _binned_outputs(trees, classes)
        for batch in batches:
            bins = _matrix(batch.column(1), width, np.uint8)
            margins = _matrix(batch.column(2), classes, np.float64) + outputs(bins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * classes), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["label", "bins", "margins"])

    return run


def _histogram(recent: list[Tree], growing: list[Tree], open_nodes: list[list[int]], objective: str, width: int, bins_used: int):
    """Binned rows -> (label, node, feature, bin, g, h, n): sums of a task over the open nodes of the growing trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, cells = len(growing), width * (bins_used + 1)
        totals = [np.zeros((3, len(nodes) * cells)) for nodes in open_nodes]
        outputs, walks = _binned_outputs(recent, classes), [_walk(t) for t in growing]
        for batch in batches:
            if not len(batch):
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False)
            bins = _matrix(batch.column(1), width, np.uint8)
            margins = _matrix(batch.column(2), classes, np.float64) + outputs(bins)
            g, h = _slopes(objective, margins, y)
            slots = np.where(bins == MISSING, bins_used, bins).astype(np.int64).T + (np.arange(width) * (bins_used + 1))[:, None]
            for t, nodes, total, walk in zip(growing, open_nodes, totals, walks):
                place = np.full(len(t.feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[walk(bins)]
                rows = slice(None) if at.min() >= 0 else np.flatnonzero(at >= 0)
                start, weights = at[rows] * cells, (g[rows, t.label], h[rows, t.label], None)
                for slot in slots:
                    cell = start + slot[rows]
                    for k, w in enumerate(weights):
                        total[k] += np.bincount(cell, w, total.shape[1])
        for t, nodes, total in zip(growing, open_nodes, totals):
            some = np.flatnonzero(total[2])
            node, rest = np.divmod(some, cells)
            feature, slot = np.divmod(rest, bins_used + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), t.label, np.int32)), pa.array(np.array(nodes, np.int32)[node]), pa.array(feature.astype(np.int32)),
                 pa.array(np.where(slot == bins_used, -1, slot).astype(np.int32)), *[pa.array(total[k][some]) for k in range(3)]],
                names=["label", "node", "feature", "bin", "g", "h", "n"])

    return run


@dataclass
class Growth:
    """How trees grow: leaves are shrunk by ``reg_lambda``; a split needs a gain above ``min_gain`` and, on both sides,
    ``min_hessian`` and ``min_rows``."""

    max_depth: int = 5
    reg_lambda: float = 1.0
    min_gain: float = 1e-9
    min_hessian: float = 1e-3
    min_rows: int = 1


def best_splits(sums: DataFrame, growth: Growth) -> DataFrame:
    """(label, node, gain, feature, bin, missing_left, g_left, h_left, g, h) of every node with an allowed split, from its histogram.

    ``gain`` is half the rise of the sum of g^2 / (h + lambda). Bin -1 holds missing values. Of equal gains the first feature
    and bin win, and missing values go right.
    """
    node = Window.partitionBy("label", "node", "feature")
    running = node.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lost = {c: F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col(c))).over(node), F.lit(0.0)) for c in ("g", "h", "n")}
    rows = sums.select("*", *[F.sum(c).over(node).alias(f"{c}_all") for c in ("g", "h", "n")], *[v.alias(f"{c}_lost") for c, v in lost.items()],
                       *[F.sum(F.when(F.col("bin") >= 0, F.col(c)).otherwise(0.0)).over(running).alias(f"{c}_run") for c in ("g", "h", "n")])
    sides = rows.where("bin >= 0").withColumn("missing_left", F.explode(F.array(F.lit(False), F.lit(True)))).where("not missing_left or n_lost > 0")
    for c in ("g", "h", "n"):
        sides = sides.withColumn(f"{c}_left", F.col(f"{c}_run") + F.when(F.col("missing_left"), F.col(f"{c}_lost")).otherwise(0.0))

    def part(g, h):
        return g * g / (h + F.lit(growth.reg_lambda))

    g_right, h_right, n_right = (F.col(f"{c}_all") - F.col(f"{c}_left") for c in ("g", "h", "n"))
    gain = (part(F.col("g_left"), F.col("h_left")) + part(g_right, h_right) - part(F.col("g_all"), F.col("h_all"))) / 2
    allowed = sides.withColumn("gain", gain).where(
        (F.col("gain") > growth.min_gain) & (F.least("h_left", h_right) >= growth.min_hessian) & (F.least(F.col("n_left"), n_right) >= max(1, growth.min_rows)))
    best = allowed.groupBy("label", "node").agg(F.max(F.struct(
        "gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), (~F.col("missing_left")).alias("lost_right"), "g_left", "h_left",
        F.col("g_all").alias("g"), F.col("h_all").alias("h"))).alias("s"))
    return best.select("label", "node", "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), (~F.col("s.lost_right")).alias("missing_left"),
                       "s.g_left", "s.h_left", "s.g", "s.h")


def feature_edges(rows: DataFrame, width: int, max_bins: int) -> list[np.ndarray]:
    """Upper ends of the bins but the last, per feature: approximate quantiles of the present values, one aggregate for all."""
    probs = [i / max_bins for i in range(1, max_bins)]
    value = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    found = rows.agg(*[F.percentile_approx(v, probs, 20_000).alias(f"q{i}") for i, v in enumerate(value)], *[F.max(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    return [np.array([e for e in sorted(set(found[f"q{i}"] or ())) if e < found[f"m{i}"]]) for i in range(width)]


def fit_trees(rows: DataFrame, width: int, objective: str, rounds: int, step: float, max_bins: int, growth: Growth, classes: int = 1) -> tuple[list[Tree], list[float]]:
    """Trees and start margins from ``rows`` (``label`` double, ``x`` array of doubles with NaN for missing)."""
    if not 2 <= max_bins < MISSING:
        raise ValueError(f"max_bins must be 2 to {MISSING - 1}")
    with staging(rows.sparkSession):
        edges = feature_edges(rows, width, max_bins)
        start = _start(rows, objective, classes)
        binned = rows.select("label", "x", F.array(*[F.lit(s) for s in start]).alias("margins")).mapInArrow(
            _binned(edges), "label double, bins binary, margins array<double>")
        current, trees, recent = stage(binned, "binned"), [], []
        used = max([len(e) for e in edges], default=0) + 1
        for r in range(rounds):
            growing = [Tree.root(r, k) for k in range(classes)]
            open_nodes = [[0] for _ in growing]
            for _ in range(growth.max_depth):
                passed = current.mapInArrow(_histogram(recent, growing, open_nodes, objective, width, used),
                                            "label int, node int, feature int, bin int, g double, h double, n double")
                sums = passed.groupBy("label", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
                following = [[] for _ in growing]
                for s in best_splits(sums, growth).orderBy("label", "node").collect():  # a row per open node
                    t, node = growing[s["label"]], s["node"]
                    lam = growth.reg_lambda
                    sides = [(s["g_left"], s["h_left"]), (s["g"] - s["g_left"], s["h"] - s["h_left"])]
                    t.left[node], t.right[node] = (t.leaf(-step * g / (h + lam)) for g, h in sides)
                    t.feature[node], t.bin[node], t.gain[node] = s["feature"], s["bin"], s["gain"]
                    t.threshold[node], t.missing_left[node] = float(edges[s["feature"]][s["bin"]]) if s["bin"] < len(edges[s["feature"]]) else float("inf"), s["missing_left"]
                    following[s["label"]] += [t.left[node], t.right[node]]
                open_nodes = following
                if not any(open_nodes):
                    break
            trees += growing
            recent = [*recent, *growing]
            if all(t.feature[0] < 0 for t in growing):
                break
            if len(recent) >= ROUNDS_PER_STAGE * classes and r + 1 < rounds:
                fresh = stage(current.mapInArrow(_raised(recent, width, classes), "label double, bins binary, margins array<double>"), "margins")
                unstage(current)
                current, recent = fresh, []
    return trees, start


def _start(rows: DataFrame, objective: str, classes: int) -> list[float]:
    """Best constant margins."""
    if objective == "softmax":
        n = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}  # a row per class
        if not set(n) <= set(range(classes)):
            raise ValueError(f"labels must be 0 to {classes - 1}")
        total = sum(n.values())
        return [float(np.log(max(n.get(k, 0), 0.5) / total)) if total else 0.0 for k in range(classes)]
    mean = rows.agg(F.avg("label")).first()[0]
    if mean is None:
        raise ValueError("no rows to fit")
    if objective == "squared":
        return [float(mean)]
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return [float(np.log(mean / (1 - mean)))]


class HistogramBoosting(Estimator):
    """Estimator over a ``features`` vector and a ``label`` column; NaN is a missing value.

    ``objective`` is squared, logistic (labels 0 and 1) or softmax (labels 0 to ``classes`` - 1; one tree a class and
    round). Rows with a null label or null features are left out of the fit.
    """

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", objective: str = "squared", classes: int = 2, maxIter: int = 50,  # noqa: N803
                 maxDepth: int = 5, maxBins: int = 64, stepSize: float = 0.1, regLambda: float = 1.0, minGain: float = 1e-9, minRows: int = 1):  # noqa: N803
        super().__init__()
        if objective not in OBJECTIVES:
            raise ValueError(f"objective is one of {OBJECTIVES}, not {objective}")
        self.features_col, self.label_col, self.objective = featuresCol, labelCol, objective
        self.classes = classes if objective == "softmax" else 1
        self.rounds, self.max_bins, self.step = maxIter, maxBins, stepSize
        self.growth = Growth(maxDepth, regLambda, minGain, min_rows=minRows)

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        rows = dataset.select(F.col(self.label_col).cast("double").alias("label"), vector_to_array(self.features_col).alias("x")).where("label is not null and x is not null")
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        trees, start = fit_trees(rows, len(first["x"]), self.objective, self.rounds, self.step, self.max_bins, self.growth, self.classes)
        return BoostedTrees(trees, start, self.objective, len(first["x"]), self.features_col)


class BoostedTrees(Model, MLWritable, MLReadable):
    """Fitted trees. ``transform`` adds ``margins``' predictions: prediction, and for classes rawPrediction and probability."""

    def __init__(self, trees: list[Tree] | None = None, start: list[float] | None = None, objective: str = "squared", width: int = 0, features_col: str = "features"):
        super().__init__()
        self.trees, self.start, self.objective, self.width, self.features_col = trees or [], start or [0.0], objective, width, features_col

    def margins(self, x: Column) -> Column:
        """Column of the margins, an array with one entry per class, from a column of feature arrays."""
        return self._evaluated(x, False)

    def _evaluated(self, x: Column, with_shares: bool) -> Column:
        """Margins, followed by the probabilities of the classes if wanted: one computation a row, whatever reads them."""
        trees, start, classes, objective = self.trees, np.array(self.start), len(self.start), self.objective

        @F.pandas_udf("array<double>")
        def evaluated(rows: pd.Series) -> pd.Series:
            values = np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, 1))
            out = start + _outputs(trees, values, np.isnan(values), classes)
            return pd.Series(list(np.concatenate([out, _probabilities(objective, out)], axis=1) if with_shares else out))

        return evaluated(x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("_margins", self._evaluated(vector_to_array(self.features_col), self.objective == "softmax"))
        if self.objective == "squared":
            return out.withColumn("prediction", F.col("_margins")[0]).drop("_margins")
        m = F.col("_margins")
        if self.objective == "logistic":
            raw = F.array(-m[0], m[0])
            p = F.array(1 / (1 + F.exp(m[0])), 1 / (1 + F.exp(-m[0])))
        else:
            raw, p = F.slice(m, 1, len(self.start)), F.slice(m, len(self.start) + 1, len(self.start))
        out = out.withColumn("_p", p).withColumn("rawPrediction", array_to_vector(raw)).withColumn("probability", array_to_vector("_p"))
        return out.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_margins", "_p")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table, one row per node."""
        rows = [(t.round, t.label, i, t.feature[i], t.threshold[i], t.missing_left[i], t.left[i], t.right[i], t.value[i], t.gain[i])
                for t in self.trees for i in range(len(t.feature))]
        return spark.createDataFrame(rows, "round int, label int, node int, feature int, threshold double, missing_left boolean, `left` int, `right` int, value double, gain double")

    def importances(self) -> list[float]:
        """Share of every feature in the gain of all splits."""
        total = np.zeros(self.width)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
        return list(total / total.sum()) if total.sum() > 0 else list(total)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Settings as metadata, trees as a Parquet table beside it."""

    def __init__(self, model: BoostedTrees):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        extra = {"start": m.start, "objective": m.objective, "width": m.width, "features_col": m.features_col}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extra)
        rows = [tuple(asdict(t).values()) for t in m.trees]
        self.sparkSession.createDataFrame(rows, _TREE).coalesce(1).write.parquet(f"{path}/trees")


_TREE = ("`round` int, label int, feature array<int>, bin array<int>, threshold array<double>, missing_left array<boolean>, `left` array<int>, `right` array<int>, "
         "value array<double>, gain array<double>")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTrees:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("round", "label").collect()  # a row per tree
        trees = [Tree(*[list(v) if isinstance(v, list) else v for v in r]) for r in rows]
        model = self.cls(trees, meta["start"], meta["objective"], meta["width"], meta["features_col"])
        model._resetUid(meta["uid"])
        return model
