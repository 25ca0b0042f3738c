"""Choosing models from one long table ``metrics(model, dataset, metric, value)``.

The table has one row per model, dataset and metric, so windows over it are small by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric preference when the asked one is missing.
CLASSIFICATION_ORDER = ["accuracy", "f1", "precision", "recall", "roc", "ks"]
REGRESSION_ORDER = ["rmse", "mae", "r2"]

# Metrics where more is better (all others are errors).
HIGHER_IS_BETTER = ["ks", "roc", "accuracy", "f1", "precision", "recall", "r2"]

# Deviation between datasets that counts as unstable.
CLASSIFICATION_DEVIATION, KS_DEVIATION = 0.03, 3.0
REGRESSION_DEVIATION = {"rmse": 0.1, "mae": 0.05, "r2": 0.02}
OTHER_DEVIATION = 0.05

# Improvement and overfitting limits (shares) for preferring a tuned model.
IMPROVEMENT = {"classification": 0.01, "regression": 0.05}
OVERFITTING = {"classification": 0.05, "regression": 0.1}

# Datasets in the order in which a clustering score is looked up.
CLUSTER_DATASETS = ["validation", "train", "test"]


def _whole() -> Window:
    return Window.partitionBy(F.lit(1))


def _rank_of(c: Column, names: list[str]) -> Column:
    position = F.array_position(F.array(*[F.lit(n) for n in names]), c)
    return F.when(position > 0, position).otherwise(len(names) + 1)


def _higher(metric: Column) -> Column:
    return metric.isin(*HIGHER_IS_BETTER)


def _usable_metric(metrics: DataFrame, criterion: str, dataset: str, fallback: list[str]) -> str:
    """The criterion when the dataset has it, else the first available metric in fallback order."""
    available = metrics.where(F.col("dataset") == dataset).select("metric").distinct()
    row = available.agg(F.min_by("metric", F.struct(_rank_of(F.col("metric"), [criterion, *fallback]), "metric")).alias("m")).first()
    if row is None or row["m"] is None:
        raise ValueError(f"no metric for dataset {dataset!r}")
    return row["m"]


def _ranked(metrics: DataFrame, metric: str, dataset: str, datasets: list[str], deviation: float,
            missing: float | None) -> DataFrame:
    one = metrics.where(F.col("metric") == metric)
    grid = metrics.select("model").distinct().withColumn(
        "dataset", F.explode(F.array(*[F.lit(d) for d in dict.fromkeys([dataset, *datasets])])))
    value = F.col("value") if missing is None else F.coalesce("value", F.lit(missing))
    wide = grid.join(one, ["model", "dataset"], "left").select("model", "dataset", value.alias("value"))
    here = F.max(F.when(F.col("dataset") == dataset, F.col("value"))).over(Window.partitionBy("model"))
    unstable = (F.col("dataset") != dataset) & (F.abs(F.col("score") - F.col("value")) > deviation)
    per = wide.withColumn("score", here).groupBy("model").agg(
        F.max("score").alias("score"), F.count_if(unstable).alias("stability_score"))
    better = F.col("score").desc_nulls_last() if metric in HIGHER_IS_BETTER else F.col("score").asc_nulls_last()
    rank = F.row_number().over(_whole().orderBy("stability_score", better, "model"))
    role = F.when(F.col("rank") == 1, "Champion").when(F.col("rank") == 2, "Challenger").otherwise("")
    return per.withColumn("rank", rank).select(
        "rank", "model", F.lit(metric).alias("metric"), "score", "stability_score", role.alias("role"))


def choose_classifier(metrics: DataFrame, criterion: str = "ks", dataset: str = "train",
                      datasets: list[str] | None = None) -> DataFrame:
    """Models ranked by the number of unstable datasets, then by the criterion; two best are labelled."""
    metric = _usable_metric(metrics, criterion, dataset, CLASSIFICATION_ORDER)
    limit = KS_DEVIATION if metric == "ks" else CLASSIFICATION_DEVIATION
    return _ranked(metrics, metric, dataset, datasets or [], limit, None)


def choose_regressor(metrics: DataFrame, criterion: str = "rmse", dataset: str = "valid",
                     datasets: list[str] | None = None) -> DataFrame:
    """Same for regression; missing errors count as infinite, missing scores as zero."""
    metric = _usable_metric(metrics, criterion, dataset, REGRESSION_ORDER)
    missing = float("inf") if metric in ("rmse", "mae") else 0.0
    limit = REGRESSION_DEVIATION.get(metric, OTHER_DEVIATION)
    return _ranked(metrics, metric, dataset, datasets or [], limit, missing)


def choose_clusterer(metrics: DataFrame, criterion: str = "silhouette") -> DataFrame:
    """The model with the best criterion, judged on validation, else train, else test, else what there is."""
    order = F.struct(_rank_of(F.col("dataset"), CLUSTER_DATASETS), "dataset")
    score = metrics.where((F.col("metric") == criterion) & F.col("value").isNotNull()).groupBy("model").agg(
        F.min_by("value", order).alias("score"), F.min_by("dataset", order).alias("dataset"))
    better = F.col("score").asc() if criterion == "davies_bouldin" else F.col("score").desc()
    return score.withColumn("rank", F.row_number().over(_whole().orderBy(better, "model"))).withColumn(
        "selected", F.col("rank") == 1)


def overfitting_gap(train: Column, valid: Column, higher: Column) -> Column:
    """Share of the train score lost on validation (gained, for error metrics); 0 if train is 0 or missing."""
    gap = F.when(higher, train - valid).otherwise(valid - train)
    return F.coalesce(F.try_divide(gap, train), F.lit(0.0))


def gaps(metrics: DataFrame) -> DataFrame:
    """(model, metric, train, valid, gap)."""
    def at(d: str) -> Column:
        return F.max(F.when(F.col("dataset") == d, F.col("value")))
    wide = metrics.groupBy("model", "metric").agg(at("train").alias("train"), at("valid").alias("valid"))
    return wide.withColumn("gap", overfitting_gap(F.col("train"), F.col("valid"), _higher(F.col("metric"))))


def tuned_decisions(metrics: DataFrame, criterion: str, kind: str = "classification", dataset: str = "valid",
                    improvement: float | None = None, overfitting: float | None = None) -> DataFrame:
    """Default or tuned variant of every model.

    ``metrics`` has an extra column ``variant`` ('default' / 'tuned'). The score is taken on ``dataset``, else
    on train. Tuned wins only when it is better by the improvement share and does not overfit more than allowed.
    """
    improvement = IMPROVEMENT[kind] if improvement is None else improvement
    overfitting = OVERFITTING[kind] if overfitting is None else overfitting
    one = metrics.where(F.col("metric") == criterion)

    def at(variant: str, d: str) -> Column:
        return F.max(F.when((F.col("variant") == variant) & (F.col("dataset") == d), F.col("value")))

    wide = one.groupBy("model").agg(*[at(v, d).alias(f"{v}_{d}_") for v in ("default", "tuned")
                                      for d in dict.fromkeys([dataset, "train", "valid"])])
    higher = F.lit(criterion in HIGHER_IS_BETTER)

    def gap(v: str) -> Column:
        return overfitting_gap(F.col(f"{v}_train_"), F.col(f"{v}_valid_"), higher)

    wide = wide.select(
        "model",
        F.coalesce(f"default_{dataset}_", "default_train_").alias("default_score"),
        F.coalesce(f"tuned_{dataset}_", "tuned_train_").alias("tuned_score"),
        gap("default").alias("default_overfitting"), gap("tuned").alias("tuned_overfitting"))
    gain = F.when(higher, F.col("tuned_score") - F.col("default_score")).otherwise(F.col("default_score") - F.col("tuned_score"))
    pct = F.coalesce(F.try_divide(gain, F.abs("default_score")) * 100, F.lit(0.0))
    reason = (
        F.when(F.coalesce(gain, F.lit(0.0)) <= 0, "not better")
        .when(F.col("improvement_pct") < improvement * 100, "improvement below threshold")
        .when(F.col("tuned_overfitting") > F.col("default_overfitting") + overfitting, "more overfitting")
        .otherwise("improved")
    )
    return wide.withColumn("improvement_pct", pct).withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason") == "improved", "tuned").otherwise("default"))


def stability(metrics: DataFrame, metric: str, kind: str = "classification") -> DataFrame:
    """Mean, population std, cv, min, max and range of a metric over the datasets; steadiest model first."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (v != float("inf"))
    usable = metrics.where((F.col("metric") == metric) & (finite if kind == "regression" else finite & (v > 0)))
    mean = F.avg("value")
    out = usable.groupBy("model").agg(
        mean.alias("mean"), F.stddev_pop("value").alias("std"),
        F.when(mean > 0, F.stddev_pop("value") / mean).otherwise(0.0).alias("cv"),
        F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"),
        F.count("value").alias("datasets"))
    if kind == "regression":
        out = out.where(F.col("datasets") > 1)
    return out.orderBy("cv", "model")


def compare_models(metrics: DataFrame) -> DataFrame:
    """Mean, sample std, min and max of every metric over the datasets, per model."""
    return metrics.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def rank_models(metrics: DataFrame, metric: str, dataset: str) -> DataFrame:
    one = metrics.where((F.col("metric") == metric) & (F.col("dataset") == dataset))
    better = F.col("value").desc() if metric in HIGHER_IS_BETTER else F.col("value").asc()
    return one.select(F.row_number().over(_whole().orderBy(better, "model")).alias("rank"), "model", "value")


def run_summary(decisions: DataFrame) -> DataFrame:
    """Models, default / tuned choices and how often each reason decided."""
    return decisions.agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.col("decision") == "default").alias("default_chosen"),
        F.count_if(F.col("decision") == "tuned").alias("tuned_chosen"),
        F.count_if(F.col("reason") == "not better").alias("not_better"),
        F.count_if(F.col("reason") == "improvement below threshold").alias("below_threshold"),
        F.count_if(F.col("reason") == "more overfitting").alias("more_overfitting"),
        F.avg("improvement_pct").alias("avg_improvement_pct"))


def elbow(sweep: DataFrame) -> DataFrame:
    """(k, bend): the k with the largest second difference of inertia; empty below three points."""
    known = sweep.where(F.col("inertia").isNotNull())
    w = Window.partitionBy(F.lit(1)).orderBy("k")  # one row per k
    bend = F.lead("inertia").over(w) - 2 * F.col("inertia") + F.lag("inertia").over(w)
    return known.withColumn("bend", bend).where(F.col("bend").isNotNull()).orderBy(F.col("bend").desc(), "k").limit(1).select("k", "bend")


def recommend_k(sweep: DataFrame) -> DataFrame:
    """(criterion, k): best k by elbow, silhouette, Calinski-Harabasz and Davies-Bouldin."""
    def best(criterion: str, c: str, good: Column, largest: bool) -> DataFrame:
        order = [F.col(c).desc() if largest else F.col(c).asc(), F.col("k")]
        return sweep.where(good).orderBy(*order).limit(1).select(F.lit(criterion).alias("criterion"), "k")

    db = F.col("davies_bouldin")
    parts = [elbow(sweep).select(F.lit("elbow").alias("criterion"), "k"),
             best("silhouette", "silhouette", F.col("silhouette") > 0, True),
             best("calinski_harabasz", "calinski_harabasz", F.col("calinski_harabasz") > 0, True),
             best("davies_bouldin", "davies_bouldin", db.isNotNull() & (db != float("inf")), False)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
