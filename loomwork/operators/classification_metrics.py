"""Classification metrics over any frame with a 0/1 label, a prediction and a score.

``groups`` columns (model, dataset, ...) let one pass score many models on many datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.rank import ntile_of, running_sums, with_group_position, with_ntile


def _window(groups: list[str]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             groups: list[str] | None = None) -> DataFrame:
    hit = F.when(F.col(prediction) == F.col(label), 1.0).otherwise(0.0)
    return df.groupBy(*(groups or [])).agg(F.avg(hit).alias("accuracy"))


def _score_counts(df: DataFrame, label: str, score: str, groups: list[str], descending: bool) -> DataFrame:
    """Positives and negatives per distinct score with running and whole totals of the group; rows without a label count as neither."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    direction = F.col("score").desc() if descending else F.col("score").asc()
    return running_sums(counts, groups, [direction], ["pos", "neg"])


def area_under_roc(df: DataFrame, label: str = "label", score: str = "score",
                   groups: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve by rank sums over distinct scores (ties count one half)."""
    groups = groups or []
    running = _score_counts(df, label, score, groups, descending=False)
    pieces = F.col("pos") * (F.col("neg_cum") - F.col("neg") + F.col("neg") / 2.0)
    return running.groupBy(*groups).agg(
        F.try_divide(F.sum(pieces), F.sum("pos").cast("double") * F.sum("neg")).alias("roc"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               groups: list[str] | None = None) -> DataFrame:
    """One ROC point per distinct score: rows scored at or above the threshold count as positive."""
    groups = groups or []
    running = _score_counts(df, label, score, groups, descending=True)
    return running.select(
        *groups,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_cum").cast("double"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_cum").cast("double"), F.col("pos_total")).alias("tpr"),
    )


def area_under_pr(df: DataFrame, label: str = "label", score: str = "score",
                  groups: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall curve, trapezoids between distinct scores.

    The curve starts at recall 0 with the precision of the highest score.
    """
    groups = groups or []
    running = _score_counts(df, label, score, groups, descending=True)
    # the point before a row follows from its own running totals, so no lag window is needed
    prev_pos, prev_neg = F.col("pos_cum") - F.col("pos"), F.col("neg_cum") - F.col("neg")
    here = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    before = F.when(prev_pos + prev_neg == 0, here).otherwise(F.try_divide(prev_pos, prev_pos + prev_neg))
    piece = F.try_divide(F.col("pos").cast("double"), F.col("pos_total")) * (here + before) / 2.0
    return running.groupBy(*groups).agg(F.sum(piece).alias("pr"))


def decile_table(df: DataFrame, tie_break: list[str], label: str = "label", score: str = "score",
                 groups: list[str] | None = None, tiles: int = 10) -> DataFrame:
    """Gain table: rows ordered by score (highest first, then the tie-break key) cut into equal tiles."""
    groups = groups or []
    slim = df.select(*groups, *tie_break, F.col(label).cast("int").alias("_label"), F.col(score).alias("_score"))
    return _gain_table(with_ntile(slim, groups, _score_order(tie_break), tiles, drop=tie_break), groups)


def _score_order(tie_break: list[str]) -> list[Column]:
    return [F.col("_score").desc()] + [F.col(t).asc() for t in tie_break]


def _gain_table(tiled: DataFrame, groups: list[str]) -> DataFrame:
    per = tiled.groupBy(*groups, "decile").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("_label").alias("target"),
        F.sum(1 - F.col("_label")).alias("non_target"),
    )
    # at most ``tiles`` rows per group from here on
    upto = _window(groups).orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    whole = _window(groups)
    per = (
        per.withColumn("cum_target", F.sum("target").over(upto))
        .withColumn("cum_non_target", F.sum("non_target").over(upto))
        .withColumn("_t", F.sum("target").over(whole))
        .withColumn("_n", F.sum("non_target").over(whole))
    )
    share_t = F.try_divide(F.col("cum_target").cast("double"), F.col("_t"))
    share_n = F.try_divide(F.col("cum_non_target").cast("double"), F.col("_n"))
    return per.select(
        *groups, "decile", "count", "target", "non_target", "cum_target", "cum_non_target",
        F.round(F.col("target") / F.col("count") * 100, 2).alias("Pct_target"),
        F.round(share_t * 100, 2).alias("%Dist_Target"),
        F.round(share_n * 100, 2).alias("%Dist_non_Target"),
        F.round(F.abs(share_t - share_n) * 100, 2).alias("spread"),
    )


def ks_statistic(deciles: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Largest spread of a gain table, in percent with two decimals."""
    return deciles.groupBy(*(groups or [])).agg(F.max("spread").alias("ks"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     groups: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(groups or []), F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     groups: list[str] | None = None) -> DataFrame:
    """Accuracy, f1, precision and recall weighted by class frequency, from the confusion counts only."""
    groups = groups or []
    cells = confusion_counts(df, label, prediction, groups)
    per_class = cells.select(
        *groups,
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("actual"),
                     F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")),
        )).alias("e"),
    ).select(*groups, "e.*").groupBy(*groups, "cls").agg(
        F.sum("actual").alias("actual"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("claimed")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def weighted(x: Column) -> Column:
        return F.sum(x * F.col("actual")) / F.sum("actual")

    return per_class.groupBy(*groups).agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        weighted(f1).alias("f1"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
    )


def metric_matrix(df: DataFrame, tie_break: list[str], groups: list[str], datasets: list[str] | None = None,
                  dataset: str = "dataset") -> DataFrame:
    """Long table (groups..., metric, value) with roc, accuracy and ks for every group at once.

    With ``datasets`` every expected dataset appears for every other group key; absent ones get 0.0.
    """
    slim = df.select(*groups, *tie_break, F.col("label").cast("int").alias("_label"), F.col("score").alias("_score"),
                     F.when(F.col("prediction") == F.col("label"), 1).otherwise(0).alias("_hit"))
    # one range sort, written once and without the keys, serves all three metrics: positions give the tiles for ks and the rank sum for roc
    placed = with_group_position(slim, groups, _score_order(tie_break), "_rn", "_total", drop=tie_break)
    ks = ks_statistic(_gain_table(placed.withColumn("decile", ntile_of(F.col("_rn"), F.col("_total"), 10)), groups), groups)
    ties = placed.groupBy(*groups, "_score").agg(
        F.sum("_label").alias("pos"), F.sum(1 - F.col("_label")).alias("neg"), F.sum("_hit").alias("hit"),
        F.max("_rn").alias("last"), F.max("_total").alias("total"))
    # mean rank of a tie group counted from the lowest score; rank sum of the positives gives roc
    tie_rank = F.col("total") - F.col("last") + (F.col("pos") + F.col("neg") + 1) / 2.0
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    auc = ties.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("pos") * tie_rank) - p * (p + 1) / 2, p * n).alias("roc"),
        (F.sum("hit") / F.max("total")).alias("accuracy"))
    long = auc.join(ks, groups).unpivot(
        groups, ["roc", "accuracy", "ks"], "metric", "value")
    if datasets is None:
        return long
    others = [g for g in groups if g != dataset]
    wanted = long.select(*others, "metric").distinct().withColumn(
        dataset, F.explode(F.array(*[F.lit(d) for d in datasets])))
    keys = others + [dataset, "metric"]
    return wanted.join(long, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))


def multiclass_matrix(df: DataFrame, groups: list[str]) -> DataFrame:
    """Long table with the weighted multiclass metrics for every group."""
    return weighted_metrics(df, groups=groups).unpivot(
        groups, ["accuracy", "f1", "precision", "recall"], "metric", "value")
