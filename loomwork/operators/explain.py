"""Sampled Shapley values as one Spark job.

Every explained row meets background rows drawn for it, in a feature order drawn from the hash of the pair.
Walking along that order from the background row to the explained row changes one feature at a time, and the
change of the score is that feature's contribution. All steps of all rows are scored by one ``transform``.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import key_bucket
from loomwork.operators.rank import with_position
from loomwork.session import stage

#: Numbers of a background that may travel to every task; the draws of all rows never do.
BACKGROUND_DOUBLES = 1_000_000


def model_score(df: DataFrame, probability: bool = True) -> Column:
    """Probability of the positive class where there is one, else the prediction."""
    if probability and "probability" in df.columns:
        return vector_to_array("probability")[1]
    return F.col("prediction").cast("double")


def background_draws(rows: DataFrame, background: DataFrame, features: list[str], keys: list[str], draws: int = 10,
                     seed: int = 42) -> DataFrame:
    """(keys..., x, b, bg): ``draws`` background rows for every row, spread evenly over the whole background.

    The hash of a row's key says where in the (hashed) order of the background its draws begin; they follow at equal
    distances, so all background rows take part and as many draws as background rows are each of them once.
    """
    def numbers(df: DataFrame) -> Column:
        return F.array(*[F.col(f).cast("double") for f in features])

    table = background.select(numbers(background).alias("bg"))
    table = stage(with_position(table, [F.xxhash64(F.lit(seed), "bg"), F.col("bg")], "at"), "background")
    total = table.count()
    draws = min(draws, total)
    if not draws:
        raise ValueError("the background is empty")
    start = F.floor(key_bucket([F.col(k) for k in keys], seed) * total)
    picks = rows.select(*keys, numbers(rows).alias("x"), start.alias("_start"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    place = (F.col("_start") + F.floor(F.col("b") * F.lit(total) / F.lit(draws))) % F.lit(total) + 1
    # a table of draws looks small to the planner, which does not count what explode makes of it
    placed = F.broadcast(table) if total * len(features) <= BACKGROUND_DOUBLES else table.hint("merge")
    return picks.withColumn("at", place).join(placed, "at").select(*keys, "x", "b", "bg")


def shapley_values(model: Transformer, rows: DataFrame, background: DataFrame, features: list[str], keys: list[str],
                   background_rows: int = 10, seed: int = 42, probability: bool = True) -> DataFrame:
    """(keys..., feature, phi). Per row the contributions add up to score(row) - mean score of its background draws.

    ``background_rows`` is the number of draws per explained row, see ``background_draws``.
    """
    width = len(features)
    pairs = background_draws(rows, background, features, keys, background_rows, seed)
    tickets = F.array_sort(F.array(*[
        F.struct(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], "b", F.lit(i)).alias("h"), F.lit(i).alias("f"))
        for i in range(width)]))
    ordered = pairs.withColumn("order", F.transform(tickets, lambda t: t["f"]))
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    taken = F.slice(F.col("order"), F.lit(1), F.col("step"))
    mixed = steps.select(
        *keys, "order", "step",
        *[F.when(F.array_contains(taken, i), F.col("x")[i]).otherwise(F.col("bg")[i]).alias(f) for i, f in enumerate(features)])
    scored = model.transform(mixed)
    scored = scored.select(*keys, "order", "step", model_score(scored, probability).alias("score"))
    # the score after a step counts for the feature just added and against the feature added next
    gain = F.struct(F.element_at("order", F.greatest(F.col("step"), F.lit(1))).alias("f"),
                    F.when(F.col("step") >= 1, F.col("score")).otherwise(0.0).alias("v"))
    loss = F.struct(F.element_at("order", F.least(F.col("step") + 1, F.lit(width))).alias("f"),
                    F.when(F.col("step") < width, -F.col("score")).otherwise(0.0).alias("v"))
    names = F.array(*[F.lit(f) for f in features])
    used = F.lit(min(background_rows, background.count()))
    return scored.select(*keys, F.explode(F.array(gain, loss)).alias("e")).groupBy(
        *keys, names[F.col("e.f")].alias("feature")).agg(F.sum("e.v").alias("total")).select(
        *keys, "feature", (F.col("total") / used).alias("phi"))


def mean_absolute(phi: DataFrame) -> DataFrame:
    """Global importance: mean absolute contribution of every feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.col("importance").desc(), "feature")
