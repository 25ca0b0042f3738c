"""Mixing a corpus to target shares: iterative proportional fitting of token weights, then calibrated sampling.

Built-in DataFrame functions only; cells and category factors stay in tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import broadcast_if_small, keep, stage, staging

DIMENSIONS = ("source", "lang", "topic")
#: Target share of a category: its tokens to this power, made to add up to 1. 1 keeps the corpus as it is.
TEMPER = 0.9
ROUNDS = 12
#: Topics by rules on the text (SQL over ``text``), the first that holds; the rest is ``DEFAULT_TOPIC``.
TOPICS = (
    ("legal", "contains(text, 'icense') or contains(text, 'opyright')"),
    ("tabular", "contains(text, ' | ')"),
    ("contact", "contains(text, '@')"),
)
DEFAULT_TOPIC = "prose"
MISSING = "(none)"
SEED = "mix"


def with_topic(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """``docs`` with ``topic``; a null text has the default topic."""
    return docs.withColumn("topic", F.expr("CASE " + " ".join(f"WHEN {c} THEN '{t}'" for t, c in topics) + f" ELSE '{DEFAULT_TOPIC}' END"))


def tokens(text: Column) -> Column:
    """Weight of a text: its UTF-8 bytes, at least 1, so that every document belongs to a cell with a weight."""
    return F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("bigint")


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """(category, target): target shares from the corpus itself, flattened by ``power``."""
    sizes = cells.groupBy(F.col(dimension).alias("category")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    return sizes.select("category", (F.col("p") / sizes.agg(F.sum("p")).scalar()).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (one row per combination, ``tokens``) with ``weight``: factors that bring every margin to its target.

    A round scales each dimension in turn: every category by its target share of all tokens over its weighted tokens.
    Categories without a target get weight 0, targets without tokens are left out and the rest is scaled up. Cells are
    sums already, one row per combination however many documents it has. A margin is summed in the tasks before it is
    shuffled, so no task gathers the cells of a category, and every round is written.
    """
    all_tokens = cells.agg(F.sum("tokens").cast("double")).scalar()
    current = cells.withColumn("weight", F.lit(1.0))
    for d, table in targets.items():
        have = table.join(cells.select(F.col(d).alias("category")).distinct(), "category", "left_semi")
        goal = have.select(F.col("category").alias(d), (F.col("target") / have.agg(F.sum("target")).scalar() * all_tokens).alias(f"_goal_{d}"))
        current = current.join(goal, d, "left")
    current = stage(current, "raked")
    for _ in range(rounds):
        for d in targets:
            margin = current.groupBy(d).agg(F.sum(F.col("weight") * F.col("tokens")).alias("_margin"))
            factor = F.when(F.col("_margin") > 0, F.coalesce(f"_goal_{d}", F.lit(0.0)) / F.col("_margin")).otherwise(0.0)
            current = current.join(margin, d).withColumn("weight", F.col("weight") * factor).drop("_margin")
        current = stage(current, "raked")
    return current.select(*cells.columns, "weight")


def mixed(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", targets: dict[str, DataFrame] | None = None,
          rounds: int = ROUNDS, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those named) with topic, tokens, weight, probability and sampled.

    Weights are raked over (source, language, topic) cells to the target shares (``tempered`` unless given). The
    sampling probability is weight over the largest weight, so expected shares equal the raked ones and no document
    is wanted more than once; a document is sampled if a number drawn from its key lies below its probability, which
    makes the sample the same in every run. Only cells are shuffled, summed before they travel: a source with a third
    of all rows is as cheap as any other. A missing source or language is a category of its own; a null key draws as
    the empty key; equal keys draw equal numbers; an empty table gives an empty result; columns of ``docs`` that clash
    with result names are replaced.
    """
    made = ("topic", "tokens", "weight", "probability", "sampled")
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in made]
    text = F.col(f"`{text_col}`")
    cell = with_topic(docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(wanted)], F.col(f"`{key_col}`").cast("string").alias("_key"), text.alias("text"),
                                  *[F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias(d) for d in DIMENSIONS[:2]]))
    cell = cell.withColumn("tokens", tokens(F.col("text"))).drop("text")
    with staging(docs.sparkSession):
        cells = stage(cell.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
        if targets is None:
            targets = {d: tempered(cells, d) for d in DIMENSIONS}
        weights = raked(cells, targets, rounds)
        largest = weights.agg(F.max("weight")).scalar()
        weights = weights.select(*DIMENSIONS, "weight", F.when(largest > 0, F.col("weight") / largest).otherwise(0.0).alias("probability"))
        weights = keep(stage(weights, "weights"))
    return cell.join(broadcast_if_small(weights, 20_000), list(DIMENSIONS)).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(wanted)], "topic", "tokens", "weight", "probability",
        (unit(F.coalesce("_key", F.lit(""))) < F.col("probability")).alias("sampled"))


def unit(key: Column) -> Column:
    """Number in [0, 1) drawn from a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), key)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
