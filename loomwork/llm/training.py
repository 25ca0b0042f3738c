"""Bounded training rows for the text classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 8


def held_out(key: Column) -> Column:
    """Rows that are never trained on: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(part, text, label) of at most ``max_rows`` labelled rows that are not held out, in ``PARTS`` parts by key hash.

    Rows are taken in the order of a hash of their key. Null keys and labels are left out; of several labels of a key
    the smallest counts. The wanted keys are few by their bound, so they go to the documents and texts stay in place.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    wanted = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(wanted), "_id").select(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(PARTS)).cast("int").alias("part"), "text", "label")
