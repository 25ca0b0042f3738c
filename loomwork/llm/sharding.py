"""Stable shards of records by weighted rendezvous hashing. Built-in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.rank import with_group_position

SHARDS = 40
#: Hexadecimal digits of a digest that make a draw: 52 bits, exact in a double.
_DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """Whole number below 2^52 that depends on the key and the shard only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, _DIGITS), 16, 10).cast("bigint")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of each key: the one whose draw, bent by the shard's weight, wins.

    A shard's chance is its weight's share. Draws of one shard do not depend on the others, so a new shard takes keys
    only into itself, and a removed one gives away only its own. Draws are compared as weight / -log(draw); with equal
    weights, as whole numbers. Equal draws go to the lower shard. A null key has no shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    equal = len(set(weights)) == 1

    def strength(i: int) -> Column:
        d = draw(key, i)
        return d if equal else F.lit(float(weights[i])) / -F.log((d + 0.5) / float(1 << 4 * _DIGITS))

    best = F.greatest(*[F.struct(strength(i).alias("s"), F.lit(-i).alias("i")) for i in range(len(weights))]) if len(weights) > 1 else F.struct(F.lit(0).alias("i"))
    return F.when(key.isNotNull(), -best["i"]).cast("int")


def shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", n: int = SHARDS, weights: list[float] | None = None,
           columns: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those named) with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: the key as text and the shard count alone decide, so the same record is in the same shard in
    every run, and with one more shard a record either stays or moves into the new one (``grown_shard``). ``size`` is
    the text's UTF-8 bytes (null: none) plus 16, ``text_crc32`` their checksum (null: null). ``slot`` numbers a
    shard's rows from 0 in the order of key and checksum; rows equal in both take the slots in any order. Slots come
    from a range sort in which a shard spans many tasks. Rows with a null key have neither shard nor slot numbers of
    their own: they get the shard of the empty key. An empty table gives an empty result; columns of ``docs`` that
    clash with result names are replaced, any other name may be used; only the length and checksum of a text are kept,
    however long it is.
    """
    weights = [1.0] * n if weights is None else weights
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    grown = [*weights, math.fsum(weights) / len(weights)]
    text = F.col(f"`{text_col}`")
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in made]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(wanted)], (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"), key.alias("_key"))
    placed = with_group_position(rows, ["shard"], [F.col("_key"), F.col("text_crc32")], name="_place", total="_in_shard")
    return placed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(wanted)], "size", "text_crc32", "law", "shard", (F.col("_place") - 1).cast("bigint").alias("slot"), "grown_shard")
