"""Query of the periodic runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm.periods import periodic_runs
from loomwork.llm.registry import query, table


def with_repeats(docs):
    """``docs`` in which the end of every tenth text, by a hash of its key, is replaced by repetitions of some of its words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    ws = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))
    chosen = docs.withColumn("_h", h).withColumn("_ws", F.when(F.col("_h") % 10 == 0, ws)).withColumn("_n", F.size("_ws"))
    g = F.floor(F.col("_h") / 10)
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    place = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    repeated = F.array_join(F.transform(place, lambda i: F.get("_ws", i.cast("int"))), " ")
    return chosen.withColumn("text", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text"))).drop("_h", "_ws", "_n", "_a", "_p")


@query("op13_periodic_runs")
def periodic_run_detection(spark, folder):
    found = periodic_runs(with_repeats(table(spark, folder, "documents").select("doc_id", "text")), columns=["doc_id"])
    # the greatest exponent first: quotients of numbers this small differ as doubles wherever they differ
    order = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", F.array_min(order))
    return best.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
