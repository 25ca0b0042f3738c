"""Scoring of files as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from loomwork.operators.score import scored_rows
from loomwork.sources.sinks import load_model


def score_arrivals(spark: SparkSession, model_path: str, source: str, schema: StructType, output: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Score the Parquet files of ``source`` that no earlier call with this ``checkpoint`` has scored; returns their rows.

    The call ends when all files present are scored. The checkpoint remembers the files; the log of the written folder makes
    a batch that is repeated after a failure count once, so ``output`` holds every row once when it is read by Spark. All
    three folders must be reachable by all executors. Files are taken in batches, so memory does not follow their number;
    an empty or unchanged folder scores nothing. Rows are scored as ``score`` does.
    """
    model, info = load_model(spark, model_path)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = (scored_rows(arriving, model, info).writeStream.format("parquet").option("path", output)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
