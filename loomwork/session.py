"""Session helpers: where shared scratch tables go, when they are freed and when a table may be broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session, else a folder of the warehouse.

    On a cluster both must be visible to every executor, so a machine-local warehouse is an error there unless
    the checkpoint folder is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return f"{warehouse}/staging"


def _staged_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Remove every table this application staged; frames built on them can no longer be read."""
    _delete(spark, _staged_dir(spark))


_SCOPES: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Free at the end whatever was staged inside, except tables handed out with ``keep``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def keep(df: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Let a staged table, or the one that ``df`` reads, outlive the current ``staging`` scope: it passes to the enclosing one."""
    df._staged_path = _path_of(df if staged is None else staged)
    if _SCOPES:
        path = _path_of(df)
        if path in _SCOPES[-1]:
            _SCOPES[-1].remove(path)
            if len(_SCOPES) > 1:
                _SCOPES[-2].append(path)
    return df


def unstage(df: DataFrame | None) -> None:
    """Delete a staged table that nothing reads any more."""
    path = None if df is None else _path_of(df)
    if path:
        _delete(df.sparkSession, path)
        for scope in _SCOPES:
            if path in scope:
                scope.remove(path)


def _path_of(df: DataFrame) -> str | None:
    return getattr(df, "_staged_path", None)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Used where a table feeds several passes that must see identical rows (range bounds are sampled, so a
    recomputed range shuffle may cut elsewhere) and to cut lineage in loops. The copy outlives executors.
    """
    spark = df.sparkSession
    path = f"{_staged_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows by key before many training passes: one shuffle, then equal work for every task."""
    return df.repartition(shuffle_width(df.sparkSession), *keys)


#: Rows of one task in a fit that keeps its rows in memory.
TASK_ROWS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew where a partition has more than ``TASK_ROWS`` rows, so that tasks do not grow with the table."""
    found = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.sum("count")).first()
    return df if (found[0] or 0) <= TASK_ROWS else df.repartition(max(shuffle_width(df.sparkSession), -(-found[1] // TASK_ROWS)))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint when the table is counted to be small; otherwise leave the join choice to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_small(df: DataFrame, small: DataFrame, keys: list[str], max_rows: int = 100_000) -> DataFrame:
    """Attach a per-key table to a large one (inner, null-safe).

    The small table is written and counted first: up to ``max_rows`` it is broadcast and the large side stays
    where it is; beyond that Spark joins by shuffle.
    """
    small = stage(small, "per_key").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(broadcast_if_small(small, max_rows), same).drop(*[f"_k_{k}" for k in keys])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table on every row; the row is a subquery, so nothing is joined."""
    held = row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("r")).scalar()
    return df.select("*", held.alias("_row")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_row.`{c}`") for c in row.columns])
