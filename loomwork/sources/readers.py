"""Reading tables: by format, by name, and with a push-down read spec."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File extension of every supported format.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".parquet": "parquet"}


def read_csv(spark: SparkSession, path: str, *, header: bool = True, infer: bool = True, sep: str = ",",
             schema: T.StructType | None = None) -> DataFrame:
    """CSV; give ``schema`` for large inputs, inference costs a pass of its own."""
    reader = spark.read.option("header", header).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)
    return reader.csv(path)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(spark: SparkSession, path: str, *, multiline: bool = False, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet}


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> tuple[DataFrame, dict]:
    """Read a path by extension (or explicit format); rows are not counted, see ``preview``."""
    fmt = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if fmt not in READERS:
        raise ValueError(f"unsupported format of {path!r}; known: {sorted(READERS)}")
    df = READERS[fmt](spark, path, **options)
    return df, {"format": fmt, "path": path, "columns": len(df.columns)}


def load_named(spark: SparkSession, name: str) -> DataFrame:
    """A registered table or view, by name or by ``name.csv`` path."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    path = name if os.path.splitext(name)[1] else f"{name}.csv"
    return load(spark, path)[0]


@dataclass(frozen=True)
class ReadSpec:
    """What to read: sample, then filter, then columns, then limit."""

    select: list[str] | None = None
    where: str | None = None
    sample_percent: float | None = None
    limit: int | None = None
    seed: int = 42

    def apply(self, df: DataFrame) -> DataFrame:
        if self.sample_percent:
            df = df.sample(False, self.sample_percent / 100.0, self.seed)
        if self.where and self.where.strip():
            df = df.where(F.expr(self.where))
        if self.select:
            df = df.selectExpr(*self.select)
        return df.limit(self.limit) if self.limit else df

    def for_holdout(self) -> "ReadSpec":
        """Same filter and columns, but every row."""
        return replace(self, sample_percent=None, limit=None)


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in key order with the row and column count of the table."""
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return df.orderBy(*order).limit(n).withColumns({"total_rows": rows, "total_columns": F.lit(len(df.columns))})


def load_bundle(spark: SparkSession, train: tuple[str, ReadSpec], holdouts: dict[str, str]) -> dict[str, DataFrame]:
    """Train and hold-out frames; hold-outs inherit filter and columns of train."""
    path, spec = train
    frames = {"train": spec.apply(load(spark, path)[0])}
    for name, other in holdouts.items():
        frames[name] = spec.for_holdout().apply(load(spark, other)[0])
    return frames
