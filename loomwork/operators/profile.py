"""Table and column profiling: one aggregate over all columns instead of one job per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.columns import is_missing, looks_like_date
from loomwork.session import with_row

# Name fragments of date columns.
DATE_NAME_PARTS = ["date", "time", "dt_", "_dt", "timestamp"]
DATE_SHARE = 0.5

# Row counts below which a table is small / medium, and the sampling fraction of each class.
SMALL_ROWS, MEDIUM_ROWS = 10_000, 100_000
SAMPLING = {"small": 1.0, "medium": 0.3, "large": 0.1}

# Megabytes below which a table is small / medium / large, and byte widths of fixed-size types.
SMALL_MB, MEDIUM_MB, LARGE_MB = 100, 1_000, 10_000
TYPE_BYTES = {"int": 4, "bigint": 8, "double": 8, "boolean": 1, "binary": 64}
OTHER_BYTES = 16


def _long(df: DataFrame, values: dict[str, Column], key: str, value: str) -> DataFrame:
    """One aggregated row turned into (key, value) rows."""
    return df.agg(*[e.alias(n) for n, e in values.items()]).unpivot([], list(values), key, value)


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, missing, rows, ratio) for every column from one aggregate."""
    columns = columns or df.columns
    packed = [
        F.struct(F.count_if(is_missing(c, df.schema[c].dataType)).alias("missing"),
                 F.count(F.lit(1)).alias("rows")).alias(c)
        for c in columns
    ]
    return df.agg(*packed).unpivot([], columns, "column", "v").select(
        "column", F.col("v.missing").alias("missing"), F.col("v.rows").alias("rows"),
        F.try_divide(F.col("v.missing").cast("double"), F.col("v.rows")).alias("ratio"))


def columns_below_missing(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Columns whose missing share is at most ``threshold``."""
    return missing_counts(df).where(F.coalesce("ratio", F.lit(0.0)) <= threshold)


def feature_names(columns: list[str], target: str | None = None, *, include: list[str] = (),
                  include_prefix: list[str] = (), include_suffix: list[str] = (), exclude: list[str] = (),
                  exclude_prefix: list[str] = (), exclude_suffix: list[str] = ()) -> list[str]:
    """Feature columns after the include rules, then the exclude rules; the column order is kept.

    Rules of different kinds are intersected; several prefixes (or suffixes) of one kind are alternatives.
    """
    def wanted(c: str) -> bool:
        if c == target or c in exclude:
            return False
        if (include and c not in include) or (include_prefix and not c.startswith(tuple(include_prefix))):
            return False
        if include_suffix and not c.endswith(tuple(include_suffix)):
            return False
        return not (c.startswith(tuple(exclude_prefix)) or c.endswith(tuple(exclude_suffix)))

    return [c for c in columns if wanted(c)]


def variable_types(df: DataFrame, columns: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(categorical, numerical): strings and everything else."""
    columns = columns or df.columns
    text = [c for c in columns if isinstance(df.schema[c].dataType, (T.StringType, T.VarcharType, T.CharType))]
    return text, [c for c in columns if c not in text]


def date_like_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, reason) of columns that hold dates, by type or by name plus content.

    Content is judged by the share of date-like values among all non-null values of name-matched columns.
    """
    columns = columns or df.columns
    typed = [c for c in columns
             if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    named = [c for c in columns if c not in typed and any(p in c.lower() for p in DATE_NAME_PARTS)]
    spark = df.sparkSession
    out = spark.createDataFrame([(c, "type") for c in typed], "column string, reason string")
    if not named:
        return out
    share = {c: F.avg(F.when(F.col(c).isNotNull(), F.when(looks_like_date(F.col(c)), 1.0).otherwise(0.0))) for c in named}
    judged = _long(df.select(*named), share, "column", "share")
    return out.unionByName(judged.where(F.col("share") > DATE_SHARE).select("column", F.lit("pattern").alias("reason")))


def drop_date_columns(df: DataFrame, columns: list[str]) -> list[str]:
    dates = {r["column"] for r in date_like_columns(df, columns).collect()}
    return [c for c in columns if c not in dates]


def clean_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a usable numeric target; a text target is cast, unparsable text is dropped."""
    if isinstance(df.schema[target].dataType, T.StringType):
        kept = df.where(F.col(target).isNotNull() & (F.trim(target) != ""))
        kept = kept.withColumn(target, F.col(target).try_cast("double"))
        return kept.where(F.col(target).isNotNull() & ~F.isnan(target))
    return df.where(~is_missing(target, df.schema[target].dataType)).withColumn(target, F.col(target).cast("double"))


@dataclass
class TargetCoder:
    """How a regression target becomes a number; fitted on the training rows, applied alike to every dataset."""

    target: str
    index: StringIndexerModel | None

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows with a usable target; a text target keeps its number or gets the index of its text."""
        if self.index is None:
            return clean_target(df, self.target)
        present = df.where(F.col(self.target).isNotNull() & (F.trim(self.target) != ""))
        return self.index.transform(present).drop(self.target).withColumnRenamed("_index", self.target)

    def dropped(self, df: DataFrame) -> DataFrame:
        """(rows, dropped): how many rows have no usable target."""
        kept = self.apply(df).agg(F.count(F.lit(1)).alias("kept"))
        return with_row(df.agg(F.count(F.lit(1)).alias("rows")), kept).select("rows", (F.col("rows") - F.col("kept")).alias("dropped"))


def fit_target(df: DataFrame, target: str, most_lost: float = 0.5) -> TargetCoder:
    """A text target is numeric unless more than ``most_lost`` of its values are no numbers; then it is indexed by frequency.

    Values that the index has not seen are left out where it is applied; ``TargetCoder.dropped`` counts them.
    """
    if not isinstance(df.schema[target].dataType, T.StringType):
        return TargetCoder(target, None)
    present = df.where(F.col(target).isNotNull() & (F.trim(target) != ""))
    lost = present.agg(F.avg(F.col(target).try_cast("double").isNull().cast("double"))).first()[0]
    if lost is None or lost <= most_lost:
        return TargetCoder(target, None)
    return TargetCoder(target, StringIndexer(inputCol=target, outputCol="_index", handleInvalid="skip").fit(present))


def numeric_or_indexed_target(df: DataFrame, target: str, most_lost: float = 0.5) -> DataFrame:
    """The rows with a usable target, coded by themselves."""
    return fit_target(df, target, most_lost).apply(df)


def table_summary(df: DataFrame) -> DataFrame:
    """(position, column, dtype, rows, columns): schema rows joined with the row count."""
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    fields = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    names = df.sparkSession.createDataFrame(fields, "position int, column string, dtype string")
    return names.select("position", "column", "dtype", rows.alias("rows"), F.lit(len(fields)).alias("columns"))


def size_class(rows: Column) -> Column:
    return (
        F.when(rows < SMALL_ROWS, "small").when(rows < MEDIUM_ROWS, "medium").otherwise("large")
    )


def size_report(df: DataFrame) -> DataFrame:
    """Rows, size class and the sampling fraction for feature selection."""
    counted = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("size_class", size_class(F.col("rows")))
    c = F.col("size_class")
    fraction = F.when(c == "small", SAMPLING["small"]).when(c == "medium", SAMPLING["medium"]).otherwise(SAMPLING["large"])
    return counted.withColumn("sampling_fraction", fraction)


def width_profile(df: DataFrame) -> DataFrame:
    """(column, width, rows, est_mb): text width is the mean of average and maximum length."""
    def width(c: str) -> Column:
        t = df.schema[c].dataType
        if isinstance(t, T.StringType):
            return F.coalesce((F.avg(F.length(c)) + F.max(F.length(c))) / 2.0, F.lit(0.0))
        return F.max(F.lit(float(TYPE_BYTES.get(t.simpleString(), OTHER_BYTES))))

    packed = [F.struct(width(c).alias("w"), F.count(F.lit(1)).alias("n")).alias(c) for c in df.columns]
    return df.agg(*packed).unpivot([], df.columns, "column", "v").select(
        "column", F.col("v.w").alias("width"), F.col("v.n").alias("rows"),
        (F.col("v.w") * F.col("v.n") / (1024.0 * 1024.0)).alias("est_mb"))


def size_category(profile: DataFrame) -> DataFrame:
    """Estimated megabytes of the table and their class."""
    mb = F.col("est_mb")
    return profile.agg(F.sum("est_mb").alias("est_mb")).withColumn(
        "category", F.when(mb < SMALL_MB, "small").when(mb < MEDIUM_MB, "medium").when(mb < LARGE_MB, "large")
        .otherwise("huge"))


def complexity_score(df: DataFrame, high_cardinality: int = 1000, approximate: bool = False) -> DataFrame:
    """min(1, 0.1 per text column + 0.2 per text column with many values + 0.1 per distinct type)."""
    text, _ = variable_types(df)
    types = len({f.dataType.simpleString() for f in df.schema})
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = sum([F.when(count(F.col(c)) > high_cardinality, 1).otherwise(0) for c in text], F.lit(0))
    return df.agg(wide.alias("high_cardinality_columns")).select(
        F.lit(len(text)).alias("text_columns"), "high_cardinality_columns", F.lit(types).alias("types"),
        F.least(F.lit(1.0), 0.1 * len(text) + 0.2 * F.col("high_cardinality_columns") + 0.1 * types).alias("score"))


def task_kind(df: DataFrame, target: str) -> DataFrame:
    """Number of classes, binary or multiclass, and the model criterion that fits."""
    return df.groupBy(F.col(target)).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.count(F.lit(1)).alias("classes")
    ).select("classes", F.when(F.col("classes") > 2, "multiclass").otherwise("binary").alias("kind"),
             F.when(F.col("classes") > 2, "accuracy").otherwise("ks").alias("criterion"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, distinct); a null counts as one value, as a plain distinct does.

    The exact form deduplicates (column, value) pairs with map-side combine and then counts pairs, so a
    column with billions of values is spread over all tasks.
    """
    if approximate:
        agg = {c: F.approx_count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int")) for c in columns}
        return _long(df, agg, "column", "distinct")
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return pairs.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def cardinality_roles(df: DataFrame, columns: list[str], to_number_above: int = 50,
                      drop_above: int = 200) -> DataFrame:
    """(column, distinct, role): keep as category, hash to a number, and whether it may be index-encoded."""
    d = F.col("distinct")
    return distinct_counts(df, columns).select(
        "column", "distinct",
        F.when(d > to_number_above, "numeric").otherwise("categorical").alias("role"),
        (d <= drop_above).alias("encodable"))


def suggest_target(df: DataFrame, task: str) -> DataFrame:
    """One row (column): two-valued, else text column for classification; first numeric for regression; else last."""
    text, _ = variable_types(df)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    last = df.columns[-1]
    if task == "regression":
        return df.sparkSession.createDataFrame([((numeric or [last])[0],)], "column string")
    return two_valued(df).agg(F.min_by("column", "position").alias("column")).select(
        F.coalesce("column", F.lit((text or [last])[0])).alias("column"))


def two_valued(df: DataFrame) -> DataFrame:
    """(column, position) of columns with exactly two values, null counting as one.

    A column has two values when every row equals its minimum, its maximum or null: two plain aggregates,
    no distinct values are shuffled.
    """
    df = df.select(*[f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))])
    ends = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in df.columns])
    packed = ends.select(F.struct("*").alias("e")).scalar()
    facts = [F.struct(
        F.count_if((F.col(c) != F.col(f"_e.{c}.lo")) & (F.col(c) != F.col(f"_e.{c}.hi"))).alias("between"),
        F.max(F.col(c).isNull().cast("int")).alias("nulls"),
        F.max((F.col(f"_e.{c}.lo") != F.col(f"_e.{c}.hi")).cast("int")).alias("spread"),
        F.count(c).alias("known")).alias(c) for c in df.columns]
    values = F.when(F.col("v.known") == 0, 0).otherwise(1 + F.col("v.spread")) + F.col("v.nulls")
    position = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    return df.withColumn("_e", packed).agg(*facts).unpivot([], df.columns, "column", "v").where(
        (F.col("v.between") == 0) & (values == 2)).select("column", position[F.col("column")].alias("position"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, count, share, role, classes): role marks the smallest and the largest class."""
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    ends = counts.agg(F.struct(
        F.sum("count").alias("total"), F.count(F.lit(1)).alias("classes"),
        F.min(F.struct("count", "class")).alias("low"), F.max(F.struct("count", "class")).alias("high")).alias("e")).scalar()
    role = F.when(F.col("class") == F.col("e.low.class"), "minority").when(
        F.col("class") == F.col("e.high.class"), "majority").otherwise("other")
    return counts.withColumn("e", ends).select(
        "class", "count", (F.col("count") / F.col("e.total")).alias("share"), role.alias("role"),
        F.col("e.classes").alias("classes"))


def imbalance(df: DataFrame, target: str, threshold: float = 0.05) -> DataFrame:
    """Whether any class holds less than ``threshold`` of the rows."""
    return class_distribution(df, target).agg(
        F.min("share").alias("smallest_share"),
        F.count_if(F.col("share") < threshold).alias("classes_below"),
        (F.min("share") < threshold).alias("imbalanced"))
