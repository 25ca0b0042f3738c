"""Column expressions shared by the operators (all JVM side)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that stand for "missing" in a numeric text column.
MISSING_TEXT = ["?", "NA", "NULL"]

# Text patterns of dates and of unix times.
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{2}-\d{2}-\d{4}",
]
UNIX_TIME_PATTERN = r"^\d{10,13}$"

# Hash encoding range and the code of a missing string.
HASH_RANGE = 1000000
HASH_MISSING = -999


def is_missing(name: str, dtype: T.DataType) -> Column:
    """Null, blank string, or NaN — whichever the type allows."""
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def text_to_number(c: Column) -> Column:
    """Numeric text cleaned to double; blanks, placeholders and unparsable text become null."""
    trimmed = F.trim(c)
    blank = c.isNull() | (trimmed == "") | trimmed.isin(*MISSING_TEXT)
    digits = F.regexp_replace(trimmed, r"[^0-9.\-]", "")
    return F.when(~blank, digits.try_cast("double"))


def hash_code(c: Column, positive: bool = False) -> Column:
    """Hash encoding of a string. The remainder keeps the sign of the hash unless ``positive``."""
    h = F.hash(c)
    code = F.pmod(h, F.lit(HASH_RANGE)) if positive else h % HASH_RANGE
    return F.when(c.isNotNull() & (c != ""), code.cast("int")).otherwise(F.lit(HASH_MISSING))


def looks_like_date(c: Column) -> Column:
    text = c.cast("string")
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in DATE_PATTERNS]) | text.rlike(UNIX_TIME_PATTERN)


def positive_probability(probability: Column, position: int = 1) -> Column:
    return vector_to_array(probability)[position]


def key_bucket(keys: list[Column], seed: int | str) -> Column:
    """Uniform number in [0, 1) from the row key: the same whatever the partitioning.

    First eight hex digits of ``md5(key1|key2|...|seed)`` over 2**32.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; null when a side is constant (the built-in one raises in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _poly(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


# Acklam's published rational approximation of the inverse normal distribution.
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0]
PPF_LOW = 0.02425


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1 (relative error about 1e-9)."""
    centre = p - 0.5
    r = centre * centre
    middle = _poly(r, PPF_A) * centre / _poly(r, PPF_B)
    low_q = F.sqrt(-2.0 * F.ln(p))
    high_q = F.sqrt(-2.0 * F.ln(1.0 - p))
    low = _poly(low_q, PPF_C) / _poly(low_q, PPF_D)
    high = -_poly(high_q, PPF_C) / _poly(high_q, PPF_D)
    return F.when(p < PPF_LOW, low).when(p > 1.0 - PPF_LOW, high).otherwise(middle)
