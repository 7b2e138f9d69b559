"""Token components, safe numbers and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed

COMPONENTS = ("fresh_input", "cache_read", "cache_write", "output")


def token_total(*parts: str | Column) -> Column:
    """Sum of components, a missing one counting as 0."""
    total = F.lit(0).cast("bigint")
    for part in parts or COMPONENTS:
        column = F.col(part) if isinstance(part, str) else part
        total = total + F.coalesce(column.cast("bigint"), F.lit(0).cast("bigint"))
    return total


def components_from_inclusive(df: DataFrame, input_: str, cache_read: str, output: str) -> DataFrame:
    """Split a cache-inclusive input count; such a log has no cache writes."""
    zero = F.lit(0).cast("bigint")
    inclusive, cached, out = (F.coalesce(F.col(c).cast("bigint"), zero) for c in (input_, cache_read, output))
    return df.withColumns(
        {
            "fresh_input": inclusive - cached,
            "cache_read": cached,
            "cache_write": zero,
            "output": out,
            "tokens": inclusive + out,
        }
    )


def components_from_split(df: DataFrame, input_: str, cache_read: str, cache_write: str, output: str) -> DataFrame:
    """Take four separately counted components."""
    zero = F.lit(0).cast("bigint")
    parts = [F.coalesce(F.col(c).cast("bigint"), zero) for c in (input_, cache_read, cache_write, output)]
    out = dict(zip(COMPONENTS, parts))
    out["tokens"] = parts[0] + parts[1] + parts[2] + parts[3]
    return df.withColumns(out)


def safe_integer(text: str | Column, default: int | None = 0) -> Column:
    """Text as a whole number in 0 … 2^53-1; null when it is not one; blank gives the default."""
    column = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(column.cast("string"), F.lit(fixed.TRIM_CHARS))
    number = trimmed.try_cast("decimal(38,9)")
    whole = number.between(0, fixed.MAX_SAFE_INTEGER) & (number == F.floor(number))
    parsed = F.when(whole, number.try_cast("bigint"))
    blank = column.isNull() | (trimmed == "")
    return F.when(blank, F.lit(default).cast("bigint")).otherwise(parsed)


def safe_amount(text: str | Column, default: int | None = 0) -> Column:
    """Text as a non-negative amount, kept as a decimal; null when it is not one."""
    column = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(column.cast("string"), F.lit(fixed.TRIM_CHARS))
    number = trimmed.try_cast("decimal(28,9)")
    blank = column.isNull() | (trimmed == "")
    return F.when(blank, F.lit(default).cast("decimal(28,9)")).when(number >= 0, number)


def round_half_up(value: str | Column, digits: int = 2) -> Column:
    """Half-up rounding of a double after adding the double epsilon."""
    column = F.col(value) if isinstance(value, str) else value
    factor = float(10**digits)
    return F.floor((column.cast("double") + F.lit(fixed.JS_EPSILON)) * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def round9(value: str | Column) -> Column:
    """Amount fixed to nine decimals."""
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("decimal(38,9)")


def as_double(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def record_weight(calls: str | Column) -> Column:
    """Calls of an exported record; a missing or non-positive count weighs 1."""
    column = F.col(calls) if isinstance(calls, str) else calls
    return F.when(column > 0, column.cast("bigint")).otherwise(F.lit(1).cast("bigint"))
