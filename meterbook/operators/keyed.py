"""Joins on key columns and totals attached to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that matches null keys with null keys and keeps the left keys.

    ``<=>`` is planned as a hash or sort-merge join like ``=``.
    """
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def full_keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer form; the keys come from whichever side has the row."""
    marked = left.withColumn("_in_left", F.lit(True))
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    renamed = renamed.withColumn("_in_right", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = marked.join(renamed, on, "full")
    merged = {k: F.when(F.col("_in_left"), F.col(k)).otherwise(F.col(f"_right_{k}")) for k in keys}
    joined = joined.withColumns(merged).drop(*[f"_right_{k}" for k in keys])
    return joined.withColumns(
        {
            "_in_left": F.coalesce("_in_left", F.lit(False)),
            "_in_right": F.coalesce("_in_right", F.lit(False)),
        }
    )


def summarise(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """One row for the table, or one per key."""
    named = [expression.alias(name) for name, expression in aggregates.items()]
    return df.groupBy(*by).agg(*named) if by else df.agg(*named)


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Put the columns of a summary next to every row.

    Without keys the summary is a single row and becomes a scalar subquery, so
    nothing is shuffled or cross joined.  With keys it is an ordinary left join.
    """
    names = [c for c in totals.columns if c not in by]
    if by:
        return keyed_join(df, totals, by)
    packed = totals.select(F.struct(*names).alias("totals")).scalar()
    return df.withColumns({n: packed.getField(n) for n in names})


def columns_of(by: Sequence[str], *names: str) -> list[str]:
    return [*by, *names]
