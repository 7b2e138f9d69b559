"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder)`` under a name; ``sql`` is what DuckDB runs to check it."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(build(tune(spark), folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Columns as plain values: dates and times as text, amounts as doubles, whole numbers as bigint."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(f"`{field.name}`")
        if kind == "date":
            column = column.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")
        elif kind.startswith("decimal"):
            column = column.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("bigint")
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        out.append(column.alias(field.name))
    return df.select(*out)


def sql_round(expression: str, digits: int) -> str:
    """The half-up rounding rule in SQL."""
    return f"floor((CAST({expression} AS DOUBLE) + 2.220446049250313e-16) * 1e{digits} + 5e-1) / 1e{digits}"


def sql_time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%g')"
