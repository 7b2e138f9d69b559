"""Date series: days, months, running totals, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterbook.functions.timeparts import days_in_month, month_key
from meterbook.functions.tokens import COMPONENTS, as_double, round_half_up
from meterbook.operators.keyed import keyed_join

MEASURES = ("cost", "calls", *COMPONENTS)


def component_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COMPONENTS]


def daily_totals(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost, calls, distinct sessions and components per local date."""
    return usage.groupBy(*by, "date").agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        F.countDistinct("session").alias("sessions"),
        *component_sums(),
    ).withColumn("tokens", sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0])))


def zero_fill(
    daily: DataFrame,
    by: Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
    date: str = "date",
    blank: Sequence[str] = (),
) -> DataFrame:
    """One row per calendar date: every gap is filled from the row before it.

    Each row spans the dates up to its successor, so the axis needs neither a
    second pass over the data nor a join.  ``start``/``end`` widen the axis;
    ``blank`` columns are null on added days, all others 0.
    """
    neighbours = W.partitionBy(*by).orderBy(date)
    placed = daily.withColumns({"_previous": F.lag(date).over(neighbours), "_next": F.lead(date).over(neighbours)})
    # least/greatest skip nulls: an axis end inside the data changes nothing
    widened = F.least(F.lit(start).cast("date"), F.col(date))
    axis_from = F.when(F.col("_previous").isNull(), widened).otherwise(F.col(date))
    axis_to = F.coalesce(F.date_sub("_next", 1), F.greatest(F.lit(end).cast("date"), F.col(date)))
    spread = placed.withColumn("_day", F.explode(F.sequence(axis_from, axis_to)))
    here = F.col("_day") == F.col(date)
    values = [c for c in daily.columns if c not in by and c != date]
    filled = [
        (F.when(here, F.col(c)) if c in blank else F.when(here, F.col(c)).otherwise(F.lit(0)))
        .cast(daily.schema[c].dataType)
        .alias(c)
        for c in values
    ]
    return spread.select(*by, F.col("_day").alias(date), *filled)


def running_cost(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    upto = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("cumulative_cost", round_half_up(F.sum("cost").over(upto), 2))


def with_account(daily: DataFrame, account: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Account tokens next to the local days: null where the account has no bucket."""
    series = account.select(*by, "date", F.col("tokens").alias("account_tokens"))
    return keyed_join(daily, series, [*by, "date"])


def running_account(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    upto = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn(
        "cumulative_account_tokens", F.sum(F.coalesce("account_tokens", F.lit(0))).over(upto)
    )


def account_with_local(account: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Account buckets with the local day beside them; a missing local day is 0."""
    local = daily.select(*by, "date", F.col("tokens").alias("local_tokens"), F.col("calls").alias("local_calls"))
    joined = keyed_join(account.select(*by, "date", F.col("tokens").alias("account_tokens")), local, [*by, "date"])
    return joined.fillna(0, ["local_tokens", "local_calls"])


def monthly_totals(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Months of a gap-free daily series, with partial months marked."""
    months = daily.groupBy(*by, month_key("date").alias("month")).agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        F.sum("sessions").alias("sessions"),
        F.count_if(F.col("calls") > 0).alias("active_days"),
        F.count(F.lit(1)).alias("calendar_days"),
        *component_sums(),
        F.sum("tokens").alias("tokens"),
        days_in_month(F.max("date")).cast("bigint").alias("days_in_month"),
    )
    return months.withColumn("is_partial", F.col("calendar_days") < F.col("days_in_month"))


def rounded_months(months: DataFrame) -> DataFrame:
    return months.withColumn("cost", round_half_up("cost", 2))


def dominant_month(months: DataFrame, total_cost: Column, by: Sequence[str] = ()) -> DataFrame:
    """Month with the highest cost, against the month before and everything before it.

    The earliest of equally expensive months wins.
    """
    order = W.partitionBy(*by).orderBy("month")
    costed = months.withColumn("cost", round_half_up("cost", 2)).withColumns(
        {
            "_previous_month": F.lag("month").over(order),
            "_previous_cost": F.lag("cost").over(order),
            "_before": F.coalesce(F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "_total": total_cost.cast("double"),
        }
    )
    packed = F.struct("month", "cost", "is_partial", "_previous_month", "_previous_cost", "_before", "_total")
    picked = costed.groupBy(*by).agg(F.min_by(packed, F.struct(-F.col("cost"), F.col("month"))).alias("m"))
    return picked.select(
        *by,
        F.col("m.month").alias("month"),
        F.col("m.cost").alias("cost"),
        F.try_divide("m.cost", "m._total").alias("share"),
        F.col("m.is_partial").alias("is_partial"),
        F.col("m._previous_month").alias("previous_month"),
        F.when(F.col("m._previous_cost") > 0, F.col("m.cost") / F.col("m._previous_cost")).alias("versus_previous"),
        F.col("m._before").alias("cost_before"),
    )


def gaps(daily: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Consecutive dates that are not exactly one day apart."""
    previous = F.lag(date).over(W.partitionBy(*by).orderBy(date))
    stepped = daily.select(*by, F.col(date).alias("date"), previous.alias("previous_date"))
    stepped = stepped.withColumn("days", F.datediff("date", "previous_date").cast("bigint"))
    return stepped.where(F.col("previous_date").isNotNull() & (F.col("days") != 1))


def peak_day(daily: DataFrame, by: Sequence[str] = (), measure: str = "tokens", active: str | None = "calls") -> DataFrame:
    """Day with the largest measure; the earliest of equal days."""
    rows = daily if active is None else daily.where(F.col(active) > 0)
    carried = [c for c in ("tokens", "calls", "cost") if c in daily.columns]
    picked = rows.groupBy(*by).agg(
        F.min_by(F.struct("date", *carried), F.struct(-F.col(measure), F.col("date"))).alias("d")
    )
    return picked.select(
        *by, F.col("d.date").alias("date"), *[as_double("d.cost").alias(c) if c == "cost" else F.col(f"d.{c}").alias(c) for c in carried]
    )


def account_strip(account: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Headline figures of the account series."""
    return account.groupBy(*by).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
        F.count(F.lit(1)).alias("calendar_days"),
        F.try_divide(F.sum("tokens").cast("double"), F.count(F.lit(1)).cast("double")).alias("daily_average"),
        F.count_if(F.col("tokens") > 0).alias("active_days"),
        F.max("tokens").alias("peak_tokens"),
        F.min_by("date", F.struct(-F.col("tokens"), F.col("date"))).alias("peak_date"),
    )
