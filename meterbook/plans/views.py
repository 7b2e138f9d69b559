"""Range views: one inclusive date range applied to the compact facts and the account series.

Costs of the facts are already scaled; a range never scales them again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as day

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.timeparts import grain_for, period_end, period_start
from meterbook.functions.tokens import COMPONENTS
from meterbook.operators import rollups
from meterbook.operators.filters import date_range
from meterbook.operators.keyed import keyed_join, summarise, with_totals
from meterbook.operators.series import component_sums


def range_days(start: str, end: str) -> int:
    if start > end:
        raise ValueError(f"range is reversed: {start} > {end}")
    return (day.fromisoformat(end) - day.fromisoformat(start)).days + 1


def grain(start: str, end: str) -> str:
    """1–14 days daily, 15–92 weekly, more monthly."""
    return grain_for(range_days(start, end))


def with_period(df: DataFrame, start: str, end: str, unit: str | None = None) -> DataFrame:
    """Period of each row; a period the range cuts off is marked partial."""
    unit = unit or grain(start, end)
    first = period_start("date", unit)
    partial = (first < F.lit(start).cast("date")) | (period_end(first, unit) > F.lit(end).cast("date"))
    return df.withColumns({"period": first, "is_partial": partial})


def range_axis(base: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Every date of the range (per key), made from the range itself."""
    dates = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    keys = base.select(*by).distinct() if by else base.sparkSession.range(1).select()
    return keys.select(*by, dates)


def range_summary(
    facts: DataFrame, account: DataFrame, start: str, end: str, by: Sequence[str] = ()
) -> DataFrame:
    """Both layers over one range; a range with account data only has zero local calls."""
    local = summarise(
        date_range(facts, start, end),
        by,
        calls=F.sum("calls"),
        cost=F.sum("cost"),
        sessions=F.countDistinct("session"),
        projects=F.countDistinct("project"),
        **{c: F.sum(c) for c in COMPONENTS},
        tokens=F.sum(rollups.tokens()),
    )
    official = summarise(
        date_range(account, start, end), by, account_tokens=F.sum("tokens"), account_days=F.count(F.lit(1))
    )
    joined = with_totals(official, local, by)
    zero = ["calls", "sessions", "projects", *COMPONENTS, "tokens", "account_tokens"]
    return joined.fillna(0, zero).withColumn("cost", F.coalesce(F.col("cost"), F.lit(0))).withColumn(
        "local_detail", F.when(F.col("calls") > 0, "present").otherwise("empty")
    )


def token_ledger(facts: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Components per period of the range."""
    rows = with_period(date_range(facts, start, end), start, end)
    return rows.groupBy(*by, "period", "is_partial").agg(
        *component_sums(), F.sum(rollups.tokens()).alias("tokens"), F.sum("calls").alias("calls"), F.sum("cost").alias("cost")
    )


def project_periods(facts: DataFrame, start: str, end: str, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Sessions of the top projects by the period of their first call inside the range."""
    selected = date_range(facts, start, end)
    sessions = rollups.by_session(selected, by)
    folded = rollups.fold_projects(sessions, rollups.top_projects(selected, k, by), by)
    return with_period(folded, start, end).groupBy(*by, "project", "period").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("cost").alias("cost"), F.sum("calls").alias("calls")
    )


def model_periods(facts: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    rows = with_period(date_range(facts, start, end), start, end)
    return rows.groupBy(*by, "model", "period").agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        F.sum(rollups.tokens()).alias("tokens"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def date_hours(facts: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Dense date × hour matrix of a short range, each date's total beside its hours."""
    if range_days(start, end) > 14:
        raise ValueError("a date by hour matrix covers 14 days at most")
    cells = date_range(facts, start, end).groupBy(*by, "date", "hour").agg(
        F.sum("calls").alias("calls"), F.sum(rollups.tokens()).alias("tokens"), F.sum("cost").alias("cost")
    )
    axis = range_axis(facts, start, end, by).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    filled = keyed_join(axis, cells, [*by, "date", "hour"]).fillna(0, ["calls", "tokens"])
    filled = filled.withColumn("cost", F.coalesce(F.col("cost"), F.lit(0)))
    from pyspark.sql import Window as W

    # 24 rows per date
    whole = W.partitionBy(*by, "date")
    return filled.withColumns(
        {
            "date_calls": F.sum("calls").over(whole),
            "date_tokens": F.sum("tokens").over(whole),
            "date_cost": F.sum("cost").over(whole),
        }
    )


def range_facts(facts: DataFrame, account: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Peak account day, top project and model, busiest hour; what has no data is null."""
    selected = date_range(facts, start, end)
    peak = summarise(
        date_range(account, start, end),
        by,
        peak_account_date=F.min_by("date", F.struct(-F.col("tokens"), F.col("date"))),
        peak_account_tokens=F.max("tokens"),
    )
    projects = selected.groupBy(*by, "project").agg(F.sum("cost").alias("c"))
    top_project = summarise(
        projects,
        by,
        top_project=F.min_by("project", F.struct(-F.col("c"), F.col("project"))),
        top_project_share=F.try_divide(F.max("c").cast("double"), F.sum("c").cast("double")),
    )
    top_model = rollups.top_by_tokens(selected, "model", by).select(
        *by, F.col("name").alias("top_model"), F.col("share").alias("top_model_share")
    )
    hours = selected.groupBy(*by, "hour").agg(F.sum("calls").alias("n"))
    busiest = summarise(
        hours,
        by,
        busiest_hour=F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))),
        busiest_calls=F.coalesce(F.max("n"), F.lit(0)),
    )
    out = peak
    for part in (top_project, top_model, busiest):
        out = with_totals(out, part, by)
    return out.fillna(0, ["busiest_calls"])
