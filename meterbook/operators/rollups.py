"""Group-by tables of a report.

Input is a *prepared* usage frame (see ``plans.report.prepare``) or the compact
facts made from it: ``date hour weekday project session model activity``, the
four components, ``calls``, ``cost`` and the call times ``first_call`` and
``last_call``.  Both give the same tables, since every measure is a sum, a
minimum, a maximum or a distinct count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.timeparts import epoch_ms, week_start
from meterbook.functions.tokens import COMPONENTS, ratio_or_null, ratio_or_zero, round_half_up
from meterbook.operators.keyed import keyed_join, summarise, with_totals
from meterbook.operators.ranking import first_k, ordered_positions, small_rank
from meterbook.operators.series import component_sums


def tokens() -> Column:
    return F.col("fresh_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")


def totals(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whole-period sums used as denominators."""
    return summarise(
        usage, by, total_cost=F.sum("cost"), total_calls=F.sum("calls"), total_tokens=F.sum(tokens())
    )


def by_model(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    grouped = usage.groupBy(*by, "model").agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        F.countDistinct("session").alias("sessions"),
        *component_sums(),
        F.sum(tokens()).alias("tokens"),
        F.min(F.when(F.col("calls") > 0, F.col("date"))).alias("first_date"),
        F.max(F.when(F.col("calls") > 0, F.col("date"))).alias("last_date"),
    )
    # few rows per key by now: the share shares the window of the rank
    whole = F.sum("cost").over(W.partitionBy(*by))
    shared = grouped.withColumn("share", ratio_or_zero(F.col("cost"), whole))
    return small_rank(shared, [F.desc("cost"), F.asc("model")], by)


def by_activity(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Turns equal calls where the source counts no turns of its own."""
    grouped = usage.groupBy(*by, "activity").agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        F.sum("calls").alias("turns"),
        F.sum(tokens()).alias("tokens"),
    )
    # few rows per key by now: the share shares the window of the rank
    whole = F.sum("cost").over(W.partitionBy(*by))
    shared = grouped.withColumn("share", ratio_or_zero(F.col("cost"), whole))
    return small_rank(shared, [F.desc("cost"), F.asc("activity")], by)


def activity_with_calls(activities: DataFrame, usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Given activity rows with call counts looked up from records; no match is 0."""
    counted = usage.groupBy(*by, "activity").agg(F.sum("calls").alias("calls"))
    return keyed_join(activities.drop("calls"), counted, [*by, "activity"]).fillna(0, ["calls"])


def project_sums(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return usage.groupBy(*by, "project").agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        F.countDistinct("session").alias("sessions"),
        F.sum(tokens()).alias("tokens"),
    )


def by_project(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Projects ranked by cost with share and cumulative share of the unrounded cost."""
    grouped = project_sums(usage, by)
    ranked = ordered_positions(
        grouped, [F.desc("cost"), F.asc("project")], by, rank="rank", sums={"_running": "cost"}
    )
    whole = summarise(ranked, by, _cost=F.sum("cost"))
    shared = with_totals(ranked, whole, by)
    return shared.withColumns(
        {
            "share": ratio_or_null(F.col("cost"), F.col("_cost")),
            "cumulative_share": ratio_or_null(F.col("_running"), F.col("_cost")),
        }
    ).drop("_running", "_cost")


def by_session(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per session; its project is the one of its first call."""
    grouped = usage.groupBy(*by, "session").agg(
        F.min_by("project", F.struct("first_call", "project")).alias("project"),
        F.min("first_call").alias("started_at"),
        F.max("last_call").alias("last_call"),
        F.min("date").alias("date"),
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        *component_sums(),
        F.sum(tokens()).alias("tokens"),
        F.array_sort(F.collect_set("model")).alias("models"),
    )
    return grouped.withColumn("cache_share", ratio_or_zero(F.col("cache_read"), F.col("tokens")))


def ranked_sessions(sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sessions by cost, the cost already rounded to cents as it is shown."""
    rounded = sessions.withColumn("cost", round_half_up("cost", 2))
    return ordered_positions(rounded, [F.desc("cost"), F.asc("session")], by)


def session_rows_with_detail(given: DataFrame, detail: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Session rows of a source with tokens, cache share and models from its records."""
    extra = detail.select(*by, "session", "tokens", "cache_share", "models")
    joined = keyed_join(given, extra, [*by, "session"])
    return joined.withColumns(
        {
            "tokens": F.coalesce("tokens", F.lit(0)),
            "cache_share": F.coalesce("cache_share", F.lit(0.0)),
            "models": F.coalesce("models", F.array().cast("array<string>")),
        }
    )


def top_projects(usage: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The k projects with the highest cost; k rows per key at most."""
    sums = usage.groupBy(*by, "project").agg(F.sum("cost").alias("cost"))
    order = [F.desc("cost"), F.asc("project")]
    if not by:
        return first_k(sums, order, k).select("project", F.lit(True).alias("is_top"))
    return small_rank(sums, order, by).where(F.col("rank") <= k).select(*by, "project", F.lit(True).alias("is_top"))


def fold_projects(rows: DataFrame, top: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the top projects and fold the rest into one label."""
    # at most k rows when there is one key; AQE sizes the side otherwise
    side = top if by else F.broadcast(top)
    marked = keyed_join(rows, side, [*by, "project"])
    kept = F.when(F.col("is_top"), F.col("project")).otherwise(F.lit(fixed.OTHER_LABEL))
    return marked.withColumn("project", kept).drop("is_top")


def project_weeks(sessions: DataFrame, top: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Top projects and the rest, by the week of a session's first call."""
    folded = fold_projects(sessions, top, by)
    return folded.groupBy(*by, "project", week_start("date").alias("week")).agg(
        F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("sessions"), F.sum("calls").alias("calls")
    )


def model_days(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return usage.groupBy(*by, "model", "date").agg(
        F.sum("cost").alias("record_cost"), F.sum("calls").alias("calls"), F.sum(tokens()).alias("tokens")
    )


def scaled_model_days(days: DataFrame, exact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily cost of a model scaled so that its days add up to its exact total.

    ``exact`` has ``model`` and ``cost``; a model without one, or without
    any recorded cost, gets 0.
    """
    given = exact.select(*by, "model", F.col("cost").cast("double").alias("_exact"))
    # one row per model and day by now: the total of a model is a window over its days
    recorded = F.sum("record_cost").over(W.partitionBy(*by, "model")).cast("double")
    joined = keyed_join(days.withColumn("_recorded", recorded), given, [*by, "model"])
    scaled = F.col("record_cost").cast("double") * F.coalesce("_exact", F.lit(0.0)) / F.col("_recorded")
    cost = F.when(F.col("_recorded") > 0, scaled).otherwise(F.lit(0.0))
    return joined.withColumn("cost", round_half_up(cost, 4)).drop("record_cost", "_recorded", "_exact")


def weekday_hours(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense week: 7 × 24 cells, zeros kept."""
    cells = usage.groupBy(*by, "weekday", "hour").agg(
        F.sum("calls").alias("calls"), F.sum(tokens()).alias("tokens"), F.sum("cost").alias("cost")
    )
    grid = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(167)),
            lambda i: F.struct(
                F.element_at(F.array(*[F.lit(d) for d in fixed.WEEKDAYS]), (F.floor(i / 24) + 1).cast("int")).alias("weekday"),
                F.floor(i / 24).alias("weekday_index"),
                (i % 24).alias("hour"),
            ),
        )
    ).alias("cell")
    spark = usage.sparkSession
    axis = cells.select(*by).distinct() if by else spark.range(1).select()
    axis = axis.select(*by, grid).select(*by, "cell.*")
    filled = keyed_join(axis, cells, [*by, "weekday", "hour"]).fillna(0, ["calls", "tokens"])
    filled = filled.withColumn("cost", F.coalesce(F.col("cost"), F.lit(0)))
    whole = F.sum("tokens").over(W.partitionBy(*by))
    return filled.withColumn("token_share", ratio_or_null(F.col("tokens"), whole))


def compact_facts(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Call facts by date, hour, project, session, model and activity."""
    return usage.groupBy(*by, "date", "hour", "weekday", "project", "session", "model", "activity").agg(
        F.sum("cost").alias("cost"),
        F.sum("calls").alias("calls"),
        *component_sums(),
        F.min("first_call").alias("first_call"),
        F.max("last_call").alias("last_call"),
    )


def scale_costs(facts: DataFrame, period_cost: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scale record cost to the period total by one constant for all later filters.

    ``period_cost`` has one ``period_cost`` per key.
    """
    recorded = summarise(facts, by, _recorded=F.sum("cost"))
    scale = with_totals(recorded, period_cost.select(*by, "period_cost"), by)
    scale = scale.select(
        *by,
        F.when(
            F.col("_recorded") > 0, F.col("period_cost").cast("double") / F.col("_recorded").cast("double")
        ).otherwise(F.lit(1.0)).alias("cost_scale"),
    )
    scaled = with_totals(facts, scale, by)
    return scaled.withColumn("cost", round_half_up(F.col("cost").cast("double") * F.col("cost_scale"), 6))


def night_and_weekend(week: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token shares of hours 0–5 and of Saturday and Sunday."""
    whole = F.sum("tokens").cast("double")
    night = F.sum(F.when(F.col("hour") <= 5, F.col("tokens")).otherwise(0)).cast("double")
    weekend = F.sum(F.when(F.col("weekday").isin("Sat", "Sun"), F.col("tokens")).otherwise(0)).cast("double")
    return summarise(
        week, by, night_share=F.try_divide(night, whole), weekend_share=F.try_divide(weekend, whole)
    )


def top_by_tokens(usage: DataFrame, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """Name, tokens and share of the largest value of a dimension; ties by name."""
    sums = usage.groupBy(*by, dimension).agg(F.sum(tokens()).alias("_tokens"))
    picked = summarise(
        sums,
        by,
        name=F.min_by(F.col(dimension), F.struct(-F.col("_tokens"), F.col(dimension))),
        tokens=F.max("_tokens"),
        whole=F.sum("_tokens"),
    )
    return picked.select(*by, "name", "tokens", ratio_or_zero(F.col("tokens"), F.col("whole")).alias("share"))


def report_summary(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Headline totals; days with calls and calendar days are named apart."""
    # several distinct counts expand every row several times: sum up per combination first
    combined = usage.groupBy(*by, "session", "project", "date").agg(
        F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), *component_sums()
    )
    summed = summarise(
        combined,
        by,
        cost=F.sum("cost"),
        calls=F.sum("calls"),
        sessions=F.countDistinct("session"),
        projects=F.countDistinct("project"),
        call_days=F.countDistinct(F.when(F.col("calls") > 0, F.col("date"))),
        listed_days=F.countDistinct("date"),
        calendar_days=(F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint"),
        **{c: F.sum(c) for c in COMPONENTS},
    )
    return summed.withColumns(
        {
            "tokens": tokens(),
            "cache_hit_rate": ratio_or_null(F.col("cache_read"), F.col("fresh_input") + F.col("cache_read")),
        }
    )


def source_sums(sources: Sequence[str] = fixed.SOURCES) -> dict[str, Column]:
    """Calls and tokens of each source as aggregates for any group-by."""
    out = {}
    for name in sources:
        here = F.col("source") == name
        out[f"{name}_calls"] = F.sum(F.when(here, F.col("calls")).otherwise(0))
        out[f"{name}_tokens"] = F.sum(F.when(here, tokens()).otherwise(0))
    return out


def ledger_rollup(events: DataFrame, keys: Sequence[str], **extra: Column) -> DataFrame:
    """Ledger aggregate with per-source parts: the shape of every ledger table."""
    return summarise(
        events,
        keys,
        calls=F.sum("calls"),
        cost=F.sum("cost"),
        **{c: F.sum(c) for c in COMPONENTS},
        tokens=F.sum(tokens()),
        first_at=F.min("ts"),
        last_at=F.max("ts"),
        **source_sums(),
        **extra,
    )


def compact_records(events: DataFrame, by: Sequence[str] = (), device: bool = False) -> DataFrame:
    """Ledger rows by date, hour, project, session, model, activity, source (and device)."""
    keys = [*by, "date", "hour", "project", "session", "model", "activity", "source", *(["device"] if device else [])]
    return events.groupBy(*keys).agg(
        F.min("ts").alias("ts"), F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), *component_sums()
    )


def attribution_coverage(
    events: DataFrame, attributed: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Attributed and unattributed calls and tokens per dimension; ratios are null on zero."""
    size = tokens()
    sums = {"_calls": F.sum("calls"), "_tokens": F.sum(size)}
    for name, known in attributed.items():
        known = F.coalesce(known, F.lit(False))
        sums[f"_calls_{name}"] = F.sum(F.when(known, F.col("calls")).otherwise(0))
        sums[f"_tokens_{name}"] = F.sum(F.when(known, size).otherwise(0))
    wide = summarise(events, by, **sums)
    parts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("dimension"),
                    F.coalesce(F.col(f"_calls_{name}"), F.lit(0)).alias("attributed_calls"),
                    F.coalesce(F.col(f"_tokens_{name}"), F.lit(0)).alias("attributed_tokens"),
                )
                for name in attributed
            ]
        )
    ).alias("p")
    tall = wide.select(
        *by, F.coalesce("_calls", F.lit(0)).alias("total_calls"), F.coalesce("_tokens", F.lit(0)).alias("total_tokens"), parts
    ).select(*by, "p.*", "total_calls", "total_tokens")
    return tall.withColumns(
        {
            "unattributed_calls": F.col("total_calls") - F.col("attributed_calls"),
            "unattributed_tokens": F.col("total_tokens") - F.col("attributed_tokens"),
            "call_coverage": ratio_or_null(F.col("attributed_calls"), F.col("total_calls")),
            "token_coverage": ratio_or_null(F.col("attributed_tokens"), F.col("total_tokens")),
        }
    )


def ledger_summary(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and range of a ledger whose rows carry their local ``date``."""
    return ledger_rollup(
        events,
        by,
        first_date=F.min("date"),
        last_date=F.max("date"),
        calendar_days=(F.datediff(F.max("date"), F.min("date")) + 1).cast("bigint"),
        active_days=F.countDistinct(F.when(F.col("calls") > 0, F.col("date"))),
    )


def freshness(rows: DataFrame, now: Column, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Age of the newest row per source and key at a given instant (UTC wall clock)."""
    newest = rows.groupBy(*by, "source").agg(F.max(ts).alias("newest"))
    hours = F.greatest(F.lit(0.0), (epoch_ms(now) - epoch_ms("newest")) / F.lit(3_600_000.0))
    return newest.withColumns({"age_hours": round_half_up(hours, 2), "is_fresh": hours <= fixed.FRESH_HOURS})

