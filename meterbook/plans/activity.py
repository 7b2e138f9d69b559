"""Activity analytics: threads, turns, skills and plugins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.labels import tool_item_key
from meterbook.functions.tokens import ratio_or_zero
from meterbook.operators.keyed import keyed_join, summarise, with_totals
from meterbook.operators.quality import (
    date_rules,
    detail_rules,
    grouping_rules,
    key_text,
    recomputed,
    repeated_dates,
    row_checks,
    same_buckets,
    same_grouping,
    stack,
)
from meterbook.session import stage


def usage_by(days: DataFrame, listed: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Threads and turns per model or client.

    Shares are of the turns in the daily totals, not of the listed turns; only buckets
    with activity count as active.
    """
    shown = F.col("display_name") if listed == "clients" else F.col(name)
    rows = days.select(*by, "date", F.inline(listed))
    grouped = rows.groupBy(*by, name).agg(
        F.min(shown).alias("display_name"),
        F.sum("threads").alias("threads"),
        F.sum("turns").alias("turns"),
        F.countDistinct(F.when((F.col("threads") > 0) | (F.col("turns") > 0), F.col("date"))).alias("active_buckets"),
    )
    whole = summarise(days, by, _turns=F.sum("turns"))
    shared = with_totals(grouped, whole, by)
    return shared.withColumn("turn_share", ratio_or_zero(F.col("turns"), F.col("_turns"))).drop("_turns")


def tool_ranking(tools: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """Invocations per skill or plugin; the first listed spelling names a row."""
    rows = tools.select(*by, "date", F.posexplode("items").alias("_at", "i")).select(*by, "date", "_at", "i.*")
    plugin = "plugin_id" if kind == "plugins" else None
    rows = rows.withColumn("item_key", tool_item_key("name", plugin))
    first = F.struct("date", "_at")
    grouped = rows.groupBy(*by, "item_key").agg(
        F.min_by("name", first).alias("name"),
        F.min_by("display_name", first).alias("display_name"),
        F.sum("invocations").alias("invocations"),
        F.countDistinct(F.when(F.col("invocations") > 0, F.col("date"))).alias("active_buckets"),
    )
    grouped = grouped.withColumn(
        "display_name", F.when(F.col("item_key") == "other", "Other").otherwise(F.col("display_name"))
    )
    whole = summarise(grouped, by, _all=F.sum("invocations"))
    return (
        with_totals(grouped, whole, by).withColumn("share", ratio_or_zero(F.col("invocations"), F.col("_all"))).drop("_all")
    )


def _bucket_sums(tools: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    summed = F.aggregate(F.transform("items", lambda i: i["invocations"]), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return tools.select(*by, "date", summed.alias(name))


def activity_days(
    days: DataFrame, skills: DataFrame | None = None, plugins: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Daily threads and turns beside skill and plugin sums; an absent response stays null, never 0."""
    out = days.select(*by, "date", "threads", "turns")
    for tools, name in ((skills, "skill_invocations"), (plugins, "plugin_calls")):
        if tools is None:
            out = out.withColumn(name, F.lit(None).cast("bigint"))
        else:
            out = keyed_join(out, _bucket_sums(tools, name, by), [*by, "date"]).fillna(0, [name])
    return out


def activity_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    summed = summarise(
        daily,
        by,
        buckets=F.count(F.lit(1)),
        threads=F.sum("threads"),
        turns=F.sum("turns"),
        skill_invocations=F.sum("skill_invocations"),
        plugin_calls=F.sum("plugin_calls"),
    )
    return summed.withColumn("turns_per_thread", ratio_or_zero(F.col("turns"), F.col("threads")))


def response_checks(
    days: DataFrame, skills: DataFrame | None = None, plugins: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Grouping, dates, equal buckets and detail against totals."""
    rules = [
        *grouping_rules(),
        *date_rules("date_text", "date"),
        *detail_rules("models", ["threads", "turns"]),
        *detail_rules("clients", ["threads", "turns"]),
    ]
    found = [row_checks(days, F.col("date_text"), rules), repeated_dates(days, "date_text", by)]
    for tools, name in ((skills, "skills"), (plugins, "plugins")):
        if tools is not None:
            found += [
                row_checks(tools, F.col("date_text"), [*grouping_rules(), *date_rules("date_text", "date")]),
                repeated_dates(tools, "date_text", by),
                same_grouping(days, tools, name),
                same_buckets(days, tools, name, by),
            ]
    return stack(*found)


def audit_checks(
    summary: DataFrame,
    daily: DataFrame,
    models: DataFrame,
    skills: DataFrame | None = None,
    plugins: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Stored activity figures against figures recomputed from their parts; absent stays null."""
    again = activity_summary(daily, by)
    renamed = again.select(*by, *[F.col(c).alias(f"again_{c}") for c in again.columns if c not in by])
    joined = with_totals(summary, renamed, by)
    key = key_text(*by) if by else F.lit("total")
    names = ("buckets", "threads", "turns", "skill_invocations", "plugin_calls", "turns_per_thread")
    found = [
        recomputed(joined, key, [(f"activity-{n}", F.col(n).cast("double"), F.col(f"again_{n}").cast("double")) for n in names], 1e-12)
    ]
    turns = with_totals(models, summary.select(*by, F.col("turns").alias("_whole")), by)
    found.append(
        recomputed(
            turns, F.col("display_name"), [("activity-share", F.col("turn_share"), ratio_or_zero(F.col("turns"), F.col("_whole")))], 1e-12
        )
    )
    for tools, column in ((skills, "skill_invocations"), (plugins, "plugin_calls")):
        if tools is not None:
            listed = with_totals(summary.select(*by, column), summarise(tools, by, _listed=F.sum("invocations")), by)
            found.append(
                recomputed(listed, key, [(f"{column}-listed", F.col(column).cast("double"), F.col("_listed").cast("double"))], 1e-12)
            )
            shares = with_totals(tools, summary.select(*by, F.col(column).alias("_whole")), by)
            found.append(
                recomputed(
                    shares, F.col("display_name"),
                    [(f"{column}-share", F.col("share"), ratio_or_zero(F.col("invocations"), F.col("_whole")))], 1e-12,
                )
            )
    return stack(*found)


def activity_audit(
    days: DataFrame, skills: DataFrame | None = None, plugins: DataFrame | None = None, by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """All tables of the activity report, and every violation of the responses and of the figures made from them."""
    days = stage(days)
    daily = stage(activity_days(days, skills, plugins, by))
    tables = {
        "days": daily,
        "summary": activity_summary(daily, by),
        "models": usage_by(days, "models", "model", by),
        "clients": usage_by(days, "clients", "client_id", by),
    }
    for name, tools in (("skills", skills), ("plugins", plugins)):
        if tools is not None:
            tables[name] = tool_ranking(tools, name, by)
    found = audit_checks(tables["summary"], daily, tables["models"], tables.get("skills"), tables.get("plugins"), by)
    tables["violations"] = response_checks(days, skills, plugins, by).unionByName(found)
    return tables
