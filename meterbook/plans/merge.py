"""One ledger from the ledgers of several devices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.labels import activity_fallback, device_fallback, is_specific
from meterbook.functions.tokens import COMPONENTS
from meterbook.operators import dedup, rollups
from meterbook.operators.keyed import keyed_join, summarise
from meterbook.operators.projects import resolve_projects
from meterbook.operators.quality import core_conflicts, device_checks, event_checks, key_text, row_checks, unique_ids
from meterbook.plans.ledger import localised
from meterbook.session import stage, stage_table
from meterbook.sources.devices import ledger_head_checks


@dataclass
class MergedEvents:
    """Stages of an event-level merge."""

    input: DataFrame
    distinct: DataFrame
    matches: DataFrame
    events: DataFrame


def with_provenance(events: DataFrame) -> DataFrame:
    """Provenance columns for events that come without any."""
    out = {}
    if "devices" not in events.columns:
        out["devices"] = F.array("device")
    if "sources" not in events.columns:
        out["sources"] = F.array("source")
    if "source_event_ids" not in events.columns:
        out["source_event_ids"] = F.array("event_id")
    return events.withColumns(out) if out else events


def merge_events(events: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = ()) -> MergedEvents:
    """Labels, exact dedup, near-time dedup.

    Ambiguous neighbours do not stop the plan: they are in ``matches`` and stay
    apart in ``events``; a result with any of them is not reliable.
    """
    resolved = resolve_projects(with_provenance(events), aliases, by)
    # the distinct events are read three times below, each time a part of their columns
    distinct = stage_table(dedup.exact_dedup(resolved, by))
    # and the matches by each join, the audit and the checks
    matches = stage_table(dedup.near_time_matches(distinct, by))
    merged = dedup.merge_pairs(distinct, dedup.mutual_pairs(matches, by), by)
    return MergedEvents(events, distinct, matches, merged)


def serialised(events: DataFrame) -> DataFrame:
    """Merged events with the fallback label for an unknown activity."""
    return events.withColumn("activity", activity_fallback("activity"))


def merged_records(events: DataFrame, tz: str, by: Sequence[str] = ()) -> DataFrame:
    """Compact records of merged events, with a device of their own."""
    labelled = localised(events, tz).withColumns(
        {"project": device_fallback("project", "device"), "activity": activity_fallback("activity")}
    )
    return rollups.compact_records(labelled, by, device=True)


def coverage(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rollups.attribution_coverage(
        records,
        {
            "model": F.col("model").isNotNull(),
            "session": F.col("session").isNotNull(),
            "project": is_specific("project"),
            "activity": is_specific("activity"),
        },
        by,
    )


def token_audit(merged: MergedEvents, by: Sequence[str] = ()) -> DataFrame:
    """Calls and components in, removed by each step, and out."""
    # what was removed is counted where it was removed: further copies of an id, and
    # the increment of each pair; ``audit_checks`` compares that with the difference
    dropped = merged.matches.where(F.col("status") == "pair").select(*by, F.col("increment_id").alias("event_id"))
    paired = keyed_join(merged.distinct, dropped.distinct(), [*by, "event_id"], "left_semi")
    counted = [
        ("input", merged.input, F.lit(1)),
        ("exact removed", merged.distinct, F.col("copies") - 1),
        ("cross-source removed", paired, F.lit(1)),
        ("output", merged.events, F.lit(1)),
    ]
    frames = []
    for name, df, times in counted:
        sums = summarise(
            df, by, calls=F.coalesce(F.sum(times), F.lit(0)).cast("bigint"),
            **{c: F.coalesce(F.sum(F.col(c) * times), F.lit(0)).cast("bigint") for c in COMPONENTS},
            tokens=F.coalesce(F.sum(rollups.tokens() * times), F.lit(0)).cast("bigint"),
        )
        frames.append(sums.withColumn("stage", F.lit(name)))
    measures = ["calls", *COMPONENTS, "tokens"]
    found = reduce(DataFrame.unionByName, frames)
    if by:  # an account without pairs has its row of zeros too
        names = F.explode(F.array(*[F.lit(n) for n, _, _ in counted])).alias("stage")
        found = keyed_join(merged.input.select(*by).distinct().select(*by, names), found, [*by, "stage"]).fillna(0, measures)
    return found.select(*by, "stage", *measures)


def audit_checks(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Input less what was removed is the output, in calls and every component, and nothing removed is negative."""
    measures = ["calls", *COMPONENTS, "tokens"]

    def at(name: str, measure: str) -> Column:
        return F.max(F.when(F.col("stage") == name, F.col(measure)))

    names = {"input": "input", "exact": "exact removed", "cross": "cross-source removed", "output": "output"}
    wide = summarise(audit, by, **{f"{short}_{m}": at(name, m) for short, name in names.items() for m in measures})
    checks = []
    for m in measures:
        left = F.col(f"input_{m}") - F.col(f"exact_{m}") - F.col(f"cross_{m}")
        checks.append((f"merge-balance-{m}", left != F.col(f"output_{m}"), F.col(f"output_{m}"), left))
        removed = F.least(F.col(f"exact_{m}"), F.col(f"cross_{m}"))
        checks.append((f"merge-negative-{m}", removed < 0, ">= 0", removed))
    return row_checks(wide, key_text(*by) if by else F.lit("total"), checks)


def device_summary(merged: MergedEvents, by: Sequence[str] = ()) -> DataFrame:
    """What each device brought, and how many merged events have it in their provenance."""
    inputs = merged.input.groupBy(*by, "device").agg(
        F.count(F.lit(1)).alias("input_events"),
        F.sum("calls").alias("input_calls"),
        *[F.sum(c).alias(f"input_{c}") for c in COMPONENTS],
    )
    kept = (
        merged.events.select(*by, F.explode("devices").alias("device"))
        .groupBy(*by, "device")
        .agg(F.count(F.lit(1)).alias("retained_events"))
    )
    return keyed_join(inputs, kept, [*by, "device"]).fillna(0, ["retained_events"])


def merged_cutoffs(heads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest cutoffs and outer range of the device ledgers."""
    return summarise(
        heads,
        by,
        cutoff_seconds=F.max("cutoff_seconds"),
        append_after_ms=F.max("append_after_ms"),
        first_at=F.min("first_at"),
        last_at=F.max("last_at"),
    )


def merge_compact(
    records: DataFrame, tz: str, aliases: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Merge of ledgers that have compact records only; not reliable at event level."""
    merged = dedup.multiset_merge(resolve_projects(records, aliases, by), by)
    return localised(merged, tz).withColumns(
        {"project": device_fallback("project", "device"), "activity": activity_fallback("activity")}
    )


@dataclass
class MergedLedger:
    """What a merge of device ledgers gives: the tables only where nothing was refused."""

    mode: str
    violations: DataFrame
    records: DataFrame | None = None
    events: DataFrame | None = None
    audit: DataFrame | None = None
    devices: DataFrame | None = None


def merge_ledgers(
    heads: DataFrame,
    events: DataFrame,
    records: DataFrame,
    tz: str,
    aliases: DataFrame | None = None,
    by: Sequence[str] = (),
    malformed: DataFrame | None = None,
) -> MergedLedger:
    """Gates, mode and merge of device ledgers.

    Heads must agree in time zone and schema and have labels of their own.  If
    every device is reliable at event level, events are merged: their own rules,
    ids within a device, conflicting copies, ambiguous neighbours and the balance
    of the audit decide whether the result is given.  Else compact records are
    merged as multisets, which is never reliable at event level.
    """
    gates = [device_checks(heads, by=by).where(F.col("check") != "device-reliable"), ledger_head_checks(heads)]
    if malformed is not None:
        gates.append(malformed)
    gate = stage(reduce(DataFrame.unionByName, gates))
    mode = "events" if heads.where(~F.coalesce("reliable", F.lit(False))).isEmpty() else "records"
    if not gate.isEmpty():
        return MergedLedger(mode, gate)
    if mode == "records":
        return MergedLedger(mode, gate, merge_compact(records, tz, aliases, by), devices=compact_summary(records, by))
    merged = merge_events(events, aliases, by)
    audit = token_audit(merged, by)
    found = stage(
        reduce(
            DataFrame.unionByName,
            [
                event_checks(events),
                unique_ids(events, [*by, "device"]),
                core_conflicts(merged.distinct),
                device_checks(heads, merged.matches, by).where(F.col("check") == "near-time-ambiguous"),
                audit_checks(audit, by),
            ],
        )
    )
    if not found.isEmpty():
        return MergedLedger(mode, found, audit=audit)
    return MergedLedger(mode, found, merged_records(merged.events, tz, by), merged.events, audit, device_summary(merged, by))


def compact_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each device: records given, records another device has too, and records that may be the same with other numbers."""
    prints = records.withColumn("_print", dedup.record_fingerprint())
    spread = prints.groupBy(*by, "_print").agg(F.countDistinct("device").alias("_devices"))
    shared = keyed_join(prints, spread, [*by, "_print"])
    odd = dedup.overlap_groups(records, by).select(*by, "ts", "session", "model", "source", F.lit(True).alias("_odd"))
    marked = keyed_join(shared, odd, [*by, "ts", "session", "model", "source"])
    return marked.groupBy(*by, "device").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("_devices") > 1).alias("matched_records"),
        F.count_if(F.coalesce("_odd", F.lit(False))).alias("possible_ambiguous"),
    )


def interchange(events: DataFrame) -> DataFrame:
    """Merged events with provenance as they are written for exchange."""
    from meterbook.sources.sinks import event_documents

    extra = F.when(
        (F.size("source_event_ids") > 1) | (F.element_at("source_event_ids", 1) != F.col("event_id")),
        F.col("source_event_ids"),
    )
    shaped = serialised(events).withColumns(
        {"tokens": rollups.tokens(), "provenance": F.struct("devices", "sources"), "sourceEventIds": extra}
    )
    return event_documents(shaped)


