"""Call ledger of one device: baseline log through its cutoff, export records after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.identity import event_id
from meterbook.functions.timeparts import local_date, local_hour
from meterbook.operators import rollups, series
from meterbook.operators.attribution import (
    attach_fingerprint,
    attribute_baseline,
    rollout_mappings,
    session_attribution,
)
from meterbook.operators.filters import after_cutoff, provider_filter
from meterbook.operators.keyed import columns_of
from meterbook.sources.requestlog import baseline_cutoff, baseline_rows

EVENT_COLUMNS = (
    "event_id", "source", "ts", "session", "model", "project", "activity", "fingerprint", "cost", "calls",
    "fresh_input", "cache_read", "cache_write", "output", "tokens", "recovered",
)


def ledger_events(
    export: DataFrame,
    log: DataFrame,
    rollout_meta: DataFrame | None = None,
    by: Sequence[str] = (),
    app: str = fixed.DEFAULT_PROVIDER,
) -> DataFrame:
    """Disjoint union of both sources with ids and attribution.

    Export rows at or before the cutoff still vote on the attribution of their
    session, but add nothing to any total.
    """
    rows = provider_filter(export) if "provider" in export.columns else export
    rollouts = None if rollout_meta is None else rollout_mappings(rollout_meta, by)
    votes = session_attribution(rows, by)
    baseline = baseline_rows(log, app, by).withColumn("source", F.lit(fixed.SOURCE_BASELINE))
    baseline = baseline.withColumn("event_id", event_id(ts="ts", session="session", model="model", request_id="request_id"))
    baseline = attribute_baseline(baseline, votes, rollouts, by)

    increment = after_cutoff(rows, baseline_cutoff(log, app, by), by).withColumns(
        {
            "source": F.lit(fixed.SOURCE_INCREMENT),
            "event_id": event_id(ts="ts", session="session", model="model"),
            "calls": F.lit(1).cast("bigint"),
            "recovered": F.lit(False),
        }
    )
    increment = attach_fingerprint(increment, rollouts, by)
    wanted = columns_of(by, *EVENT_COLUMNS)
    return baseline.select(*wanted).unionByName(increment.select(*wanted))


def localised(events: DataFrame, tz: str) -> DataFrame:
    return events.withColumns({"date": local_date("ts", tz), "hour": local_hour("ts", tz)})


def attributed_labels(events: DataFrame) -> DataFrame:
    unknown = F.lit(fixed.UNATTRIBUTED)
    return events.withColumns({"project": F.coalesce("project", unknown), "activity": F.coalesce("activity", unknown)})


def coverage(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rollups.attribution_coverage(
        events,
        {
            "model": F.col("model").isNotNull(),
            "session": F.col("session").isNotNull(),
            "project": F.col("project").isNotNull(),
            "activity": F.col("activity").isNotNull(),
        },
        by,
    )


def ledger_models(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per model, a missing one included; ordered by tokens, then name."""
    rolled = rollups.ledger_rollup(events, [*by, "model"], sessions=F.countDistinct("session"))
    return rolled.withColumn("attributed", F.col("model").isNotNull())


def ledger_sessions(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rolled = rollups.ledger_rollup(events, [*by, "session"], models=F.array_sort(F.collect_set("model")))
    return rolled.withColumn("attributed", F.col("session").isNotNull())


def ledger_daily(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per local date with zero rows for gaps; call times are null there."""
    return series.zero_fill(rollups.ledger_rollup(events, [*by, "date"]), by, blank=("first_at", "last_at"))


def build_ledger(
    export: DataFrame,
    log: DataFrame,
    tz: str,
    rollout_meta: DataFrame | None = None,
    by: Sequence[str] = (),
    app: str = fixed.DEFAULT_PROVIDER,
) -> dict[str, DataFrame]:
    from meterbook.operators.dedup import duplicate_audit
    from meterbook.session import stage

    events = stage(localised(ledger_events(export, log, rollout_meta, by, app), tz))
    labelled = attributed_labels(events)
    return {
        "events": labelled,
        "records": rollups.compact_records(labelled, by),
        "daily": ledger_daily(events, by),
        "models": ledger_models(events, by),
        "sessions": ledger_sessions(events, by),
        "summary": rollups.ledger_summary(events, by),
        "sources": rollups.ledger_rollup(events, [*by, "source"]),
        "coverage": coverage(events, by),
        "duplicates": duplicate_audit(events, by),
        "cutoff": baseline_cutoff(log, app, by),
    }
