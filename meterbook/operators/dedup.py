"""Exact, near-time and multiset deduplication of ledgers.

Copies are merged by aggregates with map-side combine, never by numbering all
copies of an id in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.labels import is_specific
from meterbook.functions.timeparts import epoch_ms
from meterbook.functions.tokens import COMPONENTS
from meterbook.operators.keyed import keyed_join, summarise
from meterbook.operators.ranking import occurrence_number

PICKED = ("device", "device_order", "input_order", "raw_project", "fingerprint", "project_rank")
CORE = ("ts", "source", "session", "model", *COMPONENTS, "cost")
#: A block of time of near-time matching is so many windows long: the longer, the fewer points travel twice.
BLOCK_WINDOWS = 32


def preference() -> Column:
    """Order among copies: the smallest is preferred.

    Project rank counts twice as much as a specific activity; then a specific
    project, the order of the devices and the order of the input.
    """
    score = F.col("project_rank") * 2 + is_specific("activity").cast("bigint")
    return F.struct(
        -score, (~is_specific("project")).cast("int"), F.col("device_order"), F.col("input_order")
    )


def attribution_picks(carried: Sequence[str] = ()) -> list[Column]:
    """Aggregates that pick the labels of the preferred copy and fill its gaps from the next ones.

    ``carried`` columns are taken from the preferred copy as well.
    """
    order = preference()
    return [
        F.min_by(F.struct(*PICKED, "project", "activity", *carried), order).alias("_pick"),
        F.min_by("project", F.when(is_specific("project"), order)).alias("_project"),
        F.min_by("activity", F.when(is_specific("activity"), order)).alias("_activity"),
    ]


def picked_attribution(carried: Sequence[str] = ()) -> dict[str, Column]:
    return {
        **{c: F.col(f"_pick.{c}") for c in [*PICKED, *carried]},
        "project": F.coalesce("_project", "_pick.project"),
        "activity": F.col("_activity"),
    }


def provenance_set() -> Column:
    """Distinct provenance of the copies; equal provenance is combined before it travels."""
    return F.collect_set(F.struct("devices", "sources", "source_event_ids")).alias("_provenance")


def united_provenance() -> dict[str, Column]:
    def united(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.transform("_provenance", lambda p: p[field]))))

    return {field: united(field) for field in ("devices", "sources", "source_event_ids")}


def exact_dedup(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per event id, with ``copies`` and ``conflicting`` (copies that differ in their core).

    Needs ``device device_order input_order project_rank raw_project fingerprint``
    next to the event columns.
    """
    # copies agree in their core if two independent 64-bit digests do; digests are
    # plain longs, so a copy does not carry its core twice through the shuffle
    # a digest passes over nulls, so every field is hashed with a mark of its absence
    marked = [c for name in CORE for c in (F.col(name), F.col(name).isNull())]
    digests = [F.xxhash64(F.lit(seed), *marked) for seed in ("first", "second")]
    grouped = events.groupBy(*by, "event_id").agg(
        F.count(F.lit(1)).alias("copies"),
        *[f(d).alias(f"_{n}_{i}") for i, d in enumerate(digests) for n, f in (("low", F.min), ("high", F.max))],
        *attribution_picks(CORE),
        provenance_set(),
    )
    differs = (F.col("_low_0") != F.col("_high_0")) | (F.col("_low_1") != F.col("_high_1"))
    merged = grouped.withColumns(
        {
            **picked_attribution(CORE),
            **united_provenance(),
            "calls": F.lit(1).cast("bigint"),
            "conflicting": differs,
        }
    )
    return merged.drop("_pick", "_project", "_activity", "_provenance", "_low_0", "_high_0", "_low_1", "_high_1")


def duplicate_audit(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ids, ids that repeat, extra rows and ids whose core payloads disagree."""
    core = F.struct(*CORE)
    counted = events.groupBy(*by, "event_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min(core).alias("low"), F.max(core).alias("high")
    )
    return summarise(
        counted,
        by,
        distinct_ids=F.count(F.lit(1)),
        duplicate_ids=F.count_if(F.col("copies") > 1),
        duplicate_rows=F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)),
        conflicting_ids=F.count_if(~F.col("low").eqNullSafe(F.col("high"))),
    )


def near_time_matches(
    events: DataFrame,
    by: Sequence[str] = (),
    window_ms: int = fixed.CANDIDATE_WINDOW_MS,
    pair_ms: int = fixed.PAIR_WINDOW_MS,
) -> DataFrame:
    """Events with an opposite-source neighbour: mutual pairs and ambiguous ones.

    Session and model are equal (null equals null) and the times differ by at
    most ``window_ms``.  Output: one row per pair, or per point in time that is
    ambiguous, with ``status baseline_id increment_id ts_ms source events``.

    No pair is ever listed.  Rows are first counted per millisecond, which bounds
    a block of time at ``BLOCK_WINDOWS * window_ms`` points per source, and two
    windows more, whatever the data holds.  Only points within a window of its
    ends are in two blocks.  Inside a block, running sums up to either end of the window count the
    neighbours, and the last opposite point before its end is the only candidate
    if there is just one: one sort, and frames that only grow.
    """
    events = events.withColumn("_ms", epoch_ms("ts"))
    # ids are unique: a point with one event carries that event's id and numbers
    points = events.groupBy(*by, "session", "model", "source", "_ms").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("event_id", *COMPONENTS)).alias("_one")
    )
    # a point is seen from its own block of time and from those its window reaches into
    def block_of(ms: Column) -> Column:
        return F.floor(ms / F.lit(BLOCK_WINDOWS * max(window_ms, 1)))

    reach = points.withColumn("_home", block_of(F.col("_ms")))
    reach = reach.withColumn("_block", F.explode(F.sequence(block_of(F.col("_ms") - window_ms), block_of(F.col("_ms") + window_ms))))
    order = W.partitionBy(*by, "session", "model", "_block").orderBy("_ms")
    upto_end = order.rangeBetween(W.unboundedPreceding, window_ms)
    before_start = order.rangeBetween(W.unboundedPreceding, -window_ms - 1)
    baseline = F.col("source") == fixed.SOURCE_BASELINE
    point = F.struct("_ms", "_one")

    def neighbours(condition: Column) -> Column:
        size = F.when(condition, F.col("_n")).otherwise(0)
        return F.sum(size).over(upto_end) - F.coalesce(F.sum(size).over(before_start), F.lit(0))

    reach = reach.withColumns(
        {
            "_baselines": neighbours(baseline),
            "_increments": neighbours(~baseline),
            "_last_baseline": F.last(F.when(baseline, point), ignorenulls=True).over(upto_end),
            "_last_increment": F.last(F.when(~baseline, point), ignorenulls=True).over(upto_end),
        }
    )
    seen = reach.where(F.col("_block") == F.col("_home")).withColumns(
        {
            "_neighbours": F.when(baseline, F.col("_increments")).otherwise(F.col("_baselines")),
            "_other": F.when(baseline, F.col("_last_increment")).otherwise(F.col("_last_baseline")),
        }
    ).where(F.col("_neighbours") >= 1)
    strict = (
        (F.col("_n") == 1)
        & (F.col("_neighbours") == 1)
        & (F.abs(F.col("_ms") - F.col("_other._ms")) <= pair_ms)
    )
    for c in COMPONENTS:
        strict = strict & (F.col(f"_one.{c}") == F.col(f"_other._one.{c}"))
    mine, other = F.col("_one.event_id"), F.col("_other._one.event_id")
    candidates = seen.select(
        *by,
        "session",
        "model",
        "source",
        F.col("_ms").alias("ts_ms"),
        F.col("_n").alias("events"),
        F.when(baseline, mine).otherwise(F.when(strict, other)).alias("baseline_id"),
        F.when(baseline, F.when(strict, other)).otherwise(mine).alias("increment_id"),
        strict.alias("_strict"),
    )
    # a pair is named by both of its events, anything else by the event itself
    key = [*by, "baseline_id", "increment_id", "_strict", F.when(~F.col("_strict"), F.col("source")).alias("_side")]
    named = candidates.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_votes"),
        F.min(F.struct("source", "session", "model", "ts_ms")).alias("_first"),
        F.sum("events").alias("events"),
    )
    mutual = F.col("_strict") & (F.col("_votes") == 2)
    return named.select(
        *by,
        F.when(mutual, "pair").otherwise("ambiguous").alias("status"),
        "baseline_id",
        "increment_id",
        F.col("_first.session").alias("session"),
        F.col("_first.model").alias("model"),
        F.col("_first.source").alias("source"),
        F.col("_first.ts_ms").alias("ts_ms"),
        "events",
    )


def mutual_pairs(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return matches.where(F.col("status") == "pair").select(*by, "baseline_id", "increment_id")


def ambiguous_points(matches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Points in time whose events have a neighbour in the other source but form no pair."""
    return matches.where(F.col("status") == "ambiguous").select(
        *by, "source", "session", "model", "ts_ms", "events"
    )


def merge_pairs(events: DataFrame, pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fold each pair into its baseline event.

    Numbers, id and source come from the baseline; labels from the preferred of
    the two; provenance is the union.  Only paired events are grouped again,
    everything else passes through.
    """
    members = pairs.select(
        *by, F.col("baseline_id").alias("pair_id"), F.explode(F.array("baseline_id", "increment_id")).alias("event_id")
    )
    # few events are paired: both joins send the small side around, the events stay where they are
    alone = keyed_join(events, members, [*by, "event_id"], "left_anti")
    paired = keyed_join(events, members, [*by, "event_id"], "inner")
    numeric = F.struct("event_id", *CORE, "calls", "copies", "conflicting")
    baseline_first = F.struct(
        (F.col("source") != fixed.SOURCE_BASELINE).cast("int"), F.col("device_order"), F.col("input_order")
    )
    folded = (
        paired.groupBy(*by, "pair_id")
        .agg(
            F.min_by(numeric, baseline_first).alias("_numeric"),
            *attribution_picks(),
            provenance_set(),
        )
    )
    merged = folded.withColumns(
        {
            **{c: F.col(f"_numeric.{c}") for c in ("event_id", *CORE, "calls", "copies", "conflicting")},
            **picked_attribution(),
            **united_provenance(),
        }
    )
    return alone.unionByName(merged.select(*alone.columns))


def record_fingerprint() -> Column:
    """Identity of a compact record: everything but device, project and activity."""
    parts = ["session", "model", "source"]
    texts = [F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(c).cast("string"), F.lit(":"), F.col(c))) for c in parts]
    numbers = [F.col(c).cast("string") for c in ("calls", "fresh_input", "cache_read", "output", "cache_write")]
    cost = F.col("cost").cast("decimal(38,9)").cast("string")
    return F.sha2(F.concat_ws("|", epoch_ms("ts").cast("string"), *texts, *numbers, cost), 256)


def multiset_merge(records: DataFrame, by: Sequence[str] = (), block: int = 65536) -> DataFrame:
    """Merge compact records of several devices as multisets.

    The nth copy on one device matches the nth copy on another, so the largest
    multiplicity survives.  Same columns as the input, plus ``matched`` (how many
    devices had that copy).  The result is not reliable at event level.
    """
    keyed = records.withColumn("_print", record_fingerprint())
    scope = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in by]
    keyed = keyed.withColumn("_copy_key", F.concat_ws("|", "_print", "device", *scope))
    numbered = occurrence_number(keyed, "_copy_key", "input_order", block, "_nth")
    measures = ["ts", "session", "model", "source", "calls", *COMPONENTS, "cost"]
    merged = numbered.groupBy(*by, "_print", "_nth").agg(
        F.min(F.struct(*measures)).alias("_same"), F.count(F.lit(1)).alias("matched"), *attribution_picks()
    )
    return merged.withColumns(
        {
            **{c: F.col(f"_same.{c}") for c in measures},
            **picked_attribution(),
            "activity": F.coalesce("_activity", "_pick.activity"),
        }
    ).drop("_print", "_nth", "_same", "_pick", "_project", "_activity")


def overlap_groups(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Time, session, model and source that several devices report with different numbers."""
    keyed = records.withColumn("_print", record_fingerprint())
    return (
        keyed.groupBy(*by, "ts", "session", "model", "source")
        .agg(
            F.countDistinct("device").alias("devices"),
            F.countDistinct("_print").alias("fingerprints"),
            F.count(F.lit(1)).alias("records"),
        )
        .where((F.col("devices") > 1) & (F.col("fingerprints") > 1))
    )


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
