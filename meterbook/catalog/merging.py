"""Unions and deduplication over the given tables."""

from pyspark.sql import functions as F

from meterbook.catalog import tables as t
from meterbook.catalog.registry import query, sql_time
from meterbook import fixed
from meterbook.operators import dedup, quality
from meterbook.operators.projects import resolve_projects
from meterbook.plans import merge
from meterbook.plans import ledger as ledger_plan
from meterbook.session import scratch_path
from meterbook.sources import devices, sinks

NUMBERS = "CAST(cost AS DOUBLE) AS cost, fresh_input, cache_read, cache_write, output"


@query(
    "u01_ledger_union",
    f"WITH {t.TWO_SOURCES} SELECT event_id, source, {sql_time('ts')} AS ts, session, model, project, activity, calls, tokens, {NUMBERS} FROM ledger",
)
def u01_ledger_union(spark, folder):
    """Baseline through its cutoff, export strictly after it, with ids and attribution."""
    events = ledger_plan.ledger_events(t.export_rows(spark, folder), t.request_log(spark, folder))
    return events.drop("fingerprint", "recovered")


@query(
    "u02_device_union",
    f"WITH {t.DEVICES} SELECT device, count(*) AS events, count(DISTINCT event_id) AS ids, CAST(sum(tokens) AS BIGINT) AS tokens FROM device_events GROUP BY device",
)
def u02_device_union(spark, folder):
    rows = t.device_events(spark, folder)
    union = rows.where(F.col("device") == "A").unionByName(rows.where(F.col("device") == "B"))
    return union.groupBy("device").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"), F.sum("tokens").alias("tokens")
    )


def _distinct(spark, folder):
    resolved = resolve_projects(merge.with_provenance(t.device_events(spark, folder)), t.alias_map(spark, folder))
    return dedup.exact_dedup(resolved)


MERGED = f"""WITH {t.DEVICES} SELECT event_id, copies, {sql_time('ts')} AS ts, source, session, model, {NUMBERS}, device, fingerprint_first AS fingerprint, project, activity, devices FROM merged"""


@query("u03_exact_dedup", MERGED)
def u03_exact_dedup(spark, folder):
    """One event per id; labels and provenance merged from all copies (W6)."""
    return _distinct(spark, folder).select(
        "event_id", "copies", "ts", "source", "session", "model", "cost", "fresh_input", "cache_read", "cache_write", "output",
        "device", "fingerprint", "project", "activity", "devices",
    )


def _device_lines(spark, folder):
    """Ledgers of both devices, written as lines and read back."""
    events = t.device_events(spark, folder)
    paths = {}
    for name in ("A", "B"):
        own = events.where(F.col("device") == name)
        paths[name] = scratch_path(spark, f"device-{name}")
        sinks.sink_ledger(own, own, paths[name], head=sinks.ledger_head(own, t.TZ))
    return devices.read_ledger_lines(spark, paths)


@query("s12_ledger_round_trip", MERGED)
def s12_ledger_round_trip(spark, folder):
    """Device ledgers that went through files merge as their sources do."""
    lines = _device_lines(spark, folder)
    return dedup.exact_dedup(resolve_projects(merge.with_provenance(lines.events), t.alias_map(spark, folder))).select(
        "event_id", "copies", "ts", "source", "session", "model", "cost", "fresh_input", "cache_read", "cache_write", "output",
        "device", "fingerprint", "project", "activity", "devices",
    )


def _heads(events, zones=("Asia/Shanghai",), reliable=True):
    zone = F.element_at(F.array(*[F.lit(z) for z in zones]), (F.col("device_order") % len(zones) + 1).cast("int"))
    return events.select("device", "device_order").distinct().select(
        "device", "device_order", zone.alias("timezone"), F.lit(fixed.LEDGER_SCHEMA).alias("schema"), F.lit(reliable).alias("reliable")
    )


@query(
    "u06_merge_ledgers",
    f"""WITH {t.DEVICES}, d AS (SELECT DISTINCT event_id, tokens FROM device_events)
SELECT 'events' AS mode, CAST(0 AS BIGINT) AS violations, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM d""",
)
def u06_merge_ledgers(spark, folder):
    """Reliable ledgers of one source pass every gate and are merged as events."""
    events = t.device_events(spark, folder).withColumn("source", F.lit(fixed.SOURCE_BASELINE))
    found = merge.merge_ledgers(_heads(events), events, events, t.TZ, t.alias_map(spark, folder))
    return found.events.agg(
        F.lit(found.mode).alias("mode"), F.lit(found.violations.count()).cast("bigint").alias("violations"), F.count(F.lit(1)).alias("events"),
        F.sum(F.col("fresh_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")).alias("tokens"),
    )


@query(
    "u06_refused_ambiguous",
    f"""WITH {t.NEAR}, p AS (SELECT source, session, model, ms FROM near JOIN ambiguous ON ambiguous.id = near.event_id GROUP BY ALL)
SELECT 'near-time-ambiguous' AS "check", count(*) AS violations FROM p HAVING count(*) > 0""",
)
def u06_refused_ambiguous(spark, folder):
    """Ambiguous neighbours refuse a merge of events."""
    events = t.near_events(spark, folder)
    found = merge.merge_ledgers(_heads(events), events, events, t.TZ)
    if found.events is not None:
        raise AssertionError("an ambiguous merge was given")
    return quality.tally(found.violations)


@query("u06_refused_zones", "SELECT 'device-timezone' AS \"check\", CAST(1 AS BIGINT) AS violations FROM (SELECT count(*) FROM events)")
def u06_refused_zones(spark, folder):
    """Ledgers of two time zones are not merged."""
    events = t.device_events(spark, folder)
    return quality.tally(merge.merge_ledgers(_heads(events, ("Asia/Shanghai", "Europe/Berlin")), events, events, t.TZ).violations)


@query("w06_preferred_copy", f"WITH {t.DEVICES} SELECT event_id, device, project, activity FROM merged WHERE copies > 1")
def w06_preferred_copy(spark, folder):
    """The preferred of several copies, its gaps filled from the next ones."""
    return _distinct(spark, folder).where(F.col("copies") > 1).select("event_id", "device", "project", "activity")


@query(
    "u03_core_conflicts",
    f"""WITH {t.DEVICES}, changed AS (SELECT event_id, cost + CASE WHEN device = 'B' AND output % 10 = 3 THEN 1 ELSE 0 END AS cost FROM device_events)
SELECT event_id, count(*) AS copies FROM changed GROUP BY event_id HAVING count(DISTINCT cost) > 1""",
)
def u03_core_conflicts(spark, folder):
    """Ids whose copies differ: a tenth of the events of one device has a changed cost."""
    rows = t.device_events(spark, folder)
    changed = (F.col("device") == "B") & (F.col("output") % 10 == 3)
    rows = rows.withColumn("cost", F.col("cost") + F.when(changed, 1).otherwise(0))
    distinct = dedup.exact_dedup(resolve_projects(merge.with_provenance(rows)))
    return distinct.where("conflicting").select("event_id", "copies")


def _matches(spark, folder):
    return dedup.near_time_matches(t.near_events(spark, folder))


@query("j11_near_time_pairs", f"WITH {t.NEAR} SELECT b AS baseline_id, i AS increment_id FROM pairs")
def j11_near_time_pairs(spark, folder):
    return dedup.mutual_pairs(_matches(spark, folder))


@query(
    "j11_ambiguous_points",
    f"""WITH {t.NEAR} SELECT source, session, model, ms AS ts_ms, count(*) AS events FROM near JOIN ambiguous ON ambiguous.id = near.event_id GROUP BY ALL""",
)
def j11_ambiguous_points(spark, folder):
    """Points in time that have a neighbour in the other source but no unique partner."""
    return dedup.ambiguous_points(_matches(spark, folder))


@query(
    "u04_near_time_dedup",
    f"""WITH {t.NEAR}, kept AS (SELECT * FROM near WHERE event_id NOT IN (SELECT i FROM pairs)),
prints AS (SELECT 'repo' AS x, sha256('host/team/r' || 0) AS f0, sha256('host/team/r' || 1) AS f1, sha256('host/team/r' || 2) AS f2)
SELECT k.event_id, k.source, k.session, k.model, CAST(k.cost AS DOUBLE) AS cost, k.fresh_input, k.cache_read, k.cache_write, k.output,
  CASE WHEN p.b IS NOT NULL THEN 'ccSwitch,codeburnIncrement' ELSE k.source END AS sources,
  CASE WHEN p.b IS NOT NULL OR k.source = 'ccSwitch' THEN k.activity END AS activity, p.b IS NOT NULL OR k.source = 'codeburnIncrement' AS known
FROM kept k LEFT JOIN pairs p ON p.b = k.event_id""",
)
def u04_near_time_dedup(spark, folder):
    """Pairs folded: numbers of the baseline, labels of both, provenance united."""
    merged = merge.merge_events(t.near_events(spark, folder)).events
    from meterbook.functions.labels import is_specific

    return merged.select(
        "event_id", "source", "session", "model", "cost", "fresh_input", "cache_read", "cache_write", "output", "sources",
        "activity", is_specific("project").alias("known"),
    )


@query(
    "u04_merged_records",
    f"""WITH {t.DEVICES} SELECT CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS date, CAST(hour(ts + INTERVAL 8 HOUR) AS BIGINT) AS hour, session, model, source, device,
  project, coalesce(activity, '历史未归类') AS activity, {sql_time('min(ts)')} AS ts, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls, CAST(sum(fresh_input) AS BIGINT) AS fresh_input,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output FROM merged GROUP BY 1, 2, session, model, source, device, project, 8""",
)
def u04_merged_records(spark, folder):
    """Compact records of merged events."""
    return merge.merged_records(_distinct(spark, folder), t.TZ)


@query(
    "u04_merged_coverage",
    f"""WITH {t.DEVICES}, r AS (SELECT tokens, model IS NOT NULL AS m, session IS NOT NULL AS s, project NOT LIKE '历史未归属%' AS p, activity IS NOT NULL AS a FROM merged),
c AS (SELECT unnest(['model', 'session', 'project', 'activity']) AS dimension, unnest([m, s, p, a]) AS known, tokens FROM r)
SELECT dimension, count(*) FILTER (known) AS attributed_calls, CAST(coalesce(sum(tokens) FILTER (known), 0) AS BIGINT) AS attributed_tokens, count(*) AS total_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens,
  count(*) FILTER (NOT known) AS unattributed_calls, CAST(coalesce(sum(tokens) FILTER (NOT known), 0) AS BIGINT) AS unattributed_tokens,
  CAST(count(*) FILTER (known) AS DOUBLE) / count(*) AS call_coverage, CAST(coalesce(sum(tokens) FILTER (known), 0) AS DOUBLE) / CAST(sum(tokens) AS DOUBLE) AS token_coverage FROM c GROUP BY dimension""",
)
def u04_merged_coverage(spark, folder):
    return merge.coverage(merge.merged_records(_distinct(spark, folder), t.TZ))


@query(
    "u04_interchange",
    f"""WITH {t.DEVICES} SELECT event_id AS "eventId", strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "occurredAt", coalesce(activity, '历史未归类') AS activity, project, devices, tokens AS total FROM merged""",
)
def u04_interchange(spark, folder):
    """Merged events as exchange documents: provenance and source ids beside the numbers."""
    documents = merge.interchange(_distinct(spark, folder))
    return documents.select(
        "eventId", "occurredAt", "activity", "project", F.col("provenance.devices").alias("devices"), F.col("components.totalTokens").alias("total")
    )


@query(
    "u05_multiset_merge",
    f"""WITH {t.COMPACT} SELECT {sql_time('ts')} AS ts, session, model, source, calls, {NUMBERS}, matched, device, project, activity FROM multiset""",
)
def u05_multiset_merge(spark, folder):
    """The nth copy on one device meets the nth copy on the other: the larger multiplicity survives."""
    merged = merge.merge_compact(t.compact_inputs(spark, folder), t.TZ)
    return merged.select(
        "ts", "session", "model", "source", "calls", "cost", "fresh_input", "cache_read", "cache_write", "output", "matched",
        "device", "project", "activity",
    )


@query(
    "u06_repeated_records",
    """SELECT event_type, CAST(value AS DOUBLE) AS value, count(*) AS copies FROM events GROUP BY event_type, value HAVING count(*) > 1""",
)
def u06_repeated_records(spark, folder):
    return dedup.repeated_rows(t.table(spark, folder, "events"), ["event_type", "value"])


@query(
    "u07_overlap_groups",
    f"""WITH {t.COMPACT} SELECT {sql_time('ts')} AS ts, session, model, source, count(DISTINCT device) AS devices, count(DISTINCT fresh_input) AS fingerprints, count(*) AS records
FROM compact GROUP BY ts, session, model, source HAVING count(DISTINCT device) > 1 AND count(DISTINCT fresh_input) > 1""",
)
def u07_overlap_groups(spark, folder):
    return dedup.overlap_groups(t.compact_inputs(spark, folder))


@query(
    "u06_merge_records",
    f"WITH {t.COMPACT} SELECT 'records' AS mode, count(*) AS records, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cost) AS DOUBLE) AS cost FROM multiset",
)
def u06_merge_records(spark, folder):
    """Ledgers that are not reliable at event level are merged as multisets of records."""
    records = t.compact_inputs(spark, folder)
    found = merge.merge_ledgers(_heads(records, reliable=False), records, records, t.TZ)
    return found.records.agg(
        F.lit(found.mode).alias("mode"), F.count(F.lit(1)).alias("records"), F.sum("calls").alias("calls"), F.sum("cost").alias("cost")
    )
