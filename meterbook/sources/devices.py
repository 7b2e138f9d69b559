"""Device ledgers and project alias maps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.labels import clean_dimension, single_alias, trim, value_conflict
from meterbook.functions.timeparts import epoch_ms, from_epoch_ms, parse_instant
from meterbook.operators.quality import row_checks, stack
from meterbook.sources.portable import read_documents

_S, _L, _D = T.StringType(), T.LongType(), T.DecimalType(28, 9)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


COMPONENT_FIELDS = {
    "fresh_input": ("input", "freshInputTokens"),
    "cache_read": ("cacheRead", "cacheReadTokens"),
    "cache_write": ("cacheWrite", "cacheWriteTokens"),
    "output": ("output", "outputTokens"),
}
_NESTED = _struct(
    freshInputTokens=_L, cacheReadTokens=_L, cacheWriteTokens=_L, outputTokens=_L, totalTokens=_L
)
EVENT = _struct(
    eventId=_S, occurredAt=_S, timestamp=_S, source=_S, sessionId=_S, model=_S, project=_S, projectAlias=_S,
    projectFingerprint=_S, repositoryFingerprint=_S, activity=_S, task=_S, cost=_D, costUsd=_D, calls=_L,
    input=_L, cacheRead=_L, cacheWrite=_L, output=_L, freshInputTokens=_L, cacheReadTokens=_L, cacheWriteTokens=_L,
    outputTokens=_L, totalTokens=_L, components=_NESTED,
    provenance=_struct(devices=T.ArrayType(_S), sources=T.ArrayType(_S)), sourceEventIds=T.ArrayType(_S),
)
RECORD = _struct(
    timestamp=_S, sessionId=_S, model=_S, project=_S, projectFingerprint=_S, activity=_S, source=_S, cost=_D,
    calls=_L, input=_L, cacheRead=_L, output=_L, cacheWrite=_L,
)
LEDGER = _struct(
    schema=_S, generatedAt=_S, timezone=_S,
    cutoff=_struct(ccSwitchMaxCreatedAtEpochSeconds=_L, codeburnAppendAfter=_S),
    range=_struct(firstAt=_S, lastAt=_S),
    eventContract=_struct(eventLevelReliable=T.BooleanType()),
    events=T.ArrayType(EVENT), records=T.ArrayType(RECORD),
)
ALIASES = _struct(schema=_S, aliases=T.ArrayType(_struct(device=_S, project=_S, alias=_S)))


def device_name(label: str) -> str:
    """A device label: trimmed, 1 to 64 printable characters."""
    name = label.strip()
    if not 1 <= len(name) <= 64 or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise ValueError(f"device label must have 1 to 64 printable characters: {label!r}")
    return name


def read_device_ledgers(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Ledger documents of several devices, tagged with label and order."""
    if not paths:
        raise ValueError("no device ledger given")
    out = None
    for order, (label, path) in enumerate(paths.items()):
        name = device_name(label)
        one = read_documents(spark, path).withColumns(
            {"device": F.lit(name), "device_order": F.lit(order).cast("bigint")}
        )
        out = one if out is None else out.unionByName(one)
    return parse_device_ledgers(out)


def parse_device_ledgers(documents: DataFrame) -> DataFrame:
    kept = [c for c in documents.columns if c != "payload"]
    return documents.select(*kept, F.from_json("payload", LEDGER).alias("l")).select(*kept, "l.*")


def _component(name: str) -> list[Column]:
    short, long = COMPONENT_FIELDS[name]
    return [F.col(f"e.{short}"), F.col(f"e.{long}"), F.col(f"e.components.{long}")]


def ledger_document_checks(ledgers: DataFrame) -> DataFrame:
    """A document that does not parse, or holds neither events nor records, is a violation."""
    return row_checks(
        ledgers,
        F.col("device"),
        [
            ("ledger-malformed", F.col("schema").isNull() & F.col("events").isNull() & F.col("records").isNull(), "a ledger document", F.lit("other")),
            ("ledger-empty", F.col("schema").isNotNull() & F.col("events").isNull() & F.col("records").isNull(), "events or records", F.lit("neither")),
        ],
    )


def ledger_events(ledgers: DataFrame) -> DataFrame:
    """Normalised events with device, order, provenance and declared totals."""
    return normalised_events(ledgers.select("device", "device_order", F.posexplode("events").alias("input_order", "e")))


@dataclass
class LedgerLines:
    """Device ledgers in line-delimited form: tables that split, whatever their size."""

    heads: DataFrame
    events: DataFrame
    records: DataFrame
    malformed: DataFrame


_LINE = T.StructType([*EVENT.fields, T.StructField("inputOrder", _L), T.StructField("_corrupt", _S)])
_RECORD_LINE = T.StructType([*RECORD.fields, T.StructField("inputOrder", _L), T.StructField("_corrupt", _S)])
_HEAD_LINE = T.StructType([*[f for f in LEDGER.fields if f.name not in ("events", "records")], T.StructField("_corrupt", _S)])


def read_ledger_lines(spark: SparkSession, paths: Mapping[str, str]) -> LedgerLines:
    """Folders that ``sink_ledger`` wrote, one for each device label.

    A line that does not parse is a row of ``malformed`` (check key expected actual) and is in no table.
    """
    if not paths:
        raise ValueError("no device ledger given")
    parts: dict[str, list[DataFrame]] = {"head": [], "events": [], "records": []}
    kinds = {"head": _HEAD_LINE, "events": _LINE, "records": _RECORD_LINE}
    for order, (label, path) in enumerate(paths.items()):
        name = device_name(label)
        for kind, schema in kinds.items():
            lines = spark.read.text(f"{path.rstrip('/')}/{kind}_lines").select("value")
            parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
            parts[kind].append(parsed.select(F.lit(name).alias("device"), F.lit(order).cast("bigint").alias("device_order"), "value", "e"))
    stacked = {kind: reduce(DataFrame.unionByName, frames) for kind, frames in parts.items()}
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    malformed = stack(*[
        row_checks(df, F.concat_ws("|", "device", F.lit(kind)), [("ledger-line-malformed", bad, "a JSON object", F.substring("value", 1, 80))])
        for kind, df in stacked.items()
    ])
    good = {kind: df.where(~bad) for kind, df in stacked.items()}

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn("input_order", F.coalesce("e.inputOrder", F.lit(0).cast("bigint")))

    return LedgerLines(
        ledger_heads(good["head"].select("device", "device_order", "e.*")),
        normalised_events(ordered(good["events"])),
        normalised_records(ordered(good["records"])),
        malformed,
    )


def normalised_events(rows: DataFrame) -> DataFrame:
    """Events from rows (device, device_order, input_order, e)."""
    parts = {c: F.coalesce(*_component(c), F.lit(0).cast("bigint")) for c in COMPONENT_FIELDS}
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    source = clean_dimension("e.source")
    event_id = trim(F.col("e.eventId"))
    none = F.array().cast("array<string>")
    return rows.select(
        "device",
        "device_order",
        F.col("input_order").cast("bigint").alias("input_order"),
        event_id.alias("event_id"),
        from_epoch_ms(epoch_ms(parse_instant(single_alias("e.occurredAt", "e.timestamp")))).alias("ts"),
        source.alias("source"),
        clean_dimension("e.sessionId").alias("session"),
        clean_dimension("e.model").alias("model"),
        clean_dimension(single_alias("e.project", "e.projectAlias")).alias("project"),
        clean_dimension(single_alias("e.projectFingerprint", "e.repositoryFingerprint")).alias("fingerprint"),
        clean_dimension(single_alias("e.activity", "e.task")).alias("activity"),
        F.coalesce("e.cost", "e.costUsd", F.lit(0).cast(_D)).alias("cost"),
        F.coalesce("e.calls", F.lit(1).cast("bigint")).alias("calls"),
        *[v.alias(k) for k, v in parts.items()],
        F.coalesce("e.totalTokens", "e.components.totalTokens", total).alias("tokens"),
        F.array_union(F.coalesce("e.provenance.devices", none), F.array("device")).alias("devices"),
        F.array_union(F.coalesce("e.provenance.sources", none), F.array(source)).alias("sources"),
        F.array_union(F.array(event_id), F.coalesce("e.sourceEventIds", none)).alias("source_event_ids"),
    )


def spelling_checks(ledgers: DataFrame) -> DataFrame:
    """A component given directly and nested must agree; so must the two totals."""
    rows = ledgers.select("device", F.explode("events").alias("e"))
    checks = [
        (f"event-{name}-spelling", value_conflict(*_component(name)), "one value", F.concat_ws(",", *_component(name)))
        for name in COMPONENT_FIELDS
    ]
    totals = [F.col("e.totalTokens"), F.col("e.components.totalTokens")]
    checks.append(("event-total-spelling", value_conflict(*totals), "one value", F.concat_ws(",", *totals)))
    return row_checks(rows, F.col("e.eventId"), checks)


def ledger_records(ledgers: DataFrame) -> DataFrame:
    """Normalised compact records with device and order."""
    return normalised_records(ledgers.select("device", "device_order", F.posexplode("records").alias("input_order", "e")))


def normalised_records(rows: DataFrame) -> DataFrame:
    """Compact records from rows (device, device_order, input_order, e)."""
    rows = rows.withColumnRenamed("e", "r")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "device",
        "device_order",
        F.col("input_order").cast("bigint").alias("input_order"),
        from_epoch_ms(epoch_ms(parse_instant("r.timestamp"))).alias("ts"),
        clean_dimension("r.sessionId").alias("session"),
        clean_dimension("r.model").alias("model"),
        clean_dimension("r.project").alias("project"),
        clean_dimension("r.projectFingerprint").alias("fingerprint"),
        clean_dimension("r.activity").alias("activity"),
        clean_dimension("r.source").alias("source"),
        F.coalesce("r.cost", F.lit(0).cast(_D)).alias("cost"),
        F.coalesce("r.calls", zero).alias("calls"),
        F.coalesce("r.input", zero).alias("fresh_input"),
        F.coalesce("r.cacheRead", zero).alias("cache_read"),
        F.coalesce("r.cacheWrite", zero).alias("cache_write"),
        F.coalesce("r.output", zero).alias("output"),
    )


def ledger_heads(ledgers: DataFrame) -> DataFrame:
    """Device, time zone, reliability and cutoff of each ledger."""
    return ledgers.select(
        "device",
        "device_order",
        "timezone",
        "schema",
        F.coalesce("eventContract.eventLevelReliable", F.lit(False)).alias("reliable"),
        F.col("cutoff.ccSwitchMaxCreatedAtEpochSeconds").alias("cutoff_seconds"),
        epoch_ms(parse_instant("cutoff.codeburnAppendAfter")).alias("append_after_ms"),
        parse_instant("range.firstAt").alias("first_at"),
        parse_instant("range.lastAt").alias("last_at"),
    )


def ledger_head_checks(heads: DataFrame) -> DataFrame:
    return row_checks(
        heads,
        F.col("device"),
        [("ledger-schema", ~F.col("schema").eqNullSafe(F.lit(fixed.LEDGER_SCHEMA)), fixed.LEDGER_SCHEMA, F.col("schema"))],
    )


def read_alias_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_alias_map(read_documents(spark, path))


def parse_alias_map(documents: DataFrame) -> DataFrame:
    parsed = documents.select("document", F.from_json("payload", ALIASES).alias("m"))
    rows = parsed.select("document", F.col("m.schema").alias("schema"), F.explode("m.aliases").alias("a"))
    return rows.select(
        "document", "schema", trim("a.device").alias("device"), trim("a.project").alias("project"), trim("a.alias").alias("alias")
    )


def alias_checks(aliases: DataFrame) -> DataFrame:
    """Printable texts of bounded length, and no separator in an alias."""

    def unprintable(column: str, limit: int) -> Column:
        value = F.col(column)
        good = (F.length(value) >= 1) & (F.length(value) <= limit) & ~value.rlike(r"[\x00-\x1f\x7f]")
        return ~F.coalesce(good, F.lit(False))

    return row_checks(
        aliases,
        F.concat_ws("|", "device", "project"),
        [
            ("alias-schema", ~F.col("schema").eqNullSafe(F.lit(fixed.ALIAS_SCHEMA)), fixed.ALIAS_SCHEMA, F.col("schema")),
            ("alias-device", unprintable("device", 64), "1 to 64 printable characters", F.col("device")),
            ("alias-project", unprintable("project", 4096), "1 to 4096 printable characters", F.col("project")),
            ("alias-text", unprintable("alias", 80), "1 to 80 printable characters", F.col("alias")),
            ("alias-separator", F.col("alias").rlike(r"[\\/]"), "no separator", F.col("alias")),
        ],
    )
