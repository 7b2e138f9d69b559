"""Writers for ledgers, report tables and gated responses."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.timeparts import iso_utc, month_key
from meterbook.operators.quality import require_clean
from meterbook.operators.textscan import gate


def event_documents(events: DataFrame) -> DataFrame:
    """Ledger events in the shape of the interchange format, one object per row."""
    kept = [c for c in ("provenance", "sourceEventIds") if c in events.columns]
    if "input_order" in events.columns:
        kept.append(F.col("input_order").alias("inputOrder"))
    return events.select(
        F.col("event_id").alias("eventId"),
        iso_utc("ts").alias("occurredAt"),
        "source",
        F.col("session").alias("sessionId"),
        "model",
        "project",
        "activity",
        F.col("fingerprint").alias("projectFingerprint"),
        F.col("cost").cast("decimal(28,9)").alias("costUsd"),
        F.struct(
            F.col("fresh_input").alias("freshInputTokens"),
            F.col("cache_read").alias("cacheReadTokens"),
            F.col("cache_write").alias("cacheWriteTokens"),
            F.col("output").alias("outputTokens"),
            F.col("tokens").alias("totalTokens"),
        ).alias("components"),
        *kept,
    )


def record_documents(records: DataFrame) -> DataFrame:
    """Compact records in the shape of the interchange format, one object per row."""
    return records.select(
        iso_utc("ts").alias("timestamp"), F.col("session").alias("sessionId"), "model", "project", "activity", "source",
        F.col("cost").cast("decimal(28,9)").alias("cost"), "calls", F.col("fresh_input").alias("input"),
        F.col("cache_read").alias("cacheRead"), "output", F.col("cache_write").alias("cacheWrite"),
        *[F.col(c).alias(n) for c, n in (("fingerprint", "projectFingerprint"), ("input_order", "inputOrder")) if c in records.columns],
    )


def ledger_head(events: DataFrame, tz: str, cutoff: DataFrame | None = None, reliable: bool = True) -> DataFrame:
    """Schema, zone, cutoff, range and event contract of a ledger, as one row."""
    bounds = events.agg(iso_utc(F.min("ts")).alias("firstAt"), iso_utc(F.max("ts")).alias("lastAt"))
    last = F.lit(None).cast("bigint") if cutoff is None else cutoff.select("cutoff_seconds").scalar()
    return bounds.select(
        F.lit(fixed.LEDGER_SCHEMA).alias("schema"),
        F.lit(tz).alias("timezone"),
        F.struct(last.alias("ccSwitchMaxCreatedAtEpochSeconds")).alias("cutoff"),
        F.struct("firstAt", "lastAt").alias("range"),
        F.struct(F.lit(reliable).alias("eventLevelReliable")).alias("eventContract"),
    )


def sink_ledger(events: DataFrame, compact: DataFrame, path: str, compression: str = "gzip", head: DataFrame | None = None) -> None:
    """Both tables as compressed JSON lines for exchange and as parquet for work; ``read_ledger_lines`` reads the lines."""
    documents = event_documents(events)
    lines = {"events": documents, "records": record_documents(compact)}
    if head is not None:
        lines["head"] = head
    for kind, df in lines.items():
        df.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", False).json(f"{path}/{kind}_lines")
    events.write.mode("overwrite").parquet(f"{path}/events")
    compact.write.mode("overwrite").parquet(f"{path}/records")


def sink_report_tables(tables: Mapping[str, DataFrame], path: str, monthly: tuple[str, ...] = ("facts",)) -> None:
    """One parquet table per report table; facts are partitioned by month."""
    for name, df in tables.items():
        if name in monthly:
            # rebalanced by size: few files per month, and a hot month is split over writers
            df = df.withColumn("month", month_key("date")).hint("rebalance", "month")
            df.write.mode("overwrite").partitionBy("month").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


class ReportSetError(ValueError):
    """There is no whole set of report tables."""


def sink_report_set(tables: Mapping[str, DataFrame], path: str, monthly: tuple[str, ...] = ("facts",)) -> str:
    """All tables of a report as one set; returns its name.

    Tables go to a folder of their own and a manifest, which names them with schema and
    row count, is written last.  Readers see a set from then on, whole or not at all,
    and an earlier set stays readable while a later one is written.
    """
    spark = next(iter(tables.values())).sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    sink_report_tables(tables, f"{path}/{name}", monthly)
    # a few dozen rows; the counts come from the footers of what was written
    listed = [(name, table, df.schema.json(), spark.read.parquet(f"{path}/{name}/{table}").count()) for table, df in tables.items()]
    manifest = spark.createDataFrame(listed, "set string, table string, schema string, rows bigint")
    manifest.coalesce(1).write.json(f"{path}/manifests/{name}")
    return name


def read_report_set(spark: SparkSession, path: str, name: str | None = None) -> dict[str, DataFrame]:
    """Tables of the latest set, or of the set ``name``; refused without its manifest or if a table is missing or incomplete."""
    try:
        listed = spark.read.schema("set string, table string, schema string, rows bigint").option("recursiveFileLookup", True).json(f"{path}/manifests").collect()
    except AnalysisException as error:
        raise ReportSetError(f"no manifest below {path}") from error
    wanted = name or max((r["set"] for r in listed), default=None)
    own = [r for r in listed if r["set"] == wanted]
    if not own:
        raise ReportSetError(f"no manifest of set {wanted}")
    out = {}
    for r in own:
        schema = T.StructType.fromJson(json.loads(r["schema"]))
        try:
            found = spark.read.schema(schema).parquet(f"{path}/{wanted}/{r['table']}")
        except AnalysisException as error:
            raise ReportSetError(f"table {r['table']} of set {wanted} is missing") from error
        if found.count() != r["rows"]:
            raise ReportSetError(f"table {r['table']} of set {wanted} has not the {r['rows']} rows of its manifest")
        out[r["table"]] = found.select(*[F.col(f"`{name}`") for name in schema.names])
    return out


def sink_responses(responses: DataFrame, path: str) -> DataFrame:
    """Write response bodies only if none of them is rejected."""
    clean, violations = gate(responses)
    require_clean(violations)
    clean.write.mode("overwrite").partitionBy("kind").text(path)
    return clean
