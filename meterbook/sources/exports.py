"""Session exports: one nested JSON document per account or device."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.identity import normalize_session_id
from meterbook.functions.labels import clean_dimension
from meterbook.functions.timeparts import epoch_ms, from_epoch_ms, parse_date, parse_instant
from meterbook.functions.tokens import components_from_split
from meterbook.operators.quality import row_checks
from meterbook.sources.portable import read_documents
from meterbook.sources.splitjson import SPLIT_BYTES, read_elements

_MONEY = T.DecimalType(28, 9)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _named(pairs: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


_S, _L = T.StringType(), T.LongType()
RECORD = _struct(
    project=_S, sessionId=_S, timestamp=_S, category=_S, provider=_S, model=_S, inputTokens=_L, outputTokens=_L,
    reasoningTokens=_L, cacheReadTokens=_L, cacheWriteTokens=_L, cost=_MONEY, calls=_L,
)
DAY = _named(
    [("Date", _S), ("Cost (USD)", _MONEY), ("API Calls", _L), ("Sessions", _L), ("Input Tokens", _L),
     ("Output Tokens", _L), ("Cache Read Tokens", _L), ("Cache Write Tokens", _L)]
)
MODEL = _named(
    [("Model", _S), ("Cost (USD)", _MONEY), ("Share (%)", T.DoubleType()), ("API Calls", _L), ("Input Tokens", _L),
     ("Output Tokens", _L), ("Cache Read Tokens", _L), ("Cache Write Tokens", _L)]
)
ACTIVITY = _named([("Activity", _S), ("Cost (USD)", _MONEY), ("Share (%)", T.DoubleType()), ("Turns", _L)])
SESSION = _named(
    [("Session ID", _S), ("Project", _S), ("Started At", _S), ("Cost (USD)", _MONEY), ("API Calls", _L), ("Turns", _L)]
)
PROJECT = _named([("Project", _S), ("Cost (USD)", _MONEY), ("API Calls", _L), ("Sessions", _L)])
SUMMARY = _named([("Cost (USD)", _MONEY), ("API Calls", _L), ("Sessions", _L), ("Projects", _L)])
PERIOD = _struct(label=_S, daily=T.ArrayType(DAY), models=T.ArrayType(MODEL), activity=T.ArrayType(ACTIVITY))
EXPORT = _struct(
    schema=_S, generated=_S, codeburnVersion=_S, summary=T.ArrayType(SUMMARY), periods=T.ArrayType(PERIOD),
    records=T.ArrayType(RECORD), sessions=T.ArrayType(SESSION), projects=T.ArrayType(PROJECT),
)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    return parse_exports(read_documents(spark, path))


def parse_exports(documents: DataFrame) -> DataFrame:
    """One row per export with nested columns."""
    return documents.select("document", F.from_json("payload", EXPORT).alias("e")).select("document", "e.*")


def export_checks(exports: DataFrame) -> DataFrame:
    schema, size = F.col("schema"), F.coalesce(F.size("records"), F.lit(0))
    days = F.coalesce(F.size(F.try_element_at("periods", F.lit(1))["daily"]), F.lit(0))
    return row_checks(
        exports,
        F.col("document"),
        [
            ("export-schema", ~schema.eqNullSafe(F.lit(fixed.EXPORT_SCHEMA)), fixed.EXPORT_SCHEMA, schema),
            ("export-records", size < 1, ">= 1 record", size),
            ("export-days", days < 1, ">= 1 day", days),
        ],
    )


def export_records(exports: DataFrame) -> DataFrame:
    """Records with their place in the export; provider and validity rules are left to operators."""
    return _usage(exports.select("document", F.posexplode("records").alias("input_order", "r")).select("document", "input_order", "r.*"))


def read_split_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, parts: bool = False) -> DataFrame:
    """The same records of exports of any size, each read by as many tasks as it has ranges; the order is the byte a record begins at."""
    found = read_elements(spark, path, split_bytes, parts=parts).where("kind = 'element' AND field = 'records'")
    return _usage(found.select("document", F.col("place").alias("input_order"), F.from_json("value", RECORD).alias("r")).select("document", "input_order", "r.*"))


def _usage(rows: DataFrame) -> DataFrame:
    usage = rows.select(
        "document",
        "input_order",
        F.col("provider"),
        from_epoch_ms(epoch_ms(parse_instant("timestamp"))).alias("ts"),
        clean_dimension("sessionId").alias("session"),
        clean_dimension("model").alias("model"),
        clean_dimension("project").alias("project"),
        clean_dimension("category").alias("activity"),
        "inputTokens",
        "cacheReadTokens",
        "cacheWriteTokens",
        "outputTokens",
        F.coalesce("reasoningTokens", F.lit(0)).alias("reasoning"),
        F.coalesce("cost", F.lit(0).cast(_MONEY)).alias("cost"),
        F.col("calls"),
    )
    usage = usage.withColumn("session", normalize_session_id("session"))
    split = components_from_split(usage, "inputTokens", "cacheReadTokens", "cacheWriteTokens", "outputTokens")
    return split.drop("inputTokens", "cacheReadTokens", "cacheWriteTokens", "outputTokens")


def _first_period(exports: DataFrame, column: str) -> DataFrame:
    period = F.try_element_at("periods", F.lit(1))
    return exports.select("document", F.posexplode(period[column]).alias("ord", "row")).select("document", "ord", "row.*")


def export_days(exports: DataFrame) -> DataFrame:
    return _first_period(exports, "daily").select(
        "document",
        parse_date("Date").alias("date"),
        F.coalesce(F.col("Cost (USD)"), F.lit(0).cast(_MONEY)).alias("cost"),
        F.coalesce(F.col("API Calls"), F.lit(0)).alias("calls"),
        F.coalesce(F.col("Sessions"), F.lit(0)).alias("sessions"),
        F.coalesce(F.col("Input Tokens"), F.lit(0)).alias("fresh_input"),
        F.coalesce(F.col("Cache Read Tokens"), F.lit(0)).alias("cache_read"),
        F.coalesce(F.col("Cache Write Tokens"), F.lit(0)).alias("cache_write"),
        F.coalesce(F.col("Output Tokens"), F.lit(0)).alias("output"),
    )


def export_models(exports: DataFrame) -> DataFrame:
    return _first_period(exports, "models").select(
        "document", "ord", F.col("Model").alias("model"), F.col("Cost (USD)").alias("cost"),
        (F.col("Share (%)") / 100).alias("share"), F.col("API Calls").alias("calls"),
        F.col("Input Tokens").alias("fresh_input"), F.col("Cache Read Tokens").alias("cache_read"),
        F.col("Cache Write Tokens").alias("cache_write"), F.col("Output Tokens").alias("output"),
    )


def export_activities(exports: DataFrame) -> DataFrame:
    return _first_period(exports, "activity").select(
        "document", "ord", F.col("Activity").alias("activity"), F.col("Cost (USD)").alias("cost"),
        (F.col("Share (%)") / 100).alias("share"), F.col("Turns").alias("turns"),
    )


def export_sessions(exports: DataFrame) -> DataFrame:
    return exports.select("document", F.explode("sessions").alias("s")).select(
        "document", F.col("s.Session ID").alias("session"), F.col("s.Project").alias("project"),
        parse_instant(F.col("s.Started At")).alias("started_at"), F.col("s.Cost (USD)").alias("cost"),
        F.col("s.API Calls").alias("calls"), F.col("s.Turns").alias("turns"),
    )


def export_projects(exports: DataFrame) -> DataFrame:
    return exports.select("document", F.posexplode("projects").alias("ord", "p")).select(
        "document", "ord", F.col("p.Project").alias("project"), F.col("p.Cost (USD)").alias("cost"),
        F.col("p.API Calls").alias("calls"), F.col("p.Sessions").alias("sessions"),
    )


def export_summary(exports: DataFrame) -> DataFrame:
    first = F.try_element_at("summary", F.lit(1))
    return exports.select(
        "document", first["Cost (USD)"].alias("period_cost"), first["API Calls"].alias("total_calls"),
        first["Sessions"].alias("sessions"), first["Projects"].alias("projects"),
    )
