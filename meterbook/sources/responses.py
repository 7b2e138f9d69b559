"""Daily usage, skill and plugin responses of the activity dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.functions.labels import client_display_name, trim
from meterbook.functions.timeparts import parse_date
from meterbook.sources.portable import read_documents

_S, _L, _D = T.StringType(), T.LongType(), T.DecimalType(28, 9)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


USAGE_DAY = _struct(
    date=_S,
    totals=_struct(
        credits=_D, threads=_L, turns=_L, cached_text_input_tokens=_L, uncached_text_input_tokens=_L,
        text_output_tokens=_L, text_total_tokens=_L,
    ),
    models=T.ArrayType(_struct(model=_S, credits=_D, threads=_L, turns=_L)),
    clients=T.ArrayType(_struct(client_id=_S, credits=_D, threads=_L, turns=_L)),
)
SKILL_DAY = _struct(
    date=_S, skill_usage_overviews=T.ArrayType(_struct(skill_name=_S, display_name=_S, invocation_counts=_L))
)
PLUGIN_DAY = _struct(
    date=_S,
    plugin_usage_overviews=T.ArrayType(
        _struct(plugin_id=_S, plugin_name=_S, display_name=_S, invocation_counts=_L)
    ),
)
TOOL_FIELDS = {
    "skills": (SKILL_DAY, "skill_usage_overviews", "skill_name"),
    "plugins": (PLUGIN_DAY, "plugin_usage_overviews", "plugin_name"),
}


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path)


def _days(documents: DataFrame, day: T.StructType) -> DataFrame:
    """Day rows of bodies that are either an array or an object with a data array."""
    as_object = F.from_json("payload", _struct(data=T.ArrayType(day), group_by=_S))
    as_array = F.from_json("payload", T.ArrayType(day))
    is_array = F.startswith(trim("payload"), F.lit("["))
    parsed = documents.select(
        *[c for c in documents.columns if c != "payload"],
        F.when(is_array, as_array).otherwise(as_object["data"]).alias("_rows"),
        F.when(~is_array, as_object["group_by"]).alias("group_by"),
    )
    kept = [c for c in parsed.columns if c != "_rows"]
    return parsed.select(*kept, F.posexplode("_rows").alias("pos", "d")).select(*kept, "pos", "d.*")


def parse_usage(documents: DataFrame) -> DataFrame:
    """One row per day: totals as columns, model and client detail as arrays."""
    days = _days(documents, USAGE_DAY)
    kept = [c for c in documents.columns if c != "payload"]
    zero = F.lit(0).cast("bigint")

    def detail(column: str, name: str, extra: bool) -> Column:
        def row(item: Column) -> Column:
            fields = [
                trim(item[name]).alias(name),
                F.coalesce(item["threads"], zero).alias("threads"),
                F.coalesce(item["turns"], zero).alias("turns"),
                F.coalesce(item["credits"], F.lit(0).cast(_D)).alias("credits"),
            ]
            if extra:
                fields.append(client_display_name(trim(item[name])).alias("display_name"))
            return F.struct(*fields)

        missing = F.array().cast(days.schema[column].dataType)
        return F.transform(F.coalesce(F.col(column), missing), row)

    return days.select(
        *kept,
        "group_by",
        "pos",
        F.col("date").alias("date_text"),
        parse_date("date").alias("date"),
        F.col("totals.credits").alias("credits"),
        F.col("totals.cached_text_input_tokens").alias("cached"),
        F.col("totals.uncached_text_input_tokens").alias("uncached"),
        F.col("totals.text_output_tokens").alias("output"),
        F.col("totals.text_total_tokens").alias("tokens"),
        F.col("totals.threads").alias("threads"),
        F.col("totals.turns").alias("turns"),
        detail("models", "model", False).alias("models"),
        detail("clients", "client_id", True).alias("clients"),
    )


def parse_tools(documents: DataFrame, kind: str) -> DataFrame:
    """One row per day with the skill or plugin items as an array."""
    day, listed, name = TOOL_FIELDS[kind]
    days = _days(documents, day)
    kept = [c for c in documents.columns if c != "payload"]

    def item(row: Column) -> Column:
        label = trim(row[name])
        shown = F.coalesce(F.nullif(trim(row["display_name"]), F.lit("")), label)
        plugin = trim(row["plugin_id"]) if kind == "plugins" else F.lit(None).cast("string")
        return F.struct(
            label.alias("name"),
            shown.alias("display_name"),
            plugin.alias("plugin_id"),
            row["invocation_counts"].alias("invocations"),
        )

    return days.select(
        *kept, "group_by", "pos", F.col("date").alias("date_text"), parse_date("date").alias("date"),
        F.transform(listed, item).alias("items"),
    )
