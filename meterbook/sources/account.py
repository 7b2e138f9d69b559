"""Account series: authoritative daily token totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.timeparts import parse_date
from meterbook.operators.quality import row_checks
from meterbook.sources.portable import read_documents

_FIELDS = ("lifetimeTokens", "peakDailyTokens", "longestRunningTurnSec", "currentStreakDays", "longestStreakDays")
ACCOUNT = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("generatedAt", T.StringType()),
        T.StructField("summary", T.StructType([T.StructField(f, T.LongType()) for f in _FIELDS])),
        T.StructField(
            "dailyUsageBuckets",
            T.ArrayType(T.StructType([T.StructField("startDate", T.StringType()), T.StructField("tokens", T.LongType())])),
        ),
    ]
)


def read_account(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_account(read_documents(spark, path))


def parse_account(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary rows and daily buckets.  A missing summary figure stays null."""
    parsed = documents.select("document", F.from_json("payload", ACCOUNT).alias("a"))
    summary = parsed.select(
        "document",
        F.col("a.schema").alias("schema"),
        F.col("a.generatedAt").alias("generated_at"),
        F.col("a.summary.lifetimeTokens").alias("lifetime_tokens"),
        F.col("a.summary.peakDailyTokens").alias("peak_daily_tokens"),
        F.col("a.summary.longestRunningTurnSec").alias("longest_running_turn_sec"),
        F.col("a.summary.currentStreakDays").alias("current_streak_days"),
        F.col("a.summary.longestStreakDays").alias("longest_streak_days"),
    )
    buckets = parsed.select("document", F.posexplode("a.dailyUsageBuckets").alias("pos", "b")).select(
        "document",
        "pos",
        F.col("b.startDate").alias("date_text"),
        parse_date("b.startDate").alias("date"),
        F.col("b.tokens").alias("tokens"),
    )
    return summary, buckets


def account_schema_checks(summary: DataFrame) -> DataFrame:
    figures = ("lifetime_tokens", "peak_daily_tokens", "longest_running_turn_sec", "current_streak_days", "longest_streak_days")
    return row_checks(
        summary,
        F.col("document"),
        [
            ("account-schema", ~F.col("schema").eqNullSafe(F.lit(fixed.ACCOUNT_SCHEMA)), fixed.ACCOUNT_SCHEMA, F.col("schema")),
            *[(f"account-{f}", ~F.col(f).between(0, fixed.MAX_SAFE_INTEGER), "0 … 2^53-1", F.col(f)) for f in figures],
        ],
    )
