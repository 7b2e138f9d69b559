"""Baseline request log: a landed table of per-request rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.identity import normalize_session_id
from meterbook.functions.labels import clean_dimension
from meterbook.functions.timeparts import from_epoch_seconds
from meterbook.functions.tokens import components_from_inclusive
from meterbook.operators.keyed import summarise
from meterbook.operators.quality import number_rules, row_checks

COLUMNS = (
    "request_id", "created_at", "model", "session_id", "input_tokens", "output_tokens", "cache_read_tokens",
    "cache_creation_tokens", "total_cost_usd", "app_type",
)


def app_rows(log: DataFrame, app: str = fixed.DEFAULT_PROVIDER, by: Sequence[str] = ()) -> DataFrame:
    """Rows of one application; filter and column list reach the scan."""
    return log.where(F.col("app_type") == app).select(*by, *[c for c in COLUMNS if c != "app_type"])


def baseline_cutoff(log: DataFrame, app: str = fixed.DEFAULT_PROVIDER, by: Sequence[str] = ()) -> DataFrame:
    """Last whole second of the wanted application per key; a key without rows has none."""
    return summarise(app_rows(log, app, by), by, cutoff_seconds=F.max("created_at"))


def baseline_rows(log: DataFrame, app: str = fixed.DEFAULT_PROVIDER, by: Sequence[str] = ()) -> DataFrame:
    """Baseline usage.  The maximum is taken over the same rows, so ``created_at <= max`` holds by itself."""
    rows = app_rows(log, app, by).withColumns(
        {
            "request_id": clean_dimension("request_id"),
            "ts": from_epoch_seconds("created_at"),
            "session": clean_dimension("session_id"),
            "model": clean_dimension("model"),
            "cost": F.coalesce(F.col("total_cost_usd").cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)")),
            "calls": F.lit(1).cast("bigint"),
            "observed_cache_creation": F.coalesce(F.col("cache_creation_tokens").cast("bigint"), F.lit(0)),
        }
    )
    rows = rows.withColumn("session", normalize_session_id("session"))
    split = components_from_inclusive(rows, "input_tokens", "cache_read_tokens", "output_tokens")
    return split.drop(
        "session_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "total_cost_usd", "created_at"
    )


def request_checks(log: DataFrame, app: str = fixed.DEFAULT_PROVIDER) -> DataFrame:
    """Every rule of a request row in one pass."""
    integers = ("created_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    rows = app_rows(log, app).withColumn("_id", clean_dimension("request_id"))
    texts = rows.withColumns({c: F.col(c).cast("string") for c in [*integers, "total_cost_usd"]})
    within = F.col("cache_read_tokens").try_cast("bigint") > F.col("input_tokens").try_cast("bigint")
    return row_checks(
        texts,
        F.coalesce("_id", "created_at"),
        [
            *number_rules(integers, ["total_cost_usd"]),
            ("cache-within-input", within, F.col("input_tokens"), F.col("cache_read_tokens")),
            ("request-id", F.col("_id").isNull(), "text", F.col("request_id")),
        ],
    )
