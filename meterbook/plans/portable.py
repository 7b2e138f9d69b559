"""Portable usage files to report tables, with the audit of the input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.timeparts import local_date
from meterbook.operators import rollups
from meterbook.operators.keyed import summarise
from meterbook.operators.quality import require_clean
from meterbook.plans.report import build_report
from meterbook.sources import portable


def portable_audit(usage: DataFrame, tz: str, by: Sequence[str] = ()) -> DataFrame:
    return summarise(
        usage,
        by,
        record_rows=F.count(F.lit(1)),
        calls=F.sum("calls"),
        tokens=F.sum(rollups.tokens()),
        cost=F.sum("cost"),
        range_start=F.min(local_date("ts", tz)),
        range_end=F.max(local_date("ts", tz)),
    )


def portable_report(
    parsed: DataFrame, tz: str, by: Sequence[str] = (), documents: DataFrame | None = None, max_days: int | None = None
) -> dict[str, DataFrame]:
    """Check the documents (where there are any) and the records, then derive the report; raises on the first violations found."""
    if documents is not None:
        require_clean(portable.document_checks(documents))
    require_clean(portable.checks(parsed, by, max_days))
    usage = portable.normalize(parsed, by)
    tables = build_report(usage, tz, by)
    tables["portable_audit"] = portable_audit(usage, tz, by)
    return tables
