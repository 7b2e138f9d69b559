"""Row filters: ranges, providers, cutoffs, scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.timeparts import epoch_ms, local_date
from meterbook.operators.keyed import summarise, with_totals


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Inclusive calendar range; an open side is bounded by the data itself."""
    if start is not None and end is not None and start > end:
        raise ValueError(f"range is reversed: {start} > {end}")
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def selected_bounds(df: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """First and last date that are really there; null when nothing was selected."""
    return summarise(df, by, first_date=F.min(date), last_date=F.max(date), rows=F.count(F.lit(1)))


def wanted_provider(provider: str = "provider", wanted: str = fixed.DEFAULT_PROVIDER) -> Column:
    """True for rows of the wanted provider and for rows that name none."""
    column = F.nullif(F.col(provider), F.lit(""))
    return column.isNull() | (F.lower(column) == wanted)


def provider_filter(df: DataFrame, provider: str = "provider", wanted: str = fixed.DEFAULT_PROVIDER) -> DataFrame:
    return df.where(wanted_provider(provider, wanted))


def provider_counts(df: DataFrame, by: Sequence[str] = (), provider: str = "provider") -> DataFrame:
    keep = wanted_provider(provider)
    return summarise(df, by, scanned=F.count(F.lit(1)), kept=F.count_if(keep), skipped=F.count_if(~keep))


def after_cutoff(df: DataFrame, cutoff: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows strictly after the last whole second of the baseline.

    ``cutoff`` holds ``cutoff_seconds`` per key; where it is null or the key has
    no baseline, every row is admitted.
    """
    marked = with_totals(df, cutoff.select(*by, "cutoff_seconds"), by)
    return marked.where(admitted(ts)).drop("cutoff_seconds")


def admitted(ts: str = "ts", cutoff: str = "cutoff_seconds") -> Column:
    return F.col(cutoff).isNull() | (epoch_ms(ts) > F.col(cutoff) * 1000 + 999)


def append_counts(df: DataFrame, cutoff: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    marked = with_totals(df, cutoff.select(*by, "cutoff_seconds"), by)
    return summarise(
        marked,
        by,
        scanned=F.count(F.lit(1)),
        selected=F.count_if(admitted(ts)),
        at_or_before_cutoff=F.count_if(~admitted(ts)),
    )


def account_bounds(account: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    return summarise(account, by, account_start=F.min(date), account_end=F.max(date))


def inside_account_range(
    ledger: DataFrame, account: DataFrame, by: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Local rows between the first and last account date."""
    marked = with_totals(ledger, account_bounds(account, by), by)
    inside = F.col(date).between(F.col("account_start"), F.col("account_end"))
    return marked.where(inside).drop("account_start", "account_end")


def range_split(ledger: DataFrame, account: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Tokens and calls inside the account range, and outside of it as an audit value."""
    marked = with_totals(ledger, account_bounds(account, by), by)
    inside = F.coalesce(F.col(date).between(F.col("account_start"), F.col("account_end")), F.lit(False))
    return summarise(
        marked,
        by,
        inside_calls=F.coalesce(F.sum(F.when(inside, F.col("calls"))), F.lit(0)),
        outside_calls=F.coalesce(F.sum(F.when(~inside, F.col("calls"))), F.lit(0)),
        inside_tokens=F.coalesce(F.sum(F.when(inside, F.col("tokens"))), F.lit(0)),
        outside_tokens=F.coalesce(F.sum(F.when(~inside, F.col("tokens"))), F.lit(0)),
    )


def record_range(records: DataFrame, start: str, end: str, tz: str, ts: str = "ts") -> DataFrame:
    """Exported records whose local date lies in the period; records may be broader than it."""
    return records.where(local_date(ts, tz).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def scoped_source_switch(
    scoped: DataFrame, recomputed: DataFrame, total_calls: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Rows given by the source if their calls add up to the total, otherwise recomputed rows.

    ``total_calls`` has one ``total_calls`` per key; both inputs have ``calls``
    and the same columns.
    """
    given = summarise(scoped, by, given_calls=F.sum("calls"))
    verdict = with_totals(total_calls.select(*by, "total_calls"), given, by)
    in_scope = F.coalesce(F.col("given_calls"), F.lit(0)) == F.col("total_calls")
    verdict = verdict.select(*by, in_scope.alias("_in_scope"))
    columns = scoped.columns
    kept = with_totals(scoped, verdict, by).where("_in_scope").select(*columns)
    rebuilt = with_totals(recomputed, verdict, by).where(~F.col("_in_scope")).select(*columns)
    return kept.unionByName(rebuilt)


def active_days(daily: DataFrame, calls: str = "calls") -> DataFrame:
    return daily.where(F.col(calls) > 0)
