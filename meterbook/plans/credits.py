"""Credits audit of daily usage responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.tokens import ratio_or_zero
from meterbook.operators.keyed import summarise
from meterbook.operators.quality import (
    date_rules,
    detail_rules,
    grouping_rules,
    identity_rules,
    key_text,
    recomputed,
    repeated_dates,
    row_checks,
    stack,
)
from meterbook.session import stage


def rate_card() -> Column:
    """Rates per million tokens with the tokens one credit buys, as an array of rows."""
    rows = []
    for model, fresh, cached, output in fixed.RATE_CARD:
        rows.append(
            F.struct(
                F.lit(model).alias("rate_model"),
                F.lit(fresh).alias("input_rate"),
                F.lit(cached).alias("cached_rate"),
                F.lit(output).alias("output_rate"),
                F.lit(1_000_000.0 / fresh).alias("input_per_credit"),
                F.lit(1_000_000.0 / cached).alias("cached_per_credit"),
                F.lit(1_000_000.0 / output).alias("output_per_credit"),
            )
        )
    return F.array(*rows)


def priced(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reference credits of token totals under every rate.

    The card is a constant of five rows next to each total, so there is nothing to join.
    """
    rows = totals.select("*", F.explode(rate_card()).alias("r")).select(*totals.columns, "r.*")
    reference = (
        F.col("uncached").cast("double") * F.col("input_rate")
        + F.col("cached").cast("double") * F.col("cached_rate")
        + F.col("output").cast("double") * F.col("output_rate")
    ) / F.lit(1_000_000.0)
    return rows.withColumn("reference_credits", reference)


def credit_totals(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    summed = summarise(
        days,
        by,
        days=F.count(F.lit(1)),
        credits=F.coalesce(F.sum("credits"), F.lit(0).cast("decimal(28,9)")),
        **{c: F.coalesce(F.sum(c), F.lit(0)) for c in ("cached", "uncached", "output", "tokens", "threads", "turns")},
        detail_days=F.count_if(F.size("models") > 0),
    )
    name, fresh, cached, output = next(r for r in fixed.RATE_CARD if r[0] == fixed.REFERENCE_MODEL)
    reference = (
        F.col("uncached").cast("double") * fresh
        + F.col("cached").cast("double") * cached
        + F.col("output").cast("double") * output
    ) / F.lit(1_000_000.0)
    return summed.withColumns(
        {
            "cached_share": ratio_or_zero(F.col("cached"), F.col("tokens")),
            "turns_per_thread": ratio_or_zero(F.col("turns"), F.col("threads")),
            "reference_credits": reference,
        }
    ).withColumn(
        "charged_ratio",
        F.when(F.col("reference_credits") > 0, F.col("credits").cast("double") / F.col("reference_credits")),
    )


def credit_days(days: DataFrame) -> DataFrame:
    return days.withColumn("turns_per_thread", ratio_or_zero(F.col("turns"), F.col("threads")))


def credits_by_model(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per model; a day on which a model is listed counts, with or without activity."""
    rows = days.select(*by, "date", F.inline("models"))
    grouped = rows.groupBy(*by, "model").agg(
        F.countDistinct("date").alias("active_dates"),
        F.sum("threads").alias("threads"),
        F.sum("turns").alias("turns"),
        F.sum("credits").alias("credits"),
    )
    return grouped.withColumn("turns_per_thread", ratio_or_zero(F.col("turns"), F.col("threads")))


def quota(totals: DataFrame, remaining: Column | None) -> DataFrame:
    """Quota behind a remaining percentage that was rounded to a whole percent.

    Adds consumed percent, point estimate, the interval the rounding allows, remaining
    credits and a status.
    """
    rest = F.lit(None).cast("double") if remaining is None else remaining.cast("double")
    credits = F.col("credits").cast("double")
    used = F.lit(100.0) - rest
    low = F.greatest(F.lit(0.0), F.lit(100.0) - F.least(F.lit(100.0), rest + 0.5))
    high = F.least(F.lit(100.0), F.lit(100.0) - F.greatest(F.lit(0.0), rest - 0.5))
    point = credits / (used / 100)
    known = rest.isNotNull()
    empty = known & (credits == 0) & (used == 0)
    open_ = known & ~empty & (used > 0)
    return totals.withColumns(
        {
            "consumed_percent": used,
            "point_estimate": F.when(open_, point),
            "interval_low": F.when(open_ & (low > 0), credits / (high / 100)),
            "interval_high": F.when(open_ & (low > 0), credits / (low / 100)),
            "estimated_remaining": F.when(open_, point * (rest / 100)),
            "quota_status": F.when(empty, "insufficient-data")
            .when(known & (used <= 0), "inconsistent")
            .when(known, "approximate"),
        }
    )


def detail_alignment(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether model detail adds up to the totals of its day, for threads and turns."""

    def listed(field: str) -> Column:
        return F.aggregate(F.transform("models", lambda m: m[field]), F.lit(0).cast("bigint"), lambda a, v: a + v)

    skipped = F.size("models") == 0
    return summarise(
        days,
        by,
        threads_match=F.every(skipped | (listed("threads") == F.col("threads"))),
        turns_match=F.every(skipped | (listed("turns") == F.col("turns"))),
    )


def credit_checks(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every rule of a day in one pass, and repeated dates."""
    figures = ("cached", "uncached", "output", "tokens", "threads", "turns")
    rules = [
        *grouping_rules(("day",)),
        *date_rules("date_text", "date"),
        *identity_rules(["cached", "uncached", "output"], "tokens"),
        *[
            (f"{f}-integer", F.col(f).isNull() | ~F.col(f).between(0, fixed.MAX_SAFE_INTEGER), "0 … 2^53-1", F.col(f))
            for f in figures
        ],
        ("credits-amount", F.col("credits").isNull() | (F.col("credits") < 0), ">= 0", F.col("credits")),
        *detail_rules("models", ["threads", "turns"]),
    ]
    return stack(row_checks(days, F.col("date_text"), rules), repeated_dates(days, "date_text", by))


def audit_checks(audit: DataFrame, days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stored audit totals against totals recomputed from the days."""
    from meterbook.operators.keyed import with_totals

    again = credit_totals(days, by)
    renamed = again.select(*by, *[F.col(c).alias(f"again_{c}") for c in again.columns if c not in by])
    joined = with_totals(audit, renamed, by)
    names = ("credits", "cached", "uncached", "output", "tokens", "threads", "turns", "reference_credits")
    pairs = [(f"audit-{n}", F.col(n).cast("double"), F.col(f"again_{n}").cast("double")) for n in names]
    if "point_estimate" in audit.columns:
        estimate = F.when(
            F.col("point_estimate").isNotNull(), F.col("credits").cast("double") / (F.col("consumed_percent") / 100)
        )
        pairs.append(("audit-quota", F.col("point_estimate"), estimate))
    return recomputed(joined, key_text(*by) if by else F.lit("total"), pairs, 1e-8)


def credits_audit(days: DataFrame, remaining: Column | None = None, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All tables of the credits audit, and every violation of the responses and of the figures made from them."""
    days = stage(days)
    totals = stage(quota(credit_totals(days, by), remaining))
    return {
        "summary": totals,
        "days": credit_days(days),
        "models": credits_by_model(days, by),
        "reference": priced(totals.select(*by, "cached", "uncached", "output"), by),
        "alignment": detail_alignment(days, by),
        "violations": stack(credit_checks(days, by), audit_checks(totals, days, by)),
    }
