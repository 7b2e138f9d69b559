"""Report tables from usage rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.identity import label_sessions, session_key, session_label
from meterbook.functions.labels import activity_label, is_specific, model_label
from meterbook.functions.timeparts import local_date, local_hour, weekday
from meterbook.functions.tokens import COMPONENTS, ratio_or_null, ratio_or_zero, record_weight, round_half_up
from meterbook.operators import rollups, series
from meterbook.operators.filters import account_bounds
from meterbook.operators.keyed import keyed_join, summarise, with_totals
from meterbook.operators.projects import with_project_alias
from meterbook.operators.quality import pseudonym_checks, require_clean
from meterbook.operators.ranking import rank_quantiles, small_quantiles, top_share
from meterbook.operators.series import component_sums
from meterbook.session import stage
from meterbook.sources import exports as exports_source


def prepare(
    usage: DataFrame,
    tz: str,
    by: Sequence[str] = (),
    bases: DataFrame | None = None,
    missing_activity: str = fixed.OTHER_LABEL,
    weigh_calls: bool = True,
) -> DataFrame:
    """Usage rows with local calendar parts, public labels and whole session keys (``label_sessions`` shortens them at the edge).

    All of it is column expressions on one scan.  ``bases`` (known project paths)
    adds the lookup of worktree parents.
    """
    date = local_date("ts", tz)
    rows = usage.withColumns(
        {
            "date": date,
            "hour": local_hour("ts", tz),
            "weekday": weekday(date),
            "raw_session": F.col("session"),
            "session": session_key("session"),
            "model": model_label("model"),
            "activity": activity_label("activity", missing_activity),
            "calls": record_weight("calls") if weigh_calls else F.coalesce(F.col("calls"), F.lit(0)).cast("bigint"),
            "cost": F.coalesce(F.col("cost").cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)")),
            "first_call": F.col("ts"),
            "last_call": F.col("ts"),
            **{c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) for c in COMPONENTS},
        }
    )
    return with_project_alias(rows, bases, by)


def lifecycle_projection(ledger: DataFrame) -> DataFrame:
    """Ledger rows as usage rows, with labels for what the ledger does not know.

    The ledger already carries its local ``date`` and ``hour``; a missing session
    is named after them.
    """
    unknown = F.lit(fixed.UNATTRIBUTED)
    day_hour = F.concat_ws("-", F.lit("historical"), F.date_format("date", "yyyy-MM-dd"), F.col("hour").cast("string"))
    return ledger.withColumns(
        {
            "project": F.coalesce(F.nullif("project", F.lit("")), unknown),
            "session": F.coalesce(F.nullif("session", F.lit("")), day_hour),
            "activity": activity_label("activity", fixed.UNATTRIBUTED),
            "model": F.coalesce(F.nullif("model", F.lit("")), unknown),
            "calls": F.coalesce("calls", F.lit(0).cast("bigint")),
            "cost": F.coalesce(F.col("cost").cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)")),
        }
    )


def reconstruction(
    usage: DataFrame, account: DataFrame, by: Sequence[str] = (), full_ledger_tokens: Column | None = None
) -> DataFrame:
    """Account total against the locally rebuilt total, with attribution coverage.

    ``usage`` may reach beyond the account range; the part outside is kept as an
    audit figure.  One pass over the usage rows.
    """
    official = summarise(account, by, official_tokens=F.coalesce(F.sum("tokens"), F.lit(0)))
    marked = with_totals(usage, account_bounds(account, by), by)
    inside = F.coalesce(F.col("date").between(F.col("account_start"), F.col("account_end")), F.lit(False))
    size = rollups.tokens()

    def summed(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, size)), F.lit(0))

    local = summarise(
        marked,
        by,
        full_ledger_tokens=F.coalesce(F.sum(size), F.lit(0)),
        reconstructed_tokens=summed(inside),
        known_project_tokens=summed(inside & is_specific("project")),
        known_activity_tokens=summed(inside & is_specific("activity")),
    )
    joined = with_totals(official, local, by).fillna(
        0, ["full_ledger_tokens", "reconstructed_tokens", "known_project_tokens", "known_activity_tokens"]
    )
    gap = F.col("official_tokens") - F.col("reconstructed_tokens")
    rebuilt = F.col("reconstructed_tokens")
    return joined.withColumns(
        {
            "net_gap_tokens": gap,
            "absolute_gap_tokens": F.abs(gap),
            "absolute_gap_rate": F.when(
                F.col("official_tokens") != 0, F.abs(gap).cast("double") / F.col("official_tokens").cast("double")
            ).otherwise(F.lit(0.0)),
            "reconstructed_ratio": F.when(
                F.col("official_tokens") != 0, rebuilt.cast("double") / F.col("official_tokens").cast("double")
            ).otherwise(F.lit(0.0)),
            "outside_range_tokens": F.col("full_ledger_tokens") - rebuilt,
            "unattributed_project_tokens": rebuilt - F.col("known_project_tokens"),
            "project_coverage": ratio_or_zero(F.col("known_project_tokens"), rebuilt),
            "unattributed_activity_tokens": rebuilt - F.col("known_activity_tokens"),
            "activity_coverage": ratio_or_zero(F.col("known_activity_tokens"), rebuilt),
        }
    )


def token_cells(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tokens by date and project and by date and model, in one pass: ``dimension name date tokens``."""
    sets = [[*by, "date", d] for d in ("project", "model")]
    cells = facts.groupingSets(sets, *by, "date", "project", "model").agg(F.sum(rollups.tokens()).alias("tokens"), F.grouping("project").alias("_other"))
    by_project = F.col("_other") == 0
    return cells.select(
        *by, F.when(by_project, "project").otherwise("model").alias("dimension"), F.when(by_project, F.col("project")).otherwise(F.col("model")).alias("name"), "date", "tokens"
    )


def concentration(facts: DataFrame, daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Peak day against the median active day, and top shares overall and on the peak day; the facts are read once."""
    peak = series.peak_day(daily, by).select(
        *by, F.col("date").alias("peak_date"), F.col("tokens").alias("peak_tokens"), F.col("calls").alias("peak_calls")
    )
    active = daily.where(F.col("calls") > 0)
    median = small_quantiles(active, "tokens", [0.5], by)
    out = with_totals(peak, median, by)
    ratio = F.col("peak_tokens").cast("double") / F.greatest(F.lit(1.0), F.col("p50"))
    out = out.withColumn("peak_ratio", ratio).drop("p50")
    marked = with_totals(token_cells(facts, by), peak.select(*by, "peak_date"), by)
    sums = marked.groupBy(*by, "dimension", "name").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("date") == F.col("peak_date"), F.col("tokens"))).alias("on_peak")
    )
    largest = {}
    for dimension in ("project", "model"):
        here = F.col("dimension") == dimension
        largest |= {
            f"top_{dimension}": F.min_by("name", F.when(here, F.struct(-F.col("tokens"), F.col("name")))),
            f"top_{dimension}_tokens": F.max(F.when(here, F.col("tokens"))),
            f"_{dimension}_whole": F.sum(F.when(here, F.col("tokens"))),
            f"_{dimension}_peak": F.max(F.when(here, F.col("on_peak"))),
            f"_{dimension}_day": F.sum(F.when(here, F.col("on_peak"))),
        }
    tops = summarise(sums, by, **largest)
    shown = []
    for dimension in ("project", "model"):
        share = ratio_or_zero(F.col(f"top_{dimension}_tokens"), F.col(f"_{dimension}_whole"))
        shown += [F.col(f"top_{dimension}"), F.col(f"top_{dimension}_tokens"), share.alias(f"top_{dimension}_share")]
    shown += [ratio_or_zero(F.col(f"_{d}_peak"), F.col(f"_{d}_day")).alias(f"peak_day_top_{d}_share") for d in ("project", "model")]
    return with_totals(out, tops.select(*by, *shown), by)


class ReportCells:
    """Sums of compact facts by model and date, activity, weekday and hour, and project, from one pass (GROUPING SETS).

    Each slice has the columns of usage rows that its table reads, so the rollups work on it as on the facts.
    """

    SETS = {"models": ["date", "model"], "activities": ["activity"], "hours": ["weekday", "hour"], "projects": ["project"]}

    def __init__(self, facts: DataFrame, by: Sequence[str] = ()):
        keys = ["date", "model", "activity", "weekday", "hour", "project"]
        sets = [[*by, *names] for names in self.SETS.values()]
        summed = facts.groupingSets(sets, *by, *keys).agg(
            F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), *component_sums(), *[F.grouping(k).alias(f"_no_{k}") for k in keys]
        )
        # which set a row belongs to: the keys it is not summed over
        marks = {name: F.lit(True) for name in self.SETS}
        for name, own in self.SETS.items():
            for k in keys:
                marks[name] = marks[name] & (F.col(f"_no_{k}") == (0 if k in own else 1))
        kind = F.coalesce(*[F.when(mark, name) for name, mark in marks.items()])
        self.by, self.cells = list(by), stage(summed.select(*by, kind.alias("kind"), *keys, "cost", "calls", *COMPONENTS))

    def slice(self, name: str) -> DataFrame:
        return self.cells.where(F.col("kind") == name).select(*self.by, *self.SETS[name], "cost", "calls", *COMPONENTS)


def analysis_facts(concentrated: DataFrame, cache_share: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rounded facts with the threshold each is notable from."""
    joined = with_totals(concentrated, cache_share.select(*by, "cache_read_share"), by)

    def fact(code: str, value: Column, digits: int, notable: float | None, name: Column | None = None) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            round_half_up(value, digits).alias("value"),
            (value >= notable if notable is not None else F.lit(None).cast("boolean")).alias("notable"),
            (name if name is not None else F.lit(None)).cast("string").alias("name"),
        )

    peak = F.col("peak_date")
    rows = F.array(
        fact("peak-day-token-ratio", F.col("peak_ratio"), 4, fixed.PEAK_RATIO_NOTABLE, peak),
        fact("top-project-token-share", F.col("top_project_share"), 8, fixed.TOP_SHARE_NOTABLE, F.col("top_project")),
        fact("top-model-token-share", F.col("top_model_share"), 8, fixed.TOP_SHARE_NOTABLE, F.col("top_model")),
        fact("peak-day-top-project-token-share", F.col("peak_day_top_project_share"), 8, None, peak),
        fact("peak-day-top-model-token-share", F.col("peak_day_top_model_share"), 8, None, peak),
        fact("cache-read-token-share", F.col("cache_read_share"), 8, fixed.CACHE_SHARE_NOTABLE),
    )
    return joined.select(*by, F.explode(rows).alias("f")).select(*by, "f.*")


def token_shares(usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    summed = summarise(usage, by, **{c: F.sum(c) for c in COMPONENTS}, tokens=F.sum(rollups.tokens()))
    return summed.select(
        *by,
        ratio_or_null(F.col("cache_read"), F.col("tokens")).alias("cache_read_share"),
        ratio_or_null(F.col("cache_write"), F.col("tokens")).alias("cache_write_share"),
        ratio_or_null(F.col("fresh_input"), F.col("tokens")).alias("input_share"),
        ratio_or_null(F.col("output"), F.col("tokens")).alias("output_share"),
    )


def cost_quantiles(daily: DataFrame, ranked_sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median and P95 of active-day cost and of session cost."""
    days = small_quantiles(series_active(daily), "cost", [0.5, 0.95], by)
    sessions = rank_quantiles(ranked_sessions, "cost", [0.5, 0.95], by)
    renamed = sessions.select(*by, F.col("p50").alias("session_median"), F.col("p95").alias("session_p95"))
    return with_totals(
        days.select(*by, F.col("p50").alias("active_day_median"), F.col("p95").alias("active_day_p95")), renamed, by
    )


def series_active(daily: DataFrame) -> DataFrame:
    return daily.where(F.col("calls") > 0)


def top_shares(daily: DataFrame, projects: DataFrame, sessions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost shares of the top days, projects and sessions."""
    from meterbook.operators.ranking import small_rank

    days = small_rank(series_active(daily), [F.desc("cost"), F.asc("date")], by)
    out = top_share(days, "cost", [10], by).select(*by, F.col("top_10_share").alias("top_ten_days"))
    p = top_share(projects, "cost", [2, 5], by).select(
        *by, F.col("top_2_share").alias("top_two_projects"), F.col("top_5_share").alias("top_five_projects")
    )
    s = top_share(sessions, "cost", [5, 10], by).select(
        *by, F.col("top_5_share").alias("top_five_sessions"), F.col("top_10_share").alias("top_ten_sessions")
    )
    return with_totals(with_totals(out, p, by), s, by)


def export_report(
    usage: DataFrame,
    tz: str,
    exports: DataFrame,
    account: DataFrame | None = None,
    bases: DataFrame | None = None,
    session_digits: int = 12,
) -> dict[str, DataFrame]:
    """Report of a session export: its own period cost, model, activity and session tables lead, the records add detail.

    ``exports`` are parsed export documents, ``usage`` their records.
    """
    period = exports_source.export_summary(exports).agg(F.sum("period_cost").alias("period_cost"))
    tables = build_report(usage, tz, (), account, bases, period, session_digits)
    prepared = prepare(usage, tz, (), bases)
    exact = stage(rollups.compact_facts(prepared))
    given = exports_source.export_models(exports).withColumn("model", model_label("model")).groupBy("model").agg(
        F.sum("cost").alias("cost"), F.sum("calls").alias("calls"), *[F.sum(c).alias(c) for c in COMPONENTS]
    )
    tables["models"] = given.withColumn("tokens", rollups.tokens())
    tables["model_days"] = rollups.scaled_model_days(rollups.model_days(exact), given)
    activities = exports_source.export_activities(exports).withColumn("activity", activity_label("activity"))
    tables["activities"] = keyed_join(
        activities.groupBy("activity").agg(F.sum("cost").alias("cost"), F.sum("turns").alias("turns")),
        rollups.by_activity(exact).select("activity", "calls", "tokens"), ["activity"],
    ).fillna(0, ["calls", "tokens"])
    sessions = exports_source.export_sessions(exports).drop("document").withColumn("session", session_key("session"))
    tables["sessions"] = label_sessions(rollups.session_rows_with_detail(sessions, rollups.by_session(exact)), session_digits)
    return tables


def build_report(
    usage: DataFrame,
    tz: str,
    by: Sequence[str] = (),
    account: DataFrame | None = None,
    bases: DataFrame | None = None,
    period_cost: DataFrame | None = None,
    session_digits: int = 12,
) -> dict[str, DataFrame]:
    """All report tables.

    Everything is grouped by whole session keys; the tables show them with
    ``session_digits`` digits.  Two sessions under one label are refused: ask for
    more digits then.

    The usage rows are read once: every table comes from the compact facts, which
    are staged in the shared folder, so a lost executor costs no second pass.
    """
    prepared = prepare(usage, tz, by, bases)
    if account is not None:
        bounds = account_bounds(account, by)
        full = prepared
        prepared = with_totals(prepared, bounds, by).where(
            F.col("date").between(F.col("account_start"), F.col("account_end"))
        ).drop("account_start", "account_end")
    exact = stage(rollups.compact_facts(prepared, by))
    labels = exact.select(*by, F.col("session").alias("raw_session"), session_label("session", session_digits).alias("session")).distinct()
    require_clean(pseudonym_checks(labels, by=by).where(F.col("check") == "pseudonym-collision"))
    cells = ReportCells(exact, by)
    totals = rollups.totals(cells.slice("activities"), by)
    daily = stage(series.running_cost(series.zero_fill(series.daily_totals(exact, by), by), by))
    sessions = stage(rollups.by_session(exact, by))
    ranked = rollups.ranked_sessions(sessions, by)
    projects = rollups.by_project(exact, by)
    months = series.monthly_totals(daily, by)
    models = rollups.by_model(exact, by)
    week = rollups.weekday_hours(cells.slice("hours"), by)
    cost = period_cost if period_cost is not None else totals.select(*by, F.col("total_cost").alias("period_cost"))
    facts = rollups.scale_costs(exact, cost, by)
    top = rollups.top_projects(cells.slice("projects"), 5, by)
    focus = concentration(exact, daily, by)
    shares = token_shares(cells.slice("activities"), by)
    tables = {
        "summary": rollups.report_summary(exact, by),
        "daily": daily,
        "months": series.rounded_months(months),
        "projects": projects,
        "project_weeks": rollups.project_weeks(sessions, top, by),
        "models": models,
        "model_days": rollups.scaled_model_days(rollups.model_days(cells.slice("models"), by), models, by),
        "activities": rollups.by_activity(cells.slice("activities"), by),
        "sessions": ranked,
        "weekday_hours": week,
        "facts": facts,
        "concentration": focus,
        "analysis_facts": analysis_facts(focus, shares, by),
        "token_shares": shares,
        "cost_quantiles": cost_quantiles(daily, ranked, by),
        "top_shares": top_shares(daily, projects, ranked, by),
        "night_weekend": rollups.night_and_weekend(week, by),
    }
    if not by:
        whole = totals.select("total_cost").scalar()
        tables["dominant_month"] = series.dominant_month(months, whole)
    else:
        costed = keyed_join(months, totals.select(*by, "total_cost"), by)
        tables["dominant_month"] = series.dominant_month(costed, F.col("total_cost"), by)
    if account is not None:
        tables["daily"] = series.running_account(series.with_account(daily, account, by), by)
        tables["account"] = series.account_with_local(account, daily, by)
        tables["account_strip"] = series.account_strip(account, by)
        tables["reconstruction"] = reconstruction(full, account, by)
    return {name: label_sessions(df, session_digits) for name, df in tables.items()}
