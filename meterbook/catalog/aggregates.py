"""Aggregations, windows, sorts: report tables over the given tables."""

from pyspark.sql import functions as F

from meterbook.catalog import tables as t
from meterbook.catalog.registry import query, sql_round, sql_time
from meterbook.functions.identity import label_sessions, session_label
from meterbook.functions.tokens import round_half_up
from meterbook.operators import ranking, rollups, series
from meterbook.operators.attribution import rollout_stats
from meterbook.operators.dedup import duplicate_audit
from meterbook.operators.filters import active_days
from meterbook.plans import activity, credits, merge, portable, report
from meterbook.plans import ledger as ledger_plan
from meterbook.sources.responses import parse_tools, parse_usage
from meterbook.sources.rollout import parse_rollout_meta

SUMS = """CAST(sum(fresh_input) AS BIGINT) AS fresh_input, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output"""


# --- A1, J4, W1, F7, W9: the daily series ------------------------------------


@query(
    "a01_daily",
    f"WITH {t.DAILY} SELECT CAST(date AS VARCHAR) AS date, CAST(cost AS DOUBLE) AS cost, calls, sessions, fresh_input, cache_read, cache_write, output, tokens FROM daily",
)
def a01_daily(spark, folder):
    return series.daily_totals(t.prepared(spark, folder))


@query(
    "a01_daily_large",
    f"""WITH {t.SHIPMENTS}
SELECT CAST(date AS VARCHAR) AS date, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(calls) AS BIGINT) AS calls,
  count(DISTINCT session) AS sessions, {SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens FROM shipments GROUP BY date""",
)
def a01_daily_large(spark, folder):
    return series.daily_totals(t.shipments(spark, folder))


@query(
    "a01_daily_by_supplier",
    f"""WITH {t.SHIPMENTS}
SELECT l_suppkey, CAST(date AS VARCHAR) AS date, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(calls) AS BIGINT) AS calls,
  count(DISTINCT session) AS sessions, {SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens FROM shipments GROUP BY l_suppkey, date""",
)
def a01_daily_by_supplier(spark, folder):
    """The same operator for many accounts at once: suppliers stand for tenants."""
    return series.daily_totals(t.shipments(spark, folder), ["l_suppkey"])


FILLED_COLUMNS = "CAST(date AS VARCHAR) AS date, CAST(cost AS DOUBLE) AS cost, calls, sessions, fresh_input, cache_read, cache_write, output, tokens"


@query("j04_zero_filled_days", f"WITH {t.SPARSE} SELECT {FILLED_COLUMNS} FROM filled")
def j04_zero_filled_days(spark, folder):
    return series.zero_fill(t.sparse_daily(spark, folder))


@query(
    "w01_running_cost",
    f"""WITH {t.SPARSE} SELECT {FILLED_COLUMNS},
  {sql_round("sum(cost) OVER (ORDER BY date)", 2)} AS cumulative_cost FROM filled""",
)
def w01_running_cost(spark, folder):
    return series.running_cost(series.zero_fill(t.sparse_daily(spark, folder)))


@query("f07_active_days", f"WITH {t.SPARSE} SELECT {FILLED_COLUMNS} FROM filled WHERE calls > 0")
def f07_active_days(spark, folder):
    return active_days(series.zero_fill(t.sparse_daily(spark, folder)))


@query(
    "w09_gaps",
    f"""WITH {t.SPARSE}, steps AS (SELECT date, lag(date) OVER (ORDER BY date) AS previous_date FROM daily)
SELECT CAST(date AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date, date_diff('day', previous_date, date) AS days
FROM steps WHERE previous_date IS NOT NULL AND date_diff('day', previous_date, date) <> 1""",
)
def w09_gaps(spark, folder):
    return series.gaps(t.sparse_daily(spark, folder))


# --- A2–A5: models, activities, projects, sessions ---------------------------


def _ranked_sql(source: str, dim: str, extra: str = "") -> str:
    return f"""SELECT {dim}, CAST(cost AS DOUBLE) AS cost, calls, {extra} CAST(cost AS DOUBLE) / CAST(sum(cost) OVER () AS DOUBLE) AS share,
  row_number() OVER (ORDER BY cost DESC, {dim}) AS rank FROM {source}"""


@query(
    "a02_models",
    f"""WITH {t.PREPARED}, g AS (SELECT model, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session) AS sessions, {SUMS},
  CAST(sum(tokens) AS BIGINT) AS tokens, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM prepared GROUP BY model)
{_ranked_sql("g", "model", "sessions, fresh_input, cache_read, cache_write, output, tokens, first_date, last_date,")}""",
)
def a02_models(spark, folder):
    return rollups.by_model(t.prepared(spark, folder))


@query(
    "a03_activities",
    f"""WITH {t.PREPARED}, g AS (SELECT activity, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(calls) AS BIGINT) AS turns,
  CAST(sum(tokens) AS BIGINT) AS tokens FROM prepared GROUP BY activity) {_ranked_sql("g", "activity", "turns, tokens,")}""",
)
def a03_activities(spark, folder):
    return rollups.by_activity(t.prepared(spark, folder))


PROJECT_SQL = """p AS (SELECT project, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session) AS sessions,
  CAST(sum(tokens) AS BIGINT) AS tokens FROM {source} GROUP BY project),
ranked AS (SELECT *, row_number() OVER (ORDER BY cost DESC, project) AS rank,
  sum(cost) OVER (ORDER BY cost DESC, project ROWS UNBOUNDED PRECEDING) AS run, sum(cost) OVER () AS whole FROM p)"""


@query(
    "a04_projects",
    f"WITH {t.PREPARED}, {PROJECT_SQL.format(source='prepared')} SELECT project, CAST(cost AS DOUBLE) AS cost, calls, sessions, tokens FROM p",
)
def a04_projects(spark, folder):
    return rollups.project_sums(t.prepared(spark, folder))


RANKED_PROJECTS = """SELECT project, CAST(cost AS DOUBLE) AS cost, calls, sessions, tokens, rank,
  CAST(cost AS DOUBLE) / CAST(whole AS DOUBLE) AS share, CAST(run AS DOUBLE) / CAST(whole AS DOUBLE) AS cumulative_share FROM ranked"""


@query("w03_ranked_projects", f"WITH {t.PREPARED}, {PROJECT_SQL.format(source='prepared')} {RANKED_PROJECTS}")
def w03_ranked_projects(spark, folder):
    """Rank, share and cumulative share (W4) of projects."""
    return rollups.by_project(t.prepared(spark, folder))


@query("w04_cumulative_share", f"WITH {t.SHIPMENTS}, {PROJECT_SQL.format(source='shipments')} {RANKED_PROJECTS}")
def w04_cumulative_share(spark, folder):
    return rollups.by_project(t.shipments(spark, folder))


SESSION_SQL = """s AS (SELECT session, arg_min(project, (first_call, project)) AS project, min(first_call) AS started_at, max(last_call) AS last_call,
  min(date) AS date, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(fresh_input) AS BIGINT) AS fresh_input,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(tokens) AS BIGINT) AS tokens, array_to_string(list_sort(list_distinct(list(model))), ',') AS models
  FROM {source} GROUP BY session)"""
SESSION_COLUMNS = f"""session, project, {sql_time('started_at')} AS started_at, {sql_time('last_call')} AS last_call, CAST(date AS VARCHAR) AS date,
  calls, fresh_input, cache_read, cache_write, output, tokens, models,
  CASE WHEN tokens > 0 THEN CAST(cache_read AS DOUBLE) / tokens ELSE 0 END AS cache_share"""


@query(
    "a05_sessions",
    f"WITH {t.FACTS}, {SESSION_SQL.format(source='facts')} SELECT {SESSION_COLUMNS}, CAST(cost AS DOUBLE) AS cost FROM s",
)
def a05_sessions(spark, folder):
    return label_sessions(rollups.by_session(t.prepared(spark, folder)))


@query(
    "w03_ranked_sessions",
    f"""WITH {t.SHIPMENTS}, f AS (SELECT *, ts AS first_call, ts AS last_call FROM shipments), {SESSION_SQL.format(source='f')},
c AS (SELECT *, {sql_round("cost", 2)} AS shown FROM s)
SELECT {SESSION_COLUMNS}, shown AS cost, row_number() OVER (ORDER BY shown DESC, session) AS rank FROM c""",
)
def w03_ranked_sessions(spark, folder):
    """All sessions of the large ledger ranked by cost, without a one-task window."""
    return rollups.ranked_sessions(rollups.by_session(t.shipments(spark, folder)))


@query(
    "j08_sessions_with_detail",
    f"""WITH {t.FACTS}, {SESSION_SQL.format(source='facts')}, given AS (SELECT 'session-' || substr(sha256(session), 1, 12) AS session, count(*) AS turns FROM usage
  WHERE user_id % 4 <> 0 GROUP BY 1 UNION ALL SELECT DISTINCT 'extra-' || session, 1 FROM usage WHERE user_id % 9 = 0)
SELECT given.session, turns, coalesce(tokens, 0) AS tokens,
  coalesce(CASE WHEN tokens > 0 THEN CAST(cache_read AS DOUBLE) / tokens ELSE 0 END, 0) AS cache_share, coalesce(models, '') AS models
FROM given LEFT JOIN s ON s.session = given.session""",
)
def j08_sessions_with_detail(spark, folder):
    """Session rows given by a source, some without records, with detail from the records."""
    rows = t.prepared(spark, folder)
    known = rows.where(F.col("user_id") % 4 != 0).groupBy("session").agg(F.count(F.lit(1)).alias("turns"))
    extra = rows.where(F.col("user_id") % 9 == 0).select(F.concat(F.lit("extra-"), "raw_session").alias("session"), F.lit(1).cast("bigint").alias("turns")).distinct()
    given = rollups.session_rows_with_detail(known.unionByName(extra), rollups.by_session(rows))
    return given.withColumn("session", F.when(F.startswith("session", F.lit("session-")), session_label("session")).otherwise(F.col("session")))


@query(
    "j07_activity_calls",
    f"""WITH {t.PREPARED}, listed AS (SELECT DISTINCT activity FROM prepared UNION ALL SELECT DISTINCT 'Unused ' || model FROM prepared),
n AS (SELECT activity, CAST(sum(calls) AS BIGINT) AS calls FROM prepared GROUP BY activity)
SELECT listed.activity, coalesce(n.calls, 0) AS calls FROM listed LEFT JOIN n USING (activity)""",
)
def j07_activity_calls(spark, folder):
    rows = t.prepared(spark, folder)
    listed = rows.select("activity").distinct().unionByName(
        rows.select(F.concat(F.lit("Unused "), "model").alias("activity")).distinct()
    )
    return rollups.activity_with_calls(listed, rows)


# --- A6, W8, A30: months ------------------------------------------------------

MONTHS = """months AS (
  SELECT strftime(date, '%Y-%m') AS month, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(sessions) AS BIGINT) AS sessions,
    CAST(count(*) FILTER (calls > 0) AS BIGINT) AS active_days, count(*) AS calendar_days, CAST(sum(fresh_input) AS BIGINT) AS fresh_input,
    CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output,
    CAST(sum(tokens) AS BIGINT) AS tokens, CAST(day(last_day(max(date))) AS BIGINT) AS days_in_month
  FROM filled GROUP BY 1)"""

SHIPMENT_DAYS = (
    t.SHIPMENTS
    + f""",
daily AS (SELECT date, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session) AS sessions, {SUMS},
  CAST(sum(tokens) AS BIGINT) AS tokens FROM shipments GROUP BY date),
axis AS (SELECT unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily), INTERVAL 1 DAY))::DATE AS date),
filled AS (SELECT axis.date, coalesce(cost, 0) AS cost, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions,
  coalesce(fresh_input, 0) AS fresh_input, coalesce(cache_read, 0) AS cache_read, coalesce(cache_write, 0) AS cache_write,
  coalesce(output, 0) AS output, coalesce(tokens, 0) AS tokens FROM axis LEFT JOIN daily USING (date))"""
)


def _shipment_days(spark, folder):
    return series.zero_fill(series.daily_totals(t.shipments(spark, folder)))


@query(
    "a06_months",
    f"""WITH {SHIPMENT_DAYS}, {MONTHS}
SELECT month, {sql_round("cost", 2)} AS cost, calls, sessions, active_days, calendar_days, fresh_input, cache_read, cache_write, output,
  tokens, days_in_month, calendar_days < days_in_month AS is_partial FROM months""",
)
def a06_months(spark, folder):
    return series.rounded_months(series.monthly_totals(_shipment_days(spark, folder)))


@query(
    "w08_previous_month",
    f"""WITH {SHIPMENT_DAYS}, {MONTHS}, m AS (SELECT month, {sql_round("cost", 2)} AS cost, calendar_days < days_in_month AS is_partial FROM months),
o AS (SELECT *, lag(month) OVER w AS pm, lag(cost) OVER w AS pc, coalesce(sum(cost) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM m WINDOW w AS (ORDER BY month)),
whole AS (SELECT CAST(sum(cost) AS DOUBLE) AS total FROM shipments)
SELECT month, cost, cost / total AS share, is_partial, pm AS previous_month, CASE WHEN pc > 0 THEN cost / pc END AS versus_previous,
  round(before, 4) AS cost_before FROM o, whole ORDER BY cost DESC, month LIMIT 1""",
)
def w08_previous_month(spark, folder):
    """Dominant month (A30) against the month before it."""
    days = _shipment_days(spark, folder)
    whole = t.shipments(spark, folder).agg(F.sum("cost")).scalar()
    out = series.dominant_month(series.monthly_totals(days), whole)
    return out.withColumn("cost_before", F.round("cost_before", 4))


@query(
    "a30_dominant_month_by_supplier",
    f"""WITH {t.SHIPMENTS}, months AS (SELECT l_suppkey, strftime(date, '%Y-%m') AS month, {sql_round("sum(cost)", 2)} AS cost FROM shipments GROUP BY ALL)
SELECT l_suppkey, month, cost FROM months QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY cost DESC, month) = 1""",
)
def a30_dominant_month_by_supplier(spark, folder):
    """Dominant month of every supplier: one row per key."""
    daily = series.daily_totals(t.shipments(spark, folder), ["l_suppkey"])
    months = series.monthly_totals(series.zero_fill(daily, ["l_suppkey"]), ["l_suppkey"])
    return series.dominant_month(months, F.lit(1.0), ["l_suppkey"]).select("l_suppkey", "month", "cost")


# --- A7–A11 -------------------------------------------------------------------


@query(
    "a07_project_weeks",
    f"""WITH {t.FACTS}, {SESSION_SQL.format(source='facts')}, {PROJECT_SQL.format(source='prepared')}
SELECT CASE WHEN rank <= 5 THEN s.project ELSE 'Other' END AS project, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week,
  CAST(sum(s.cost) AS DOUBLE) AS cost, count(*) AS sessions, CAST(sum(s.calls) AS BIGINT) AS calls
FROM s JOIN ranked ON ranked.project = s.project GROUP BY 1, 2""",
)
def a07_project_weeks(spark, folder):
    rows = t.prepared(spark, folder)
    return rollups.project_weeks(rollups.by_session(rows), rollups.top_projects(rows))


@query(
    "t02_top_projects_and_other",
    f"""WITH {t.SHIPMENTS}, {PROJECT_SQL.format(source='shipments')}
SELECT CASE WHEN rank <= 5 THEN s.project ELSE 'Other' END AS project, CAST(sum(s.cost) AS DOUBLE) AS cost, count(*) AS calls
FROM shipments s JOIN ranked USING (project) GROUP BY 1""",
)
def t02_top_projects_and_other(spark, folder):
    rows = t.shipments(spark, folder)
    folded = rollups.fold_projects(rows, rollups.top_projects(rows))
    return folded.groupBy("project").agg(F.sum("cost").alias("cost"), F.sum("calls").alias("calls"))


@query(
    "a08_model_days",
    f"""WITH {t.PREPARED} SELECT model, CAST(date AS VARCHAR) AS date, CAST(sum(cost) AS DOUBLE) AS record_cost, CAST(sum(calls) AS BIGINT) AS calls,
  CAST(sum(tokens) AS BIGINT) AS tokens FROM prepared GROUP BY model, date""",
)
def a08_model_days(spark, folder):
    return rollups.model_days(t.prepared(spark, folder))


@query(
    "j06_scaled_model_days",
    f"""WITH {t.PREPARED}, d AS (SELECT model, date, sum(cost) AS c, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM prepared GROUP BY model, date),
m AS (SELECT model, CAST(sum(c) AS DOUBLE) AS total FROM d GROUP BY model),
exact AS (SELECT model, CAST(CAST(sum(cost) * 2 AS DECIMAL(38,2)) AS DOUBLE) AS cost FROM prepared WHERE model <> 'view' GROUP BY model)
SELECT d.model, CAST(date AS VARCHAR) AS date, {sql_round("CASE WHEN total > 0 THEN CAST(c AS DOUBLE) * coalesce(exact.cost, 0) / total ELSE 0 END", 4)} AS cost,
  calls, tokens FROM d JOIN m USING (model) LEFT JOIN exact ON exact.model = d.model""",
)
def j06_scaled_model_days(spark, folder):
    """Model days scaled to totals that are twice the recorded ones; one model has no total."""
    rows = t.prepared(spark, folder)
    exact = rows.where(F.col("model") != "view").groupBy("model").agg((F.sum("cost") * 2).alias("cost"))
    return rollups.scaled_model_days(rollups.model_days(rows), exact)


@query(
    "a09_weekday_hours",
    f"""WITH {t.PREPARED}, grid AS (SELECT w.w AS weekday, CAST(w.i AS BIGINT) AS weekday_index, CAST(h.h AS BIGINT) AS hour FROM
  (VALUES ('Mon', 0), ('Tue', 1), ('Wed', 2), ('Thu', 3), ('Fri', 4), ('Sat', 5), ('Sun', 6)) w(w, i), (SELECT unnest(range(24)) AS h) h),
c AS (SELECT weekday, hour, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM prepared
  GROUP BY ALL)
SELECT weekday, weekday_index, hour, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, CAST(coalesce(cost, 0) AS DOUBLE) AS cost,
  CAST(coalesce(tokens, 0) AS DOUBLE) / CAST(sum(tokens) OVER () AS DOUBLE) AS token_share FROM grid LEFT JOIN c USING (weekday, hour)""",
)
def a09_weekday_hours(spark, folder):
    """Dense week of usage."""
    return rollups.weekday_hours(t.prepared(spark, folder))


FACT_COLUMNS = f"""CAST(date AS VARCHAR) AS date, hour, weekday, project, session, model, activity, calls, fresh_input, cache_read, cache_write, output,
  {sql_time('first_call')} AS first_call, {sql_time('last_call')} AS last_call"""


@query("a10_compact_facts", f"WITH {t.FACTS} SELECT {FACT_COLUMNS}, CAST(cost AS DOUBLE) AS cost FROM facts")
def a10_compact_facts(spark, folder):
    return label_sessions(rollups.compact_facts(t.prepared(spark, folder)))


@query(
    "a10_compact_facts_large",
    f"""WITH {t.SHIPMENTS}
SELECT CAST(date AS VARCHAR) AS date, hour, weekday, project, session, model, activity, CAST(sum(calls) AS BIGINT) AS calls, {SUMS},
  {sql_time('min(ts)')} AS first_call, {sql_time('max(ts)')} AS last_call, CAST(sum(cost) AS DOUBLE) AS cost FROM shipments GROUP BY ALL""",
)
def a10_compact_facts_large(spark, folder):
    return rollups.compact_facts(t.shipments(spark, folder))


@query(
    "p21_scaled_cost",
    f"""WITH {t.FACTS}, k AS (SELECT CAST(sum(cost) * 3 AS DOUBLE) / CAST(sum(cost) AS DOUBLE) AS s FROM facts)
SELECT {FACT_COLUMNS}, s AS cost_scale, {sql_round("CAST(cost AS DOUBLE) * s", 6)} AS cost FROM facts, k""",
)
def p21_scaled_cost(spark, folder):
    """Facts scaled to a period total that is three times the recorded cost."""
    facts = rollups.compact_facts(t.prepared(spark, folder))
    period = t.prepared(spark, folder).agg((F.sum("cost") * 3).alias("period_cost"))
    return label_sessions(rollups.scale_costs(facts, period))


@query(
    "a11_compact_records",
    f"""WITH {t.TWO_SOURCES}
SELECT CAST(date AS VARCHAR) AS date, hour, coalesce(project, '历史未归属') AS project, session, model, coalesce(activity, '历史未归属') AS activity, source,
  {sql_time('min(ts)')} AS ts, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(calls) AS BIGINT) AS calls, {SUMS} FROM local_ledger GROUP BY date, hour, 3, session, model, 6, source""",
)
def a11_compact_records(spark, folder):
    return rollups.compact_records(ledger_plan.attributed_labels(t.ledger(spark, folder)))


# --- A12–A16: ledger and report summaries -------------------------------------

ROLLUP = f"""CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cost) AS DOUBLE) AS cost, {SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens,
  {sql_time('min(ts)')} AS first_at, {sql_time('max(ts)')} AS last_at,
  CAST(coalesce(sum(calls) FILTER (source = 'ccSwitch'), 0) AS BIGINT) AS "ccSwitch_calls", CAST(coalesce(sum(tokens) FILTER (source = 'ccSwitch'), 0) AS BIGINT) AS "ccSwitch_tokens",
  CAST(coalesce(sum(calls) FILTER (source = 'codeburnIncrement'), 0) AS BIGINT) AS "codeburnIncrement_calls",
  CAST(coalesce(sum(tokens) FILTER (source = 'codeburnIncrement'), 0) AS BIGINT) AS "codeburnIncrement_tokens\""""


@query("a12_source_sums", f"WITH {t.TWO_SOURCES} SELECT CAST(date AS VARCHAR) AS date, {ROLLUP} FROM local_ledger GROUP BY date")
def a12_source_sums(spark, folder):
    """Ledger days with calls and tokens per source; the data has no gap."""
    return ledger_plan.ledger_daily(t.ledger(spark, folder))


@query("a12_ledger_models", f"WITH {t.TWO_SOURCES} SELECT model, {ROLLUP}, count(DISTINCT session) AS sessions, model IS NOT NULL AS attributed FROM local_ledger GROUP BY model")
def a12_ledger_models(spark, folder):
    return ledger_plan.ledger_models(t.ledger(spark, folder))


@query(
    "a12_ledger_sessions",
    f"WITH {t.TWO_SOURCES} SELECT session, {ROLLUP}, array_to_string(list_sort(list_distinct(list(model))), ',') AS models, session IS NOT NULL AS attributed FROM local_ledger GROUP BY session",
)
def a12_ledger_sessions(spark, folder):
    return ledger_plan.ledger_sessions(t.ledger(spark, folder))


def _coverage_sql(source: str, known: dict[str, str]) -> str:
    parts = [
        f"""SELECT '{d}' AS dimension, CAST(coalesce(sum(calls) FILTER ({c}), 0) AS BIGINT) AS attributed_calls,
  CAST(coalesce(sum(tokens) FILTER ({c}), 0) AS BIGINT) AS attributed_tokens, CAST(sum(calls) AS BIGINT) AS total_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM {source}"""
        for d, c in known.items()
    ]
    return f"""cov AS ({' UNION ALL '.join(parts)})
SELECT *, total_calls - attributed_calls AS unattributed_calls, total_tokens - attributed_tokens AS unattributed_tokens,
  CAST(attributed_calls AS DOUBLE) / nullif(total_calls, 0) AS call_coverage, CAST(attributed_tokens AS DOUBLE) / nullif(total_tokens, 0) AS token_coverage FROM cov"""


@query(
    "a13_attribution_coverage",
    f"WITH {t.TWO_SOURCES}, " + _coverage_sql("ledger", {d: f"{d} IS NOT NULL" for d in ("model", "session", "project", "activity")}),
)
def a13_attribution_coverage(spark, folder):
    return ledger_plan.coverage(t.ledger(spark, folder))


@query(
    "a14_ledger_summary",
    f"""WITH {t.TWO_SOURCES} SELECT {ROLLUP}, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
  date_diff('day', min(date), max(date)) + 1 AS calendar_days, count(DISTINCT date) FILTER (calls > 0) AS active_days FROM local_ledger""",
)
def a14_ledger_summary(spark, folder):
    return rollups.ledger_summary(t.ledger(spark, folder))


@query(
    "a15_report_summary",
    f"""WITH {t.PREPARED}, s AS (SELECT sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session) AS sessions, count(DISTINCT project) AS projects,
  count(DISTINCT date) FILTER (calls > 0) AS call_days, count(DISTINCT date) AS listed_days, date_diff('day', min(date), max(date)) + 1 AS calendar_days, {SUMS} FROM prepared)
SELECT CAST(cost AS DOUBLE) AS cost, calls, sessions, projects, call_days, listed_days, calendar_days, fresh_input, cache_read, cache_write, output,
  fresh_input + cache_read + cache_write + output AS tokens, CAST(cache_read AS DOUBLE) / (fresh_input + cache_read) AS cache_hit_rate FROM s""",
)
def a15_report_summary(spark, folder):
    return rollups.report_summary(t.prepared(spark, folder))


RECONSTRUCTION = """sums AS (
  SELECT (SELECT CAST(sum(tokens) AS BIGINT) FROM account) AS official_tokens, CAST(sum(tokens) AS BIGINT) AS full_ledger_tokens,
    CAST(coalesce(sum(tokens) FILTER (inside), 0) AS BIGINT) AS reconstructed_tokens,
    CAST(coalesce(sum(tokens) FILTER (inside AND project <> '历史未归属'), 0) AS BIGINT) AS known_project_tokens,
    CAST(coalesce(sum(tokens) FILTER (inside AND activity <> '历史未归属'), 0) AS BIGINT) AS known_activity_tokens
  FROM (SELECT *, date BETWEEN (SELECT min(date) FROM account) AND (SELECT max(date) FROM account) AS inside FROM shipments)),
rec AS (SELECT *, official_tokens - reconstructed_tokens AS net_gap_tokens, abs(official_tokens - reconstructed_tokens) AS absolute_gap_tokens,
  CAST(abs(official_tokens - reconstructed_tokens) AS DOUBLE) / CAST(official_tokens AS DOUBLE) AS absolute_gap_rate,
  CAST(reconstructed_tokens AS DOUBLE) / CAST(official_tokens AS DOUBLE) AS reconstructed_ratio,
  full_ledger_tokens - reconstructed_tokens AS outside_range_tokens, reconstructed_tokens - known_project_tokens AS unattributed_project_tokens,
  CAST(known_project_tokens AS DOUBLE) / CAST(reconstructed_tokens AS DOUBLE) AS project_coverage,
  reconstructed_tokens - known_activity_tokens AS unattributed_activity_tokens,
  CAST(known_activity_tokens AS DOUBLE) / CAST(reconstructed_tokens AS DOUBLE) AS activity_coverage FROM sums)"""


@query("a16_reconstruction", f"WITH {t.SHIPMENTS}, {t.ACCOUNT}, {RECONSTRUCTION} SELECT * FROM rec")
def a16_reconstruction(spark, folder):
    return report.reconstruction(t.shipments(spark, folder), t.account(spark, folder))


# --- A17–A20: duplicates, audits, devices --------------------------------------


@query(
    "a17_duplicate_audit",
    f"""WITH {t.DEVICES}, c AS (SELECT event_id, count(*) AS n FROM device_events GROUP BY event_id)
SELECT count(*) AS distinct_ids, count(*) FILTER (n > 1) AS duplicate_ids, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS conflicting_ids FROM c""",
)
def a17_duplicate_audit(spark, folder):
    return duplicate_audit(t.device_events(spark, folder))


MERGE_SUMS = """count(*) AS calls, CAST(sum(fresh_input) AS BIGINT) AS fresh_input, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output, CAST(sum(tokens) AS BIGINT) AS tokens"""


@query(
    "a18_token_audit",
    f"""WITH {t.NEAR}, a AS (SELECT {MERGE_SUMS} FROM near), p AS (SELECT {MERGE_SUMS} FROM near WHERE event_id IN (SELECT i FROM pairs))
SELECT 'input' AS stage, * FROM a UNION ALL SELECT 'exact removed', 0, 0, 0, 0, 0, 0
UNION ALL SELECT 'cross-source removed', * FROM p
UNION ALL SELECT 'output', a.calls - p.calls, a.fresh_input - p.fresh_input, a.cache_read - p.cache_read, a.cache_write - p.cache_write, a.output - p.output, a.tokens - p.tokens FROM a, p""",
)
def a18_token_audit(spark, folder):
    """Tokens in, removed by each step, and out, over two sources with near-time copies."""
    return merge.token_audit(merge.merge_events(t.near_events(spark, folder)))


@query(
    "a19_device_summary",
    f"""WITH {t.DEVICES}, kept AS (SELECT d AS device, count(*) AS n FROM (SELECT unnest(string_split(devices, ',')) AS d FROM merged) GROUP BY d)
SELECT device, count(*) AS input_events, CAST(sum(calls) AS BIGINT) AS input_calls, CAST(sum(fresh_input) AS BIGINT) AS input_fresh_input,
  CAST(sum(cache_read) AS BIGINT) AS input_cache_read, CAST(sum(cache_write) AS BIGINT) AS input_cache_write, CAST(sum(output) AS BIGINT) AS input_output,
  min(n) AS retained_events FROM device_events JOIN kept USING (device) GROUP BY device""",
)
def a19_device_summary(spark, folder):
    """Devices whose events come from one source each side: only exact copies are merged."""
    from meterbook.operators.dedup import exact_dedup
    from meterbook.operators.projects import resolve_projects

    resolved = resolve_projects(merge.with_provenance(t.device_events(spark, folder)), t.alias_map(spark, folder))
    distinct = exact_dedup(resolved)
    return merge.device_summary(merge.MergedEvents(resolved, distinct, distinct, distinct))


@query(
    "a20_merged_cutoffs",
    f"""WITH {t.USAGE}, heads AS (SELECT user_id % 5 AS device, CAST(floor(epoch_ms(max(ts)) / 1000) AS BIGINT) AS c, min(ts) AS f, max(ts) AS l FROM usage GROUP BY 1)
SELECT max(CASE WHEN device <> 4 THEN c END) AS cutoff_seconds, max(CASE WHEN device <> 4 THEN c * 1000 + 999 END) AS append_after_ms,
  {sql_time('min(f)')} AS first_at, {sql_time('max(l)')} AS last_at FROM heads""",
)
def a20_merged_cutoffs(spark, folder):
    """Five devices, one of them without a baseline."""
    from meterbook.functions.timeparts import epoch_ms

    heads = t.usage(spark, folder).groupBy((F.col("user_id") % 5).alias("device")).agg(
        F.floor(epoch_ms(F.max("ts")) / 1000).alias("_c"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )
    has = F.col("device") != 4
    heads = heads.withColumns(
        {"cutoff_seconds": F.when(has, F.col("_c")), "append_after_ms": F.when(has, F.col("_c") * 1000 + 999)}
    )
    return merge.merged_cutoffs(heads)


# --- A21–A26: credits and activity ----------------------------------------------

CREDIT = """t AS (SELECT count(*) AS days, CAST(sum(credits) AS DOUBLE) AS credits, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(uncached) AS BIGINT) AS uncached,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns,
  CAST(count(*) FILTER (has_detail) AS BIGINT) AS detail_days FROM days),
totals AS (SELECT *, CAST(cached AS DOUBLE) / tokens AS cached_share, CAST(turns AS DOUBLE) / threads AS turns_per_thread,
  (uncached * 125e0 + cached * 12.5e0 + output * 750e0) / 1e6 AS reference_credits FROM t)"""


@query("a21_credit_totals", f"WITH {t.RESPONSES}, {CREDIT} SELECT *, credits / reference_credits AS charged_ratio FROM totals")
def a21_credit_totals(spark, folder):
    return credits.credit_totals(parse_usage(t.response_days(spark, folder)))


@query(
    "a21_credit_days",
    f"""WITH {t.RESPONSES} SELECT CAST(date AS VARCHAR) AS date, CAST(credits AS DOUBLE) AS credits, cached, uncached, output, tokens, threads, turns,
  CASE WHEN threads > 0 THEN CAST(turns AS DOUBLE) / threads ELSE 0 END AS turns_per_thread FROM days""",
)
def a21_credit_days(spark, folder):
    days = credits.credit_days(parse_usage(t.response_days(spark, folder)))
    return days.select("date", "credits", "cached", "uncached", "output", "tokens", "threads", "turns", "turns_per_thread")


@query(
    "a22_credits_by_model",
    f"""WITH {t.RESPONSES} SELECT model, count(DISTINCT date) AS active_dates, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns,
  CAST(0 AS DOUBLE) AS credits, CAST(sum(turns) AS DOUBLE) / CAST(sum(threads) AS DOUBLE) AS turns_per_thread FROM detail GROUP BY model""",
)
def a22_credits_by_model(spark, folder):
    """The detail carries no credits of its own, so they stay 0."""
    return credits.credits_by_model(parse_usage(t.response_days(spark, folder)))


@query(
    "a23_priced_reference",
    f"""WITH {t.RESPONSES}, {CREDIT}, r(m, i, c, o) AS (VALUES ('GPT-5.6 Sol', 125e0, 12.5e0, 750e0), ('GPT-5.6 Terra', 50e0, 5e0, 300e0), ('GPT-5.6 Luna', 5e0, 0.5e0, 30e0),
  ('GPT-5.5', 125e0, 12.5e0, 750e0), ('GPT-5.4', 62.5e0, 6.25e0, 375e0))
SELECT m AS rate_model, (uncached * i + cached * c + output * o) / 1e6 AS reference_credits, credits / ((uncached * i + cached * c + output * o) / 1e6) AS charged_ratio FROM totals, r""",
)
def a23_priced_reference(spark, folder):
    totals = credits.credit_totals(parse_usage(t.response_days(spark, folder)))
    rows = credits.priced(totals.select("credits", "cached", "uncached", "output"))
    ratio = F.when(F.col("reference_credits") > 0, F.col("credits").cast("double") / F.col("reference_credits"))
    return rows.select("rate_model", "reference_credits", ratio.alias("charged_ratio"))


@query(
    "j17_rate_card",
    f"""WITH {t.RESPONSES}, r(m, i, c, o) AS (VALUES ('GPT-5.6 Sol', 125e0, 12.5e0, 750e0), ('GPT-5.6 Terra', 50e0, 5e0, 300e0), ('GPT-5.6 Luna', 5e0, 0.5e0, 30e0),
  ('GPT-5.5', 125e0, 12.5e0, 750e0), ('GPT-5.4', 62.5e0, 6.25e0, 375e0))
SELECT CAST(date AS VARCHAR) AS date, m AS rate_model, 1e6 / i AS input_per_credit, 1e6 / c AS cached_per_credit, 1e6 / o AS output_per_credit,
  (uncached * i + cached * c + output * o) / 1e6 AS reference_credits FROM days, r""",
)
def j17_rate_card(spark, folder):
    """Every day priced under every rate of the card."""
    days = parse_usage(t.response_days(spark, folder)).select("date", "uncached", "cached", "output")
    return credits.priced(days).select(
        "date", "rate_model", "input_per_credit", "cached_per_credit", "output_per_credit", "reference_credits"
    )


@query(
    "a24_quota",
    f"""WITH {t.PREPARED}, u AS (SELECT project, CAST(sum(cost) AS DOUBLE) AS credits, CAST(count(*) % 101 AS DOUBLE) AS rest FROM prepared GROUP BY project
  UNION ALL SELECT DISTINCT 'idle ' || model, 0e0, 100e0 FROM prepared UNION ALL SELECT DISTINCT 'full ' || model, 5e0, 100e0 FROM prepared
  UNION ALL SELECT DISTINCT 'edge ' || model, 5e0, 99.7e0 FROM prepared),
q AS (SELECT *, 100e0 - rest AS used, greatest(0e0, 100e0 - least(100e0, rest + 0.5e0)) AS lo, least(100e0, 100e0 - greatest(0e0, rest - 0.5e0)) AS hi FROM u),
s AS (SELECT *, CASE WHEN credits = 0 AND used = 0 THEN 'insufficient-data' WHEN used <= 0 THEN 'inconsistent' ELSE 'approximate' END AS st FROM q)
SELECT project, credits, used AS consumed_percent, CASE WHEN st = 'approximate' THEN credits / (used / 100e0) END AS point_estimate,
  CASE WHEN st = 'approximate' AND lo > 0 THEN credits / (hi / 100e0) END AS interval_low, CASE WHEN st = 'approximate' AND lo > 0 THEN credits / (lo / 100e0) END AS interval_high,
  CASE WHEN st = 'approximate' THEN credits / (used / 100e0) * (rest / 100e0) END AS estimated_remaining, st AS quota_status FROM s""",
)
def a24_quota(spark, folder):
    """Quota of many accounts: projects stand for accounts, with idle, full and edge cases."""
    rows = t.prepared(spark, folder)
    used = rows.groupBy("project").agg(
        F.sum("cost").cast("double").alias("credits"), (F.count(F.lit(1)) % 101).cast("double").alias("rest")
    )
    models = rows.select("model").distinct()
    for name, amount, rest in (("idle ", 0.0, 100.0), ("full ", 5.0, 100.0), ("edge ", 5.0, 99.7)):
        used = used.unionByName(
            models.select(F.concat(F.lit(name), "model").alias("project"), F.lit(amount).alias("credits"), F.lit(rest).alias("rest"))
        )
    return credits.quota(used, F.col("rest")).drop("rest")


@query(
    "a25_usage_by_model",
    f"""WITH {t.RESPONSES} SELECT model, model AS display_name, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns,
  count(DISTINCT date) AS active_buckets, CAST(sum(turns) AS DOUBLE) / (SELECT CAST(sum(turns) AS DOUBLE) FROM days) AS turn_share FROM detail GROUP BY model""",
)
def a25_usage_by_model(spark, folder):
    return activity.usage_by(parse_usage(t.response_days(spark, folder)), "models", "model")


@query(
    "a25_usage_by_client",
    f"""WITH {t.RESPONSES} SELECT client AS client_id, CASE client WHEN 'CODEX_DESKTOP_APP' THEN 'Desktop App' WHEN 'CODEX_CLI' THEN 'CLI'
  WHEN 'CODEX_CLOUD_TASKS' THEN 'Cloud Tasks' ELSE 'Other Tool' END AS display_name, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns,
  count(DISTINCT date) AS active_buckets, CAST(sum(turns) AS DOUBLE) / (SELECT CAST(sum(turns) AS DOUBLE) FROM days) AS turn_share FROM detail GROUP BY client""",
)
def a25_usage_by_client(spark, folder):
    return activity.usage_by(parse_usage(t.response_days(spark, folder)), "clients", "client_id")


def _tools_sql(key: str) -> str:
    return f"""WITH {t.TOOLS}, k AS (SELECT *, {key} AS item_key FROM tools)
SELECT item_key, arg_min(name, (date, coalesce(plugin_id, ''), name)) AS name, CASE WHEN item_key = 'other' THEN 'Other' ELSE arg_min(name, (date, coalesce(plugin_id, ''), name)) END AS display_name,
  CAST(sum(calls) AS BIGINT) AS invocations, count(DISTINCT date) AS active_buckets, CAST(sum(calls) AS DOUBLE) / (SELECT CAST(sum(calls) AS DOUBLE) FROM k) AS share FROM k GROUP BY item_key"""


@query("a26_skills", _tools_sql("CASE WHEN name = 'Other' THEN 'other' ELSE 'name:' || lower(name) END"))
def a26_skills(spark, folder):
    return activity.tool_ranking(parse_tools(t.tool_days(spark, folder, "skills"), "skills"), "skills")


@query(
    "a26_plugins",
    _tools_sql("CASE WHEN name = 'Other' THEN 'other' WHEN plugin_id IS NOT NULL THEN 'id:' || plugin_id ELSE 'name:' || lower(name) END"),
)
def a26_plugins(spark, folder):
    return activity.tool_ranking(parse_tools(t.tool_days(spark, folder, "plugins"), "plugins"), "plugins")


# --- A27–A33: statistics ---------------------------------------------------------


@query(
    "a27_cost_quantiles",
    f"""WITH {t.SPARSE}, {SESSION_SQL.replace('first_call', 'ts').replace('last_call', 'ts').replace('max(ts) AS ts', 'max(ts) AS lc').replace('min(ts) AS started_at', 'min(ts) AS started_at').format(source='sparse')},
c AS (SELECT {sql_round("cost", 2)} AS cost FROM s)
SELECT round(quantile_cont(CAST(cost AS DOUBLE), 0.5), 6) AS active_day_median, round(quantile_cont(CAST(cost AS DOUBLE), 0.95), 6) AS active_day_p95,
  (SELECT round(quantile_cont(cost, 0.5), 6) FROM c) AS session_median, (SELECT round(quantile_cont(cost, 0.95), 6) FROM c) AS session_p95
FROM filled WHERE calls > 0""",
)
def a27_cost_quantiles(spark, folder):
    rows = t.sparse(spark, folder)
    daily = series.zero_fill(series.daily_totals(rows))
    ranked = rollups.ranked_sessions(rollups.by_session(rows))
    out = report.cost_quantiles(daily, ranked)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "a27_session_quantiles_large",
    f"""WITH {t.SHIPMENTS}, c AS (SELECT {sql_round("sum(cost)", 2)} AS cost FROM shipments GROUP BY session)
SELECT round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95 FROM c""",
)
def a27_session_quantiles_large(spark, folder):
    """Read off by selection: neither a sort nor ranks of all sessions."""
    out = ranking.exact_quantiles(rollups.by_session(t.shipments(spark, folder)), "cost", [0.5, 0.95])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "a27_cost_quantiles_by_account",
    f"""WITH {t.SHIPMENTS}, c AS (SELECT session, min(project) AS project, {sql_round("sum(cost)", 2)} AS cost FROM shipments GROUP BY session)
SELECT project, round(quantile_cont(cost, 0.1), 6) AS p10, round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.99), 6) AS p99 FROM c GROUP BY project""",
)
def a27_cost_quantiles_by_account(spark, folder):
    """Quantiles of session costs for each project, the account of a session being its least project."""
    costs = t.shipments(spark, folder).groupBy("session").agg(F.min("project").alias("project"), round_half_up(F.sum("cost"), 2).alias("cost"))
    out = ranking.exact_quantiles(costs, "cost", [0.1, 0.5, 0.99], ["project"])
    return out.select("project", *[F.round(c, 6).alias(c) for c in out.columns if c != "project"])


CONCENTRATION = """pk AS (SELECT date AS peak_date, tokens AS peak_tokens, calls AS peak_calls FROM daily WHERE calls > 0 ORDER BY tokens DESC, date LIMIT 1),
med AS (SELECT quantile_cont(CAST(tokens AS DOUBLE), 0.5) AS m FROM daily WHERE calls > 0),
tp AS (SELECT project, sum(tokens) AS n FROM prepared GROUP BY 1), tm AS (SELECT model, sum(tokens) AS n FROM prepared GROUP BY 1),
pp AS (SELECT project, sum(tokens) AS n FROM prepared, pk WHERE date = peak_date GROUP BY 1), pm AS (SELECT model, sum(tokens) AS n FROM prepared, pk WHERE date = peak_date GROUP BY 1),
con AS (SELECT peak_date, peak_tokens, peak_calls, peak_tokens / greatest(1e0, m) AS peak_ratio,
  (SELECT project FROM tp ORDER BY n DESC, project LIMIT 1) AS top_project, (SELECT CAST(max(n) AS BIGINT) FROM tp) AS top_project_tokens, (SELECT CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) FROM tp) AS top_project_share,
  (SELECT model FROM tm ORDER BY n DESC, model LIMIT 1) AS top_model, (SELECT CAST(max(n) AS BIGINT) FROM tm) AS top_model_tokens, (SELECT CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) FROM tm) AS top_model_share,
  (SELECT CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) FROM pp) AS peak_day_top_project_share, (SELECT CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) FROM pm) AS peak_day_top_model_share FROM pk, med)"""


@query("a28_concentration", f"WITH {t.DAILY}, {CONCENTRATION} SELECT * REPLACE (CAST(peak_date AS VARCHAR) AS peak_date) FROM con")
def a28_concentration(spark, folder):
    rows = t.prepared(spark, folder)
    return report.concentration(rollups.compact_facts(rows), series.daily_totals(rows))


@query(
    "a28_analysis_facts",
    f"""WITH {t.DAILY}, {CONCENTRATION}, cr AS (SELECT CAST(sum(cache_read) AS DOUBLE) / CAST(sum(tokens) AS DOUBLE) AS s FROM prepared)
SELECT 'peak-day-token-ratio' AS code, {sql_round('peak_ratio', 4)} AS value, peak_ratio >= 2 AS notable, CAST(peak_date AS VARCHAR) AS name FROM con
UNION ALL SELECT 'top-project-token-share', {sql_round('top_project_share', 8)}, top_project_share >= 0.6e0, top_project FROM con
UNION ALL SELECT 'top-model-token-share', {sql_round('top_model_share', 8)}, top_model_share >= 0.6e0, top_model FROM con
UNION ALL SELECT 'peak-day-top-project-token-share', {sql_round('peak_day_top_project_share', 8)}, NULL, CAST(peak_date AS VARCHAR) FROM con
UNION ALL SELECT 'peak-day-top-model-token-share', {sql_round('peak_day_top_model_share', 8)}, NULL, CAST(peak_date AS VARCHAR) FROM con
UNION ALL SELECT 'cache-read-token-share', {sql_round('s', 8)}, s >= 0.8e0, NULL FROM cr""",
)
def a28_analysis_facts(spark, folder):
    rows = t.prepared(spark, folder)
    focus = report.concentration(rollups.compact_facts(rows), series.daily_totals(rows))
    return report.analysis_facts(focus, report.token_shares(rows))


@query(
    "a29_night_weekend",
    f"""WITH {t.PREPARED} SELECT CAST(sum(tokens) FILTER (hour <= 5) AS DOUBLE) / CAST(sum(tokens) AS DOUBLE) AS night_share,
  CAST(sum(tokens) FILTER (weekday IN ('Sat', 'Sun')) AS DOUBLE) / CAST(sum(tokens) AS DOUBLE) AS weekend_share FROM prepared""",
)
def a29_night_weekend(spark, folder):
    return rollups.night_and_weekend(rollups.weekday_hours(t.prepared(spark, folder)))


@query(
    "a31_account_strip",
    f"""WITH {t.WHOLE_ACCOUNT} SELECT CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS calendar_days, CAST(sum(tokens) AS DOUBLE) / count(*) AS daily_average,
  count(*) FILTER (tokens > 0) AS active_days, max(tokens) AS peak_tokens, (SELECT CAST(date AS VARCHAR) FROM account ORDER BY tokens DESC, date LIMIT 1) AS peak_date FROM account""",
)
def a31_account_strip(spark, folder):
    return series.account_strip(t.whole_account(spark, folder))


@query(
    "a32_portable_audit",
    f"""WITH {t.PREPARED} SELECT count(*) AS record_rows, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost,
  CAST(min(date) AS VARCHAR) AS range_start, CAST(max(date) AS VARCHAR) AS range_end FROM prepared""",
)
def a32_portable_audit(spark, folder):
    return portable.portable_audit(t.usage(spark, folder), t.TZ)


@query(
    "a33_rollout_stats",
    f"""WITH {t.ROLLOUTS}, r AS (SELECT *, session IS NOT NULL AND (project IS NOT NULL OR fingerprint IS NOT NULL) AS parsed FROM meta),
p AS (SELECT session, project, row_number() OVER (PARTITION BY session ORDER BY file_path) AS n, first_value(project) OVER (PARTITION BY session ORDER BY file_path) AS f FROM r WHERE parsed AND project IS NOT NULL),
g AS (SELECT session, fingerprint, row_number() OVER (PARTITION BY session ORDER BY file_path) AS n, first_value(fingerprint) OVER (PARTITION BY session ORDER BY file_path) AS f FROM r WHERE parsed AND fingerprint IS NOT NULL)
SELECT (SELECT count(*) FROM r) AS files, (SELECT count(*) FROM r WHERE parsed) AS rows_parsed, (SELECT count(*) FROM r WHERE NOT parsed) AS rows_skipped,
  (SELECT count(DISTINCT session) FROM p) AS project_sessions, (SELECT count(DISTINCT session) FROM g) AS fingerprint_sessions,
  (SELECT count(*) FROM p WHERE n > 1 AND project = f) AS duplicate_projects, (SELECT count(*) FROM p WHERE n > 1 AND project <> f) AS conflicting_projects,
  (SELECT count(*) FROM g WHERE n > 1 AND fingerprint = f) AS duplicate_fingerprints, (SELECT count(*) FROM g WHERE n > 1 AND fingerprint <> f) AS conflicting_fingerprints""",
)
def a33_rollout_stats(spark, folder):
    return rollout_stats(parse_rollout_meta(t.rollout_lines(spark, folder)))


# --- W2, W7, T1, T3–T5 -------------------------------------------------------------

RECENT = """account AS (SELECT date, CAST(CAST(tokens * 11 AS DOUBLE) / 10 AS BIGINT) AS tokens FROM daily WHERE day(date) % 7 <> 3)"""


@query(
    "w02_running_account",
    f"""WITH {t.DAILY}, account AS (SELECT date, CAST(trunc(tokens * 11 / 10e0) AS BIGINT) AS tokens FROM daily WHERE day(date) % 7 <> 3)
SELECT CAST(daily.date AS VARCHAR) AS date, daily.tokens, account.tokens AS account_tokens,
  CAST(sum(coalesce(account.tokens, 0)) OVER (ORDER BY daily.date) AS BIGINT) AS cumulative_account_tokens FROM daily LEFT JOIN account USING (date)""",
)
def w02_running_account(spark, folder):
    """Local days beside account buckets, some missing; the running total takes those as 0."""
    daily = series.daily_totals(t.prepared(spark, folder))
    joined = series.with_account(daily, t.recent_account(spark, folder, gaps=True))
    return series.running_account(joined).select("date", "tokens", "account_tokens", "cumulative_account_tokens")


@query(
    "w07_occurrence",
    f"""WITH {t.COMPACT} SELECT device, input_order, nth - 1 AS occurrence FROM labelled""",
)
def w07_occurrence(spark, folder):
    """Which copy of its fingerprint a record is; blocks of 64 orders, so that many keys span several."""
    from meterbook.operators.dedup import record_fingerprint

    keyed = t.compact_inputs(spark, folder).withColumn("_key", F.concat_ws("|", record_fingerprint(), "device"))
    return ranking.occurrence_number(keyed, "_key", "input_order", block=4).select("device", "input_order", "occurrence")


@query(
    "t01_ordered_events",
    f"""WITH {t.TWO_SOURCES} SELECT {sql_time('ts')} AS ts, source, event_id, tokens FROM ledger ORDER BY ts, source, event_id""",
)
def t01_ordered_events(spark, folder):
    """Events by time, source and id: a range-partitioned sort."""
    return t.ledger(spark, folder).orderBy("ts", "source", "event_id").select("ts", "source", "event_id", "tokens")


@query(
    "t03_peaks",
    f"""WITH {t.DAILY}, h AS (SELECT weekday, hour, sum(tokens) AS n FROM prepared GROUP BY ALL)
SELECT (SELECT CAST(date AS VARCHAR) FROM daily ORDER BY tokens DESC, date LIMIT 1) AS token_day, (SELECT CAST(date AS VARCHAR) FROM daily ORDER BY cost DESC, date LIMIT 1) AS cost_day,
  (SELECT weekday FROM h ORDER BY n DESC, weekday, hour LIMIT 1) AS heat_weekday, (SELECT hour FROM h ORDER BY n DESC, weekday, hour LIMIT 1) AS heat_hour, (SELECT CAST(max(n) AS BIGINT) FROM h) AS heat_tokens""",
)
def t03_peaks(spark, folder):
    rows = t.prepared(spark, folder)
    daily = series.daily_totals(rows)
    cell = rollups.weekday_hours(rows).agg(
        F.min_by(F.struct("weekday", "hour", "tokens"), F.struct(-F.col("tokens"), F.col("weekday"), F.col("hour"))).alias("c")
    )
    tokens = series.peak_day(daily).select(F.col("date").alias("token_day"))
    cost = series.peak_day(daily, measure="cost").select(F.col("date").alias("cost_day"))
    from meterbook.operators.keyed import with_totals

    heat = cell.select(F.col("c.weekday").alias("heat_weekday"), F.col("c.hour").alias("heat_hour"), F.col("c.tokens").alias("heat_tokens"))
    return with_totals(with_totals(tokens, cost), heat)


@query(
    "t04_top_shares",
    f"""WITH {SHIPMENT_DAYS}, {PROJECT_SQL.format(source='shipments')}, d AS (SELECT cost, row_number() OVER (ORDER BY cost DESC, date) AS r FROM filled WHERE calls > 0),
s AS (SELECT {sql_round("sum(cost)", 2)} AS cost, session FROM shipments GROUP BY session), sr AS (SELECT cost, row_number() OVER (ORDER BY cost DESC, session) AS r FROM s)
SELECT (SELECT CAST(sum(cost) FILTER (r <= 10) AS DOUBLE) / CAST(sum(cost) AS DOUBLE) FROM d) AS top_ten_days,
  (SELECT CAST(sum(cost) FILTER (rank <= 2) AS DOUBLE) / CAST(sum(cost) AS DOUBLE) FROM ranked) AS top_two_projects,
  (SELECT CAST(sum(cost) FILTER (rank <= 5) AS DOUBLE) / CAST(sum(cost) AS DOUBLE) FROM ranked) AS top_five_projects,
  (SELECT round(sum(cost) FILTER (r <= 5) / sum(cost), 10) FROM sr) AS top_five_sessions, (SELECT round(sum(cost) FILTER (r <= 10) / sum(cost), 10) FROM sr) AS top_ten_sessions""",
)
def t04_top_shares(spark, folder):
    rows = t.shipments(spark, folder)
    out = report.top_shares(
        _shipment_days(spark, folder), rollups.by_project(rows), rollups.ranked_sessions(rollups.by_session(rows))
    )
    rounded = {c: F.round(c, 10) for c in ("top_five_sessions", "top_ten_sessions")}
    return out.withColumns(rounded)


@query(
    "t05_report_heads",
    f"""WITH {t.DAILY}, m AS (SELECT model AS name, sum(tokens) AS n FROM prepared GROUP BY 1 ORDER BY n DESC, name LIMIT 3)
SELECT * FROM (SELECT 'day' AS head, CAST(date AS VARCHAR) AS name, tokens FROM daily ORDER BY date DESC LIMIT 12)
UNION ALL SELECT 'model', name, CAST(n AS BIGINT) FROM m""",
)
def t05_report_heads(spark, folder):
    """Report heads: the last twelve days and the three largest models."""
    rows = t.prepared(spark, folder)
    days = ranking.first_k(series.daily_totals(rows), [F.desc("date")], 12)
    sums = rows.groupBy("model").agg(F.sum(rollups.tokens()).alias("tokens"))
    models = ranking.first_k(sums, [F.desc("tokens"), F.asc("model")], 3)
    return days.select(F.lit("day").alias("head"), F.col("date").cast("string").alias("name"), "tokens").unionByName(
        models.select(F.lit("model").alias("head"), F.col("model").alias("name"), "tokens")
    )




def _sizes(tables, names):
    parts = [tables[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "a21_credits_audit",
    f"""WITH {t.RESPONSES} SELECT 'summary' AS name, CAST(1 AS BIGINT) AS rows FROM (SELECT count(*) FROM days) UNION ALL SELECT 'days', count(*) FROM days UNION ALL SELECT 'models', count(DISTINCT model) FROM prepared
UNION ALL SELECT 'reference', CAST(5 AS BIGINT) FROM (SELECT count(*) FROM days) UNION ALL SELECT 'alignment', CAST(1 AS BIGINT) FROM (SELECT count(*) FROM days)""",
)
def a21_credits_audit(spark, folder):
    """All tables of the credits audit at once."""
    tables = credits.credits_audit(parse_usage(t.response_days(spark, folder)), F.lit(41.0))
    return _sizes(tables, ("summary", "days", "models", "reference", "alignment"))


@query(
    "a25_activity_audit",
    f"""WITH {t.RESPONSES} SELECT 'days' AS name, count(*) AS rows FROM days UNION ALL SELECT 'summary', CAST(1 AS BIGINT) FROM (SELECT count(*) FROM days) UNION ALL SELECT 'models', count(DISTINCT model) FROM prepared""",
)
def a25_activity_audit(spark, folder):
    """All tables of the activity report at once."""
    days = parse_usage(t.response_days(spark, folder))
    tools = [parse_tools(t.tool_days(spark, folder, k), k) for k in ("skills", "plugins")]
    return _sizes(activity.activity_audit(days, *tools), ("days", "summary", "models"))
