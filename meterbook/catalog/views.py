"""Range views over compact facts and an account series."""

from pyspark.sql import functions as F

from meterbook.catalog import tables as t
from meterbook.catalog.registry import query
from meterbook.catalog.aggregates import SUMS
from meterbook.operators import rollups
from meterbook.plans import views

WEEK = ("2024-01-08", "2024-01-14")
MONTH = ("2024-01-03", "2024-01-24")
LONG = ("1997-02-10", "1998-11-20")


def _facts(spark, folder):
    return rollups.compact_facts(t.prepared(spark, folder))


def _between(bounds):
    return f"date BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}'"


RECENT = "account AS (SELECT date, CAST(trunc(sum(tokens) * 11 / 10e0) AS BIGINT) AS tokens FROM prepared GROUP BY date)"


def _summary_sql(bounds):
    return f"""WITH {t.PREPARED}, {RECENT}, f AS (SELECT * FROM prepared WHERE {_between(bounds)}), a AS (SELECT * FROM account WHERE {_between(bounds)})
SELECT (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) FROM a) AS account_tokens, (SELECT count(*) FROM a) AS account_days, count(*) AS calls, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost,
  count(DISTINCT session) AS sessions, count(DISTINCT project) AS projects, CAST(coalesce(sum(fresh_input), 0) AS BIGINT) AS fresh_input, CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read,
  CAST(coalesce(sum(cache_write), 0) AS BIGINT) AS cache_write, CAST(coalesce(sum(output), 0) AS BIGINT) AS output, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
  CASE WHEN count(*) > 0 THEN 'present' ELSE 'empty' END AS local_detail FROM f"""


@query("v01_range_summary", _summary_sql(WEEK))
def v01_range_summary(spark, folder):
    return views.range_summary(_facts(spark, folder), t.recent_account(spark, folder), *WEEK)


@query(
    "v02_periods",
    f"""WITH {t.SHIPMENTS} SELECT DISTINCT CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS period,
  date_trunc('month', date) < DATE '{LONG[0]}' OR last_day(date) > DATE '{LONG[1]}' AS is_partial FROM shipments WHERE {_between(LONG)}""",
)
def v02_periods(spark, folder):
    """A long range is shown by month, with the cut-off months marked."""
    from meterbook.operators.filters import date_range

    rows = views.with_period(date_range(t.shipments(spark, folder), *LONG), *LONG)
    return rows.select("period", "is_partial").distinct()


@query(
    "v03_token_ledger",
    f"""WITH {t.PREPARED} SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS period, date_trunc('week', date) < DATE '{MONTH[0]}' OR date_trunc('week', date) + INTERVAL 6 DAY > DATE '{MONTH[1]}' AS is_partial,
  {SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls, CAST(sum(cost) AS DOUBLE) AS cost FROM prepared WHERE {_between(MONTH)} GROUP BY 1, 2""",
)
def v03_token_ledger(spark, folder):
    return views.token_ledger(_facts(spark, folder), *MONTH)


@query(
    "v03_token_ledger_large",
    f"""WITH {t.SHIPMENTS} SELECT CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS period, date_trunc('month', date) < DATE '{LONG[0]}' OR last_day(date) > DATE '{LONG[1]}' AS is_partial,
  {SUMS}, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls, CAST(sum(cost) AS DOUBLE) AS cost FROM shipments WHERE {_between(LONG)} GROUP BY 1, 2""",
)
def v03_token_ledger_large(spark, folder):
    return views.token_ledger(t.shipments(spark, folder), *LONG)


@query(
    "v04_project_periods",
    f"""WITH {t.FACTS}, f AS (SELECT * FROM facts WHERE {_between(MONTH)}), s AS (SELECT session, arg_min(project, (first_call, project)) AS project, min(date) AS date, sum(cost) AS cost, sum(calls) AS calls FROM f GROUP BY session),
r AS (SELECT project, row_number() OVER (ORDER BY sum(cost) DESC, project) AS n FROM f GROUP BY project)
SELECT CASE WHEN n <= 5 THEN s.project ELSE 'Other' END AS project, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS period, count(*) AS sessions, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(calls) AS BIGINT) AS calls
FROM s JOIN r ON r.project = s.project GROUP BY 1, 2""",
)
def v04_project_periods(spark, folder):
    return views.project_periods(_facts(spark, folder), *MONTH)


@query(
    "v05_model_periods",
    f"""WITH {t.PREPARED} SELECT model, CAST(date AS VARCHAR) AS period, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(date AS VARCHAR) AS first_date, CAST(date AS VARCHAR) AS last_date
FROM prepared WHERE {_between(WEEK)} GROUP BY model, date""",
)
def v05_model_periods(spark, folder):
    return views.model_periods(_facts(spark, folder), *WEEK)


@query(
    "v06_date_hours",
    f"""WITH {t.PREPARED}, axis AS (SELECT d.d AS date, CAST(h.h AS BIGINT) AS hour FROM (SELECT unnest(generate_series(DATE '{WEEK[0]}', DATE '{WEEK[1]}', INTERVAL 1 DAY))::DATE AS d) d, (SELECT unnest(range(24)) AS h) h),
c AS (SELECT date, hour, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM prepared GROUP BY ALL),
f AS (SELECT axis.date, axis.hour, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost FROM axis LEFT JOIN c USING (date, hour))
SELECT CAST(date AS VARCHAR) AS date, hour, calls, tokens, CAST(cost AS DOUBLE) AS cost, CAST(sum(calls) OVER w AS BIGINT) AS date_calls, CAST(sum(tokens) OVER w AS BIGINT) AS date_tokens, CAST(sum(cost) OVER w AS DOUBLE) AS date_cost
FROM f WINDOW w AS (PARTITION BY date)""",
)
def v06_date_hours(spark, folder):
    return views.date_hours(_facts(spark, folder), *WEEK)


def _facts_sql(bounds, source="prepared"):
    return f"""WITH {t.PREPARED}, {RECENT}, f AS (SELECT * FROM {source} WHERE {_between(bounds)}), a AS (SELECT * FROM account WHERE {_between(bounds)}),
p AS (SELECT project, sum(cost) AS c FROM f GROUP BY 1), m AS (SELECT model, sum(tokens) AS c FROM f GROUP BY 1), h AS (SELECT hour, count(*) AS c FROM f GROUP BY 1)
SELECT (SELECT CAST(date AS VARCHAR) FROM a ORDER BY tokens DESC, date LIMIT 1) AS peak_account_date, (SELECT max(tokens) FROM a) AS peak_account_tokens,
  (SELECT project FROM p ORDER BY c DESC, project LIMIT 1) AS top_project, (SELECT CAST(max(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE) FROM p) AS top_project_share,
  (SELECT model FROM m ORDER BY c DESC, model LIMIT 1) AS top_model, (SELECT coalesce(CAST(max(c) AS DOUBLE) / CAST(sum(c) AS DOUBLE), 0) FROM m) AS top_model_share,
  (SELECT hour FROM h ORDER BY c DESC, hour LIMIT 1) AS busiest_hour, (SELECT coalesce(max(c), 0) FROM h) AS busiest_calls"""


@query("v07_range_facts", _facts_sql(WEEK))
def v07_range_facts(spark, folder):
    return views.range_facts(_facts(spark, folder), t.recent_account(spark, folder), *WEEK)


@query(
    "v07_account_only",
    f"""WITH {t.WHOLE_ACCOUNT}, a AS (SELECT * FROM account WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-01-01')
SELECT CAST(sum(tokens) AS BIGINT) AS account_tokens, count(*) AS account_days, CAST(0 AS BIGINT) AS calls, CAST(0 AS DOUBLE) AS cost, CAST(0 AS BIGINT) AS sessions, CAST(0 AS BIGINT) AS projects, CAST(0 AS BIGINT) AS fresh_input,
  CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(0 AS BIGINT) AS output, CAST(0 AS BIGINT) AS tokens, 'empty' AS local_detail FROM a""",
)
def v07_account_only(spark, folder):
    """A range the account knows and the ledger does not: zero local calls, no error."""
    # the first order was placed a day before the first shipment left
    return views.range_summary(t.shipments(spark, folder), t.whole_account(spark, folder), "1995-01-01", "1995-01-01")
