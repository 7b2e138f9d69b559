from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import call, usage
from meterbook.sources import sinks
from meterbook.functions import timeparts
from meterbook.functions.labels import add_project_alias
from meterbook.operators import quality, rollups, series
from meterbook.operators.ranking import ordered_positions
from meterbook.plans import report, views
from meterbook.sources.sinks import sink_report_tables

ROWS = [
    call("2024-01-30T20:00:00", "a", "m1", "/Users/u/web", "coding", (10, 80, 0, 10), 2, "4"),
    call("2024-02-01T01:00:00", "a", "m2", "/Users/u/api", None, (5, 0, 0, 5), 0, "1"),
    call("2024-02-03T04:00:00", "b", "m1", "/Users/u/api", "git", (100, 0, 0, 0), 3, "2"),
    call("2024-02-03T04:30:00", "c", "m1", "/Users/u/web", "git", (1, 0, 0, 0), 1, "0.005", account="y"),
]


def test_daylight_saving(spark):
    rows = spark.createDataFrame([(datetime(2024, 3, 31, 0, 30),), (datetime(2024, 3, 31, 1, 30),), (datetime(2024, 10, 27, 0, 30),)], "ts timestamp_ntz")
    hours = [r[0] for r in rows.select(timeparts.local_hour("ts", "Europe/Berlin")).collect()]
    assert hours == [1, 3, 2]


def test_instants(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T08:00:00+0800", "2024-01-01T08:00:00.5+08:00", "rubbish"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(timeparts.epoch_ms(timeparts.parse_instant("x"))).collect()
    assert [r[0] for r in rows] == [1704067200000, 1704067200000, 1704067200500, None]


def test_weeks_start_on_monday(spark):
    rows = spark.createDataFrame([(date(2024, 1, 7),), (date(2024, 1, 8),)], "d date").select(timeparts.week_start("d")).collect()
    assert [r[0] for r in rows] == [date(2024, 1, 1), date(2024, 1, 8)]


def test_report_tables(spark, tmp_path):
    tables = report.build_report(usage(spark, ROWS), "Asia/Shanghai")
    daily = {str(r.date): r for r in tables["daily"].collect()}
    assert sorted(daily) == ["2024-01-31", "2024-02-01", "2024-02-02", "2024-02-03"]
    # a record without calls weighs one call
    assert (daily["2024-02-01"].calls, daily["2024-02-02"].calls, daily["2024-02-03"].sessions) == (1, 0, 2)
    months = {r.month: r for r in tables["months"].collect()}
    assert (months["2024-01"].calendar_days, months["2024-01"].is_partial, months["2024-02"].days_in_month) == (1, True, 29)
    sessions = tables["sessions"].orderBy("rank").collect()
    assert [r.project for r in sessions] == ["web", "api", "web"] and sessions[0].models == ["m1", "m2"]
    assert tables["weekday_hours"].count() == 168
    assert {r.activity for r in tables["activities"].collect()} == {"Coding", "Other", "Git Ops"}
    top = tables["dominant_month"].first()
    assert (top.month, top.previous_month, top.cost_before) == ("2024-01", None, 0)
    views_ = {"summary": tables["summary"], **{n: tables[n] for n in ("daily", "months", "projects", "models", "activities", "sessions", "weekday_hours")}}
    quality.require_clean(quality.cross_view_checks(views_))
    quality.require_clean(quality.fact_checks(tables["facts"], "Asia/Shanghai"))
    quality.require_clean(quality.leak_checks({"facts": tables["facts"], "sessions": tables["sessions"]}))
    sink_report_tables({"facts": tables["facts"], "models": tables["models"]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == tables["facts"].count()


def test_accounts_do_not_mix(spark):
    tables = report.build_report(usage(spark, ROWS), "Asia/Shanghai", by=["account"])
    summary = {r.account: r for r in tables["summary"].collect()}
    assert (summary["x"].sessions, summary["y"].sessions, summary["y"].tokens) == (2, 1, 1)
    assert {(r.account, r.rank) for r in tables["sessions"].collect()} == {("x", 1), ("x", 2), ("y", 1)}
    assert tables["weekday_hours"].groupBy("account").count().agg(F.min("count")).first()[0] == 168
    assert {r.account: r.month for r in tables["dominant_month"].collect()} == {"x": "2024-01", "y": "2024-02"}
    assert tables["concentration"].count() == 2 and tables["top_shares"].count() == 2 and tables["cost_quantiles"].count() == 2


def test_account_layer(spark):
    account = spark.createDataFrame([(date(2024, 2, 1), 50), (date(2024, 2, 2), 0), (date(2024, 2, 3), 70)], "date date, tokens bigint")
    tables = report.build_report(usage(spark, ROWS), "Asia/Shanghai", account=account)
    made = tables["reconstruction"].first()
    assert (made.official_tokens, made.reconstructed_tokens, made.net_gap_tokens, made.outside_range_tokens) == (120, 111, 9, 100)
    quality.require_clean(quality.reconstruction_algebra(tables["reconstruction"]))
    assert tables["account"].where("local_calls = 0").count() == 1
    assert [r.cumulative_account_tokens for r in tables["daily"].orderBy("date").collect()] == [50, 50, 120]


def test_project_names(spark):
    rows = spark.createDataFrame([("/Users/x",), ("\\Users\\x\\Deep\\New\\",), (None,), ("/srv/app",)], "p string")
    got = [r.p for r in add_project_alias(rows, "p", "p").collect()]
    assert got == ["Home", "deep · new", "Home", "srv · app"]


@pytest.mark.parametrize("days, unit", [(1, "daily"), (14, "daily"), (15, "weekly"), (92, "weekly"), (93, "monthly")])
def test_grain(days, unit):
    assert timeparts.grain_for(days) == unit


def test_range_view_rules(spark):
    facts = rollups.compact_facts(report.prepare(usage(spark, ROWS), "UTC"))
    account = spark.createDataFrame([(date(2024, 2, 10), 5)], "date date, tokens bigint")
    empty = views.range_summary(facts, account, "2024-02-10", "2024-02-11").first()
    assert (empty.account_tokens, empty.calls, empty.local_detail) == (5, 0, "empty")
    none = views.range_facts(facts, account, "2024-02-10", "2024-02-11").first()
    assert (none.top_project, none.busiest_hour, none.busiest_calls) == (None, None, 0)
    # inside the range session a starts with its second call
    periods = views.project_periods(facts, "2024-02-01", "2024-02-03").collect()
    assert {(r.project, str(r.period), r.sessions) for r in periods} == {("api", "2024-02-01", 1), ("api", "2024-02-03", 1), ("web", "2024-02-03", 1)}
    matrix = views.date_hours(facts, "2024-02-01", "2024-02-03")
    assert matrix.count() == 72 and matrix.agg(F.sum("calls")).first()[0] == 5
    with pytest.raises(ValueError):
        views.grain("2024-02-03", "2024-02-01")


def test_large_scale_plans_keep_their_shape(spark):
    """Filters and columns reach the scan, aggregates combine before the shuffle, nothing is cross joined."""
    from meterbook.catalog import tables as t

    folder = "/root/testdata/sf0.001"
    rows = t.shipments(spark, folder)
    plan = series.daily_totals(rows.where(F.col("l_suppkey") == 3))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in plan and "l_partkey" not in plan
    facts = rollups.compact_facts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in facts and facts.count("Exchange hashpartitioning") == 1
    scaled = rollups.scale_costs(rollups.compact_facts(rows), rows.agg(F.sum("cost").alias("period_cost")))
    assert "NestedLoopJoin" not in scaled._jdf.queryExecution().executedPlan().toString()
    ranked = ordered_positions(rollups.project_sums(rows), [F.desc("cost"), F.asc("project")])
    assert "Exchange SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_export_tables_lead_the_report(spark):
    """The tables of an export are shown; its records give days, tokens and detail."""
    import json

    from meterbook.plans.report import export_report
    from meterbook.sources import exports

    def record(n, model, category, cost):
        return {"project": "/u/site", "sessionId": f"rollout-s{n}", "timestamp": f"2024-05-0{n}T08:00:00Z", "category": category, "model": model,
                "inputTokens": 100, "outputTokens": 20, "cacheReadTokens": 50, "cacheWriteTokens": 0, "cost": cost, "calls": 1}

    def figures(**more):
        return {"Cost (USD)": 8.0, "API Calls": 2, "Input Tokens": 100, "Output Tokens": 40, "Cache Read Tokens": 100, "Cache Write Tokens": 0, **more}

    body = {
        "schema": "codeburn.export.v2", "summary": [{"Cost (USD)": 16.0, "API Calls": 4, "Sessions": 2, "Projects": 1}],
        "periods": [{
            "daily": [{"Date": "2024-05-01", **figures()}],
            "models": [figures(Model="m1", **{"Share (%)": 50.0}), figures(Model="m2", **{"Share (%)": 50.0})],
            "activity": [{"Activity": "Coding", "Cost (USD)": 16.0, "Share (%)": 100.0, "Turns": 9}],
        }],
        "records": [record(1, "m1", "Coding", 1.0), record(2, "m1", "Coding", 3.0), record(3, "m2", "Coding", 4.0)],
        "sessions": [{"Session ID": "s1", "Project": "site", "Started At": "2024-05-01T08:00:00Z", "Cost (USD)": 2.0, "API Calls": 1, "Turns": 3}],
        "projects": [{"Project": "site", "Cost (USD)": 16.0, "API Calls": 4, "Sessions": 2}],
    }
    made = exports.parse_exports(spark.createDataFrame([("d", json.dumps(body))], "document string, payload string"))
    tables = export_report(exports.export_records(made), "UTC", made)
    assert {r.model: float(r.cost) for r in tables["models"].collect()} == {"m1": 8.0, "m2": 8.0}
    assert {(r.model, str(r.date)): r.cost for r in tables["model_days"].collect()} == {
        ("m1", "2024-05-01"): 2.0, ("m1", "2024-05-02"): 6.0, ("m2", "2024-05-03"): 8.0,
    }
    assert [(r.activity, r.turns, float(r.cost)) for r in tables["activities"].collect()] == [("Coding", 9, 16.0)]
    session = tables["sessions"].first()
    assert len(session.session) == len("session-") + 12 and session.turns == 3
    # records cost 8, the period 16: one factor for all facts
    assert {float(r.cost_scale) for r in tables["facts"].select("cost_scale").distinct().collect()} == {2.0}


def test_report_sets_are_read_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "reports")
    with pytest.raises(sinks.ReportSetError):
        sinks.read_report_set(spark, path)
    first = {"models": spark.createDataFrame([("m", 1)], "model string, calls bigint"), "empty": spark.createDataFrame([], "a int, `b.c` array<string>")}
    name = sinks.sink_report_set(first, path)
    second = sinks.sink_report_set({"models": spark.createDataFrame([("m", 2), ("n", 3)], "model string, calls bigint")}, path)
    back = sinks.read_report_set(spark, path)
    assert list(back) == ["models"] and sorted(map(tuple, back["models"].collect())) == [("m", 2), ("n", 3)]
    old = sinks.read_report_set(spark, path, name)
    assert [tuple(r) for r in old["models"].collect()] == [("m", 1)]
    assert old["empty"].collect() == [] and old["empty"].columns == ["a", "b.c"]
    # a table that lost rows, and one without its manifest
    spark.createDataFrame([("m", 2)], "model string, calls bigint").write.mode("overwrite").parquet(f"{path}/{second}/models")
    with pytest.raises(sinks.ReportSetError):
        sinks.read_report_set(spark, path)
    with pytest.raises(sinks.ReportSetError):
        sinks.read_report_set(spark, path, "none")
