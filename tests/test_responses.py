import json

import pytest
from pyspark.sql import functions as F

from meterbook.operators.quality import QualityError, require_clean
from meterbook.operators.textscan import gate
from meterbook.plans import activity, credits
from meterbook.sources.account import account_schema_checks, parse_account
from meterbook.operators.quality import account_checks
from meterbook.sources.responses import parse_tools, parse_usage
from meterbook.sources.sinks import sink_responses


def frame(spark, *bodies):
    return spark.createDataFrame([(f"d{i}", json.dumps(b)) for i, b in enumerate(bodies)], "document string, payload string")


def day(date, credits_, cached, fresh, output, threads, turns, models=(), clients=(), total=None):
    return {
        "date": date,
        "totals": {
            "credits": credits_, "threads": threads, "turns": turns, "cached_text_input_tokens": cached, "uncached_text_input_tokens": fresh,
            "text_output_tokens": output, "text_total_tokens": cached + fresh + output if total is None else total,
        },
        "models": [dict(zip(("model", "threads", "turns"), m)) for m in models],
        "clients": [dict(zip(("client_id", "threads", "turns"), c)) for c in clients],
    }


USAGE = {
    "group_by": "day",
    "data": [
        day("2024-06-02", 400, 2_000_000, 400_000, 100_000, 3, 9, [("sol", 2, 6), ("luna", 1, 3), ("idle", 0, 0)], [("CODEX_CLI", 3, 9)]),
        day("2024-06-01", 600, 4_000_000, 0, 200_000, 2, 3, [], [("CODEX_CLOUD_TASKS", 2, 3)]),
    ],
}


def test_credits_of_two_days(spark):
    days = parse_usage(frame(spark, USAGE))
    require_clean(credits.credit_checks(days))
    row = credits.credit_totals(days).first()
    # (400000*125 + 6000000*12.5 + 300000*750) / 1e6
    assert (float(row.credits), row.tokens, row.reference_credits, row.detail_days, row.turns) == (1000.0, 6_700_000, 350.0, 1, 12)
    assert row.turns_per_thread == 2.4 and abs(row.charged_ratio - 1000 / 350) < 1e-12
    models = {r.model: r for r in credits.credits_by_model(days).collect()}
    assert models["idle"].active_dates == 1 and models["sol"].turns == 6 and models["idle"].turns_per_thread == 0
    # a bare array of days is accepted too
    assert parse_usage(frame(spark, USAGE["data"])).count() == 2


@pytest.mark.parametrize(
    "credits_, remaining, expected",
    [
        (5900, 41, (10_000, "approximate", True)),
        (0, 100, (None, "insufficient-data", False)),
        (5, 100, (None, "inconsistent", False)),
        (5, 99.7, (5 / 0.003, "approximate", False)),
        (50, 0, (50, "approximate", True)),
        (50, None, (None, None, False)),
    ],
)
def test_quota(spark, credits_, remaining, expected):
    totals = spark.createDataFrame([(float(credits_), None if remaining is None else float(remaining))], "credits double, rest double")
    row = credits.quota(totals, F.col("rest")).first()
    point, status, interval = expected
    assert row.quota_status == status and (row.interval_low is not None) == interval
    assert row.point_estimate is None if point is None else abs(row.point_estimate - point) < 1e-6
    if remaining == 41:
        assert (int(row.interval_low), round(row.interval_high)) == (9915, 10085)


def test_bad_days(spark):
    bad = {"group_by": "week", "data": [day("2024-06-31", 1, 1, 1, 1, 1, 1), day("2024-06-01", 1, 1, 1, 1, 1, 1, total=4), day("2024-06-01", 1, 0, 0, 0, 1, 2, [("m", 1, 1)])]}
    found = {r.check for r in credits.credit_checks(parse_usage(frame(spark, bad))).collect()}
    assert found == {"group-by-supported", "date-invalid", "token-identity", "date-repeated", "models-turns"}


def tools(kind, days, group="day"):
    listed, name = ("skill_usage_overviews", "skill_name") if kind == "skills" else ("plugin_usage_overviews", "plugin_name")
    return {
        "group_by": group,
        "data": [
            {"date": d, listed: [{name: n, "display_name": shown, "plugin_id": p, "invocation_counts": c} for n, shown, p, c in items]} for d, items in days
        ],
    }


SKILLS = tools("skills", [("2024-06-01", [("Search", "Search!", None, 4), ("OTHER", "odd", None, 1)]), ("2024-06-02", [("search", None, None, 3), ("other", "Other", None, 0)])])
PLUGINS = tools("plugins", [("2024-06-01", [("git", "Git", "p1", 2)]), ("2024-06-02", [("Git hub", "Hub", "p1", 3), ("git", "", None, 1)])])


def test_activity(spark):
    days = parse_usage(frame(spark, USAGE))
    skills, plugins = parse_tools(frame(spark, SKILLS), "skills"), parse_tools(frame(spark, PLUGINS), "plugins")
    require_clean(activity.response_checks(days, skills, plugins))
    daily = activity.activity_days(days, skills, plugins)
    summary = activity.activity_summary(daily)
    row = summary.first()
    assert (row.buckets, row.threads, row.turns, row.skill_invocations, row.plugin_calls) == (2, 5, 12, 8, 6)
    ranked = {r.item_key: r for r in activity.tool_ranking(skills, "skills").collect()}
    assert (ranked["name:search"].invocations, ranked["name:search"].display_name, ranked["name:search"].active_buckets) == (7, "Search!", 2)
    assert (ranked["other"].display_name, ranked["other"].active_buckets, ranked["other"].share) == ("Other", 1, 0.125)
    named = {r.item_key: r.invocations for r in activity.tool_ranking(plugins, "plugins").collect()}
    assert named == {"id:p1": 5, "name:git": 1}
    clients = {r.client_id: r for r in activity.usage_by(days, "clients", "client_id").collect()}
    assert (clients["CODEX_CLI"].display_name, clients["CODEX_CLI"].turn_share, clients["CODEX_CLOUD_TASKS"].display_name) == ("CLI", 0.75, "Cloud Tasks")
    models = activity.usage_by(days, "models", "model")
    assert {r.model: r.active_buckets for r in models.collect()} == {"sol": 1, "luna": 1, "idle": 0}
    require_clean(activity.audit_checks(summary, daily, models, activity.tool_ranking(skills, "skills"), activity.tool_ranking(plugins, "plugins")))


def test_absent_responses_stay_null(spark):
    daily = activity.activity_days(parse_usage(frame(spark, USAGE)))
    row = activity.activity_summary(daily).first()
    assert (row.skill_invocations, row.plugin_calls) == (None, None)
    assert daily.where("skill_invocations IS NOT NULL").count() == 0


def test_mismatched_responses(spark):
    days = parse_usage(frame(spark, USAGE))
    late = tools("skills", SKILLS_SHORT, "week")
    found = {r.check for r in activity.response_checks(days, parse_tools(frame(spark, late), "skills")).collect()}
    assert found == {"group-by", "skills-buckets"}


SKILLS_SHORT = [("2024-06-01", [("a", "a", None, 1)])]


def test_gate(spark, tmp_path):
    rows = [
        ("usage", json.dumps(USAGE)),
        ("skills", json.dumps({**SKILLS, "who": {"User-Id": "1"}})),
        ("plugins", json.dumps({**PLUGINS, "note": "Bearer abcdefghijklmnop"})),
    ]
    responses = spark.createDataFrame(rows, "kind string, payload string")
    clean, violations = gate(responses)
    assert [r.kind for r in clean.collect()] == ["usage"]
    assert sorted((r.check, r.key) for r in violations.collect()) == [("response-credential", "plugins"), ("response-sensitive-key", "skills")]
    with pytest.raises(QualityError):
        sink_responses(responses, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    sink_responses(responses.where("kind = 'usage'"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == USAGE
    _, missing = gate(responses.where("kind <> 'usage'"))
    assert "response-required" in {r.check for r in missing.collect()}


def test_account_series(spark):
    good = {"schema": "codex.official.usage.v1", "summary": {"lifetimeTokens": 7, "peakDailyTokens": 5}, "dailyUsageBuckets": [{"startDate": "2024-01-02", "tokens": 2}, {"startDate": "2024-01-01", "tokens": 5}]}
    wrong = {**good, "schema": "x", "summary": {"lifetimeTokens": 8, "peakDailyTokens": 4}}
    summary, buckets = parse_account(frame(spark, good, wrong))
    assert summary.where("current_streak_days IS NULL").count() == 2
    found = account_checks(buckets, summary, ["document"]).unionByName(account_schema_checks(summary)).collect()
    assert sorted((r.check, r.key) for r in found) == [("account-lifetime", "d1"), ("account-peak", "d1"), ("account-schema", "d1")]
