from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at
from meterbook.functions.identity import add_repository_fingerprint
from meterbook.operators.attribution import rollout_mappings, session_attribution
from meterbook.plans.ledger import build_ledger, coverage, ledger_events
from meterbook.sources.requestlog import request_checks
from meterbook.sources.rollout import parse_rollout_meta, read_first_lines

EXPORT = (
    "provider string, ts timestamp_ntz, session string, model string, project string, activity string, fresh_input bigint, cache_read bigint, "
    "cache_write bigint, output bigint, tokens bigint, cost decimal(28,9), calls bigint, account string"
)
LOG = (
    "request_id string, created_at bigint, model string, session_id string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, "
    "cache_creation_tokens bigint, total_cost_usd double, app_type string, account string"
)
SECOND = int((at(0) - datetime(1970, 1, 1)).total_seconds())


def export(spark, rows):
    full = [(provider, at(ms), s, "m", p, a, t, 0, 0, 0, t, Decimal("1"), 1, account) for provider, ms, s, p, a, t, account in rows]
    return spark.createDataFrame(full, EXPORT)


def log(spark, rows):
    full = [(rid, SECOND + s, "m", session, 10, 2, 4, 0, 0.5, app, account) for rid, s, session, app, account in rows]
    return spark.createDataFrame(full, LOG)


def test_increment_starts_after_the_last_second_of_the_baseline(spark):
    records = export(spark, [("codex", ms, "s", "p", "a", 5, "x") for ms in (0, 999, 1000)])
    events = ledger_events(records, log(spark, [("r", 0, "s", "codex", "x"), ("late", 60, "s", "other", "x")]))
    rows = {(r.source, r.ts) for r in events.collect()}
    assert rows == {("ccSwitch", at(0)), ("codeburnIncrement", at(1000))}


def test_accounts_have_their_own_cutoff(spark):
    records = export(spark, [(None, 500, "s", "p", "a", 5, account) for account in "xy"])
    events = ledger_events(records, log(spark, [("r", 0, "s", "codex", "x")]), by=["account"])
    assert {(r.account, r.source) for r in events.collect()} == {("x", "ccSwitch"), ("y", "codeburnIncrement")}


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("p", 5), ("q", 6)], "q"),
        ([("p", 6), ("q", 3), ("q", 3)], "q"),
        ([("q", 3), ("p", 3)], "p"),
    ],
)
def test_attribution_order(spark, rows, expected):
    records = export(spark, [(None, i, "s", project, "a", n, "x") for i, (project, n) in enumerate(rows)])
    assert session_attribution(records).first().project == expected


def test_rollout_gives_projects_only(spark):
    meta = spark.createDataFrame(
        [("/sessions/b", "s", "/late", None), ("/sessions/a", "s", "/first", "f" * 64)], "file_path string, session string, project string, fingerprint string"
    )
    events = ledger_events(export(spark, [(None, 9_000_000, "t", None, None, 1, "x")]), log(spark, [("r", 0, "s", "codex", "x")]), meta)
    row = events.where("source = 'ccSwitch'").first()
    assert (row.project, row.activity, row.fingerprint, row.recovered) == ("/first", None, "f" * 64, True)
    by_dimension = {r.dimension: r for r in coverage(events).collect()}
    assert (by_dimension["project"].attributed_calls, by_dimension["activity"].attributed_calls) == (1, 0)
    assert rollout_mappings(meta).count() == 1


def test_build_ledger_tables_agree(spark):
    records = export(spark, [("codex", 1000 * i, f"s{i % 3}", f"p{i % 2}", None, i, "x") for i in range(1, 40)])
    made = build_ledger(records, log(spark, [("r1", 0, "s0", "codex", "x"), ("r2", 5, "s9", "codex", "x")]), "Asia/Shanghai")
    total = made["summary"].first().tokens
    for name in ("records", "daily", "models", "sessions", "sources"):
        rows = made[name]
        size = F.col("tokens") if "tokens" in rows.columns else F.col("fresh_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")
        assert rows.agg(F.sum(size)).first()[0] == total, name
    assert made["duplicates"].first().duplicate_ids == 0


def test_request_rows_are_checked(spark):
    rows = log(spark, [("r", 0, "s", "codex", "x"), (" ", 1, "s", "codex", "x")]).withColumn(
        "cache_read_tokens", F.when(F.col("request_id") == "r", 11).otherwise(F.col("cache_read_tokens"))
    )
    assert {r.check for r in request_checks(rows).collect()} == {"cache-within-input", "request-id"}


def test_first_line_of_rollout_files(spark, tmp_path):
    folder = tmp_path / "sessions" / "2024"
    folder.mkdir(parents=True)
    uuid = "0199AB00-1111-2222-3333-00000000002a"
    first = '{"type":"session_meta","payload":{"cwd":" /w/site ","git":{"repository_url":"git@h.example:T/R.git"}}}'
    (folder / f"rollout-1-{uuid}.jsonl").write_text(first + "\n" + '{"type":"session_meta","payload":{"id":"second"}}\n')
    (folder / "rollout-2.jsonl").write_text("not json\n")
    (folder / "notes.jsonl").write_text(first + "\n")
    rows = {r.session: r for r in parse_rollout_meta(read_first_lines(spark, str(tmp_path))).collect()}
    assert set(rows) == {uuid.lower(), None}
    remote = spark.createDataFrame([("https://h.example/t/r",)], "remote string")
    same = add_repository_fingerprint(remote, "remote", "fingerprint", identity="identity").first()
    assert (rows[uuid.lower()].project, rows[uuid.lower()].fingerprint, same.identity) == ("/w/site", same.fingerprint, "h.example/t/r")
