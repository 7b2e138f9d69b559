import json

import pytest

from meterbook.operators.quality import QualityError, require_clean, table_diff, to_metrics
from meterbook.plans.portable import portable_report
from meterbook.sources import portable

TZ = "Asia/Shanghai"
# three days in Shanghai: 1 May (two sessions), none on 2 May, 3 May (after local midnight)
RECORDS = [
    {"timestamp": "2024-05-01T09:00:00+08:00", "project": "alpha", "session": "one", "model": "GPT-5.5", "activity": "coding",
     "inputTokens": 100, "outputTokens": 10, "cacheReadTokens": 880, "cacheWriteTokens": 10, "estimatedCostUsd": 3, "calls": 4},
    {"timestamp": "2024-05-01T02:30:00Z", "project": "beta, \"two\"", "session": "two", "model": "gpt-5.6-sol", "activity": "Review",
     "inputTokens": 300, "outputTokens": 100, "cacheReadTokens": 0, "cacheWriteTokens": 0, "estimatedCostUsd": 1.5, "calls": 2},
    {"timestamp": "2024-05-02T17:00:00Z", "project": "alpha", "session": "one", "model": "GPT-5.5", "activity": "coding",
     "inputTokens": 50, "outputTokens": 50, "cacheReadTokens": 100, "cacheWriteTokens": 0, "estimatedCostUsd": 0.5, "calls": 1},
]
SNAKE = {
    "inputTokens": "input_tokens", "outputTokens": "output_tokens", "cacheReadTokens": "cache_read_tokens",
    "cacheWriteTokens": "cache_write_tokens", "estimatedCostUsd": "estimated_cost_usd",
}


def write(folder, kind):
    path = folder / f"usage.{kind}"
    if kind == "json":
        path.write_text(json.dumps({"schema": "codex.portable.usage.v1", "timezone": TZ, "records": RECORDS}, indent=2))
    elif kind == "jsonl":
        path.write_text("\n\n".join(json.dumps(r) for r in RECORDS) + "\n")
    else:
        names = [SNAKE.get(n, n) for n in RECORDS[0]]
        quote = lambda v: '"' + str(v).replace('"', '""') + '"'
        lines = [",".join(quote(v) for v in r.values()) for r in RECORDS]
        path.write_text("\ufeff" + ",".join(names) + "\n" + "\n".join(lines) + "\n")
    return str(path)


def parsed(spark, folder, kind):
    path = write(folder, kind)
    if kind == "json":
        return portable.parse_records(portable.parse_documents(portable.read_documents(spark, path)))
    if kind == "jsonl":
        return portable.parse_records(portable.read_lines(spark, path))
    return portable.read_csv(spark, path)


EXPECTED = {
    "calls": "7", "sessions": "2", "projects": "2", "call_days": "2", "calendar_days": "3", "fresh_input": "450", "cache_read": "980",
    "cache_write": "10", "output": "160", "tokens": "1600",
}


@pytest.mark.parametrize("kind", ["json", "jsonl", "csv"])
def test_formats_give_the_same_report(spark, tmp_path, kind):
    tables = portable_report(parsed(spark, tmp_path, kind), TZ)
    metrics = to_metrics(tables["summary"].select(*EXPECTED))
    golden = spark.createDataFrame(list(EXPECTED.items()), "name string, value string")
    require_clean(table_diff(metrics, golden, ["name"]))
    facts = {r.code: r for r in tables["analysis_facts"].collect()}
    # active days hold 1400 and 200 tokens: the peak is 1400 / 800 of the median
    assert facts["peak-day-token-ratio"].value == 1.75 and not facts["peak-day-token-ratio"].notable
    assert facts["top-project-token-share"].value == 0.75 and facts["top-project-token-share"].notable
    assert facts["cache-read-token-share"].value == 0.6125
    days = [(str(r.date), r.calls, r.cumulative_cost) for r in tables["daily"].orderBy("date").collect()]
    assert days == [("2024-05-01", 6, 4.5), ("2024-05-02", 0, 4.5), ("2024-05-03", 1, 5.0)]
    assert [r.project for r in tables["projects"].orderBy("rank").collect()] == ["alpha", 'beta, "two"']
    # a changed golden value is found
    wrong = spark.createDataFrame([("tokens", "1601")], "name string, value string")
    with pytest.raises(QualityError):
        require_clean(table_diff(metrics.where("name = 'tokens'"), wrong, ["name"]))


BAD = [
    ({"colour": "red"}, "unknown-field"),
    ({"prompt": "x"}, "forbidden-field"),
    ({"project": "/srv/place"}, "project-path"),
    ({"project": "p 0199ab00-1111-2222-3333-00000000002a"}, "project-uuid"),
    ({"session": "abcdefabcdefabcdefabcdefabcdef"}, "session-opaque"),
    ({"session": "a@b.example"}, "session-email"),
    ({"model": "x" * 101}, "model-length"),
    ({"activity": "a\tb"}, "activity-control"),
    ({"calls": 0}, "calls-minimum"),
    ({"inputTokens": -1}, "input-integer"),
    ({"inputTokens": 9007199254740992}, "input-integer"),
    ({"estimatedCostUsd": "a lot"}, "cost-amount"),
    ({"timestamp": "2024-05-01T09:00:00"}, "timestamp-offset"),
    ({"timestamp": "soonZ"}, "timestamp-invalid"),
    ({"input_tokens": 3}, "input-alias"),
    ({"timestamp": "2026-01-01T00:00:00Z"}, "date-span"),
    ({"inputTokens": 0, "outputTokens": 0, "cacheReadTokens": 0, "cacheWriteTokens": 0}, "tokens-minimum"),
    ({}, "record-repeated"),
]


def test_bad_records_are_named(spark):
    """All bad records in one frame; each rule must fire."""
    lines = [json.dumps(r) for r in RECORDS] + [json.dumps({**RECORDS[0], **change}) for change, _ in BAD] + ['{"timestamp":']
    frame = spark.createDataFrame([("d", line) for line in lines], "document string, record string")
    found = {r.check for r in portable.checks(portable.parse_records(frame), max_days=366).collect()}
    assert {check for _, check in BAD} | {"record-malformed"} <= found


def test_good_records_pass(spark, tmp_path):
    require_clean(portable.checks(parsed(spark, tmp_path, "jsonl")))


def test_row_ids_are_unique(spark):
    lines = [json.dumps({**r, "rowId": "same"}) for r in RECORDS]
    frame = spark.createDataFrame([("d", line) for line in lines], "document string, record string")
    assert [r.check for r in portable.checks(portable.parse_records(frame)).collect()] == ["row-id-repeated"]


def test_document_rules(spark):
    bodies = [
        ("a", json.dumps({"schema": "other", "records": RECORDS})),
        ("b", json.dumps({"schema": "codex.portable.usage.v1", "records": [], "extra": 1})),
        ("c", json.dumps({"schema": "codex.portable.usage.v1", "records": RECORDS})),
    ]
    found = portable.document_checks(spark.createDataFrame(bodies, "document string, payload string")).collect()
    assert sorted((r.check, r.key) for r in found) == [("document-records", "b"), ("document-root-field", "b"), ("document-schema", "a")]


@pytest.mark.parametrize(
    "headers", [["timestamp", "project"], ["timestamp", "timestamp"], ["prompt", "timestamp"]]
)
def test_csv_headers(headers):
    with pytest.raises(portable.PortableInputError):
        portable.check_headers(headers)


def test_short_csv_row(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("timestamp,project,session,model,activity,input_tokens,cost_usd,calls\n2024-05-01T00:00:00Z,p,s,m,a,1,1,1\n2024-05-01T00:00:00Z,p\n")
    found = {r.check for r in portable.checks(portable.read_csv(spark, str(path))).collect()}
    assert "record-malformed" in found


def test_accounts_and_years(spark):
    """Three accounts over three years are one input; each has its own totals."""
    lines = [(account, json.dumps({**RECORDS[0], "timestamp": f"202{year}-05-01T09:00:00Z", "session": f"s{year}"})) for account in "abc" for year in (2, 3, 4)]
    parsed_ = portable.parse_records(spark.createDataFrame(lines, "account string, record string"))
    tables = portable_report(parsed_, "UTC", ["account"])
    assert {(r.account, r.record_rows) for r in tables["portable_audit"].collect()} == {(a, 3) for a in "abc"}
    with pytest.raises(QualityError, match="date-span"):
        portable_report(parsed_, "UTC", ["account"], max_days=366)
