"""Files of several devices, from disk to one merged ledger."""

import json

import pytest

from meterbook.operators.quality import device_checks, event_checks, require_clean
from meterbook.plans import merge
from meterbook.sources import devices, exports

DIGEST = "{:064x}".format


def ledger(*events, zone="Asia/Shanghai", reliable=True):
    return {
        "schema": "codex.lifecycle.ledger.v1", "timezone": zone, "cutoff": {"ccSwitchMaxCreatedAtEpochSeconds": 100, "codeburnAppendAfter": None},
        "eventContract": {"eventLevelReliable": reliable}, "events": list(events), "records": [],
    }


def event(n, **more):
    return {
        "eventId": DIGEST(n), "occurredAt": f"2024-05-01T00:00:{n:02d}.000Z", "source": "ccSwitch", "sessionId": "s", "model": "m",
        "components": {"freshInputTokens": 5, "cacheReadTokens": 1, "cacheWriteTokens": 0, "outputTokens": 2, "totalTokens": 8}, "costUsd": 0.25, **more,
    }


def write(folder, name, body):
    path = folder / name
    path.write_text(json.dumps(body, indent=1, ensure_ascii=False))
    return str(path)


def test_merge_from_files(spark, tmp_path):
    paths = {
        "mac": write(tmp_path, "mac.json", ledger(event(1, project="/u/site"), event(2, project="/u/site"))),
        "pc": write(tmp_path, "pc.json", ledger(event(2, activity="Coding", provenance={"devices": ["old"], "sources": ["ccSwitch"]}), event(30))),
    }
    aliases = devices.read_alias_map(
        spark, write(tmp_path, "aliases.json", {"schema": "codex.project.aliases.v1", "aliases": [{"device": "mac", "project": "/u/site", "alias": "Site"}]})
    )
    require_clean(devices.alias_checks(aliases))
    ledgers = devices.read_device_ledgers(spark, paths)
    heads = devices.ledger_heads(ledgers)
    require_clean(device_checks(heads))
    require_clean(devices.ledger_head_checks(heads))
    require_clean(devices.spelling_checks(ledgers))
    events = devices.ledger_events(ledgers)
    require_clean(event_checks(events))
    merged = merge.merge_events(events, aliases)
    rows = {r.event_id: r for r in merged.events.collect()}
    assert set(rows) == {DIGEST(1), DIGEST(2), DIGEST(30)}
    assert (rows[DIGEST(2)].project, rows[DIGEST(2)].activity, rows[DIGEST(2)].devices) == ("Site", "Coding", ["mac", "old", "pc"])
    audit = {r.stage: r for r in merge.token_audit(merged).collect()}
    assert (audit["input"].tokens, audit["exact removed"].calls, audit["output"].tokens) == (32, 1, 24)
    summary = {r.device: r.retained_events for r in merge.device_summary(merged).collect()}
    assert summary == {"mac": 2, "pc": 2}
    assert merge.merged_cutoffs(heads).first().cutoff_seconds == 100
    assert merge.merged_records(merged.events, "Asia/Shanghai").count() == 3


def test_unlike_devices_are_reported(spark, tmp_path):
    paths = {
        "a": write(tmp_path, "a.json", ledger(event(1, input=6))),
        "b": write(tmp_path, "b.json", ledger(event(2), zone="UTC", reliable=False)),
    }
    ledgers = devices.read_device_ledgers(spark, paths)
    found = {r.check for r in device_checks(devices.ledger_heads(ledgers)).collect()}
    assert found == {"device-timezone", "device-reliable"}
    assert [r.check for r in devices.spelling_checks(ledgers).collect()] == ["event-fresh_input-spelling"]
    with pytest.raises(ValueError):
        devices.read_device_ledgers(spark, {" ": paths["a"]})


def test_export_from_file(spark, tmp_path):
    body = {
        "schema": "codeburn.export.v2",
        "summary": [{"Cost (USD)": 1.5, "API Calls": 2, "Sessions": 1, "Projects": 1}],
        "periods": [{"label": "all", "daily": [{"Date": "2024-05-01", "Cost (USD)": 1.5, "API Calls": 2}], "models": [], "activity": []}],
        "records": [{"project": " p ", "sessionId": "x", "timestamp": "2024-05-01T00:00:00Z", "model": "", "inputTokens": 3, "outputTokens": 1, "cost": 1.5}],
        "sessions": [], "projects": [{"Project": "p", "Cost (USD)": 1.5, "API Calls": 2, "Sessions": 1}],
    }
    made = exports.read_exports(spark, write(tmp_path, "export.json", body))
    require_clean(exports.export_checks(made))
    row = exports.export_records(made).first()
    assert (row.project, row.model, row.tokens, float(row.cost), row.reasoning) == ("p", None, 4, 1.5, 0)
    assert exports.export_days(made).first().calls == 2 and exports.export_projects(made).count() == 1
    assert exports.export_summary(made).first().total_calls == 2
    broken = exports.read_exports(spark, write(tmp_path, "broken.json", {"schema": "other"}))
    assert {r.check for r in exports.export_checks(broken).collect()} == {"export-schema", "export-records", "export-days"}
