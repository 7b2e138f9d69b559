"""Order summaries, selection, and keys without a value, against plain Python."""

import datetime
import random

import pytest

from meterbook.operators import quality, ranking
from meterbook.operators.projects import device_project_labels, resolve_projects
from meterbook.plans import report


def days(*numbers):
    return [None if n is None else datetime.date(2024, 1, 1) + datetime.timedelta(days=n) for n in numbers]


def steps(dates):
    return sum(a is not None and b is not None and b <= a for a, b in zip(dates, dates[1:], strict=False))


@pytest.mark.parametrize("hot", [False, True])
def test_strict_order_over_blocks(spark, hot):
    rng = random.Random(3)
    rows = [("hot" if hot else rng.choice(["a", "b", None]), i, d) for i, d in enumerate(days(*(rng.choice([i, i, i - 3, None]) for i in range(900))))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "account string, pos int, date date").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small blocks stay apart
    blocks = quality.order_blocks(df, "date", ["account"])
    assert blocks.select("_block").distinct().count() > 1
    merged = {r.account: r for r in quality.merged_order(quality.block_order(blocks, "date", ["account"]), ["account"]).collect()}
    found = quality.strictly_ordered(df, "date", ["account"]).groupBy("key").count().collect()
    total = 0
    for name in {r[0] for r in rows}:
        own = [r[2] for r in sorted((r for r in rows if r[0] == name), key=lambda r: r[1])]
        assert (merged[name].rows, merged[name].first, merged[name].last, merged[name].broken) == (len(own), own[0], own[-1], steps(own))
        total += steps(own)
    assert sum(r["count"] for r in found) == total > 0
    assert quality.strictly_ordered(df.limit(0), "date", ["account"]).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quantiles_by_selection(spark):
    rng = random.Random(5)
    rows = [("x", rng.choice([0.0, 0.01, -3.5, 1e7, round(rng.random() * 1e6, 2)])) for _ in range(700)] + [("one", 2.5), (None, 7.0), (None, 9.0), ("none", None), ("same", 4.0), ("same", 4.0)]
    got = {r.k: tuple(r)[1:] for r in ranking.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.0, 0.3, 0.5, 0.99, 1.0], ["k"]).collect()}
    for name in ("x", "one", None, "same"):
        own = sorted(v for k, v in rows if k == name and v is not None)
        for p, value in zip([0.0, 0.3, 0.5, 0.99, 1.0], got[name], strict=True):
            at = (len(own) - 1) * p
            low = own[int(at)]
            assert value == pytest.approx(low + (own[min(int(at) + 1, len(own) - 1)] - low) * (at - int(at)), rel=1e-9, abs=1e-9), (name, p)
    assert "none" not in got
    whole = ranking.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", [0.5])
    assert len(whole.collect()) == 1
    assert ranking.exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().p50 is None


def test_an_account_without_a_name_keeps_its_aliases(spark):
    items = [(a, "A", "/p/one", "f" * 64) for a in (None, "t")] + [(a, "B", "/p/two", None) for a in (None, "t")]
    schema = "account string, device string, project string, fingerprint string"
    rows = spark.createDataFrame(items, schema)
    aliases = spark.createDataFrame([(None, "A", "/p/one", "Alias"), ("t", "A", "/p/one", "Alias")], "account string, device string, project string, alias string")
    labels = {(r.account, r.device): (r.label, r["rank"]) for r in device_project_labels(rows, aliases, ["account"]).collect()}
    assert labels[None, "A"] == labels["t", "A"] == ("Alias", 3) and labels[None, "B"] == labels["t", "B"]
    plain = {(r.account, r.device): r.project for r in resolve_projects(rows, None, ["account"]).collect()}
    assert plain[None, "A"] == plain["t", "A"] and plain[None, "B"] == plain["t", "B"]


def test_cells_of_a_report_add_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), datetime.date(2024, 1, rng.randint(1, 9)), rng.randrange(24), rng.choice(["Mon", "Tue"]), rng.choice(["p", "q", None]),
             rng.choice(["m", None]), rng.choice(["x", "y"]), 1, *(rng.randrange(9) for _ in range(4)), float(rng.randrange(5))) for _ in range(300)]
    names = "account string, date date, hour int, weekday string, project string, model string, activity string, calls bigint, fresh_input bigint, cache_read bigint, cache_write bigint, output bigint, cost double"
    facts = spark.createDataFrame(rows, names)
    cells = report.ReportCells(facts, ["account"])
    for name, keys in report.ReportCells.SETS.items():
        got = {tuple(r[k] for k in ["account", *keys]): (r.calls, r.output, r.cost) for r in cells.slice(name).collect()}
        want = {}
        for r in facts.collect():
            key = tuple(r[k] for k in ["account", *keys])
            want[key] = tuple(x + y for x, y in zip(want.get(key, (0, 0, 0.0)), (r.calls, r.output, r.cost), strict=True))
        assert got == want
