import random

import pytest
from pyspark.sql import functions as F

from helpers import BASE, INC, event, events
from meterbook.operators import dedup
from meterbook.operators.projects import conflicting_fingerprints, device_project_labels
from meterbook.operators.quality import QualityError, core_conflicts, require_clean
from meterbook.plans import merge

P1, P2 = "a" * 64, "b" * 64


def statuses(spark, rows):
    found = dedup.near_time_matches(events(spark, rows)).collect()
    pairs = {(r.baseline_id, r.increment_id) for r in found if r.status == "pair"}
    return pairs, sum(r.events for r in found if r.status == "ambiguous")


@pytest.mark.parametrize(
    "gap, expected",
    [(0, "pair"), (1500, "pair"), (-1500, "pair"), (1501, "ambiguous"), (10_000, "ambiguous"), (10_001, "apart"), (-10_001, "apart")],
)
def test_pair_bounds(spark, gap, expected):
    pairs, ambiguous = statuses(spark, [event("b", 50_000), event("i", 50_000 + gap, INC)])
    assert (pairs, ambiguous) == {"pair": ({("b", "i")}, 0), "ambiguous": (set(), 2), "apart": (set(), 0)}[expected]


def test_different_tokens_and_two_candidates_are_ambiguous(spark):
    assert statuses(spark, [event("b"), event("i", 10, INC, tokens=(11, 0, 0, 1))]) == (set(), 2)
    assert statuses(spark, [event("b"), event("i", 100, INC), event("j", 9_000, INC)]) == (set(), 3)


def test_missing_session_and_model_match_each_other_only(spark):
    rows = [event("b", session=None, model=None), event("i", 900, INC, session=None, model=None), event("c", session=None), event("j", 900, INC)]
    assert statuses(spark, rows) == ({("b", "i")}, 0)


def brute(rows):
    """All pairs, the slow way: (pairs, ambiguous events)."""

    def near(e):
        return [o for o in rows if o[5] != e[5] and o[6:8] == e[6:8] and abs((o[4] - e[4]).total_seconds()) <= 10]

    pairs, ambiguous = set(), 0
    for e in rows:
        n = near(e)
        if not n:
            continue
        c = n[0]
        strict = len(n) == 1 and abs((c[4] - e[4]).total_seconds()) <= 1.5 and c[13:] == e[13:] and near(c) == [e]
        if strict:
            pairs.add((e[3], c[3]) if e[5] == BASE else (c[3], e[3]))
        else:
            ambiguous += 1
    return pairs, ambiguous


@pytest.mark.parametrize("seed", range(4))
def test_near_time_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        # a third of all rows in one hot session and model, many of them in the same milliseconds
        hot = i % 3 == 0
        rows.append(
            event(
                f"e{i:03d}",
                rng.choice([0, 0, 500, 1400, 9_999, 10_000, 10_001, 25_000]) if hot else rng.randrange(0, 400_000, 250),
                rng.choice([BASE, INC]),
                session="hot" if hot else rng.choice(["s", None]),
                tokens=(rng.choice([10, 10, 11]), 0, 0, 1),
            )
        )
    assert statuses(spark, rows) == brute(rows)


def test_hot_instant_is_counted_not_paired(spark):
    """Thousands of copies in one millisecond: the plan keeps one point per source."""
    base = spark.range(4000).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("event_id"), F.lit(BASE).alias("source"))
    inc = spark.range(4000).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("event_id"), F.lit(INC).alias("source"))
    template = events(spark, [event("x")]).drop("event_id", "source")
    rows = base.unionByName(inc).crossJoin(template)
    found = dedup.near_time_matches(rows).collect()
    assert [(r.status, r.events) for r in found] == [("ambiguous", 4000)] * 2


def test_pair_takes_numbers_from_the_baseline_and_labels_from_both(spark):
    rows = [
        event("b", 0, BASE, activity="Coding", cost="2.5"),
        event("i", 700, INC, project="/w/site", fingerprint=P1, cost="9"),
        event("z", 90_000, INC, project="/w/other"),
    ]
    out = {r.event_id: r for r in merge.merge_events(events(spark, rows)).events.collect()}
    assert set(out) == {"b", "z"}
    assert (out["b"].source, float(out["b"].cost), out["b"].project, out["b"].activity) == (BASE, 2.5, "site", "Coding")
    assert out["b"].sources == [BASE, INC] and out["b"].source_event_ids == ["b", "i"]
    assert out["z"].project == "other · A"


def test_exact_copies_merge_labels_and_provenance(spark):
    rows = [
        event("e", project="/w/site", device="A", order=1),
        event("e", activity="Coding", device="B", order=2),
        event("e", project="/w/site2", activity="历史未归类", device="C", order=3),
    ]
    row = merge.merge_events(events(spark, rows)).distinct.collect()[0]
    # A and C have a project and the same score: the order of devices decides; the activity comes from B
    assert (row.project, row.activity, row.device, row.copies, row.devices) == ("site · A", "Coding", "A", 3, ["A", "B", "C"])
    assert not row.conflicting


def test_many_copies_of_one_id(spark):
    """A third of all rows is one id; it is combined before the shuffle."""
    rows = spark.range(3000).select(F.col("id").alias("input_order"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"))
    template = events(spark, [event("x")]).drop("event_id", "input_order")
    merged = merge.merge_events(rows.crossJoin(template)).distinct
    assert merged.count() == 2001
    assert merged.where("event_id = 'hot'").first().copies == 1000


def test_conflicting_copies_are_reported(spark):
    rows = [event("e", device="A"), event("e", device="B", cost="2")]
    distinct = merge.merge_events(events(spark, rows)).distinct
    with pytest.raises(QualityError, match="event-core-conflict"):
        require_clean(core_conflicts(distinct))


def test_labels_of_shared_names_and_fingerprints(spark):
    rows = [
        event("1", project="/a/site", fingerprint=P1, device="A"),
        event("2", project="C:\\b\\site", fingerprint=P2, device="B"),
        event("3", project="/a/api", fingerprint="c" * 64, device="A"),
        event("4", project="/b/api-old", fingerprint="c" * 64, device="B"),
        event("5", project="/a/solo", fingerprint="d" * 64, device="A"),
        event("6", project=None, fingerprint="d" * 64, device="B"),
        event("7", project="历史未归属 · x", device="B"),
    ]
    aliases = spark.createDataFrame([("A", "/a/solo", "Solo Project")], "device string, project string, alias string")
    got = {(r.device, r.raw_project): (r.label, r.rank) for r in device_project_labels(events(spark, rows), aliases).collect()}
    assert got == {
        ("A", "/a/site"): ("site · aaaaaa", 2),
        ("B", "C:\\b\\site"): ("site · bbbbbb", 2),
        ("A", "/a/api"): ("api · cccccc", 2),
        ("B", "/b/api-old"): ("api · cccccc", 2),
        ("A", "/a/solo"): ("Solo Project", 3),
        ("B", None): ("Solo Project", 3),
        ("B", "历史未归属 · x"): ("历史未归属 · B", 0),
    }


def test_two_aliases_for_one_fingerprint(spark):
    rows = [event("1", project="/a", fingerprint=P1, device="A"), event("2", project="/b", fingerprint=P1, device="B")]
    aliases = spark.createDataFrame([("A", "/a", "One"), ("B", "/b", "Two")], "device string, project string, alias string")
    assert conflicting_fingerprints(events(spark, rows), aliases).first().aliases == 2


@pytest.mark.parametrize("seed", range(3))
def test_multiset_merge_keeps_the_largest_multiplicity(spark, seed):
    rng = random.Random(seed)
    rows = []
    for order in range(240):
        rows.append(
            event("e", 0 if order % 3 else rng.randrange(3) * 1000, device=rng.choice("AAB"), order=order, project=rng.choice([None, "/w/p", "/w/q"]),
                  activity=rng.choice([None, "Coding"]))
        )
    frame = events(spark, rows).drop("event_id")
    got = dedup.multiset_merge(merge.resolve_projects(frame), block=8).groupBy("ts").count().collect()
    want = {}
    for row in rows:
        for device in "AB":
            n = sum(1 for r in rows if r[4] == row[4] and r[0] == device)
            want[row[4]] = max(want.get(row[4], 0), n)
    assert {r.ts: r["count"] for r in got} == want


def test_merge_keeps_accounts_apart(spark):
    rows = events(spark, [event("e"), event("f", 500, INC)]).crossJoin(spark.createDataFrame([("x",), ("y",)], "account string"))
    out = merge.merge_events(rows, by=["account"]).events.select("account", "event_id", "sources").collect()
    assert sorted((r.account, r.event_id) for r in out) == [("x", "e"), ("y", "e")]


def test_blocks_of_any_length_give_the_same_matches(spark, monkeypatch):
    """Times at the ends of blocks, whose neighbours lie in the next one."""
    rng = random.Random(9)
    ends = [b * 10_000 * n for n in (1, 3, 32) for b in (0, 1, 2, 5)]
    rows = [event(f"e{i}", rng.choice(ends) + rng.choice([-10_001, -10_000, -1500, -1, 0, 1, 1500, 9_999, 10_000]), rng.choice([BASE, INC])) for i in range(120)]
    want = brute(events(spark, rows).collect())
    for windows in (1, 3, 32):
        monkeypatch.setattr(dedup, "BLOCK_WINDOWS", windows)
        assert statuses(spark, rows) == want


def test_points_travel_to_more_than_one_block_only_near_its_ends(spark):
    """Of points spread over time few are in two blocks; each was in three."""
    spread = spark.range(20_000).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"), F.timestamp_millis(F.col("id") * 997).cast("timestamp_ntz").alias("ts"), F.lit("s").alias("session"),
        F.lit("m").alias("model"), F.lit(BASE).alias("source"), *[F.lit(1).cast("bigint").alias(c) for c in dedup.COMPONENTS],
    )
    plan = dedup.near_time_matches(spread)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(" in plan
    windows = dedup.fixed.CANDIDATE_WINDOW_MS
    length = dedup.BLOCK_WINDOWS * windows
    assert sum((ms + windows) // length - (ms - windows) // length + 1 for ms in range(0, 20_000 * 997, 997)) < 1.2 * 20_000


def test_items_are_not_shuffled_to_meet_their_labels(spark):
    from meterbook.operators.projects import resolve_projects

    plan = resolve_projects(events(spark, [event("a"), event("b", 10)]))._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_shared_tables_of_a_merge_are_compressed_files(spark):
    merged = merge.merge_events(events(spark, [event("b"), event("i", 900, INC)]))
    assert all(f.endswith(".parquet") for df in (merged.distinct, merged.matches) for f in df.inputFiles())
    assert merged.distinct.inputFiles() and merged.matches.inputFiles() and merged.events.count() == 1
