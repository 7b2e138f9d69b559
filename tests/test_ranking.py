import random

from pyspark.sql import functions as F

from meterbook.operators.ranking import occurrence_number, ordered_positions, rank_quantiles, small_quantiles


def test_positions_and_running_sums_match_a_plain_sort(spark):
    rng = random.Random(7)
    # one account holds a third of the rows, one value half of them
    rows = [(rng.choice("abbb" + "c" * 2), 5 if i % 2 else rng.randrange(50), f"k{i:04d}") for i in range(900)]
    frame = spark.createDataFrame(rows, "account string, v bigint, k string").repartition(7)
    got = {
        (r.account, r.k): (r.rank, r.run)
        for r in ordered_positions(frame, [F.desc("v"), F.asc("k")], ["account"], sums={"run": "v"}).collect()
    }
    want = {}
    for account in "abc":
        total = 0
        for n, (a, v, k) in enumerate(sorted((r for r in rows if r[0] == account), key=lambda r: (-r[1], r[2])), 1):
            total += v
            want[(a, k)] = (n, total)
    assert got == want


def test_positions_of_the_whole_table(spark):
    frame = spark.range(1000).select((F.col("id") % 10).alias("v"), F.col("id").alias("k")).repartition(5)
    rows = ordered_positions(frame, [F.desc("v"), F.asc("k")]).collect()
    assert sorted(r.rank for r in rows) == list(range(1, 1001))
    assert [r.k for r in sorted(rows, key=lambda r: r.rank)][:3] == [9, 19, 29]


def test_rank_quantiles_equal_the_interpolating_aggregate(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([(rng.randrange(300), i) for i in range(257)], "v bigint, k bigint")
    ranked = ordered_positions(frame, [F.desc("v"), F.asc("k")])
    a = rank_quantiles(ranked, "v", [0.5, 0.95]).first()
    b = small_quantiles(frame, "v", [0.5, 0.95]).first()
    assert abs(a.p50 - b.p50) < 1e-9 and abs(a.p95 - b.p95) < 1e-9


def test_occurrence_over_blocks(spark):
    # key "hot" spans many blocks, key "b" two, the rest one
    rows = [("hot", 3 * i) for i in range(200)] + [("b", 5), ("b", 500)] + [(f"x{i}", i) for i in range(20)]
    frame = spark.createDataFrame(rows, "k string, o bigint").repartition(4)
    got = {(r.k, r.o): r.n for r in occurrence_number(frame, "k", "o", block=16, name="n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, o in enumerate(sorted(o for kk, o in rows if kk == k)):
            want[(k, o)] = n
    assert got == want
