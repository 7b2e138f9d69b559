"""Shards: groups stay whole, sums are near equal, slots have no gaps."""

import heapq
import random
import zlib

from meterbook.llm import kk_sharding as op

SCHEMA = "doc_id bigint, text string, shard string, size string"


def corpus(n, hot=0):
    rng = random.Random(n)
    texts = [None, None, "", "é", "é"] + ["".join(rng.choices("abü ", k=rng.randint(1, 400))) for _ in range(n)]
    texts += [texts[rng.randrange(len(texts))] for _ in range(n // 4)] + ["hot " * 20] * hot
    return [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "x", "", ""), (3, "é", "", "")]


def check(rows, got):
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sums, home = {}, [0] * 8, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        sums[r.shard] += r.size
        home.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in home.values())
    assert (max(sums) - min(sums)) * 1000 <= sum(sums) / 8, sums  # a thousandth of a shard


def test_one_bucket(spark):
    rows = corpus(500)
    check(rows, op.shard_rows(spark.createDataFrame(rows, SCHEMA)).collect())


def test_many_buckets_and_a_hot_group(spark):
    rows = corpus(3000, hot=400)  # the hot group is below one shard's part and is levelled out by the others
    old, op.LARGE_PARTS = op.LARGE_PARTS, 64
    try:
        check(rows, op.shard_rows(spark.createDataFrame(rows, SCHEMA), bucket_groups=300).collect())
    finally:
        op.LARGE_PARTS = old


def test_difference_is_exact_where_known():
    # the textbook case: 8 7 6 5 4 in two parts differ by 2 under differencing
    shard = op._partition([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], shard, strict=True) if p == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2


def plain(sizes, shards):
    """Karmarkar-Karp by the book: sums only, the two tuples of largest spread put together in opposite order."""
    heap = [(-s, i, [s] + [0] * (shards - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x + y for x, y in zip(a, sorted(b), strict=True)), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], number, both))
        number += 1
    return sorted(heap[0][2])


def test_same_sums_as_plain_differencing():
    rng = random.Random(4)
    for shards in (2, 3, 8):
        for n in (1, 5, 40, 300):
            sizes = rng.sample(range(1, 10**12), n)  # no ties, which could be broken either way
            shard = op._partition(sorted(sizes, reverse=True), shards)
            sums = [0] * shards
            for size, k in zip(sorted(sizes, reverse=True), shard, strict=True):
                sums[k] += size
            assert [s - min(sums) for s in sorted(sums)] == [s - plain(sizes, shards)[0] for s in plain(sizes, shards)], (shards, n)


def test_slots_of_a_hot_group_have_no_gaps(spark):
    rows = [(i, "hot", "", "") for i in range(900)] + [(1000 + i, f"t{i}", "", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    check_slots = {}
    for r in op.shard_rows(docs).collect():
        check_slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in check_slots.values())


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.createDataFrame(corpus(50), SCHEMA)
    op.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.schema(docs.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_table(spark):
    assert op.shard_rows(spark.createDataFrame([], SCHEMA)).collect() == []
