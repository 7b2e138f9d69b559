"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows with equal text form a group that goes to one shard.  A *partial
partition* is a tuple of one sum per shard.  Differencing repeatedly takes the
two partial partitions with the largest spread and adds them in opposite order
(the largest sum of one to the smallest of the other); what was put together
is unwound at the end.

It runs in two levels, so that no task and no driver holds all groups:

1. Groups of at least 1/8192 of all bytes, of which there are 8192 at most,
   are differenced first.  The rest is dealt by hash into buckets of bounded
   size; each bucket is differenced in its own task, beginning with its share
   of the large groups' tuple, so that small groups level out large ones.
2. The tuple of the large groups and one tuple per bucket are differenced
   again, which orders the buckets' shards against each other.

Defined results: null text has no bytes and crc 0 and goes with the empty
texts, which are one group; repeated rows each count and get a slot of their own; a null id keeps its row; other columns are not read, whatever their
names; a table without rows gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterbook.llm.common import prepare, written

SHARDS = 8
LARGE_PARTS = 8192
BUCKET_GROUPS = 50_000


def difference(tuples: Sequence[Sequence[int]]) -> list[list[int]]:
    """For each tuple of sums, the shard that each of its places goes to.

    The heap holds (spread, node); a node is its sums in descending order and
    the two nodes it was made of, with the place each sum came from.
    """
    if not tuples:
        return []
    width = len(tuples[0])
    sums: list[list[int]] = []
    made: list[tuple] = []
    heap: list[tuple[int, int]] = []

    def add(places: list[tuple], left: int | None, right: int | None) -> None:
        places.sort(reverse=True)
        low = places[-1][0]
        sums.append([p[0] - low for p in places])
        made.append((left, right, [p[1] for p in places], [p[2] for p in places]))
        heapq.heappush(heap, (low - places[0][0], len(sums) - 1))

    for values in tuples:
        add([(v, i, 0) for i, v in enumerate(values)], None, None)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = sums[a], sums[b]
        add([(x[i] + y[width - 1 - i], i, width - 1 - i) for i in range(width)], a, b)
        sums[a] = sums[b] = []
    shard_of: list[list[int]] = [[] for _ in made]
    shard_of[-1] = list(range(width))
    for node in range(len(made) - 1, len(tuples) - 1, -1):
        left, right, from_left, from_right = made[node]
        own, one, two = shard_of[node], [0] * width, [0] * width
        for place in range(width):
            one[from_left[place]] = two[from_right[place]] = own[place]
        shard_of[left], shard_of[right], shard_of[node] = one, two, []
    out = []
    for node in range(len(tuples)):
        own = [0] * width
        for place, was in enumerate(made[node][2]):
            own[was] = shard_of[node][place]
        out.append(own)
    return out


def _partition(sizes: Sequence[int], shards: int, start: Sequence[int] | None = None) -> list[int]:
    """Shard of each size; ``start`` is what the shards hold before."""
    rest = [0] * (shards - 1)
    tuples = [[s, *rest] for s in sizes]
    if start is None:
        return [places[0] for places in difference(tuples)]
    found = difference([list(start), *tuples])
    named = {shard: i for i, shard in enumerate(found[0])}
    return [named[places[0]] for places in found[1:]]


def _group_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def assign(groups: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """(group, shard) for a written table (group, bytes)."""
    spark = prepare(groups.sparkSession)
    total, count = groups.agg(F.sum("bytes"), F.count("*")).first()
    large = groups.where(F.col("bytes") * LARGE_PARTS >= (total or 0)).orderBy(F.desc("bytes"), "group").collect()  # 8192 rows at most
    of_large = _partition([r.bytes for r in large], shards)
    held = [0] * shards
    for row, shard in zip(large, of_large, strict=True):
        held[shard] += row.bytes
    # beside the large ones there are fewer groups than this, so a bucket has about bucket_groups of them
    buckets = max(1, -(-(count - len(large)) // bucket_groups))
    small_bytes = max(1, (total or 0) - sum(held))

    def one_bucket(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "group"], ascending=[False, True])
        sizes = group["bytes"].tolist()
        part = sum(sizes)
        shard = _partition(sizes, shards, [h * part // small_bytes for h in held])
        return pd.DataFrame({"group": group["group"], "bytes": group["bytes"], "bucket": key[0], "place": shard})

    small = groups.where(F.col("bytes") * LARGE_PARTS < (total or 0)).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    placed = written(small.groupBy("bucket").applyInPandas(one_bucket, "group string, bytes bigint, bucket int, place int"), "placed")
    sums: dict[int, list[int]] = {}
    for row in placed.groupBy("bucket", "place").agg(F.sum("bytes").alias("bytes")).collect():  # a few numbers per bucket
        sums.setdefault(row.bucket, [0] * shards)[row.place] = row.bytes
    keys = sorted(sums)
    order = difference([held, *(sums[k] for k in keys)])
    moves = [(k, place, shard) for k, places in zip(keys, order[1:], strict=True) for place, shard in enumerate(places)]
    moved = spark.createDataFrame(moves, "bucket int, place int, shard int")
    top = [(row["group"], order[0][shard]) for row, shard in zip(large, of_large, strict=True)]
    return placed.join(moved, ["bucket", "place"]).select("group", "shard").unionByName(spark.createDataFrame(top, "group string, shard int"))


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"),
        _group_key(text).alias("group"),
        # the block of a row is the task that scans it, so a hot group of copies is spread over as many blocks as it has tasks
        F.spark_partition_id().alias("block"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    put = written(rows.join(assign(groups, shards, bucket_groups), "group").select("id", "size", "text_crc32", "shard", "block"), "put")
    counts = put.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("block").alias("o_block"), before.alias("before"))
    own = Window.partitionBy("block", "shard").orderBy("id", "text_crc32", "size")
    numbered = put.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("block") == F.col("o_block"))).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, text_col: str = "text", shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> None:
    """The rows themselves as Parquet, one folder per shard."""
    keyed = docs.withColumn("__group", _group_key(F.col(f"`{text_col}`")))
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1
    groups = written(keyed.groupBy(F.col("__group").alias("group")).agg(F.sum(size).cast("long").alias("bytes")), "groups")
    placed = assign(groups, shards, bucket_groups).toDF("__group", "__shard")
    keyed.join(placed, "__group").drop("__group").write.partitionBy("__shard").parquet(path)
