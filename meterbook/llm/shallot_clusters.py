"""Exact k-means over integer vectors by Shallot search.

Components become integers, so all distances that decide are exact and the
result does not depend on how rows are dealt.  Between rounds every vector
remembers its nearest and second-nearest centroid, an upper bound of the
distance to the first and a lower bound of the distance to any other.  When
centroids have moved, the bounds are loosened by how far, and

* a vector whose upper bound stays below its lower bound, or below half the way
  from its centroid to the next centroid, keeps it unseen;
* otherwise both remembered centroids are measured and the scan starts from the
  closer one.  The other centroids come in ascending distance from that one; a
  centroid further from it than the vector's distance to it plus the distance
  to the second-nearest so far cannot matter, and as better ones are found
  that ball shrinks until the rest of the sorted list lies outside;
* what is left is compared by squared integer distance, ties to the smaller
  number.  Bounds are floating point, widened beyond their rounding, and are
  only used to leave out.

Vectors and their bounds are packed in blocks, one row each.  A round is one
pass over the blocks; it writes them with one sum per centroid and block, which
Spark adds up.  Only ``k`` centroids and ``k * (size + 1)`` sums meet the driver.

Defined results: vectors that are null, of another length or hold a null or
non-finite component are left out; vectors with a component of 131072 or more
have no squared distance in a long: they come back with null cluster and
distance and take no part; repeated rows count each; null ids are kept and come
last among the first centroids, ties of the ids' hash go by components; with
fewer vectors than ``k`` there are as many centroids as vectors; other columns
are not read, whatever their names; a table without vectors gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import drop_written, map_batches, written

SIZE = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Below this a squared distance of 64 components fits a long.
LARGEST = 1 << 27
#: Bounds are widened by this share, far more than the rounding of a root and a few sums.
SLACK = 1e-9
_STATE = np.dtype([("near", "<i4"), ("next", "<i4"), ("upper", "<f8"), ("lower", "<f8")])


@dataclass
class Centroids:
    """Centroids, their distances from each other and how far they moved in the last step."""

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.at)
        apart = np.array([squared(self.at, c) for c in self.at], np.float64).reshape(k, k)
        self.apart = np.sqrt(apart)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        others = self.apart + np.diag(np.full(k, np.inf))
        self.half = others.min(axis=1, initial=np.inf) / 2
        # the furthest move among the others of each centroid
        self.others_moved = np.array([np.delete(self.moved, i).max(initial=0.0) for i in range(k)])


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances, as longs."""
    away = vectors.astype(np.int64) - centre
    return np.einsum("ij,ij->i", away, away)


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def fresh(n: int) -> np.ndarray:
    """Bounds of vectors that have not been measured."""
    state = np.zeros(n, _STATE)
    state["next"], state["upper"] = 1, np.inf
    return state


def search(vectors: np.ndarray, state: np.ndarray, now: Centroids) -> int:
    """Bring ``state`` up to date with the centroids; returns how many distances were measured."""
    k = len(now.at)
    if k == 1:
        state["near"] = 0
        return 0
    state["upper"] = _up(state["upper"] + now.moved[state["near"]])
    state["lower"] = _down(np.maximum(state["lower"] - now.others_moved[state["near"]], 0))

    def open_rows(rows: np.ndarray) -> np.ndarray:
        own = state[rows]
        return rows[own["upper"] >= _down(np.maximum(own["lower"], now.half[own["near"]]))]

    rows, measured = open_rows(np.arange(len(vectors))), 0
    first = np.empty(len(vectors), np.int64)
    for c in range(k):  # tighten the upper bound first
        mine = rows[state["near"][rows] == c]
        first[mine] = squared(vectors[mine], now.at[c])
        measured += len(mine)
    state["upper"][rows] = _up(np.sqrt(first[rows]))
    rows = open_rows(rows)
    second = np.empty(len(vectors), np.int64)
    for c in range(k):
        mine = rows[state["next"][rows] == c]
        second[mine] = squared(vectors[mine], now.at[c])
        measured += len(mine)
    near, after = state["near"].copy(), state["next"].copy()
    turned = rows[_less(second[rows], after[rows], first[rows], near[rows])]
    near[turned], after[turned] = after[turned], near[turned]
    first[turned], second[turned] = second[turned], first[turned]
    begun = near.copy()
    for c in range(k):
        mine = rows[begun[rows] == c]
        from_c = np.sqrt(first[mine])  # the ball is drawn around the centroid the scan began at
        for other in now.order[c]:
            if other == c:
                continue
            inside = now.apart[c, other] <= _up(from_c + np.sqrt(second[mine]))
            if not inside.any():
                break  # all further ones lie outside as well
            seen = mine[inside & (after[mine] != other) & (near[mine] != other)]
            far = squared(vectors[seen], now.at[other])
            measured += len(seen)
            best = _less(far, other, first[seen], near[seen])
            better = ~best & (far < second[seen])
            won, placed = seen[best], seen[better]
            second[won], after[won] = first[won], near[won]
            first[won], near[won] = far[best], other
            second[placed], after[placed] = far[better], other
    state["near"], state["next"] = near, after
    state["upper"][rows] = _up(np.sqrt(first[rows]))
    state["lower"][rows] = _down(np.sqrt(second[rows]))
    return measured


def _less(a: np.ndarray, a_number: np.ndarray | int, b: np.ndarray, b_number: np.ndarray) -> np.ndarray:
    return (a < b) | ((a == b) & (a_number < b_number))


def _vector(name: str) -> Column:
    """The integer components of a usable vector, else null."""
    raw = F.col(name).cast("array<double>")
    usable = (F.size(raw) == SIZE) & F.forall(raw, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.when(usable, raw)


def _blocks(rows: DataFrame) -> DataFrame:
    """Written rows (ids, vectors, state) of many vectors each."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            vectors = np.floor(values * SCALE).astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([vectors.tobytes()]), pa.array([fresh(batch.num_rows).tobytes()])], ["ids", "vectors", "state"])

    return written(map_batches(rows, work, f"ids array<{kind}>, vectors binary, state binary"), "vectors")


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["vectors"], "<i4").reshape(-1, SIZE), np.frombuffer(row["state"], _STATE).copy()


def _assigned(blocks: DataFrame, now: Centroids, name: str) -> DataFrame:
    """The written blocks after a search, with the sum and number of the vectors of each centroid."""
    schema = blocks.select("ids", "vectors", "state").schema.simpleString()[7:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors_of, states, sums, measured = batch.column(1), [], [], []
            for row in batch.select(["vectors", "state"]).to_pylist():
                vectors, state = _unpack(row)
                measured.append(search(vectors, state, now))
                parts = [vectors[state["near"] == c] for c in range(len(now.at))]
                sums.append(np.concatenate([np.append(p.sum(axis=0, dtype=np.int64), len(p)) for p in parts]))
                states.append(state.tobytes())
            columns = [batch.column(0), vectors_of, pa.array(states, pa.binary()), pa.array(sums, pa.list_(pa.int64())), pa.array(measured, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "vectors", "state", "sums", "measured"])

    done = map_batches(blocks.select("ids", "vectors", "state"), work, f"{schema}, sums array<bigint>, measured bigint")
    return written(done, name)


def _moved(blocks: DataFrame, now: Centroids) -> Centroids:
    """Centroids at the floor of the mean of their vectors; those without vectors stay."""
    added = blocks.select(F.posexplode("sums").alias("place", "part")).groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    totals = {r.place: int(r.total) for r in added.collect()}  # k * (SIZE + 1) numbers
    width = SIZE + 1
    at = now.at.copy()
    for c in range(len(at)):
        if n := totals.get(c * width + SIZE):
            at[c] = [totals[c * width + i] // n for i in range(SIZE)]
    away = np.array([squared(at[c : c + 1], now.at[c])[0] for c in range(len(at))], np.float64)
    return Centroids(at, _up(np.sqrt(away)))


def first_centroids(usable: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    drawn = usable.select(name.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.floor(np.array(r.v) * SCALE) for r in drawn], np.int64).reshape(-1, SIZE)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one for each usable vector."""
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{id_col}`").alias("id"), _vector(f"`{vector_col}`").alias("v")).where(F.col("v").isNotNull())
    kind = own.schema["id"].dataType.simpleString()
    small = F.forall("v", lambda x: F.abs(x) < LARGEST / SCALE)
    usable = own.where(small)
    start = first_centroids(usable, k, seed)
    blocks = _blocks(usable)
    now = Centroids(start, np.zeros(len(start)))
    if len(start):
        for round_ in range(rounds + 1):
            after = _assigned(blocks, now, f"round-{round_}")
            drop_written(blocks)
            blocks = after
            if round_ < rounds:
                now = _moved(blocks, now)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["vectors", "state"]).to_pylist()):
                vectors, state = _unpack(row)
                away = np.empty(len(vectors), np.int64)
                for c in range(len(now.at)):
                    mine = state["near"] == c
                    away[mine] = squared(vectors[mine], now.at[c])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(state["near"].astype(np.int32)), pa.array(away)], ["id", "cluster", "distance"])

    named = written(map_batches(blocks.select("ids", "vectors", "state"), work, f"id {kind}, cluster int, distance bigint"), "clusters")
    drop_written(blocks)
    parts = named.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    total = sum(int(r.d) for r in parts)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now.at]
    facts = spark.createDataFrame([(r.cluster, int(r.d), total, digests[r.cluster]) for r in parts], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = named.join(F.broadcast(facts), "cluster")  # k rows
    wide = own.where(~small).select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"))])
    wide = wide.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    return out.select(*wide.columns).unionByName(wide).withColumnRenamed("id", id_col)


SQL = f"""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
seeds AS (
  SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {CLUSTERS}),
rounds(r, c) AS (
  SELECT 0, (SELECT list(v ORDER BY h, v) FROM seeds)
  UNION ALL
  SELECT r + 1, (
    WITH near AS (
      SELECT v, list_position(d, list_min(d)) AS j
      FROM (SELECT v, list_transform(c, lambda m: list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM kept)),
    parts AS (SELECT v, j, unnest(range(1, {SIZE + 1})) AS i FROM near),
    sums AS (SELECT j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM parts GROUP BY j, i),
    means AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums GROUP BY j)
    SELECT list(coalesce(m, c[k]) ORDER BY k) FROM (SELECT unnest(range(1, len(c) + 1)) AS k) LEFT JOIN means ON j = k)
  FROM rounds WHERE r < {ROUNDS}),
named AS (
  SELECT vec_id, list_position(d, list_min(d)) AS j, CAST(list_min(d) AS BIGINT) AS distance, c
  FROM (SELECT vec_id, c, list_transform(c, lambda m: list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d
        FROM kept, rounds WHERE r = {ROUNDS}))
SELECT vec_id, CAST(j - 1 AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c[j], ',')) AS centroid_sha256
FROM named
"""
