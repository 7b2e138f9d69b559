"""Near-duplicate groups by SimHash.

Fingerprints are 64-bit SimHashes of word shingles.  Two documents are linked
if their fingerprints differ in at most three bits.  Links are found through a
*segment-popcount embedding*: the 64 bits are cut into 32 segments of two bits
and each segment is mapped to its number of set bits (0, 1, 2).  The Manhattan
distance of two such vectors is never larger than the Hamming distance of the
fingerprints, so it bounds the search:

* a distance of at most three leaves at most one on one of the two halves of
  the vector.  Half vectors are the cells of a grid; the range join looks into
  the own cell and the cells one step up, and so meets every such pair;
* the Manhattan distance over all segments is then compared, and last the
  exact Hamming distance.

Counts are kept in unary (00, 01, 11), so a Manhattan distance is the number
of set bits of an exclusive or and stays in generated code.

Defined results: null and empty texts have fingerprint zero and are linked
like any other; a null id keeps its row, its group takes the smallest id that
is there (null if there is none); repeated rows stay; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import ASCII_LOWER, bitmap_of, by_rows, drop_written, having, in_bitmap, map_batches, release, small_side, split_words, texts_of, written

SEED = 42
MAX_BITS = 3
SHINGLE_WORDS = 3
LOW_BITS = 0x5555555555555555
#: A cell of more fingerprints is compared block by block, by an operator that returns spanning links only.
CELL_BLOCK = 1024
#: ... where a cell holds more than this.
DENSE = 8
_CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as an unsigned integer: a bit is 1 if set in over half the shingle hashes."""
    parts = split_words(text.translate(ASCII_LOWER))
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    # a shingle is a slice of the joined words: from the start of its first to the end of its last
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, count = xxhash.xxh64_intdigest, len(parts) - size + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        to = min(at + _CHUNK, count)
        slices = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in slices), np.uint64, to - at)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, bits), one for each document; bits is the fingerprint as a signed long."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, size) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["id", "bits"])

    return map_batches(own, work, f"id {kind}, bits bigint")


def _unary(bits: Column) -> Column:
    """The popcounts of the two-bit segments, in unary: 00, 01, 11."""
    both = bits.bitwiseAND(F.shiftright(bits, 1)).bitwiseAND(F.lit(LOW_BITS))
    any_ = bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(LOW_BITS))
    return any_.bitwiseOR(F.shiftleft(both, 1))


def _half(counts: Column, half: int) -> Column:
    return F.shiftrightunsigned(counts, 32) if half else counts.bitwiseAND(F.lit(0xFFFFFFFF))


def _cells(prints: DataFrame) -> DataFrame:
    """The two cells of each fingerprint; the key carries the half in its lowest bit."""
    counts = _unary(F.col("bits"))
    cell = F.explode(F.array(*[_half(counts, h) * 2 + h for h in (0, 1)]))
    return prints.select("bits", cell.alias("cell"))


def _probes(cells: DataFrame) -> DataFrame:
    """Own cell (not up) and the cells with one segment counted one higher (up)."""
    ups = []
    for segment in range(16):
        low, high = 2 << (2 * segment), 4 << (2 * segment)  # shifted by the half's bit
        raised = F.when(F.col("cell").bitwiseAND(F.lit(low)) == 0, F.col("cell").bitwiseOR(F.lit(low))).otherwise(
            F.col("cell").bitwiseOR(F.lit(high))
        )
        ups.append(raised)
    near = cells.select("bits", "cell", F.posexplode(F.array(F.col("cell"), *ups)).alias("step", "at"))
    return near.where((F.col("step") == 0) | (F.col("at") != F.col("cell"))).select("bits", F.col("at").alias("cell"), (F.col("step") > 0).alias("up"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE, cell_block: int = CELL_BLOCK) -> DataFrame:
    """Rows (a, b) that connect all distinct fingerprints (bits) within ``max_bits`` (3 at most) of each other.

    Up to ``dense`` fingerprints in a cell every pair is returned; a fuller
    cell is compared in blocks of ``cell_block``, whose links are spanning ones,
    so that no group is larger than two blocks and no dense group is listed
    pair by pair.
    """
    if max_bits > MAX_BITS:
        raise ValueError("two halves bound one step only up to three bits")
    cells = _cells(prints)
    probes = _probes(cells)
    fill = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > dense)
    full = written(fill, "full-cells")
    usual_cells, usual_probes, spanning = cells, probes, None
    if not full.isEmpty():
        full = small_side(full)
        usual_cells = cells.join(full, "cell", "left_anti")
        usual_probes = probes.join(full, "cell", "left_anti")
        spanning = _full_cells(cells, probes, full, max_bits, cell_block)
    # a fingerprint has two cells and up to 34 probes, but Spark sizes them as one row: both are shuffled
    a, b = usual_cells.hint("merge").alias("a"), usual_probes.alias("b")
    near = (
        (F.col("a.cell") == F.col("b.cell"))
        & (F.col("b.up") | (F.col("a.bits") < F.col("b.bits")))
        & (F.bit_count(_unary(F.col("a.bits")).bitwiseXOR(_unary(F.col("b.bits")))) <= max_bits)
        & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= max_bits)
    )
    found = a.join(b, near).select(F.col("a.bits").alias("a"), F.col("b.bits").alias("b"))
    return found if spanning is None else found.unionByName(spanning)


def _full_cells(cells: DataFrame, probes: DataFrame, full: DataFrame, max_bits: int, block: int) -> DataFrame:
    blocks = F.ceil(F.col("n") / block).cast("int")
    base = (
        cells.join(full, "cell")
        .withColumn("i", F.pmod(F.xxhash64("bits"), blocks).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("cell", "i", "j", "bits", F.lit(False).alias("probe"))
    )
    # the probes of a cell come from at most seventeen cells, so their blocks stay bounded too
    other = (
        probes.join(full, "cell")
        .withColumn("j", F.pmod(F.xxhash64("bits"), blocks).cast("int"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("cell", "i", "j", "bits", F.lit(True).alias("probe"))
    )

    def span(group: pd.DataFrame) -> pd.DataFrame:
        left = np.unique(group.loc[~group["probe"], "bits"].to_numpy(np.int64))
        right = np.unique(group.loc[group["probe"], "bits"].to_numpy(np.int64))
        return pd.DataFrame(spanning_links(left, right, max_bits), columns=["a", "b"])

    return base.unionByName(other).groupBy("cell", "i", "j").applyInPandas(span, "a bigint, b bigint")


def spanning_links(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Links that connect what pairs of left and right within ``max_bits`` connect; at most one per value."""
    if not len(left) or not len(right):
        return np.empty((0, 2), np.int64)
    near = np.empty((len(left), len(right)), bool)
    for at in range(0, len(right), 256):
        near[:, at : at + 256] = np.bitwise_count((left[:, None] ^ right[None, at : at + 256]).view(np.uint64)) <= max_bits
    none = np.iinfo(np.int64).max
    rows, names = np.arange(len(left)), np.full(len(right), none)
    rows[~near.any(axis=1)] = none
    while True:
        for j in range(len(right)):
            met = rows[near[:, j]]
            names[j] = met.min() if len(met) else none
        after = rows.copy()
        for i in range(len(left)):
            if rows[i] != none:
                after[i] = names[near[i]].min()
        if (after == rows).all():
            break
        rows = after
    pairs = [(left[r], left[i]) for i, r in enumerate(rows) if r not in (i, none)]
    pairs += [(left[r], right[j]) for j, r in enumerate(names) if r != none and left[r] != right[j]]
    return np.array(pairs, np.int64).reshape(-1, 2)


def components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(bits, component) for every node that has a link; ``nodes`` is (bits, least), a component is the smallest ``least`` of its nodes.

    In each round a node joins its smallest neighbour, if that is smaller than
    itself, and the links are drawn between what has been joined, so only links
    between different groups reach the next round.
    """
    edges = written(_links_between(pairs.select("a", "b")), "links-0")
    joined = None
    for round_ in range(1, max_rounds + 1):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("root"))
        parents = written(parents, f"parents-{round_}")
        for jump in (1, 2):  # towards the root of the chain
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("further"))
            after = written(parents.join(above, "root").select("node", F.col("further").alias("root")), f"parents-{round_}-{jump}")
            drop_written(parents)
            parents = after
        before = joined
        if joined is None:
            joined = parents
        else:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("further"))
            joined = joined.join(above, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        joined = written(joined, f"joined-{round_}")
        if before is not None:
            drop_written(before)
        old = edges
        for side in ("a", "b"):
            edges = edges.join(parents.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
        edges = written(_links_between(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), f"links-{round_}")
        for read in (old, parents):
            drop_written(read)
    else:
        raise RuntimeError("components did not settle")
    if joined is None:
        return nodes.limit(0).select("bits", F.col("least").alias("component"))
    named = written(joined.select(F.col("node").alias("bits"), "root").join(nodes.select("bits", "least"), "bits"), "members")
    drop_written(joined)
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(least, "root").select("bits", "component")


def _links_between(pairs: DataFrame) -> DataFrame:
    """Distinct links, the smaller end first, without links of a node to itself."""
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    dense: int = DENSE, cell_block: int = CELL_BLOCK) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    prints = by_rows(written(fingerprints(docs, id_col, text_col, size), "fingerprints"))
    nodes = written(prints.groupBy("bits").agg(F.min("id").alias("least")), "prints")
    found = links(nodes, dense=dense, cell_block=cell_block)
    merged = nodes.join(components(nodes, found), "bits", "left").select("bits", F.coalesce("component", "least").alias("component"))
    return prints.join(merged, "bits").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


#: The pipeline links texts whose five-word shingles have a Jaccard similarity of at least 4 / 5.
NEAR_WORDS = 5
NEAR_PART, NEAR_WHOLE = 4, 5
#: Of one document in so many the shingles are counted; those seen three times or more come last in the order of prefixes.
#: Any order gives the same links, this one keeps common lines out of the prefixes.
SAMPLED = 32
COMMON_SHINGLES = 50_000
#: Fuller cells compare every text with some of their texts first, ``STAR_CLASSES`` a round, and what that leaves apart in blocks.
STAR_ROUNDS = 2
STAR_CLASSES = 16
#: A prefix is longer than one shared shingle asks for by one in so many shingles, so near copies share that many more.
PREFIX_PART = 16
PRUNE_ROUNDS = 2
#: A cell of up to so many texts lists its pairs.
LISTED = 64
#: Shingles are counted in so many passes, which bounds what a shuffle holds on disk.
PASSES = 4
#: Shingles of one side of a block.
BLOCK_SHINGLES = 1 << 20


def shingle_set(text: bytes, size: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; a shorter text is one shingle."""
    parts = split_words(text.translate(ASCII_LOWER))
    joined = b" ".join(parts)
    if len(parts) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, count = xxhash.xxh64_intdigest, len(parts) - size + 1
    slices = zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in slices), np.uint64, count).view(np.int64))


def prefix_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, the common ones last.

    A set lacks at most a fifth of its shingles in a near copy, so with k more
    than that in the prefixes of both, the prefixes share at least k.
    """
    take = len(shingles) - -(-NEAR_PART * len(shingles) // NEAR_WHOLE) + _least_shared(len(shingles))
    if not len(common):
        return shingles[:take]
    last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
    return np.concatenate((shingles[~last], shingles[last]))[:take]


def _least_shared(size: int | Column) -> int | Column:
    return F.floor(size / PREFIX_PART) + 1 if isinstance(size, Column) else size // PREFIX_PART + 1


def near(shared: np.ndarray | int, left: np.ndarray | int, right: int) -> np.ndarray | bool:
    """Whether sets of these sizes with so many shingles in common have the similarity of near copies."""
    return (NEAR_PART + NEAR_WHOLE) * shared >= NEAR_PART * (left + right)


def _common_shingles(keyed: DataFrame, size: int) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, size) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, np.int64)]))], ["token"])

    some = keyed.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0).select("text")
    counted = map_batches(some, work, "token bigint").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    most = counted.orderBy(F.desc("n"), "token").limit(COMMON_SHINGLES).select("token")
    return np.sort(np.array([r.token for r in most.collect()], np.int64))


def _prefixes(keyed: DataFrame, size: int) -> DataFrame:
    """Written rows (row, digest of the set, its size, prefix, SimHash fingerprint)."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(_common_shingles(keyed, size))  # at most COMMON_SHINGLES longs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            sets = [shingle_set(t, size) for t in texts]
            bits = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary())
            sizes, prefixes = pa.array(list(map(len, sets)), pa.int32()), [prefix_of(s, shared.value) for s in sets]
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, sizes, lists, bits], ["row", "digest", "size", "prefix", "bits"])

    return written(map_batches(keyed.select("row", "text"), work, "row bigint, digest binary, size int, prefix array<bigint>, bits bigint"), "prefixes")


def _sets(keyed: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Written rows (row, shingles) of at least the given rows: a bitmap of fixed size says which, and no text travels."""
    wanted = keyed.sparkSession.sparkContext.broadcast(bitmap_of(rows.select(F.xxhash64("row").alias("h"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(wanted.value, batch.column(2).to_numpy())))
            blobs = pa.array([shingle_set(t, size).tobytes() for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], ["row", "shingles"])

    own = keyed.select("row", "text", F.xxhash64("row").alias("h"))
    return written(map_batches(own, work, "row bigint, shingles binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The written pairs (a, b) whose sets are near."""
    asked = by_rows(written(pairs.select("a", "b").distinct(), f"{name}-asked"))
    sets = having(sets, "row", asked.select(F.explode(F.array("a", "b")).alias("row")))
    both = asked
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("row").alias(side), F.col("shingles").alias(f"of_{side}")), side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            keep = [bool(near(len(np.intersect1d(x, y, True)), len(x), len(y))) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    found = written(map_batches(both.select("a", "b", "of_a", "of_b"), work, "a bigint, b bigint"), name)
    drop_written(asked)
    release(found.sparkSession)
    return found


def near_links(left: list[np.ndarray], right: list[np.ndarray], left_groups: np.ndarray, right_groups: np.ndarray) -> list[tuple[int, int]]:
    """Places (left, right) of near sets; at most one for two groups that are not connected yet, and all groups that near sets connect get connected."""
    names, groups = np.unique(np.concatenate((left_groups, right_groups)), return_inverse=True)
    own, other = groups[: len(left)], groups[len(left) :]
    top = np.arange(len(names))
    sizes = np.array(list(map(len, left)), np.int64)
    tokens, owner = np.concatenate(left), np.repeat(np.arange(len(left)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    found = []
    for j, shingles in enumerate(right):
        least = np.minimum(sizes, len(shingles))
        if not (near(least, sizes, len(shingles)) & (top[own] != top[other[j]])).any():
            continue
        starts, ends = np.searchsorted(tokens, shingles, "left"), np.searchsorted(tokens, shingles, "right")
        met = [owner[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e > s]
        if not met:
            continue
        shared = np.bincount(np.concatenate(met), minlength=len(left))
        for i in np.flatnonzero(near(shared, sizes, len(shingles))).tolist():
            a, b = top[own[i]], top[other[j]]
            if a != b:
                top[top == a] = b
                found.append((i, j))
    return found


def _apart(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Written rows (token, row, size, n, group, main) of the cells that hold texts of several groups; main is the group of most of its texts."""
    named = cells.join(groups, "row", "left").withColumn("group", F.coalesce("group", "row"))
    parts = named.groupBy("token", "group").agg(F.count("*").alias("texts"))
    several = parts.groupBy("token").agg(F.count("*").alias("groups"), F.max_by("group", F.struct("texts", "group")).alias("main")).where("groups > 1")
    return written(named.join(several.select("token", "main"), "token"), "apart")


def _block_links(apart: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between the groups of each cell: all its texts against those outside its main group, block by block."""
    outside = F.col("group") != F.col("main")
    loads = apart.groupBy("token").agg(F.sum("size").alias("all"), F.sum(F.when(outside, F.col("size")).otherwise(0)).alias("out"))
    counts = loads.select("token", *[F.ceil(F.col(c) / block).cast("int").alias(k) for c, k in (("all", "is"), ("out", "js"))])
    dealt = apart.join(counts, "token")

    def deal(rows: DataFrame, own: str, other: str, probe: bool) -> DataFrame:
        mine, their = ("j", "i") if probe else ("i", "j")
        placed = rows.withColumn(mine, F.pmod(F.xxhash64("row"), F.col(own)).cast("int")).withColumn(their, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return placed.select("token", "i", "j", "row", "group", F.lit(probe).alias("probe"))

    both = deal(dealt, "is", "js", False).unionByName(deal(dealt.where(outside), "js", "is", True)).join(having(sets, "row", apart.select("row")), "row")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["probe"] == probe] for probe in (False, True)]
        if not all(map(len, sides)):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        blobs = [[np.frombuffer(x, np.int64) for x in side["shingles"]] for side in sides]
        ids, groups = ([side[c].to_numpy(np.int64) for side in sides] for c in ("row", "group"))
        found = near_links(*blobs, *groups)
        return pd.DataFrame({"a": ids[0][[i for i, _ in found]], "b": ids[1][[j for _, j in found]]}, dtype=np.int64)

    return written(both.groupBy("token", "i", "j").applyInPandas(work, "a bigint, b bigint"), "block-links")


def _shared(tokens: DataFrame, passes: int = 1) -> DataFrame:
    """Written rows (row, size, token, n) of the shingles that n rows share, n two or more.

    Shingles are counted in passes over ranges of their hashes, each freed before the next, and only those that may
    occur again travel with their rows.
    """
    spark = tokens.sparkSession
    part = F.pmod(F.xxhash64("token"), F.lit(passes))
    fills = []
    for i in range(passes):
        own = tokens.where(part == i) if passes > 1 else tokens
        fills.append(written(own.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "fill"))
        release(spark)
    fill = reduce(DataFrame.unionByName, fills)
    again = spark.sparkContext.broadcast(bitmap_of(fill.select("token")))
    kinds = "row bigint, size int, token bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(again.value, batch.column(2).to_numpy())))

    some = map_batches(tokens.select("row", "size", "token"), work, kinds) if passes > 1 else tokens
    # a row for each shingle, which Spark sizes as one for each text: both sides are shuffled
    found = written(some.hint("merge").join(fill, "token"), "shared")
    for read in fills:
        drop_written(read)
    release(spark)
    return found


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Written pairs (a, b) of the rows (row, bits) that SimHash links: the first rows of linked fingerprints, and each other row with the first of its own."""
    nodes = written(prints.groupBy("bits").agg(F.min("row").alias("first")), "prints")
    firsts = by_rows(nodes)
    same = prints.join(firsts, "bits").where(F.col("row") != F.col("first")).select(F.col("first").alias("a"), F.col("row").alias("b"))
    found = links(nodes.select("bits"))
    for side in ("a", "b"):
        found = found.join(firsts.select(F.col("bits").alias(side), F.col("first").alias(f"first_{side}")), side)
    met = found.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    pairs = written(same.unionByName(met).distinct(), "fingerprint-pairs")
    drop_written(nodes)
    return pairs


def near_copy_links(keyed: DataFrame, tokens: DataFrame, prints: DataFrame, size: int, dense: int, block: int) -> DataFrame:
    """Pairs (a, b) of rows that connect all rows (row, size, token of the prefix; row, bits) whose shingles are near.

    Rows that SimHash links are compared first, and those that are near form
    groups.  What SimHash leaves apart is found by prefixes: near sets share
    shingles of them, so every such pair meets in cells.  Cells of up to
    ``dense`` texts list their pairs of different groups.  A fuller one
    compares each text with a few of its texts, and then exactly those that are
    still in different groups, in blocks that return spanning links only.
    """
    spark = keyed.sparkSession
    shared = _shared(tokens, PASSES)
    for _ in range(PRUNE_ROUNDS):  # rows that share too few shingles with all others together have no near copy
        smaller = F.ceil(F.col("size") * NEAR_PART / NEAR_WHOLE)
        enough = shared.groupBy("row", "size").agg(F.count("*").alias("t")).where(F.col("t") >= _least_shared(smaller))
        fewer = _shared(shared.drop("n").join(enough.select("row"), "row", "left_semi"))
        drop_written(shared)
        shared = fewer
    sets = _sets(keyed, shared.select("row").distinct(), size)
    release(spark)
    pairs = fingerprint_pairs(prints)
    links = _verified(pairs, sets, "fingerprint-links")
    drop_written(pairs)
    release(spark)
    full = shared.groupBy("row").agg(F.count(F.when(F.col("n") > dense, 1)).alias("full"))
    full = full.join(_groups(links), "row", "left").withColumn("group", F.coalesce("group", "row"))
    # rows of shingles take far less in files than in memory, so neither side of these joins is broadcast
    listed = written(shared.where(F.col("n") <= dense).hint("merge").join(full, "row"), "listed")
    a, b = listed.hint("merge").alias("a"), listed.alias("b")
    alike = NEAR_WHOLE * F.least("a.size", "b.size") >= NEAR_PART * F.greatest("a.size", "b.size")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.row") < F.col("b.row")) & (F.col("a.group") != F.col("b.group")) & alike)
    # what they share in full cells is not listed, and is counted as much as it can be
    lacks = F.least(*[_least_shared(F.col(f"{x}.size")) for x in "ab"]) - F.least("a.full", "b.full")
    usual = pairs.select(F.col("a.row").alias("a"), F.col("b.row").alias("b"), lacks.alias("least"))
    usual = usual.groupBy("a", "b", "least").agg(F.count("*").alias("c")).where("c >= least")
    links = links.unionByName(_verified(usual, sets, "near"))
    drop_written(listed)
    release(spark)
    cells = shared.where(F.col("n") > dense)
    if cells.isEmpty():
        return links
    for round_ in range(STAR_ROUNDS):
        apart = _apart(cells, _groups(links))
        salt = F.pmod("token", F.lit(STAR_CLASSES)) + STAR_CLASSES * round_
        centre = apart.groupBy("token").agg(F.min(F.struct(F.xxhash64("row", salt).alias("h"), F.col("row"), F.col("group"))).alias("c"))
        stars = apart.join(centre, "token").where(F.col("group") != F.col("c.group"))
        stars = stars.select(F.least("row", "c.row").alias("a"), F.greatest("row", "c.row").alias("b"))
        links = links.unionByName(_verified(stars, sets, "stars"))
        drop_written(apart)
        release(spark)
    links = links.unionByName(_block_links(_apart(cells, _groups(links)), sets, block))
    drop_written(sets)
    return links


def _groups(links: DataFrame) -> DataFrame:
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    found = components(ends.select(F.col("a").alias("bits"), F.col("a").alias("least")), links)
    return found.select(F.col("bits").alias("row"), F.col("component").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_WORDS, dense: int = LISTED,
             block: int = BLOCK_SHINGLES) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (null ids last), with the columns of ``docs``; repeated rows are one group.

    Two texts are linked if the Jaccard similarity of their ``size``-word shingles is at least 4 / 5.  SimHash links are taken first and
    compared exactly; prefixes then find the near copies whose fingerprints differ in more bits.
    """
    own = F.col(f"`{id_col}`")
    key = F.struct(own.isNull().alias("gone"), own.alias("id"), F.monotonically_increasing_id().alias("row"))
    stored = written(docs.select("*", key.alias("__key")), "keyed")  # row numbers are fixed once written
    keyed = stored.select(F.col("__key.row").alias("row"), F.col(f"`{text_col}`").alias("text"), F.col("__key").alias("key"))
    prefixes = _prefixes(keyed, size)
    first = prefixes.select("row", "digest").join(keyed.select("row", "key"), "row").groupBy("digest").agg(F.min("key").alias("least"))
    first = by_rows(written(first.select(F.col("least.row").alias("bits"), "least"), "first"))
    narrow = written(prefixes.select("row"), "rows")
    # written once: each pass over the shingles reads it, and none joins again
    own = written(prefixes.join(first.select(F.col("bits").alias("row")), "row", "left_semi").select("row", "size", "prefix", "bits"), "first-prefixes")
    drop_written(prefixes)
    release(docs.sparkSession)
    tokens = own.select("row", "size", F.explode("prefix").alias("token"))
    found = near_copy_links(keyed, tokens, own.select("row", "bits"), size, dense, block)
    drop_written(own)
    release(docs.sparkSession)
    groups = components(first, found)
    near_copies = groups.where(F.col("bits") != F.col("component.row")).select(F.col("bits").alias("__row"))
    copies = narrow.select(F.col("row").alias("__row")).join(first.select(F.col("bits").alias("__row")), "__row", "left_anti")
    gone = by_rows(written(copies.unionByName(near_copies), "copies"))
    return stored.join(gone, F.col("__key.row") == F.col("__row"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
