"""Jaccard join of n-gram sets by vertical partitioning.

The n-grams of a text are hashed to 64 bits; ascending hashes are the global
order.  Ranges of that order are *fragments*, and a fragment cuts each set into
a *segment*.  Two sets of sizes a and b with a similarity of 0.8 or more differ
in at most ``D = (a + b) // 9`` n-grams, and segments serve twice:

* **Candidates.**  With more fragments than ``D`` that are not empty, one of them
  holds no difference: both sets have the same segment there.  With ``D + m`` of them
  there are m such, and the first m are among the first ``D + m`` non-empty segments
  of each.  So a set sends digests of its first ``D + m`` segments only, m being one
  in ``LEAST_PART`` of its n-grams, and pairs have that many digests in common
  or are not linked.  The number of fragments goes by a power of two
  of the larger set's size; a set whose partners may lie in the next class
  sends its segments under that class too.  A set with too few non-empty
  fragments also sends those of a finer cut, until there are enough.  A long
  common passage is no candidate by itself: a segment mixes n-grams from all over the text.
* **Sketches.**  Hashes fall into about as many buckets as a set has n-grams; a set's sketch is
  a bit for each bucket, whether it holds an odd number.  Two sets differ in at least as many n-grams as
  their sketches in bits, so a candidate whose sketches differ in more than ``D`` is no link and its
  sets, some 30 times as long, stay where they are.
* **Overlaps.**  The sets of the candidate pairs that are left are cut into ``FRAGMENTS`` segments;
  each fragment counts its overlap on its own, and the counts are summed for
  each pair.  A fragment in which a pair differs by more than ``D`` sends nothing.

Links are needed as far as they connect.  Equal sets are one class.  Classes
that share segments are compared with one class of their cells first; then only those still in different groups are
compared with each other, in listed pairs where the cell is small and else in
blocks that return spanning links.  No group lists all its pairs, no link
between groups is lost.

The digests of all sets are what is shuffled most.  They go in ``ROUNDS`` ranges, one after
the other, so that disk holds one range of them at a time.

Which digests or classes occur again is sent to the tasks as a bitmap of fixed
size: a filter that lets some more pass when it fills up, and drops nothing.

Classes are known by 64-bit digests of their sets, as n-grams are by their hashes.

Defined results: null texts and texts without words have no n-grams and are
linked with nothing; texts with fewer words than ``size`` are one n-gram; a null id keeps
its row and takes the smallest id of its group that is there; repeated rows
stay; other columns are not read, whatever their names; a table without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import ASCII_LOWER, FILTER_BITS, bitmap_of, drop_written, having, in_bitmap, map_batches, release, split_words, written
from meterbook.llm.simhash_dedup import components

SEED = 42
WORDS = 5
#: 100 * shared >= 80 * union is 9 * shared >= 4 * (a + b).
LINK_SHARED, LINK_SIZES = 9, 4
#: Fragments of a class per n-gram of its smallest set.
CUT = 0.75
#: Linked sets share a digest for every so many n-grams of the smaller set, and one more.
LEAST_PART = 16
#: Fragments in which overlaps are counted.
FRAGMENTS = 8
SKETCH = -1
#: Ranges in which the digests of all sets are shuffled; a power of two.
ROUNDS = 4
#: A cell of up to so many classes lists the pairs that are still apart.
LISTED = 64
#: N-grams of one side of a block.
BLOCK_SHINGLES = 1 << 20
_WORD_CACHE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """One-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: dict, size: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the n-grams of a text."""
    parts = split_words(text.translate(ASCII_LOWER))
    if not parts:
        return np.empty(0, np.uint64)
    of_words = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    return np.unique(_chained(of_words, min(size, len(parts))))


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """``shingles`` of each text; each different word of the batch is hashed once, all windows side by side."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.values.dictionary_encode()
    words = found.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    follow, bounds = found.indices.to_numpy(), lists.offsets.to_numpy()
    held = np.array([w != b"" for w in words], bool)[follow]
    of_words, bounds = hashes[follow[held]], np.concatenate(([0], np.cumsum(held)))[bounds].tolist()
    windows = _chained(of_words, size)
    out = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        own = windows[start : end - size + 1] if end - start >= size else _chained(of_words[start:end], end - start)
        out.append(np.unique(own))
    return out


def _chained(of_words: np.ndarray, take: int) -> np.ndarray:
    """Hash of each window of ``take`` words."""
    count = len(of_words) - take + 1
    if not take or count < 1:
        return np.empty(0, np.uint64)
    joined = np.full(count, take, np.uint64)
    for i in range(take):
        joined = mixed(joined * _ODD + of_words[i : i + count])
    return joined


def linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    return LINK_SHARED * shared >= LINK_SIZES * (a + b)


def _least(size: int | Column) -> int | Column:
    """Digests that a set of this size has in common with a linked one that is not smaller."""
    return F.floor(size / LEAST_PART) + 1 if isinstance(size, Column) else size // LEAST_PART + 1


def _digests(hashes: np.ndarray, scheme: int, take: int) -> np.ndarray:
    """Digests of the first ``take`` segments under a class, with finer cuts until there are as many."""
    found, bits = [], 0
    while True:
        fragments = int(CUT * (1 << scheme) + 1) << bits
        last = fragments >= 1 << 31
        # above 2^31 fragments every n-gram is its own
        place = hashes if last else ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        enough = last or len(starts) >= take
        salt = mixed(np.array([(scheme << 8 | bits) + 1], np.uint64) * _ODD)
        sums = np.add.reduceat(mixed(hashes ^ salt), starts)
        found.append(mixed(sums + salt)[:take])
        if enough:
            return np.concatenate(found)
        bits += 1


def segment_digests(hashes: np.ndarray) -> np.ndarray:
    """What a set sends: any two linked sets have ``_least`` digests of the smaller one in common."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    own = n.bit_length() - 1
    largest = n * 5 // 4
    found = [_digests(hashes, own, (n + min(largest, (2 << own) - 1)) // 9 + _least(n))]
    if largest >= 2 << own:
        found.append(_digests(hashes, own + 1, (n + largest) // 9 + _least(n)))
    return np.concatenate(found)


def sketch(hashes: np.ndarray) -> bytes:
    """For each bucket whether it holds an odd number of the hashes; the number of buckets is a power of two, and at least that of the hashes."""
    buckets = 64 << (max(len(hashes) - 1, 0) // 64).bit_length()
    odd = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with fewer buckets: the halves are put together until they have so many words."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_link(left: list[bytes], right: list[bytes], left_sizes: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Whether sets (pairs, place by place) may be linked, by their sketches; True for all that are."""
    out = np.zeros(len(left), bool)
    words = np.array([[len(x) // 8, len(y) // 8] for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    for a, b in np.unique(words, axis=0).tolist():
        at = np.flatnonzero((words[:, 0] == a) & (words[:, 1] == b))
        sides = [np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1) for side in (left, right)]
        apart = np.bitwise_count(_folded(sides[0], min(a, b)) ^ _folded(sides[1], min(a, b))).sum(axis=1, dtype=np.int64)
        out[at] = apart <= (left_sizes[at] + right_sizes[at]) // 9
    return out


def prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Written rows (id, n, class, digests); the class of an empty set is null."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column(1), size)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            names = pa.array([_class_of(s) for s in sets], pa.int64())
            sent = [segment_digests(s).view(np.int64) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, sent)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sent or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, names, lists], ["id", "n", "class", "digests"])

    return written(map_batches(own, work, f"id {kind}, n bigint, class bigint, digests array<bigint>"), "segments")


def _class_of(hashes: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).astype(np.int64)) if len(hashes) else None


def _cells(marked: DataFrame, bits: int) -> DataFrame:
    """Written rows (digest, class, n, low, top) of the digests that several classes share; low and top are two of these classes."""
    spark = marked.sparkSession
    rows = marked.where(F.col("class").isNotNull())
    sent = rows.select("class", F.explode("digests").alias("digest"))
    # copies of a text and large groups are combined before they travel
    for i in range(ROUNDS):
        some = sent.where(F.shiftrightunsigned("digest", 64 - ROUNDS.bit_length() + 1) == i) if ROUNDS > 1 else sent
        part = written(some.groupBy("digest").agg(F.min("class").alias("low"), F.max("class").alias("top")).where("low < top"), "shared")
        ends = ends.unionByName(part) if i else part
        release(spark)
    again = spark.sparkContext.broadcast(bitmap_of(ends.select("digest"), bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            keep = in_bitmap(again.value, values)
            own = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)[keep]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values[keep])], ["class", "n", "digest"])

    some = map_batches(rows.select("class", "n", "digests"), work, "class bigint, n bigint, digest bigint").distinct()
    found = written(some.join(ends, "digest"), "cells")
    drop_written(ends)
    # a set that shares too few digests with all others together is linked with none
    smaller = F.ceil(F.col("n") * 4 / 5)
    enough = found.groupBy("class", "n").agg(F.count("*").alias("t")).where(F.col("t") >= _least(smaller)).select("class")
    pruned = written(found.join(enough, "class", "left_semi").select(*found.columns), "pruned")
    drop_written(found)
    return pruned


def _segments(docs: DataFrame, marked: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int, bits: int) -> DataFrame:
    """Written rows (class, fragment, n, grams) of the classes that are wanted (one bigint column); the sketch of a class is its fragment ``SKETCH``."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(bitmap_of(wanted, bits))
    # one document for each class: the others need not be read again
    least = marked.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(F.xxhash64("id")).alias("id_hash"))
    ids = least.join(wanted.toDF("class"), "class", "left_semi").select("id_hash")
    readers = spark.sparkContext.broadcast(bitmap_of(ids, bits))
    own = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("id_hash"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(readers.value, batch.column(0).to_numpy())
            sets = sets_of(batch.column(1).filter(pa.array(keep)), size)
            named = [(_class_of(s), s) for s in sets if len(s)]
            held = in_bitmap(classes.value, np.array([c for c, _ in named], np.int64)) if named else []
            rows = []
            for (name, s), yes in zip(named, held, strict=True):
                if yes:
                    cuts = np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS))
                    rows += [(name, i, len(s), part.tobytes()) for i, part in enumerate(np.split(s, cuts))]
                    rows.append((name, SKETCH, len(s), sketch(s)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["class", "fragment", "n", "grams"])

    cut = written(map_batches(own, work, "class bigint, fragment int, n bigint, grams binary"), "fragments")
    heads = cut.where("fragment = 0").groupBy("class").agg(F.count("*").alias("held"))
    if heads.where("held > 1").isEmpty():
        return cut
    once = written(cut.dropDuplicates(["class", "fragment"]), "fragments")  # repeated rows
    drop_written(cut)
    return once


def _shared(left: np.ndarray, right: np.ndarray) -> int:
    """How many values two ascending segments have in common."""
    if len(left) < len(right):
        left, right = right, left
    if not len(right):
        return 0
    at = np.searchsorted(left, right)
    return int((left[np.minimum(at, len(left) - 1)] == right).sum())


def _by_sketch(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a link."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(sketches.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("grams").alias(f"s_{side}")), side)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, own, other = (batch.column(c) for c in range(2, 6))
            keep = may_link(left.to_pylist(), right.to_pylist(), own.to_numpy(), other.to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_batches(both.select("a", "b", "s_a", "s_b", "n_a", "n_b"), work, "a bigint, b bigint")


def overlaps(pairs: DataFrame, segments: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows (a, b) of the pairs that are linked: overlaps are counted by fragment and summed."""
    both = pairs = written(_by_sketch(pairs, sketches), "pairs")
    segments = having(segments.where(F.col("fragment") != SKETCH), "class", pairs.select(F.explode(F.array("a", "b")).alias("class")))
    for side in ("a", "b"):
        own = segments.select(F.col("class").alias(side), F.col("fragment").alias(f"f_{side}"), F.col("n").alias(f"n_{side}"), F.col("grams").alias(f"g_{side}"))
        same = [side] if side == "a" else (F.col("b") == F.col("b2")) & (F.col("f_a") == F.col("f_b"))
        both = both.join(own if side == "a" else own.withColumnRenamed("b", "b2"), same)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep, counts = [], []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                met = _shared(left, right)
                if met and len(left) + len(right) - 2 * met <= sizes[i] // 9:
                    keep.append(i)
                    counts.append(met)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1)), pa.array(sizes[keep]), pa.array(counts, pa.int64())], ["a", "b", "sizes", "shared"])

    counted = map_batches(both.select("a", "b", "n_a", "n_b", "g_a", "g_b"), work, "a bigint, b bigint, sizes bigint, shared bigint")
    summed = counted.groupBy("a", "b", "sizes").agg(F.sum("shared").alias("shared"))
    return summed.where(F.col("shared") * LINK_SHARED >= F.col("sizes") * LINK_SIZES).select("a", "b")


def _groups(found: DataFrame) -> DataFrame:
    ends = found.select("a").unionByName(found.select(F.col("b").alias("a"))).distinct()
    named = components(ends.select(F.col("a").alias("bits"), F.col("a").alias("least")), found)
    return named.select(F.col("bits").alias("class"), F.col("component").alias("group"))


def _apart(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Written rows of the cells with classes of several groups, with group, main (the group with most of them) and filled."""
    named = cells.join(_groups(found), "class", "left").withColumn("group", F.coalesce("group", "class"))
    parts = named.groupBy("digest", "group").agg(F.count("*").alias("held"))
    several = parts.groupBy("digest").agg(F.count("*").alias("groups"), F.sum("held").alias("filled"), F.max_by("group", F.struct("held", "group")).alias("main"))
    return written(named.join(several.where("groups > 1").select("digest", "filled", "main"), "digest"), "apart")


def _star(cells: DataFrame, centre: str) -> DataFrame:
    """Pairs (a, b) of a class and the centre of its cells that share enough digests in such cells."""
    rows = cells.where(F.col("class") != F.col(centre)).groupBy("class", "n", centre).agg(F.count("*").alias("c"))
    pairs = rows.where(F.col("c") >= _least(F.ceil(F.col("n") * 4 / 5)))
    return pairs.select(F.least("class", centre).alias("a"), F.greatest("class", centre).alias("b")).distinct()


def _listed(apart: DataFrame, listed: int) -> DataFrame:
    """Pairs (a, b) of different groups that share enough digests; those of fuller cells, which are not listed, count as shared."""
    full = apart.groupBy("class").agg(F.count(F.when(F.col("filled") > listed, 1)).alias("full"))
    few = apart.where(F.col("filled") <= listed).join(full, "class").select("digest", "class", "group", "n", "full")
    a, b = few.alias("a"), few.alias("b")
    sizes = LINK_SHARED * F.least("a.n", "b.n") >= LINK_SIZES * (F.col("a.n") + F.col("b.n"))
    pairs = a.join(b, (F.col("a.digest") == F.col("b.digest")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.group") != F.col("b.group")) & sizes)
    lacks = _least(F.least("a.n", "b.n")) - F.least("a.full", "b.full")
    met = pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b"), lacks.alias("lacks")).groupBy("a", "b", "lacks").agg(F.count("*").alias("c"))
    return met.where("c >= lacks").select("a", "b")


def _block_links(apart: DataFrame, segments: DataFrame, block: int) -> DataFrame:
    """Links between the groups of fuller cells: the classes outside the main group against all, block by block.

    A block counts overlaps fragment by fragment, like ``overlaps``, and returns links of groups it has not connected yet.
    """
    rows = apart
    outside = F.col("group") != F.col("main")
    loads = rows.groupBy("digest").agg(F.sum("n").alias("all"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("out"))
    counts = loads.select("digest", *[F.ceil(F.col(c) / block).cast("int").alias(k) for c, k in (("all", "is"), ("out", "js"))])
    dealt = rows.join(counts, "digest")

    def deal(part: DataFrame, own: str, other: str, probe: bool) -> DataFrame:
        mine, their = ("j", "i") if probe else ("i", "j")
        placed = part.withColumn(mine, F.pmod(F.xxhash64("class"), F.col(own)).cast("int")).withColumn(their, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return placed.select("digest", "i", "j", "class", "group", F.lit(probe).alias("probe"))

    both = deal(dealt, "is", "js", False).unionByName(deal(dealt.where(outside), "js", "is", True))
    whole = having(segments.where(F.col("fragment") != SKETCH), "class", apart.select("class")).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("fragment", "grams"))).alias("cut"))  # FRAGMENTS a class

    def work(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["probe"] == probe] for probe in (False, True)]
        found = []
        if all(map(len, sides)):
            cuts = [[[np.frombuffer(s["grams"], np.uint64) for s in cut] for cut in side["cut"]] for side in sides]
            found = spanning_links(*cuts, *(side["group"].to_numpy(np.int64) for side in sides))
        ids = [side["class"].to_numpy(np.int64) for side in sides]
        return pd.DataFrame({"a": ids[0][[i for i, _ in found]], "b": ids[1][[j for _, j in found]]}, dtype=np.int64)

    return written(both.join(whole, "class").groupBy("digest", "i", "j").applyInPandas(work, "a bigint, b bigint"), "block-links")


def spanning_links(left: list, right: list, left_groups: np.ndarray, right_groups: np.ndarray) -> list[tuple[int, int]]:
    """Places (left, right) of linked sets, each a list of segments; a link for two groups that are not connected yet, until all that can be are."""
    names, groups = np.unique(np.concatenate((left_groups, right_groups)), return_inverse=True)
    own, other, top = groups[: len(left)], groups[len(left) :], np.arange(len(names))
    sizes = np.array([sum(map(len, cut)) for cut in left], np.int64)
    index = []
    for parts in zip(*left, strict=True):
        grams, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), list(map(len, parts)))
        order = np.argsort(grams, kind="stable")
        index.append((grams[order], owner[order]))
    found = []
    for j, cut in enumerate(right):
        n = sum(map(len, cut))
        if not (linked(np.minimum(sizes, n), sizes, n) & (top[own] != top[other[j]])).any():
            continue
        shared = np.zeros(len(left), np.int64)
        for (grams, owner), part in zip(index, cut, strict=True):
            starts, ends = np.searchsorted(grams, part, "left"), np.searchsorted(grams, part, "right")
            met = [owner[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e > s]
            if met:
                shared += np.bincount(np.concatenate(met), minlength=len(left))
        for i in np.flatnonzero(linked(shared, sizes, n)).tolist():
            a, b = top[own[i]], top[other[j]]
            if a != b:
                top[top == a] = b
                found.append((i, j))
    return found


def links(docs: DataFrame, marked: DataFrame, narrow: DataFrame, id_col: str, text_col: str, size: int, listed: int, block: int, bits: int) -> DataFrame | None:
    """Pairs (a, b) of classes that connect all linked classes; None without candidates.  ``marked`` is dropped; ``narrow`` is it without digests."""
    spark = docs.sparkSession
    cells = _cells(marked, bits)
    drop_written(marked)
    if cells.isEmpty():
        return None
    segments = _segments(docs, narrow, cells.select("class").distinct(), id_col, text_col, size, bits)
    release(spark)
    sketches = written(segments.where(F.col("fragment") == SKETCH).select("class", "n", "grams"), "sketches")
    found = written(overlaps(_star(cells, "low"), segments, sketches), "star-low")
    release(spark)
    apart = _apart(cells, found)
    found = found.unionByName(written(overlaps(_star(apart, "top"), segments, sketches), "star-top"))
    release(spark)
    left = _apart(apart.select(*cells.columns), found)
    drop_written(apart)
    release(spark)
    found = found.unionByName(written(overlaps(_listed(left, listed), segments, sketches), "listed"))
    release(spark)
    full = left.where(F.col("filled") > listed)
    if not full.isEmpty():
        found = found.unionByName(_block_links(full, segments, block))
    for table in (left, cells, segments, sketches):
        drop_written(table)
    release(spark)
    return found


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, listed: int = LISTED, block: int = BLOCK_SHINGLES,
                   bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links)."""
    marked = prints(docs, id_col, text_col, size)
    classes = marked.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("least"))
    classes = written(classes.select(F.col("class").alias("bits"), "least"), "classes")
    narrow = written(marked.drop("digests"), "marked")
    found = links(docs, marked, narrow, id_col, text_col, size, listed, block, bits)
    named = classes.select("bits", F.col("least").alias("component"))
    if found is not None:
        named = classes.join(components(classes, found), "bits", "left").select("bits", F.coalesce("component", "least").alias("component"))
    whole = narrow.join(named, F.col("class") == F.col("bits"), "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
