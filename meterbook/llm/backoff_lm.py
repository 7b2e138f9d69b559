"""Stupid-backoff scores of documents, by joining n-grams with count tables.

Words are lower-cased (A-Z) and known by their 64-bit hash.  The score of a
word w after a context is the count of context and word over the count of the
context, if the longer n-gram was seen at least ``MIN_COUNT`` times in the
corpus; else ``BACKOFF`` times the score after the context without its first
word; at last the share of the word in all words.  A document's score is the
sum of the logarithms over its words.

The work is relational, with rows packed so that a shuffle moves a few bytes
for each n-gram and not a row:

* *tokenised corpus*: a written table of chunks of whole documents;
* *exploded n-grams*: each chunk sends its distinct n-grams and their counts to
  the hash partitions of their order, sorted and difference-coded;
* *count tables*: each hash partition adds the counts and joins them back to
  the n-grams it was sent, so the answer to a chunk is one count per n-gram;
* *sum per document*: chunks are joined with their answers.

A frequent n-gram is sent once per chunk and order, so no partition has more
of it than there are chunks; partitions hold ``PART_GRAMS`` n-grams at most on
average, whatever the corpus is.

Defined results: null and empty texts have no words and score 0 (mean null);
repeated rows count and are scored each; a null id keeps its row; a table
without rows gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import ASCII_LOWER, map_batches, texts_of
from meterbook.session import scratch_path

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
CHUNK_WORDS = 1 << 21
PART_GRAMS = 1 << 21
MEMORY = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Word hashes of texts; a piece that was met before is looked up."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        parts = text.translate(ASCII_LOWER).split()
        for piece in set(parts).difference(self.known):
            self.known[piece] = xxhash.xxh64_intdigest(piece, 0)
        out = np.fromiter(map(self.known.__getitem__, parts), np.uint64, len(parts))
        if len(self.known) > MEMORY:
            self.known.clear()
        return out


def grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length the hash of the n-gram that ends at a word; shorter lengths where a document has just begun.

    The hash of words 1..n is made of that of words 1..n-1 and the n-th word.
    """
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    out = [_spread(words)]
    for n in range(2, order + 1):
        longer = np.empty_like(words)
        longer[:1] = out[-1][:1]
        longer[1:] = _spread(out[-1][:-1] * _MIX + words[1:] + np.uint64(n))
        out.append(np.where(place >= n - 1, longer, out[-1]))
    return out


def _planes(values: np.ndarray) -> bytes:
    """Numbers as compressed planes: all first bytes, all second bytes ..."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(1).compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def _numbers(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, as their differences."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, "<u8"), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return _planes(values.astype("<u4"))


def unpack_counts(data: bytes) -> np.ndarray:
    return _numbers(data, "<u4")


def tokenise(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written chunks of whole documents: ids, sizes, dictionary and places of the words."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, part, number = Hasher(), TaskContext.get().partitionId(), 0
        ids: list = []
        found: list[np.ndarray] = []
        size = 0

        def sent() -> pa.RecordBatch:
            words = np.concatenate(found)
            names, places, counts = np.unique(words, return_inverse=True, return_counts=True)
            # the most frequent words get the smallest numbers, which compress best
            order = np.argsort(-counts, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            sizes = np.array([len(w) for w in found], "<i8")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes.tobytes()], pa.binary()),
                    pa.array([_planes(names[order])], pa.binary()), pa.array([pack_counts(rank[places])], pa.binary()), pa.array([len(words)], pa.int64()),
                ],
                ["chunk", "ids", "sizes", "names", "places", "words"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids.append(i)
                found.append(hasher.words(text))
                size += len(found[-1])
                if size >= CHUNK_WORDS:
                    yield sent()
                    ids, found, size, number = [], [], 0, number + 1
        if ids:
            yield sent()

    schema = f"chunk bigint, ids array<{kind}>, sizes binary, names binary, places binary, words bigint"
    # bucketed by chunk: the last join reads the chunks where they are, and only the answers travel
    spark, name = docs.sparkSession, f"tokenised_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = map_batches(own, work, schema).write.option("path", scratch_path(spark, "tokenised"))
    made.bucketBy(buckets, "chunk").saveAsTable(name, format="parquet")
    return spark.table(name)


def _chunk_grams(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    words = _numbers(row["names"], "<u8")[unpack_counts(row["places"])] if row["words"] else np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    # documents without words have no place of their own
    return sizes, words, grams(words, starts[sizes > 0], order)


def explode(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(n, part, chunk, grams, counts): distinct n-grams of a chunk, by hash partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, words, found = _chunk_grams(row, order)
                if not len(words):
                    continue
                # n-grams cut short at the begin of a document are left to their own length
                for n, values in enumerate(found, 1):
                    if n > 1:
                        values = values[values != found[n - 2]]
                    if not len(values):
                        continue
                    keys, counts = np.unique(values, return_counts=True)
                    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    names, cuts = np.unique(parts, return_index=True)
                    ends = np.append(cuts[1:], len(keys))
                    blobs = [(pack(keys[a:b]), pack_counts(counts[a:b])) for a, b in zip(cuts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([n] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array([row["chunk"]] * len(names), pa.int64()),
                            pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.binary()),
                        ],
                        ["n", "part", "chunk", "grams", "counts"],
                    )

    return map_batches(chunks, work, "n int, part bigint, chunk bigint, grams binary, counts binary")


def _add(group: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of each chunk, and the count table of a hash partition."""
    sent = [unpack(g) for g in group["grams"]]
    keys = np.concatenate(sent)
    counts = np.concatenate([unpack_counts(c) for c in group["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return sent, keys[first], np.add.reduceat(counts, first)


def answers(exploded: DataFrame) -> DataFrame:
    """(chunk, n, part, counts): corpus counts of the n-grams a chunk has sent, in their order."""

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sent, keys, counts = _add(group)
        # counts of the corpus take 64 bits; their upper planes are zeros, which compress to nothing
        found = [_planes(counts[np.searchsorted(keys, g)]) for g in sent]
        return pd.DataFrame({"chunk": group["chunk"], "n": key[0], "part": key[1], "counts": found})

    return exploded.groupBy("n", "part").applyInPandas(join, "chunk bigint, n int, part bigint, counts binary")


def count_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(n, gram, count) of all n-grams by hash, for use outside the scores."""
    chunks = tokenise(docs, id_col, text_col)

    def table(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = _add(group)
        return pd.DataFrame({"n": key[0], "gram": keys.view(np.int64), "count": counts})

    return explode(chunks, order, _bits(chunks)).groupBy("n", "part").applyInPandas(table, "n int, gram bigint, count bigint")


def _total(chunks: DataFrame) -> int:
    return chunks.agg(F.sum("words")).first()[0] or 0


def _bits(chunks: DataFrame) -> int:
    return max(0, -(-_total(chunks) // PART_GRAMS) - 1).bit_length()


def word_scores(found: list[np.ndarray], counts: list[np.ndarray], total: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the score of each word, and the length of the n-gram it was taken from."""
    score = np.log(counts[0] / total)
    length = np.ones(len(score), np.int64)
    for n in range(2, len(found) + 1):
        whole = found[n - 1] != found[n - 2]  # a full n-gram ends here
        context = np.concatenate(([1], counts[n - 2][:-1]))  # the n-gram one shorter that ends at the word before
        seen = whole & (counts[n - 1] >= min_count)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(seen, np.log(counts[n - 1] / context), np.where(whole, np.log(BACKOFF) + score, score))
        length = np.where(seen, n, length)
    return score, length


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """id, n_words, log_score, mean_log_score and n_backoff (words not scored by the longest n-gram) of every document."""
    chunks = tokenise(docs, id_col, text_col)
    total = _total(chunks)
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    given = answers(explode(chunks, order, _bits(chunks)))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].to_dict()
        sizes, words, found = _chunk_grams(row, order)
        n_docs = len(sizes)
        sums, backed = np.zeros(n_docs), np.zeros(n_docs, np.int64)
        if len(words):
            counts = []
            for n, values in enumerate(found, 1):
                whole = values != found[n - 2] if n > 1 else np.ones(len(values), bool)
                own = right[right["n"] == n].sort_values("part")
                table = np.concatenate([_numbers(c, "<i8") for c in own["counts"]]).astype(np.float64) if len(own) else np.empty(0)
                at = np.zeros(len(values))
                at[whole] = table[np.unique(values[whole], return_inverse=True)[1]]
                counts.append(at)
            logs, length = word_scores(found, counts, total, min_count)
            full = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[full]
            sums[full] = np.add.reduceat(logs, starts)
            backed[full] = np.add.reduceat((length < order).astype(np.int64), starts)
        return pd.DataFrame({"id": pd.Series(list(row["ids"]), dtype=object), "n_words": sizes, "log_score": sums, "n_backoff": backed})

    done = chunks.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(score, f"id {kind}, n_words bigint, log_score double, n_backoff bigint")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return done.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"), "n_backoff")


#: The scores of order 3 in SQL, rounded as the query rounds them.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
t AS (SELECT r, p, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
c AS (SELECT *, count(*) OVER (PARTITION BY w) AS c1, count(*) OVER () AS total, CASE WHEN w1 IS NOT NULL THEN count(*) OVER (PARTITION BY w1, w) END AS c2,
    CASE WHEN w2 IS NOT NULL THEN count(*) OVER (PARTITION BY w2, w1, w) END AS c3 FROM t),
x AS (SELECT *, lag(c1) OVER o AS before1, lag(c2) OVER o AS before2 FROM c WINDOW o AS (PARTITION BY r ORDER BY p)),
s AS (SELECT r, c3 IS NULL OR c3 < {MIN_COUNT} AS backed, CASE WHEN c3 >= {MIN_COUNT} THEN ln(c3 / before2)
    WHEN c2 >= {MIN_COUNT} THEN CASE WHEN w2 IS NULL THEN 0 ELSE ln({BACKOFF}) END + ln(c2 / before1)
    ELSE CASE WHEN w1 IS NULL THEN 0 WHEN w2 IS NULL THEN ln({BACKOFF}) ELSE 2 * ln({BACKOFF}) END + ln(c1 / total) END AS score FROM x),
g AS (SELECT r, count(*) AS n, sum(score) AS score, count(*) FILTER (backed) AS backed FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(score, 0), 3) AS log_score, round(score / n, 6) AS mean_log_score,
  coalesce(backed, 0)::BIGINT AS n_backoff FROM d LEFT JOIN g USING (r)"""
