"""Benchmark passages and their paraphrases in documents, by latent semantic retrieval.

1. Texts become codes of the words that the benchmark has (letters and digits,
   lower case; any other word is code 0).  The coded documents are written
   once; all further passes read them.
2. Passages of ``PASSAGE`` words are rows of a TF-IDF matrix whose document
   frequencies and whose singular vectors come from all documents.  The SVD is
   a randomised one: a random sketch of the term space is multiplied by A'A
   (each task adds up its own passages), orthogonalised, multiplied again, and
   solved as a small problem (Rayleigh-Ritz).
3. Items and overlapping windows are folded into the latent space; pairs with
   a cosine of at least ``COSINE`` are candidates, of every window and without
   any cap.  So is every stretch that holds as many of an item's rarest words
   as a hit has to hold: no hit depends on the latent space.
4. Candidates of an item that lie together are one region of the document,
   which is checked on the words themselves.  The longest common subsequence
   of the item and a stretch half as long again, beginning at any word of the
   region, must hold at least ``COPY`` of the item's words; or at least
   ``PARAPHRASE`` of them, if the item's answer (what follows ``Answer:``, or
   else its last sentence) is there to at least ``ANSWER``.
5. Items of fewer than ``MIN_WORDS`` words have nothing to be paraphrased.
   They are found where their words follow one another, as hits of the kind
   ``short``, which ``clean`` takes out only where it is asked to.

Items are taken in blocks of about ``ITEM_BLOCK`` items or 60 times as many
words, each with a vocabulary of its own, so what goes to the tasks has a bound
whatever the benchmark is.

Defined results: null and empty texts are never hits; items without words are
not looked for; the cosine and the answer's share of a short hit are null;
repeated documents are one row for each item, and a null id is a row like any
other; an empty benchmark or table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import by_rows, map_batches, texts_of, written

STEP = 16
WINDOW = 2 * STEP
PASSAGE = 32
RANK = 96
COSINE = 0.4
#: Terms in more than this share of the passages (and in more than MOST_FREE of them) weigh nothing in the search, as
#: stop words, unless they are among the KEPT rarest of an item.  The exact checks read all words.
MOST_SHARE = 0.01
MOST_FREE = 200
KEPT = 8
COPY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
MIN_WORDS = 5
ITEM_BLOCK = 1000
#: Words of an item that a block is sized for: long items make more and smaller blocks.
BLOCK_WORDS = 60
SEGMENT = 1 << 15
SEED = 7
_CHUNK = 1 << 15
_REGION_WORDS = 1 << 18
_TERMS = 256
_ANSWER = re.compile(r"(?is).*\banswer\s*:\s*(.+)\Z")
_ASCII_DROPPED = bytes(c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\r\x0b\x0c")
_DROPPED = re.compile(r"[^\w \t\n\r\x0b\x0c]+|_+")
_SENTENCE = re.compile(r"(?s)(?:.*[.!?]\s+)?(.+?)\s*\Z")


def plain_words(text: bytes) -> list[bytes]:
    """Words as they are compared: letters and digits in lower case, cut at ASCII white space."""
    if text.isascii():
        return text.lower().translate(None, _ASCII_DROPPED).split()
    return _DROPPED.sub("", text.decode("utf-8", "replace").lower()).encode().split()


def words_of(text: str | None) -> list[bytes]:
    return plain_words((text or "").encode())


def answer_of(text: str) -> list[bytes]:
    """What follows the last ``Answer:``, or else the last sentence."""
    found = _ANSWER.match(text) or _SENTENCE.match(text)
    return words_of(found[1]) if found else []


@dataclass
class Items:
    """A block of the benchmark, coded by its own vocabulary."""

    ids: list
    codes: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]
    short_ids: list
    short: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        vocabulary: dict[bytes, int] = {}
        ids, codes, answers, short_ids, short = [], [], [], [], []
        for i, text in rows:
            found = words_of(text)
            coded = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int32)
            if len(found) >= MIN_WORDS:
                ids.append(i)
                codes.append(coded)
                answers.append(np.array([vocabulary[w] for w in answer_of(text) if w in vocabulary], np.int32))
            elif found:
                short_ids.append(i)
                short.append(coded)
        return cls(ids, codes, answers, vocabulary, short_ids, short)

    @property
    def longest(self) -> int:
        return max(map(len, self.codes), default=0)


def code_texts(texts: list[bytes], vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """Codes of the words of each text, 0 for a word that the benchmark does not have."""
    cut = map(plain_words, texts)
    return [np.fromiter(map(vocabulary.get, parts, repeat(0)), np.int32, len(parts)) for parts in cut]


def code_documents(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """Written rows (id, start, codes); long documents are cut into segments that overlap by more than any match."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    vocabulary, overlap = items.vocabulary, 2 * WINDOW + 4 * items.longest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, blobs = [], [], []
            for row, codes in enumerate(code_texts(texts_of(batch), vocabulary)):
                for at in range(0, max(1, len(codes) - overlap), SEGMENT):
                    part = codes[at : at + SEGMENT + overlap]
                    if part.any():  # without a word of the benchmark there is no match
                        rows.append(row)
                        starts.append(at)
                        blobs.append(part.astype("<i4").tobytes())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(blobs, pa.binary())], ["id", "start", "codes"])

    return written(map_batches(own, work, f"id {kind}, start bigint, codes binary"), "coded")


def _coded(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i4") for b in batch.column(2).to_pylist()]


def _chunks(parts: list[np.ndarray], unit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of some documents, each padded to whole units, and the document of each unit; about ``_CHUNK`` codes at a time."""
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (size < _CHUNK or to == at):
            size += -(-len(parts[to]) // unit) * unit
            to += 1
        codes, owner, place = np.zeros(size, np.int32), [], 0
        for i in range(at, to):
            units = -(-len(parts[i]) // unit)
            codes[place : place + len(parts[i])] = parts[i]
            owner.append(np.full(units, i))
            place += units * unit
        yield codes, np.concatenate(owner)
        at = to


def passage_counts(coded: DataFrame, terms: int) -> np.ndarray:
    """Number of passages that hold each term, over all documents; at 0 the number of passages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for codes, _ in _chunks(_coded(batch), PASSAGE):
                place = np.flatnonzero(codes)
                keys = np.unique((place // PASSAGE) * np.int64(terms + 1) + codes[place])
                counts += np.bincount(keys % (terms + 1), minlength=terms + 1)
                counts[0] += len(codes) // PASSAGE
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["term", "n"])

    out = np.zeros(terms + 1, np.int64)
    for row in map_batches(coded, work, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        out[row.term] = row.n
    return out


def gram_product(codes: np.ndarray, weights: np.ndarray, sketch: np.ndarray, out: np.ndarray) -> None:
    """Add A'A times the sketch for the passages of ``codes``; rows of A are TF-IDF vectors of length about one."""
    place = np.flatnonzero(weights[codes])
    if not len(place):
        return
    terms, passage = codes[place], place // PASSAGE
    first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    w = weights[terms]
    size = np.add.reduceat(w * w, first)
    size[size == 0] = 1
    projected = np.add.reduceat(w[:, None] * sketch[terms], first, axis=0) / size[:, None]
    row = np.cumsum(np.concatenate(([0], (passage[1:] != passage[:-1]).astype(np.int64))))
    order = np.argsort(terms, kind="stable")
    own = terms[order]
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out[own[start]] += weights[own[start]][:, None] * np.add.reduceat(projected[row[order]], start, axis=0)


def multiply(coded: DataFrame, weights: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """A'A times a sketch: tasks add up their passages, the sums of 256 terms each are added by Spark."""
    terms, rank = sketch.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, light = np.zeros((terms, rank)), sketch.astype(np.float32)
        for batch in batches:
            for codes, _ in _chunks(_coded(batch), PASSAGE):
                gram_product(codes, weights, light, out)
        blocks = [b for b in range(0, terms, _TERMS) if out[b : b + _TERMS].any()]
        blobs = [out[b : b + _TERMS].tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], ["block", "sums"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, np.float64) for s in group["sums"])
        return pd.DataFrame({"block": [key[0]], "sums": [total.tobytes()]})

    out = np.zeros((terms, rank))
    for row in map_batches(coded, work, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect():
        part = np.frombuffer(row.sums, np.float64).reshape(-1, rank)
        out[row.block : row.block + len(part)] = part
    return out


@dataclass
class Space:
    """Latent space: ``fold[term]`` is the weighted, whitened row of a term; ``searched`` tells which terms weigh anything."""

    fold: np.ndarray
    searched: np.ndarray
    counts: np.ndarray

    def item(self, codes: np.ndarray) -> np.ndarray:
        return unit(self.fold[codes].sum(axis=0, keepdims=True))[0]


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def term_weights(counts: np.ndarray, items: list[np.ndarray]) -> np.ndarray:
    """Inverse passage frequencies; zero for terms that are too frequent to search by."""
    weights = np.log((counts[0] + 1) / (counts + 0.5)).astype(np.float32)
    free = counts <= max(MOST_FREE, MOST_SHARE * counts[0])
    for codes in items:
        own = np.unique(codes)
        free[own[np.argsort(counts[own], kind="stable")[:KEPT]]] = True
    weights[~free] = 0
    weights[0] = 0
    return np.maximum(weights, 0)


def latent_space(coded: DataFrame, items: Items, rank: int = RANK) -> Space:
    """Randomised SVD of the TF-IDF passages of all documents."""
    terms = len(items.vocabulary)
    counts = passage_counts(coded, terms)
    weights = term_weights(counts, items.codes)
    rank = min(rank, terms)
    sketch = np.random.default_rng(SEED).normal(size=(terms + 1, rank))
    sketch[0] = 0
    basis, _ = np.linalg.qr(multiply(coded, weights, sketch))
    again = multiply(coded, weights, basis)
    small = basis.T @ again
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values = np.sqrt(np.maximum(values, max(values.max(), 0) * 1e-9 + 1e-12))
    return Space((weights[:, None] * (basis @ turn) / values).astype(np.float32), weights > 0, counts)


def common(mask: dict[int, int], size: int, codes: list[int]) -> int:
    """Length of the longest common subsequence with an item whose places are given by term, in bit-parallel form."""
    full = (1 << size) - 1
    row = full
    for places in filter(None, map(mask.get, codes)):
        hit = row & places
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def places_of(codes: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, code in enumerate(codes.tolist()):
        out[code] = out.get(code, 0) | 1 << i
    return out


@dataclass
class Checker:
    """The exact checks of a pair."""

    items: Items

    def __post_init__(self) -> None:
        self.masks = [places_of(c) for c in self.items.codes]
        self.answer_masks = [places_of(c) for c in self.items.answers]
        self.least = np.array([int(np.ceil(PARAPHRASE * len(c) - 1e-9)) for c in self.items.codes], np.int64)
        # a bit for each word and item
        self.held = np.zeros((len(self.items.vocabulary) + 1, -(-len(self.masks) // 8)), np.uint8)
        for i, codes in enumerate(self.items.codes):
            self.held[codes, i >> 3] |= 1 << (i & 7)

    def enough(self, codes: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which regions (none of them empty) hold as many words of their item as a hit must; about ``_REGION_WORDS`` words at a time."""
        sizes, out, at = stop - start, np.zeros(len(item), bool), 0
        ends = np.cumsum(sizes)
        while at < len(item):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _REGION_WORDS)))
            n, own = sizes[at:to], item[at:to]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) + np.repeat(start[at:to] - first, n)
            hit = self.held[codes[place], np.repeat(own >> 3, n)] >> np.repeat((own & 7).astype(np.uint8), n) & 1
            out[at:to] = np.add.reduceat(hit, first, dtype=np.int64) >= self.least[own]
            at = to
        return out

    def check(self, item: int, codes: np.ndarray, start: int, stop: int) -> tuple[float, float, int] | None:
        """(share of the item, share of its answer, first word) of the best stretch that begins in a region, if it is a hit.

        A stretch that begins with a word of neither item nor answer holds no more than the one behind that word, and
        one with too few of the item's words, in whatever order, is passed over.
        """
        size, mask, answer_mask = len(self.items.codes[item]), self.masks[item], self.answer_masks[item]
        answer, length = len(self.items.answers[item]), -(-3 * size // 2)
        best, least = None, int(self.least[item])
        region = codes[start:stop].tolist()
        own = list(filter(mask.__contains__, region))
        if len(own) < least or common(mask, size, own) < least:
            return None
        places = [(i, c) for i, c in enumerate(region, start) if c in mask or c in answer_mask]
        own = [c for _, c in places]
        counts: Counter[int] = Counter()
        held = end = 0
        for k, (at, code) in enumerate(places):
            while end < len(places) and places[end][0] < at + length:
                new = own[end]
                counts[new] += 1
                held += new in mask and counts[new] <= mask[new].bit_count()
                end += 1
            if held >= least:
                part = own[k:end]
                got = common(mask, size, part)
                if got >= least:
                    given = common(answer_mask, answer, part) / answer if answer else 0.0
                    if got / size >= COPY or given >= ANSWER:
                        best, least = (got / size, given, at), got + 1
            held -= code in mask and counts[code] <= mask[code].bit_count()
            counts[code] -= 1
        return best


@dataclass
class Rare:
    """The rarest words of each item, and how many of them a hit holds at least.

    A hit holds ``PARAPHRASE`` of the item's words in a stretch half as long
    again, so of any words of the item it lacks at most the other share.
    """

    starts: np.ndarray
    item: np.ndarray
    places: np.ndarray
    need: np.ndarray
    steps: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray], counts: np.ndarray) -> Rare:
        terms, owner, places, need = [], [], [], []
        for i, codes in enumerate(items):
            own, times = np.unique(codes, return_counts=True)
            order = np.argsort(counts[own], kind="stable")
            missing = len(codes) - int(np.ceil(PARAPHRASE * len(codes) - 1e-9))
            taken = np.cumsum(times[order])
            last = min(int(np.searchsorted(taken, missing + max(3, len(codes) // 6))), len(own) - 1)
            need.append(int(taken[last]) - missing)
            terms.append(own[order[: last + 1]])
            places.append(times[order[: last + 1]])
            owner.append(np.full(last + 1, i))
        term, sizes = np.concatenate(terms), np.array(list(map(len, items)))
        by_term = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[by_term], np.arange(len(counts) + 1))
        stretch = -(-3 * sizes // 2)
        return cls(starts, np.concatenate(owner)[by_term], np.concatenate(places)[by_term], np.array(need), -(-stretch // STEP) + 1,
                   -(-sizes // STEP) + 2, (sizes + STEP - 1) // STEP)

    def windows(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last window) wherever so many words are together; documents are told apart by the caller."""
        first = self.starts[codes]
        size = self.starts[codes + 1] - first
        place = np.flatnonzero(size)
        if not len(place):
            return
        size = size[place]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first[place] - (ends - size), size)
        span = len(codes) // STEP + int(self.steps.max()) + 1  # apart by item
        key = self.item[at] * np.int64(span) + np.repeat(place // STEP, size)
        order = np.argsort(key, kind="stable")
        key, sums = key[order], np.concatenate(([0], np.cumsum(self.places[at[order]])))
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key = key[begin]
        sums = sums[np.append(begin, len(order))]
        item = key // span
        upto = np.searchsorted(key, key + self.steps[item])
        held = sums[upto] - sums[: len(key)]
        for k in np.flatnonzero(held >= self.need[item]).tolist():
            i, step = int(item[k]), int(key[k] % span)
            yield i, step - int(self.before[i]), step + int(self.after[i])


def regions(pairs: set[tuple[int, int]], owner: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, first, last window) of candidate windows of one document whose surroundings touch."""
    open_: tuple[int, int, int] | None = None
    for item, w in sorted((item, w) for w, item in pairs):
        if open_ and open_[0] == item and owner[open_[2]] == owner[w] and (w - open_[2]) * STEP <= WINDOW + 2 * len(items.codes[item]):
            open_ = (item, open_[1], w)
            continue
        if open_:
            yield open_
        open_ = (item, w, w)
    if open_:
        yield open_


def find(docs: list[np.ndarray], space: Space, targets: np.ndarray, checker: Checker, rare: Rare) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(document, item, cosine, share, answer share, first word) of the best hit of each pair."""
    best: dict[tuple[int, int], tuple] = {}
    sizes = np.array(list(map(len, checker.items.codes)), np.int64)
    for codes, owner in _chunks(docs, STEP):
        first = np.searchsorted(owner, owner, "left")
        after = np.searchsorted(owner, owner, "right")
        pairs = set()
        for item, low, high in rare.windows(codes):
            # the step that the stretch begins at names the document; a stretch over two documents is a candidate that fails
            at = low + int(rare.before[item])
            pairs.update((w, item) for w in range(max(low, int(first[at])), min(high + 1, int(after[at]))))
        place = np.flatnonzero(space.searched[codes])
        if not len(place) and not pairs:
            continue
        steps = np.zeros((len(owner), space.fold.shape[1]), np.float32)
        if len(place):
            step = place // STEP
            begin = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
            steps[step[begin]] = np.add.reduceat(space.fold[codes[place]], begin, axis=0)
        joined = np.flatnonzero(owner[1:] == owner[:-1])
        windows = steps.copy()
        windows[joined] += steps[joined + 1]
        near = unit(windows) @ targets.T
        pairs.update(map(tuple, np.argwhere(near >= COSINE).tolist()))
        found = np.array(list(regions(pairs, owner, checker.items)), np.int64).reshape(-1, 3)
        size = sizes[found[:, 0]]
        start = (found[:, 1] - first[found[:, 1]]) * STEP - size
        stop = start + (found[:, 2] - found[:, 1]) * STEP + WINDOW + 2 * size
        begins, ends = first[found[:, 1]] * STEP, after[found[:, 1]] * STEP  # of the document
        kept = checker.enough(codes, found[:, 0], begins + np.maximum(start, 0), np.minimum(begins + stop, ends))
        for (item, begin, end), low, high in zip(found[kept].tolist(), start[kept].tolist(), stop[kept].tolist(), strict=True):
            doc = int(owner[begin])
            if best.get((doc, item), (0.0,))[0] == 1.0:  # nothing can be closer
                continue
            hit = checker.check(item, docs[doc], max(0, low), high)
            if hit:
                cosine = float(near[begin : end + 1, item].max())
                if (hit[0], cosine) > best.get((doc, item), (0.0, 0.0))[:2]:
                    best[doc, item] = (hit[0], cosine, hit[1], hit[2])
    for (doc, item), (share, cosine, given, start) in best.items():
        yield doc, item, cosine, share, given, start


def find_short(codes: np.ndarray, short: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(short item, first word) of the first place where the words of an item follow one another."""
    for size in {len(s) for s in short}:
        if len(codes) < size:
            continue
        own = [i for i, s in enumerate(short) if len(s) == size]
        # sums of odd multiples name a sequence of words, up to chance, which the words themselves rule out
        factors = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, size + 1, dtype=np.uint64)
        names = np.array([(short[i].astype(np.uint64) * factors).sum(dtype=np.uint64) for i in own])
        order = np.argsort(names, kind="stable")
        runs = np.lib.stride_tricks.sliding_window_view(codes.astype(np.uint64), size)
        keys = (runs * factors).sum(axis=1, dtype=np.uint64)
        some = np.flatnonzero(np.isin(keys, names))
        seen = set()
        low, high = (np.searchsorted(names[order], keys[some], side) for side in ("left", "right"))
        for at, a, b in zip(some.tolist(), low.tolist(), high.tolist(), strict=True):
            for i in (own[o] for o in order[a:b]):
                if i not in seen and (codes[at : at + size] == short[i]).all():
                    seen.add(i)
                    yield i, at


def _short_hits(coded: DataFrame, items: Items) -> DataFrame:
    kind, short = coded.schema["id"].dataType.simpleString(), items.short

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, i, at) for row, codes in enumerate(_coded(batch)) for i, at in find_short(codes, short)]
            at = pa.array([f[0] for f in found], pa.int64())
            starts = batch.column(1).take(at).to_numpy(zero_copy_only=False) + np.array([f[2] for f in found], np.int64)
            columns = [batch.column(0).take(at), pa.array([f[1] for f in found], pa.int32()), pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "item", "start_word"])

    found = map_batches(coded, work, f"id {kind}, item int, start_word bigint").groupBy("id", "item").agg(F.min("start_word").alias("start_word"))
    none = F.lit(None).cast("double")
    return found.select("id", "item", F.struct(none.alias("cosine"), F.lit(1.0).alias("lcs_share"), none.alias("answer_share"), "start_word").alias("b"))


def hits_of_block(docs: DataFrame, rows: list[tuple], id_col: str, text_col: str, item_type: str) -> DataFrame | None:
    items = Items.of(rows)
    if not items.vocabulary:
        return None
    coded = code_documents(docs, items, id_col, text_col)
    hits = ([_long_hits(coded, items)] if items.ids else []) + ([_short_hits(coded, items)] if items.short else [])
    parts = []
    for ids, each in zip([i for i in (items.ids, items.short_ids) if i], hits, strict=True):
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item int, name {item_type}")
        parts.append(each.join(names, "item").select("id", F.col("name").alias("item"), "b.*"))
    return reduce(DataFrame.unionByName, parts)


def _long_hits(coded: DataFrame, items: Items) -> DataFrame:
    space = latent_space(coded, items)
    targets = np.stack([space.item(c) for c in items.codes])
    rare = Rare.of(items.codes, space.counts)
    shared = coded.sparkSession.sparkContext.broadcast((items, space, targets, rare))  # a block of items has a bound
    kind = coded.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space, targets, rare = shared.value
        checker = Checker(items)
        for batch in batches:
            found = list(find(_coded(batch), space, targets, checker, rare))
            at = pa.array([f[0] for f in found], pa.int64())
            starts = batch.column(1).take(at).to_numpy(zero_copy_only=False) + np.array([f[5] for f in found], np.int64)
            columns = [batch.column(0).take(at), pa.array([f[1] for f in found], pa.int32())]
            columns += [pa.array([f[i] for f in found], pa.float64()) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64())], ["id", "item", "cosine", "lcs_share", "answer_share", "start_word"])

    found = map_batches(coded, work, f"id {kind}, item int, cosine double, lcs_share double, answer_share double, start_word bigint")
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_share", "start_word"), F.struct("lcs_share", "cosine", -F.col("start_word")))
    return found.groupBy("id", "item").agg(best.alias("b"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each document and item found in it: the shares, the cosine, the first word of the stretch."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where(F.length("text") > 0)
    item_type = items.schema["item"].dataType.simpleString()
    count, words = items.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    blocks = max(1, -(-count // item_block), -(-(words or 0) // (item_block * BLOCK_WORDS)))
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text")
        found = hits_of_block(docs, [(r.item, r.text) for r in own.collect()], id_col, text_col, item_type)
        if found is not None:
            parts.append(found)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"id {kind}, item {item_type}, cosine double, lcs_share double, answer_share double, start_word bigint"
    out = spark.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    way = F.when(F.col("cosine").isNull(), "short").when(F.col("lcs_share") >= COPY, "copy").otherwise("paraphrase")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), way.alias("kind"), "cosine", "lcs_share", "answer_share", "start_word")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``docs`` without those that hold a benchmark item, with their columns; an item of a few words counts only if ``short`` is set."""
    found = contaminated(docs, benchmark, id_col, text_col)
    gone = found if short else found.where("kind != 'short'")
    gone = by_rows(written(gone.select(F.col(f"`{id_col}`").alias("__hit")).distinct(), "contaminated"))
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__hit")), "left_anti")
