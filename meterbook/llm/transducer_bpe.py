"""BPE encoding and decoding with a transducer lexicon.

The frequent words of the corpus, counted over all documents, are encoded once
and compiled into a minimal acyclic transducer: words share prefixes and
suffixes, and the outputs along a word's path add up to its number, under
which its ids lie in a table.  The file is put into the shared folder, Spark
hands it to every executor, and tasks memory-map it.  Words that are not in it
are merged exactly, rank by rank; many words are merged side by side.

A text is cut at ASCII white space, which no token crosses.  Pieces of ASCII
and Latin-1 letters are lower-cased and cut here; all others go through the
normaliser and cutter of the tokenizer file itself.  Some texts go at once:
each of their different pieces is cut once, and each different word looked up
or merged once, as columns; nothing is remembered from one lot to the next.

Defined results: null and empty texts have no tokens and decode to an empty
text; texts of any length are encoded whole; strings of special tokens in a
text become their ids, as the library does; ids, repeated rows and a table
without rows are passed through; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.llm.common import BATCH_ROWS, map_batches, written
from meterbook.session import shared_dir

#: The lexicon holds at most so many words (a few MB); it changes the speed only.
LEXICON_WORDS = 65_536
MIN_COUNT = 2
#: Pieces and words that an encoder of ``elias_fano`` remembers before it starts anew.
MEMORY = 350_000
#: Bytes of the texts that go at once (one batch at least), and words merged side by side.
LOT_BYTES = 2 << 20
MERGED_WORDS = 1 << 14
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿ]+|[0-9]|[^a-zßà-öø-ÿ0-9]+")
#: Kind of each byte of a piece that is cut without patterns: 1 letter, 2 digit, 3 other, 0 none of these; bytes from 128 on follow 0xC3 (Latin-1 letters).
_KINDS = np.zeros(256, np.uint8)
_KINDS[33:127] = 3
_KINDS[[*range(65, 91), *range(97, 123), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]] = 1
_KINDS[48:58] = 2
_KINDS[ord("'")] = 0
#: First byte of what stands for a special token among the words; no word begins with it.
_SPECIAL = 0xFF
_MAGIC = b"MBLEX001"
_ARRAYS = (("keys", np.uint64), ("targets", np.uint32), ("outputs", np.uint32), ("finals", np.uint8), ("offsets", np.uint32), ("ids", np.uint32))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts or bytes without nulls, and where its values begin (and the last one ends)."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _column(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The column that ``_flat`` takes apart; ``bounds`` are in bytes."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers)


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these starts and sizes, one run after the other."""
    return np.repeat(starts - _bounds(sizes)[:-1], sizes) + np.arange(sizes.sum())


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different pieces of texts, which of them follow each other, and where those of each text begin; some pieces may be empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = lists.values.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), lists.offsets.to_numpy()


class Vocabulary:
    """Symbols and merges of a tokenizer file, and how a piece of text becomes words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        model = found["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        names = vocab | self.special
        self.names = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name.encode()
        self.spaced = pa.array([name + b" " for name in self.names], pa.large_binary())
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int64)
        self.pair_ids = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.no_rank = len(pairs)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def cut(self, pieces: list[bytes]) -> list[list[str | int]]:
        """Words of each piece; a special token as its id.  Pieces hold no line end, so they are decoded and lower-cased as one text."""
        if not pieces:
            return []
        whole = b"\n".join(pieces).decode("utf-8", "replace")
        simple, parts = _SIMPLE.fullmatch, _PARTS.findall
        return [
            parts(low) if simple(text) and "<|" not in text else self._cut_by_library(text)
            for text, low in zip(whole.split("\n"), whole.lower().split("\n"), strict=True)
        ]

    def _cut_by_library(self, text: str) -> list[str | int]:
        out: list[str | int] = []
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
                out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in cut if w]
        return out

    def words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Different words of pieces, which of them follow each other, where those of each piece begin, and the place each piece has there.

        A special token is ``_SPECIAL`` and its id.
        """
        data, bounds = _flat(pieces)
        sizes = np.diff(bounds)
        kinds, lead, tail = _KINDS[data], data == 0xC3, data & 0xC0 == 0x80
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        hard = (kinds == 0) | (tail != (after & ~first[:-1])) | (lead & first[1:])
        hard[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        plain = np.diff(_bounds(hard)[bounds]) == 0
        begins = first[:-1] | (kinds == 2)
        begins[1:] |= kinds[1:] != kinds[:-1]
        low = data + (((data >= 65) & (data <= 90)) | (tail & (data <= 0x9E))).astype(np.uint8) * np.uint8(32)
        inside = np.repeat(plain, sizes)
        low, begins = low[inside], begins[inside]
        met = _column(low, np.append(np.flatnonzero(begins), len(low)))
        counts = np.diff(_bounds(begins)[_bounds(sizes[plain])])
        cut = self.cut(pieces.filter(pa.array(~plain)).cast(pa.binary()).to_pylist())
        special = {i: bytes([_SPECIAL]) + i.to_bytes(4, "little") for i in self.special.values()}
        rest = pa.array([w.encode() if isinstance(w, str) else special[w] for parts in cut for w in parts], pa.large_binary())
        found = pa.concat_arrays([met, rest]).dictionary_encode()
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(pieces))
        return found.dictionary, found.indices.to_numpy(), _bounds(np.concatenate((counts, np.array([len(c) for c in cut], np.int64)))), place

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.no_rank)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (none is empty)."""
        ids, bounds = self.merge_side_by_side(*_flat(pa.array(words, pa.large_binary())))
        return np.split(ids, bounds[1:-1]) if words else []

    def merge_side_by_side(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and where those of each begin: the pair of lowest rank is merged first, the leftmost of equal ones.

        All words go side by side, one merge of each in a round; a word without a pair to merge is done.
        """
        if not len(data):
            return np.empty(0, np.uint32), bounds
        sizes, ends = np.diff(bounds), bounds[1:]
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        ranks = np.full(len(symbols), self.no_rank, np.int64)
        ranks[:-1] = self._rank(symbols[:-1], symbols[1:])
        ranks[ends - 1] = self.no_rank
        live = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            least = np.minimum.reduceat(ranks, starts)
            open_ = least < self.no_rank
            if not open_.all():
                inside = np.repeat(open_, sizes)
                done.append((live[~open_], sizes[~open_], symbols[~inside].astype(np.uint32)))
                symbols, ranks = symbols[inside], ranks[inside]
                live, sizes, least = live[open_], sizes[open_], least[open_]
                if not len(live):
                    break
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            owner = np.repeat(np.arange(len(live)), sizes)[hits]
            first = hits[np.concatenate(([True], owner[1:] != owner[:-1]))]
            symbols[first] = self.pair_ids[least]
            stay = np.ones(len(symbols), bool)
            stay[first + 1] = False
            symbols, ranks = symbols[stay], ranks[stay]
            first = first - np.arange(len(first))
            sizes = sizes - 1
            ends = np.cumsum(sizes) - 1
            starts = ends - sizes + 1
            after = np.minimum(first + 1, len(symbols) - 1)
            ranks[first] = np.where(first < ends, self._rank(symbols[first], symbols[after]), self.no_rank)
            before = first[first > starts] - 1
            ranks[before] = self._rank(symbols[before], symbols[before + 1])
        return _in_order(done, len(bounds) - 1)


def _in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, and where those of each begin, from parts: places of words, numbers of ids, ids."""
    sizes = np.zeros(count, np.int64)
    for at, own, _ in parts:
        sizes[at] = own
    bounds = _bounds(sizes)
    out = np.empty(bounds[-1], np.uint32)
    for at, own, ids in parts:
        out[_runs(bounds[at], own)] = ids
    return out, bounds


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1


def compile_lexicon(words: Iterable[bytes], vocabulary: Vocabulary) -> bytes:
    """The transducer of the words, with their ids, as one file.

    Words come in sorted order, so everything but the last path is final and
    is replaced by an equal state where there is one: the automaton is minimal.
    """
    words = sorted(set(words) - {b""})
    root, known, path, last = _State(), {}, [], b""

    def settle(keep: int) -> None:
        while len(path) > keep:
            parent, label, child = path.pop()
            key = (child.final, *((c, id(s)) for c, s in child.arcs.items()))
            parent.arcs[label] = known.setdefault(key, child)

    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(common)
        state = path[-1][2] if path else root
        for label in word[common:]:
            child = _State()
            state.arcs[label] = child
            path.append((state, label, child))
            state = child
        state.final = True
        last = word
    settle(0)
    states, counts = [root], {}
    root.number = 0
    for state in states:
        for child in state.arcs.values():
            if child.number < 0:
                child.number = len(states)
                states.append(child)
    work = [(root, False)]
    while work:
        state, ready = work.pop()
        if ready:
            counts[state.number] = state.final + sum(counts[c.number] for c in state.arcs.values())
        elif state.number not in counts:
            work.append((state, True))
            work.extend((c, False) for c in state.arcs.values() if c.number not in counts)
    keys, targets, outputs = [], [], []
    for state in states:
        seen = int(state.final)
        for label in sorted(state.arcs):
            child = state.arcs[label]
            keys.append(state.number << 8 | label)
            targets.append(child.number)
            outputs.append(seen)
            seen += counts[child.number]
    ids = vocabulary.merge(words)
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    arrays = (keys, targets, outputs, [s.final for s in states], offsets, np.concatenate(ids) if ids else [])
    blobs = [np.asarray(a, dtype).tobytes() for a, (_, dtype) in zip(arrays, _ARRAYS, strict=True)]
    blobs = [b + b"\0" * (-len(b) % 8) for b in blobs]
    head = np.array([len(a) for a in arrays], np.uint64).tobytes()
    return b"".join([_MAGIC, head, *blobs])


class Lexicon:
    """A memory-mapped transducer; looks up many words side by side."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError(f"not a lexicon: {path}")
        at = 8 + 8 * len(_ARRAYS)
        for (name, dtype), size in zip(_ARRAYS, raw[8:at].view(np.uint64).tolist(), strict=True):
            length = size * np.dtype(dtype).itemsize
            setattr(self, name, raw[at : at + length].view(dtype))
            at += length + (-length % 8)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where it is not in the lexicon."""
        return self.find(*_flat(pa.array(words, pa.large_binary())))

    def find(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of each word of a column, -1 where it is not in the lexicon."""
        sizes, starts = np.diff(bounds), bounds[:-1]
        found = np.full(len(sizes), -1, np.int64)
        if not len(sizes) or not len(self.keys):
            return found
        flat = np.append(data, np.uint8(0)).astype(np.uint64)
        live, state, total = np.arange(len(sizes)), np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64)
        depth = 0
        while len(live):
            done = sizes[live] == depth
            ended = done & (self.finals[state] == 1)
            found[live[ended]] = total[ended]
            live, state, total = live[~done], state[~done], total[~done]
            key = state << np.uint64(8) | flat[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            state, total = self.targets[at].astype(np.uint64), total[hit] + self.outputs[at]
            depth += 1
        return found

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]

    def ids_of_all(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all."""
        starts = self.offsets[numbers].astype(np.int64)
        sizes = self.offsets[numbers + 1] - starts
        return sizes, self.ids[_runs(starts, sizes)]


class Encoder:
    """Encodes texts by lexicon and merges; holds the different words of the last texts, and their ids."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        """Drop the last words; the vocabulary and the lexicon stay for the worker's next task."""
        self.words, self.ids = pa.array([], pa.large_binary()), np.empty(0, np.uint32)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Look up or merge words; returns where the ids of each begin."""
        data, bounds = _flat(words)
        starts, sizes = bounds[:-1], np.diff(bounds)
        special = data[starts] == _SPECIAL
        numbers = np.full(len(words), -1) if self.lexicon is None else self.lexicon.find(data, bounds)
        met, marks, unseen = np.flatnonzero(numbers >= 0), np.flatnonzero(special), np.flatnonzero((numbers < 0) & ~special)
        parts = [(marks, np.ones(len(marks), np.int64), data[_runs(starts[marks] + 1, sizes[marks] - 1)].view(np.uint32))]
        if len(met):
            parts.append((met, *self.lexicon.ids_of_all(numbers[met])))
        for i in range(0, len(unseen), MERGED_WORDS):
            some = unseen[i : i + MERGED_WORDS]
            ids, ends = self.vocabulary.merge_side_by_side(data[_runs(starts[some], sizes[some])], _bounds(sizes[some]))
            parts.append((some, np.diff(ends), ids))
        self.words, (self.ids, ends) = words, _in_order(parts, len(words))
        return ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where those of each begin."""
        pieces, follow, begin = _pieces(texts)
        words, codes, cuts, place = self.vocabulary.words(pieces)
        ends = self._learn(words)
        data, ends = _flat(_column(self.ids, 4 * ends).take(pa.array(codes)))
        data, ends = _flat(_column(data, ends[cuts]).take(pa.array(place[follow])))
        return data.view(np.uint32), ends[begin] // 4

    def shown(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded texts, each followed by a space if it has ids, and where each begins."""
        data, places = _flat(self.vocabulary.spaced.take(pa.array(ids)))
        return data, places[bounds]


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The library's decoding without a decoder: token texts joined by spaces."""
    return b" ".join([vocabulary.names[i] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _encoder(vocabulary_path: str, lexicon: str) -> Encoder:
    """One encoder for each Python worker and lexicon."""
    key = (vocabulary_path, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(_vocabulary(vocabulary_path), Lexicon(SparkFiles.get(lexicon)))
    return _ENCODERS[key]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``LOT_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > LOT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def count_words(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents; a task adds up what it has before it sends it."""
    own = docs.select(F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(vocabulary_path)
        for lot in _lots(batches):
            pieces, follow, _ = _pieces(lot.column(0))
            words, codes, cuts, place = vocabulary.words(pieces)
            times = np.bincount(place[follow], minlength=len(pieces))
            n = np.bincount(codes, np.repeat(times, np.diff(cuts)), len(words)).astype(np.int64)
            data, bounds = _flat(words)
            keep = pa.array(data[bounds[:-1]] != _SPECIAL)
            yield pa.RecordBatch.from_arrays([words.filter(keep).cast(pa.binary()).cast(pa.string()), pa.array(n).filter(keep)], ["word", "n"])

    return map_batches(own, work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file to the shared folder and have Spark hand it to every executor; returns its name there."""
    name = f"{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


def build_lexicon(docs: DataFrame, vocabulary_path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words; returns the name of the handed-out file."""
    return put_file(docs.sparkSession, "lexicon", compile_lexicon(frequent_words(docs, vocabulary_path, text_col, most), Vocabulary(vocabulary_path)))


def frequent_words(docs: DataFrame, vocabulary_path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` words, down to one level of frequency.

    The level is found from a histogram of a few hundred rows, so no task sends more than its share of the words taken.
    """
    counted = count_words(docs, vocabulary_path, text_col).where(F.col("n") >= MIN_COUNT).withColumn("level", F.floor(F.log2("n") * 16))
    counted = written(counted, "word-counts")
    total, least = 0, None
    for row in sorted(counted.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        total += row.words
        if total > most:
            break
        least = row.level
    if least is None:
        return []
    return [r.word.encode() for r in counted.where(F.col("level") >= least).select("word").collect()]


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """id, ids (little-endian 32 bit) and decoded text of every document."""
    lexicon = build_lexicon(docs, vocabulary_path, text_col, most)
    return _encoded(docs, vocabulary_path, lexicon, id_col, text_col, digests=False)


def digest_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """id, n_tokens and SHA-256 of ids and decoded text; the same work, with digests made where the ids are."""
    lexicon = build_lexicon(docs, vocabulary_path, text_col, most)
    return _encoded(docs, vocabulary_path, lexicon, id_col, text_col, digests=True)


def _encoded(docs: DataFrame, vocabulary_path: str, lexicon: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = _encoder(vocabulary_path, lexicon), int(BATCH_ROWS)
        for lot in _lots(batches):
            ids, at = encoder.encode(lot.column(1))
            data, ends = encoder.shown(ids, at)
            tokens = [memoryview(ids)[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            decoded = [memoryview(data)[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            for i in range(0, len(lot), step):
                part, left, right = lot.column(0).slice(i, step), tokens[i : i + step], decoded[i : i + step]
                if digests:
                    columns = [pa.array(list(map(len, left)), pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in side], pa.string()) for side in (left, right))]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    columns = [pa.array([x.tobytes() for x in left], pa.binary()), pa.array([x.tobytes() for x in right], pa.binary()).cast(pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part, *columns], ["id", *names])
        encoder.forget()

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return map_batches(own, work, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
