"""Token ids in binary files, with document boundaries in Elias-Fano form.

A file holds the ids of a run of documents one after the other, and behind
them two non-decreasing sequences in Elias-Fano form: the boundaries of the
documents and their doc ids.  Each value is cut into low bits, which are
stored as they are, and high bits, which are stored as gaps in unary: about two
bits plus the low bits per value.  A select over the unary part, helped by the
place of every 256th value, returns an offset without a table of 64-bit
numbers.

File: magic, ids (16 or 32 bit, little-endian), boundaries, doc ids, footer
(number of null doc ids, smallest doc id, width, places of the parts), length
of the footer.

Documents are sorted by id over all files (ties by text; null ids first), one
file for each part of the sorted table, written under a name of its own and
then renamed, so a task that runs again replaces its file by an equal one.

Defined results: null and empty texts have the end id only; repeated rows are
written each; a table without rows writes no documents; other columns are not
read, whatever their names.  Doc ids are whole numbers.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterbook.llm.common import map_batches, texts_of, written
from meterbook.llm.transducer_bpe import Vocabulary
from meterbook.session import scratch_path

_MAGIC = b"MBIDS001"
_FOOTER = "<QQqBQQQ"
_HEAD = "<QQB"
_SAMPLE = 256
_READ_IDS = 1 << 20
END_ID = 2
#: Pieces, and words, a task remembers before it starts anew.
MEMORY = 300_000


class EliasFano:
    """A non-decreasing sequence of whole numbers."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.places = count, low_bits, low, high, places

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """The sequence as bytes; the first value may be anything from zero."""
        values = np.asarray(values, np.uint64)
        count = len(values)
        largest = int(values[-1]) if count else 0
        low_bits = max(0, (largest // count).bit_length() - 1) if count else 0
        low = np.zeros(-(-count * low_bits // 64) + 1, np.uint64)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
            packed = np.packbits(bits, bitorder="little")
            low.view(np.uint8)[: len(packed)] = packed
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        high = np.zeros((int(ones[-1]) + 1 if count else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        places = ones[::_SAMPLE].astype(np.uint64)
        head = struct.pack(_HEAD, count, len(high), low_bits)
        return b"".join([head, low.tobytes(), high.tobytes(), places.tobytes()])

    @classmethod
    def decode(cls, data: bytes) -> EliasFano:
        count, high_words, low_bits = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        low_words = -(-count * low_bits // 64) + 1
        low = np.frombuffer(data, np.uint64, low_words, at)
        high = np.frombuffer(data, np.uint64, high_words, at + 8 * low_words)
        return cls(count, low_bits, low, high, np.frombuffer(data, np.uint64, -(-count // _SAMPLE), at + 8 * (low_words + high_words)))

    def select(self, i: int) -> int:
        """Place of the i-th one of the unary part: from the sampled place on, word by word."""
        place = int(self.places[i // _SAMPLE])
        left = i % _SAMPLE
        word = place >> 6
        bits = int(self.high[word]) >> (place & 63) << (place & 63)
        while left >= bits.bit_count():
            left -= bits.bit_count()
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return (word << 6) + (bits & -bits).bit_length() - 1

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        at = i * self.low_bits
        pair = int(self.low[at >> 6]) | (int(self.low[(at >> 6) + 1]) << 64 if (at & 63) + self.low_bits > 64 else 0)
        return pair >> (at & 63) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        return self.select(i) - i << self.low_bits | self._low(i)

    def run(self, start: int, stop: int) -> list[int]:
        """Values ``start`` to ``stop``: the first is selected, the others are the ones that follow it."""
        if start >= stop:
            return []
        place = self.select(start)
        word = place >> 6
        bits = int(self.high[word]) >> (place & 63) << (place & 63)
        out = []
        for i in range(start, stop):
            while not bits:
                word += 1
                bits = int(self.high[word])
            out.append((word << 6) + (bits & -bits).bit_length() - 1 - i << self.low_bits | self._low(i))
            bits &= bits - 1
        return out


class Words(dict):
    """Ids of a word as bytes, made by the library's model when they are first asked for; of a special token by its number."""

    def __init__(self, vocabulary: Vocabulary, kind: np.dtype):
        super().__init__()
        self.model = vocabulary.tokenizer.model
        self.letters = {b: ord(c) for c, b in vocabulary.byte_of.items()}
        self.codes = [i.to_bytes(kind.itemsize, "little") for i in range(len(vocabulary.names))]

    def __missing__(self, word: str | int) -> bytes:
        codes = self.codes
        if isinstance(word, int):
            return codes[word]
        # printable ASCII stands for itself
        spelt = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        ids = self[word] = b"".join([codes[t.id] for t in self.model.tokenize(spelt)])
        return ids


class PieceEncoder:
    """The tokenizers library, word by word.

    No token crosses ASCII white space, so a piece that was met before is looked
    up; the words of a new one go through the library's normaliser and cutter
    (plain letters are cut here, as they would) and its model.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.kind = np.dtype("<u2" if len(self.vocabulary.names) <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.words = Words(self.vocabulary, self.kind)

    def learn(self, pieces: set[bytes]) -> None:
        known = self.known
        if len(known) > MEMORY:  # what this batch needs stays
            known = self.known = {p: known[p] for p in pieces if p in known}
        if len(self.words) > MEMORY:
            self.words.clear()
        new, word, join = list(pieces.difference(known)), self.words.__getitem__, b"".join
        plain = list(filter(bytes.isalpha, new))  # letters alone, which are one word
        if plain:
            known.update(zip(plain, map(word, b"\n".join(plain).lower().decode().split("\n")), strict=True))
        rest = [p for p in new if p not in known]
        known.update(zip(rest, [join(map(word, parts)) for parts in self.vocabulary.cut(rest)], strict=True))

    def batch(self, texts: list[bytes]) -> Iterator[bytes]:
        collects = gc.isenabled()
        gc.disable()  # millions of lists and bytes in no cycles, which a collection would walk through for nothing
        try:
            cut = [t.split() for t in texts]
            self.learn(set().union(*cut))
        finally:
            if collects:
                gc.enable()
        ids = self.known.__getitem__
        for parts in cut:
            yield b"".join(map(ids, parts))


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, path: str, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files into ``path`` and return a written table (part, file, documents, ids)."""
    own = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # rows of one id can be parted by the hash of their text, so a hot id does not fill one file
    ordered = own.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = _encoder(vocabulary_path)
        end = np.array([end_id], encoder.kind).tobytes()
        system, folder = _store(path)
        system.create_dir(folder, recursive=True)
        name = f"part-{part:06d}.ids"
        draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
        sizes, keys, nulls = [0], [], 0
        with system.open_output_stream(draft, compression=None) as out:
            out.write(_MAGIC)
            for batch in batches:
                ids = batch.column(0)
                nulls += ids.null_count
                keys.append(ids.drop_null().to_numpy(zero_copy_only=False))
                for data in encoder.batch(texts_of(batch)):
                    out.write(data + end)
                    sizes.append(len(data) // encoder.kind.itemsize + 1)
            starts = np.cumsum(np.array(sizes, np.int64))
            known = np.concatenate(keys) if keys else np.empty(0, np.int64)
            least = int(known[0]) if len(known) else 0
            bounds, names = EliasFano.encode(starts), EliasFano.encode((known - least).astype(np.uint64))
            footer = struct.pack(_FOOTER, len(sizes) - 1, nulls, least, encoder.kind.itemsize, int(starts[-1]), len(bounds), len(names))
            out.write(bounds + names + footer)
        if len(sizes) == 1:
            system.delete_file(draft)
            return
        system.move(draft, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(sizes) - 1], pa.int64()), pa.array([int(starts[-1])], pa.int64())],
            ["part", "file", "documents", "ids"],
        )

    return written(map_batches(ordered, work, "part int, file string, documents bigint, ids bigint"), "manifest")


class IdFile:
    """Reader of one file; ids are read where they are asked for."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(8, 0) != _MAGIC:
            raise ValueError(f"not an id file: {path}")
        self.documents, self.nulls, self.least, width, self.ids, bounds, names = struct.unpack(
            _FOOTER, self.file.read_at(struct.calcsize(_FOOTER), size - struct.calcsize(_FOOTER))
        )
        self.kind = np.dtype(f"<u{width}")
        at = len(_MAGIC) + self.ids * width
        self.bounds = EliasFano.decode(self.file.read_at(bounds, at))
        self.names = EliasFano.decode(self.file.read_at(names, at + bounds))

    def read(self, start: int, stop: int) -> np.ndarray:
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, len(_MAGIC) + start * width), self.kind)

    def document(self, i: int) -> np.ndarray:
        return self.read(self.bounds[i], self.bounds[i + 1])

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        """Ids of documents ``start`` to ``stop``; null ids come first."""
        nulls = self.nulls
        return [None] * (min(stop, nulls) - min(start, nulls)) + [n + self.least for n in self.names.run(max(start - nulls, 0), max(stop - nulls, 0))]

    def stretches(self) -> Iterator[tuple[list[int | None], list[int], np.ndarray]]:
        """(doc ids, boundaries, ids) of up to ``_SAMPLE`` documents at a time, of about a million ids or one document."""
        at = 0
        while at < self.documents:
            bounds = self.bounds.run(at, min(at + _SAMPLE, self.documents) + 1)
            taken = max(1, bisect_right(bounds, bounds[0] + _READ_IDS) - 1)
            bounds = bounds[: taken + 1]
            yield self.doc_ids(at, at + taken), bounds, self.read(bounds[0], bounds[-1])
            at += taken


def read_offsets(manifest: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files."""
    files = max(1, manifest.count())
    # one row for each file
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids")
    listed = manifest.select("part", "file", before.alias("before")).repartition(files, "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                found = IdFile(system, f"{folder}/{row['file']}")
                for names, bounds, ids in found.stretches():
                    data = memoryview(ids.astype("<u4").tobytes())
                    own = [4 * (b - bounds[0]) for b in bounds]
                    starts = [b + row["before"] for b in bounds[:-1]]
                    sizes = [b - a for a, b in pairwise(bounds)]
                    sums = [zlib.crc32(data[a:b]) for a, b in pairwise(own)]
                    columns = [pa.array(x, pa.int64()) for x in (names, starts, sizes, sums)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32"])

    return map_batches(listed, work, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def store_and_read(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    return read_offsets(write_files(docs, path, vocabulary_path, id_col, text_col), path, id_col)
