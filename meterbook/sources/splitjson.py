"""Large JSON documents read by many tasks, split by byte range at the borders of their elements.

A document is one object; its fields are single values or arrays of elements.
A byte range of it cannot be read without knowing where it begins: inside a text
or not, and how deep.  Both come from a first pass, in which every range tells
what it does to either state, and these answers are put together over the ranges
of a file.  In the second pass every task reads the elements that begin in its
range, the last one beyond its end if need be, as lines of text files are read.

The state in front of a range is one of OUT, IN (inside a text) and ESCAPED
(inside a text, behind a backslash) with the depth of brackets.

A document too large for one writer is a folder of files that follow each other
by name (``parts``); its places and ranges are those of all its bytes.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterbook.session import stage, stage_table

SPLIT_BYTES = 32 << 20
OUT, IN, ESCAPED = range(3)
_TEXT = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_REST_OF_TEXT = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_OPENING, _CLOSING = re.compile(rb"[\[{]"), re.compile(rb"[\]}]")
_MARK = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["\[\]{},]', re.S)
_GAP = re.compile(rb"[ \t\r\n]*+")
_PARSE = json.JSONDecoder(strict=False).raw_decode
_LOOK_AHEAD = 1 << 16


def after(data: bytes, state: int) -> tuple[int, int]:
    """State behind a range and how much deeper it is, from the state in front of it."""
    at = 0
    if state == ESCAPED:
        if not data:
            return ESCAPED, 0
        at, state = 1, IN
    if b"\\" not in data:  # every quote begins or ends a text
        pieces = data[at:].split(b'"')
        bare = b"".join(pieces[state == IN :: 2])
        deeper = bare.count(b"[") + bare.count(b"{") - bare.count(b"]") - bare.count(b"}")
        return (IN if (len(pieces) - 1 + (state == IN)) % 2 else OUT), deeper
    if state == IN:
        end = _REST_OF_TEXT.match(data, at)
        if end is None:
            return _open_text(data, at), 0
        at = end.end()
    bare = _TEXT.sub(b"", data[at:])
    open_at = bare.find(b'"')
    if open_at >= 0:
        state, bare = _open_text(bare, open_at + 1), bare[:open_at]
    else:
        state = OUT
    return state, len(_OPENING.findall(bare)) - len(_CLOSING.findall(bare))


def _open_text(data: bytes, at: int) -> int:
    """State at the end of a text that does not end in ``data``: escaped behind an odd number of backslashes."""
    tail = len(data) - len(data[at:].rstrip(b"\\")) - at
    return ESCAPED if tail % 2 else IN


class _Document:
    """The bytes of a document, which is one file or several that follow each other; files are opened as they are read."""

    def __init__(self, path: str, files: list[tuple[str, int]] | None = None):
        self.opened, self.at_file = None, -1
        self.files = files or [(path, None)]
        if files is None:
            self.files = [(path, self._open(0).size())]
        self.begins = [0]
        for _, size in self.files:
            self.begins.append(self.begins[-1] + size)

    def _open(self, n: int):
        from pyarrow import fs

        if self.at_file != n:
            self.close()
            path = self.files[n][0]
            parts = urlsplit(path)
            if parts.scheme in ("", "file"):
                system, name = fs.LocalFileSystem(), unquote(parts.path)
            else:
                system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
            self.opened, self.at_file = system.open_input_file(name), n
        return self.opened

    def size(self) -> int:
        return self.begins[-1]

    def read_at(self, length: int, begin: int) -> bytes:
        out, end = [], min(begin + length, self.size())
        n = bisect_right(self.begins, begin) - 1
        while begin < end:
            to = min(end, self.begins[n + 1])
            if to > begin:
                out.append(self._open(n).read_at(to - begin, begin - self.begins[n]))
            begin, n = to, n + 1
        return out[0] if len(out) == 1 else b"".join(out)

    def close(self) -> None:
        if self.opened is not None:
            self.opened.close()
        self.opened, self.at_file = None, -1


class _Cursor:
    """Bytes of a document from a place on; more are read as they are needed."""

    def __init__(self, path: str, begin: int, length: int, files: list[tuple[str, int]] | None = None):
        self.file = _Document(path, files)
        self.whole, self.begin = self.file.size(), begin
        self.data, self.text, self.at = b"", "", 0
        self.more(length)

    def more(self, length: int = 0) -> bool:
        """Read on, at least as much again as there is from the cursor on; False at the end of the file."""
        begin, length = self.begin + len(self.data), max(length, _LOOK_AHEAD, len(self.data) - self.at)
        if begin >= self.whole:
            return False
        found = self.file.read_at(min(length, self.whole - begin), begin)
        # bytes as characters: whatever is not ASCII lies inside texts
        self.data, self.text = self.data + found, self.text + found.decode("latin-1")
        return True

    def peek(self) -> bytes:
        """The next byte that is not a space; empty at the end."""
        while True:
            self.at = _GAP.match(self.data, self.at).end()
            if self.at < len(self.data) or not self.more():
                return self.data[self.at : self.at + 1]

    def value(self) -> str | None:
        """The JSON value at the cursor, which moves behind it; None if there is none."""
        self.peek()
        while True:
            try:
                # parsed where it is: a copy of what follows would cost the rest of the range for each element
                end = _PARSE(self.text, self.at)[1]
                # a number may go on behind what has been read
                if self.data[end : end + 1] in (b",", b"]", b"}", b":", b" ", b"\n", b"\r", b"\t") or not self.more():
                    found, self.at = self.data[self.at : end], end
                    return found.decode("utf-8", "replace")
            except json.JSONDecodeError:
                if not self.more():
                    return None

    def first_border(self, size: int, state: int, depth: int) -> int | None:
        """Move behind the first comma between fields (returns 1) or elements of an array (returns 2) in the first ``size`` bytes."""
        if state != OUT:
            self.at = 1 if state == ESCAPED else 0
            while (rest := _REST_OF_TEXT.match(self.data, self.at)) is None:
                if not self.more():
                    return None
            self.at = rest.end()
        plain = False  # inside an object at depth 2, whose fields are no elements
        while self.at < size:
            mark = _MARK.search(self.data, self.at)
            if mark is None or mark[0] == b'"':  # nothing more, or a text that goes on behind what is read
                self.at = mark.start() if mark else len(self.data)
                if self.at >= size or not self.more():
                    return None
                continue
            self.at = mark.end()
            if mark[0] in (b"{", b"["):
                depth += 1
            elif mark[0] in (b"}", b"]"):
                depth -= 1
                plain = plain and depth > 1
            elif mark[0] == b"," and mark.start() < size:
                if depth == 1:
                    return 1
                if depth == 2 and not plain:
                    behind = self.at
                    if self.value() is None:
                        return None
                    plain = self.peek() == b":"
                    self.at = behind
                    if not plain:
                        return 2
        return None


def elements(
    path: str, begin: int, end: int, state: int, depth: int, files: list[tuple[str, int]] | None = None
) -> Iterator[tuple[str, str | None, int, str | None]]:
    """(kind, field, place, text) of what belongs to a range: what follows the borders inside it.

    Kinds are ``array`` (a field with elements), ``element``, ``value`` (any other field) and ``broken`` (no JSON from
    here on).  The field of an element is null while its name lies in front of the range.
    """
    cursor, size = _Cursor(path, begin, end - begin + _LOOK_AHEAD, files), end - begin
    try:
        yield from _walk(cursor, size, state, depth)
    finally:
        cursor.file.close()


def _walk(cursor: _Cursor, size: int, state: int, depth: int) -> Iterator[tuple[str, str | None, int, str | None]]:
    def broken() -> tuple:
        return "broken", None, cursor.begin + cursor.at, None

    if cursor.begin:
        level = cursor.first_border(size, state, depth)
        if level is None:
            return
    else:
        if cursor.data[:3] == b"\xef\xbb\xbf":
            cursor.at = 3
        if cursor.peek() != b"{":
            yield broken()
            return
        cursor.at, level = cursor.at + 1, 1
        if cursor.peek() == b"}":
            cursor.at, level = cursor.at + 1, 0
    field = None
    while level:
        if level == 1:
            name = cursor.value() if cursor.peek() == b'"' else None
            if name is None or cursor.peek() != b":":
                yield broken()
                return
            field, cursor.at = json.loads(name, strict=False), cursor.at + 1
            if cursor.peek() == b"[":
                yield "array", field, cursor.begin + cursor.at, None
                cursor.at, level = cursor.at + 1, 2
                if cursor.peek() != b"]":
                    continue
        if level == 1 or cursor.peek() != b"]":
            cursor.peek()
            place = cursor.begin + cursor.at
            found = cursor.value()
            if found is None:
                yield broken()
                return
            yield ("value" if level == 1 else "element"), field, place, found
        mark = cursor.peek()
        if level == 2 and mark == b"]":
            cursor.at, level = cursor.at + 1, 1
            mark = cursor.peek()
        if mark == b",":
            if cursor.at >= size:
                return
            cursor.at += 1
        elif level == 1 and mark == b"}":
            cursor.at, level = cursor.at + 1, 0
        else:
            yield broken()
            return
    if cursor.peek():
        yield broken()


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("document"), F.col("length").alias("size"))


def document_parts(spark: SparkSession, path: str, glob: str | None = None) -> dict[str, list[tuple[str, int]]]:
    """The files (path, size) of each document that is a folder of files, by name; empty files are left out."""
    found = {}
    for row in sorted(_files(spark, path, glob).where("size > 0").collect()):  # names only, as the driver lists them
        found.setdefault(row.document.rsplit("/", 1)[0], []).append((row.document, row.size))
    return found


def ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, glob: str | None = None, parts: bool = False) -> DataFrame:
    """Byte ranges (document, begin, end, size) of the files below a path, or with ``parts`` of its folders of files."""
    files = _files(spark, path, glob)
    if parts:
        files = files.groupBy(F.regexp_replace("document", "/[^/]*$", "").alias("document")).agg(F.sum("size").alias("size"))
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    cut = files.select("document", "size", F.explode(begins).alias("begin"))
    return cut.select("document", "begin", F.least(F.col("begin") + split_bytes, F.col("size")).alias("end"), "size")


def _spread(rows: DataFrame) -> DataFrame:
    """Ranges dealt over the tasks: they are few and small rows, but much work each."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "document", "begin")


def range_states(cut: DataFrame, files: dict[str, list[tuple[str, int]]] | None = None) -> DataFrame:
    """Ranges with the state and depth in front of them, and ``sound``: whether the whole document ends outside of texts and brackets.

    ``files`` has the files of documents in parts.
    """
    known = cut.sparkSession.sparkContext.broadcast(files or {})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                source = _Document(row["document"], known.value.get(row["document"]))
                data = source.read_at(row["end"] - row["begin"], row["begin"])
                source.close()
                found = [after(data, OUT), after(data, IN)]
                # behind a backslash only the first byte counts for more than inside a text
                found.append(after(data, ESCAPED) if data[:1] in (b"", b'"', b"\\") else found[IN])
                row["states"], row["depths"] = [s for s, _ in found], [d for _, d in found]
            names = ["document", "begin", "end", "states", "depths"]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def chain(group: pa.Table) -> pa.Table:
        rows, state, depth = group.sort_by("begin").to_pylist(), OUT, 0
        for row in rows:
            row["state"], row["depth"] = state, depth
            state, depth = row["states"][state], depth + row["depths"][state]
        names, sound = ["document", "begin", "end", "state", "depth"], state == OUT and depth == 0
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
        return pa.Table.from_arrays([*columns, pa.array([sound] * len(rows))], [*names, "sound"])

    told = _spread(cut).mapInArrow(scan, "document string, begin bigint, end bigint, states array<int>, depths array<bigint>")
    # one small row for each range of a document
    return told.groupBy("document").applyInArrow(chain, "document string, begin bigint, end bigint, state int, depth bigint, sound boolean")


def read_elements(
    spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, glob: str | None = None, parts: bool = False
) -> DataFrame:
    """Rows (document, kind, field, place, value) of all documents below a path; ``place`` is the byte it begins at.

    An empty file is no document; with ``parts`` a document is all files of a folder, one behind the other.  Kinds are ``value``, ``array``, ``element`` and ``broken``.  A document that does not close what it opens has a row of kind ``broken`` as well.
    """
    files = document_parts(spark, path, glob) if parts else {}
    states = stage(range_states(ranges(spark, path, split_bytes, glob, parts), files))
    known = spark.sparkContext.broadcast(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["document", "begin", "kind", "field", "place", "value"]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for found in elements(row["document"], row["begin"], row["end"], row["state"], row["depth"], known.value.get(row["document"])):
                    held.append((row["document"], row["begin"], *found))
                    size += len(found[3] or "")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    schema = "document string, begin bigint, kind string, field string, place bigint, value string"
    # read twice: for the names of fields at the ends of ranges, which are few columns, and for the rows themselves
    rows = stage_table(_spread(states).mapInArrow(read, schema))
    named = rows.where(F.col("field").isNotNull()).groupBy(F.col("document").alias("d"), F.col("begin").alias("b")).agg(F.max_by("field", "place").alias("last"))
    every = states.select("document", "begin").join(named, (F.col("document") == F.col("d")) & (F.col("begin") == F.col("b")), "left")
    earlier = W.partitionBy("document").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    before = every.select(F.col("document").alias("d"), F.col("begin").alias("b"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    # a row for each range: of known size once it is staged, so the elements need not be shuffled to meet it
    before = stage_table(before)
    joined = rows.join(before, (F.col("document") == F.col("d")) & (F.col("begin") == F.col("b")))
    field = F.when(F.col("kind") == "element", F.coalesce("field", "before")).otherwise(F.col("field"))
    unsound = states.where(~F.col("sound")).select("document").distinct()
    none = F.lit(None).cast("string")
    lost = unsound.select("document", F.lit("broken").alias("kind"), none.alias("field"), F.lit(None).cast("bigint").alias("place"), none.alias("value"))
    return joined.select("document", "kind", field.alias("field"), "place", "value").unionByName(lost)
