"""First lines of many files, without reading the files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stores that tasks open by themselves; files of any other are streamed by line through Spark.
_OPENED = ("", "file", "hdfs", "s3", "s3a", "gs")
_HEAD_BYTES = 1 << 16


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Paths of all files below a folder; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file_path"))


def _head(path: str) -> bytes:
    """Bytes up to the first line end; the part that is read grows until there is one."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        system, name = fs.LocalFileSystem(), unquote(parts.path)
    else:
        system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    with system.open_input_file(name) as file:
        size, length = file.size(), _HEAD_BYTES
        while True:
            data = file.read_at(min(length, size), 0)
            end = data.find(b"\n")
            if end >= 0 or length >= size:
                return data[:end] if end >= 0 else data
            length *= 4


def first_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_path, first_line) of every file below a path; an empty file has no row."""
    files = list_files(spark, path, glob)
    scheme = urlsplit(path).scheme or urlsplit(spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "").scheme
    if scheme not in _OPENED:
        return _streamed(spark, path, glob)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            heads = [_head(n) for n in names]
            kept = [(n, h.removesuffix(b"\r").decode("utf-8", "replace")) for n, h in zip(names, heads, strict=True) if h]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in kept], pa.string()), pa.array([h for _, h in kept], pa.string())], ["file_path", "first_line"]
            )

    return files.mapInArrow(work, "file_path string, first_line string")


def _streamed(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """The same through Spark's text reader: all lines are read, the earliest of each file is kept on the map side."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("value").alias("first_line"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return lines.where("_start = 0").groupBy("file_path").agg(F.min_by("first_line", "_line").alias("first_line"))
