"""Rollout files: only the first line, and of it only session, folder and hashed remote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.identity import add_repository_fingerprint, normalize_session_id
from meterbook.functions.labels import clean_dimension
from meterbook.sources.heads import first_lines

META = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("cwd", T.StringType()),
                    T.StructField("git", T.StructType([T.StructField("repository_url", T.StringType())])),
                ]
            ),
        ),
    ]
)


def read_first_lines(spark: SparkSession, path: str) -> DataFrame:
    """First line of every rollout file below a folder, read from a short head of each file.

    Where an index table of (file_path, first_line) is kept, give that to ``parse_rollout_meta`` instead.
    """
    return first_lines(spark, path, "rollout-*.jsonl").where(F.col("file_path").rlike(fixed.ROLLOUT_DIR_PATTERN))


def parse_rollout_meta(first_lines: DataFrame) -> DataFrame:
    """Session, project and fingerprint per file; a file that says nothing has nulls."""
    kept = [c for c in first_lines.columns if c != "first_line"]
    path = F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))
    named = first_lines.where(path.rlike(fixed.ROLLOUT_DIR_PATTERN)).withColumn("_base", F.substring_index(path, "/", -1))
    named = named.where(F.col("_base").rlike(fixed.ROLLOUT_FILE_PATTERN))
    line = F.regexp_replace(F.col("first_line"), "^\ufeff", "")
    parsed = named.withColumn("_meta", F.from_json(line, META))
    payload = F.when(F.col("_meta.type") == fixed.ROLLOUT_META_TYPE, F.col("_meta.payload"))
    parsed = parsed.withColumn("_payload", payload)
    shaped = parsed.select(
        *kept,
        F.col("_payload").isNotNull().alias("_known"),
        clean_dimension("_payload.id").alias("_id"),
        F.regexp_replace("_base", r"(?i)\.jsonl$", "").alias("_name"),
        clean_dimension("_payload.cwd").alias("project"),
        F.col("_payload.git.repository_url").alias("_remote"),
    )
    named = F.coalesce(F.col("_id"), F.col("_name"))
    shaped = shaped.withColumn("session", F.when(F.col("_known"), normalize_session_id(named)))
    fingerprinted = add_repository_fingerprint(shaped, "_remote", "fingerprint")
    return fingerprinted.select(*kept, "session", "project", "fingerprint")
