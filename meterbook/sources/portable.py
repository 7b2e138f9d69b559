"""Portable usage files: JSON documents, JSON lines, CSV."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.labels import alias_conflict, single_alias, trim
from meterbook.functions.timeparts import from_epoch_ms, epoch_ms, parse_instant
from meterbook.functions.tokens import safe_amount, safe_integer
from meterbook.operators.quality import (
    field_name_rules,
    label_rules,
    number_rules,
    period_checks,
    row_checks,
    stack,
    timestamp_rules,
)
from meterbook.operators.dedup import repeated_rows
from meterbook.operators.keyed import keyed_join
from meterbook.session import stage, stage_table
from meterbook.sources.heads import first_lines
from meterbook.sources.splitjson import SPLIT_BYTES, read_elements

# every record field is read as text: one set of number rules serves all three formats
RECORD_TYPE = T.StructType(
    [T.StructField(name, T.StringType()) for name in fixed.PORTABLE_RECORD_FIELDS]
    + [T.StructField("_corrupt", T.StringType())]
)
DOCUMENT_TYPE = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("generatedAt", T.StringType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("synthetic", T.StringType()),
        # objects kept as raw JSON text
        T.StructField("records", T.ArrayType(T.StringType())),
    ]
)


class PortableInputError(ValueError):
    """A portable file as a whole is not usable."""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents, one per row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("document"), F.col("value").alias("payload")
    )


def parse_documents(documents: DataFrame) -> DataFrame:
    """Records of JSON documents as raw texts, with the document's own fields beside them."""
    parsed = documents.withColumn("_doc", F.from_json("payload", DOCUMENT_TYPE))
    return parsed.select(
        "document",
        F.col("_doc.schema").alias("schema"),
        F.col("_doc.timezone").alias("timezone"),
        F.col("_doc.synthetic").alias("synthetic"),
        F.col("_doc.generatedAt").alias("generated_at"),
        F.explode("_doc.records").alias("record"),
    )


def read_split_documents(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, checks) of JSON documents of any size, each read by as many tasks as it has ranges.

    Records are those of ``parse_documents``, with the document's own fields beside them and ``place``, the byte they begin at.
    """
    found = read_elements(spark, path, split_bytes, parts=parts)
    names = {"schema": "schema", "timezone": "timezone", "synthetic": "synthetic", "generatedAt": "generated_at"}
    plain = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]
    fields = found.where(F.col("kind") == "value").groupBy("document").agg(
        *[F.max(F.when(F.col("field") == field, plain)).alias(name) for field, name in names.items()]
    )
    fields = stage_table(fields)  # a row for each document; the records of one document stay where they are
    records = found.where("kind = 'element' AND field = 'records'").select("document", F.col("value").alias("record"), "place")
    unknown = ~F.col("field").isin(*fixed.PORTABLE_ROOT_FIELDS)
    sizes = found.groupBy("document").agg(
        F.count_if((F.col("kind") == "element") & (F.col("field") == "records")).alias("n"),
        F.count_if(F.col("kind") == "broken").alias("broken"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("value", "array") & unknown, F.col("field")))).alias("unknown"),
    )
    judged = keyed_join(sizes, fields, ["document"])
    checks = row_checks(
        judged,
        F.col("document"),
        [
            ("document-malformed", F.col("broken") > 0, "one JSON object", F.col("broken")),
            ("document-schema", ~F.col("schema").eqNullSafe(F.lit(fixed.PORTABLE_SCHEMA)), fixed.PORTABLE_SCHEMA, F.col("schema")),
            ("document-root-field", F.size("unknown") > 0, "known root fields", F.array_join("unknown", ",")),
            ("document-records", F.col("n") < 1, ">= 1 record", F.col("n")),
        ],
    )
    return keyed_join(records, fields, ["document"]), checks


def document_checks(documents: DataFrame) -> DataFrame:
    """Schema name, root fields and a non-empty record list."""
    names = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    unknown = F.array_except(names, F.array(*[F.lit(n) for n in fixed.PORTABLE_ROOT_FIELDS]))
    parsed = documents.withColumns({"_doc": F.from_json("payload", DOCUMENT_TYPE), "_unknown": unknown})
    schema = F.col("_doc.schema")
    size = F.coalesce(F.size("_doc.records"), F.lit(0))
    return row_checks(
        parsed,
        F.col("document"),
        [
            ("document-schema", ~schema.eqNullSafe(F.lit(fixed.PORTABLE_SCHEMA)), fixed.PORTABLE_SCHEMA, schema),
            ("document-root-field", F.size("_unknown") > 0, "known root fields", F.array_join("_unknown", ",")),
            ("document-records", size < 1, ">= 1 record", size),
        ],
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as raw texts; blank lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("document"), F.col("value").alias("record"))
    return lines.where(trim("record") != "")


def parse_records(records: DataFrame) -> DataFrame:
    """Raw JSON record texts as one text column per accepted field name."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = records.withColumn("_r", F.from_json("record", RECORD_TYPE, options))
    kept = [c for c in records.columns if c != "record"]
    return parsed.select(
        *kept,
        "record",
        F.xxhash64("record").cast("string").alias("key"),
        *[F.col(f"_r.{name}").alias(name) for name in fixed.PORTABLE_RECORD_FIELDS],
        (F.col("_r._corrupt").isNotNull() | F.col("_r").isNull()).alias("malformed"),
    )


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """CSV rows as text columns; each file's own header decides which fields it has, and in which order.

    Fields may hold line breaks, which keeps a file in one task; ``multiline=False``
    splits files, for tables whose fields have none.
    """
    by_header: dict[str, list[str]] = {}
    for row in first_lines(spark, path).collect():  # one short line of each file
        by_header.setdefault(row.first_line or "", []).append(row.file_path)
    if not by_header:
        raise PortableInputError("no CSV file")
    out = None
    for header, files in sorted(by_header.items()):
        headers = [h.strip() for h in next(csv.reader([header.lstrip("\ufeff")]), [])]
        check_headers(headers)
        schema = T.StructType([T.StructField(h, T.StringType()) for h in [*headers, "_corrupt"]])
        reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        rows = reader.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").csv(files)
        filled = F.concat_ws("", *headers) != ""
        part = rows.where(filled | F.col("_corrupt").isNotNull()).select(
            F.col("_metadata.file_path").alias("document"),
            F.xxhash64(*headers).cast("string").alias("key"),
            *[F.col(n) if n in headers else F.lit(None).cast("string").alias(n) for n in fixed.PORTABLE_RECORD_FIELDS],
            F.col("_corrupt").isNotNull().alias("malformed"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def check_headers(headers: list[str]) -> None:
    """Known, unique headers, and at least one of every kind that is needed."""
    if len(set(headers)) != len(headers):
        raise PortableInputError("repeated header")
    extra = [h for h in headers if h not in fixed.PORTABLE_CSV_HEADERS]
    if extra:
        raise PortableInputError(f"header is not allowed: {', '.join(extra)}")
    for spellings in fixed.PORTABLE_ALIASES.values():
        if len(set(spellings) & set(headers)) > 1:
            raise PortableInputError(f"one field under several headers: {', '.join(spellings)}")
    needed = [
        ("timestamp",),
        ("project",),
        ("model",),
        ("activity",),
        ("calls",),
        ("session", "session_id"),
        ("estimated_cost_usd", "cost_usd"),
        ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"),
    ]
    for group in needed:
        if not set(group) & set(headers):
            raise PortableInputError(f"missing header: {' or '.join(group)}")


def _field(name: str) -> Column:
    return single_alias(*fixed.PORTABLE_ALIASES[name])


def _usage_columns() -> dict[str, Column]:
    return {
        "row_id": trim(_field("row_id")),
        # instants are kept to the millisecond
        "ts": from_epoch_ms(epoch_ms(parse_instant(trim(_field("timestamp"))))),
        **{name: trim(_field(name)) for name in ("session", "project", "model", "activity")},
        "fresh_input": safe_integer(_field("input")),
        **{name: safe_integer(_field(name)) for name in ("cache_read", "cache_write", "output", "calls")},
        "cost": safe_amount(_field("cost")),
    }


def normalize(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Usage rows from parsed text columns, with the account columns ``by``; what does not parse is null and shows up in ``checks``."""
    kept = [c for c in ("document", "key", "timezone", "synthetic") if c in parsed.columns and c not in by]
    return parsed.select(*by, *kept, *[column.alias(name) for name, column in _usage_columns().items()])


def alias_rules(record: str | None = None) -> list[tuple]:
    """A field may be spelled in one way only.

    Of a JSON ``record`` the names count that are there, with null or blank values too.
    """

    def conflict(spellings: tuple[str, ...]) -> Column:
        if record is None:
            return alias_conflict(*spellings)
        names = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
        return F.size(F.array_intersect(names, F.array(*[F.lit(s) for s in spellings]))) > 1

    rules = [
        (f"{name}-alias", conflict(spellings), "one spelling", " ".join(spellings))
        for name, spellings in fixed.PORTABLE_ALIASES.items()
        if len(spellings) > 1
    ]
    rules.append(("record-malformed", F.col("malformed"), "a JSON object or full CSV row", "malformed"))
    return rules


def checks(parsed: DataFrame, by: Sequence[str] = (), max_days: int | None = None) -> DataFrame:
    """Every rule of the portable format, as violations; the span of days only where ``max_days`` bounds it.

    Records are parsed once; all rules of a single record run in one pass over
    the result, the totals take a second one, and repeated records and row ids
    one shuffle each.
    """
    texts = parsed.withColumns({f"_{name}": trim(_field(name)) for name in fixed.PORTABLE_ALIASES})
    texts = texts.withColumn("_ts", parse_instant("_timestamp"))
    integers = ("input", "output", "cache_read", "cache_write", "calls")
    # spellings are judged on the given columns, everything else on the trimmed values
    given = "record" in parsed.columns
    spelled = alias_rules("record" if given else None) + (field_name_rules("record") if given else [])
    numbers = {n: safe_integer(f"_{n}") for n in integers}
    checked = texts.withColumns({f"_spelled_{i}": F.coalesce(rule[1], F.lit(False)) for i, rule in enumerate(spelled)})
    shown = {f"_shown_{i}": rule[3] if isinstance(rule[3], Column) else F.lit(rule[3]) for i, rule in enumerate(spelled)}
    wide = checked.withColumns(shown).select(
        "key",
        *[F.col(k).alias(f"by_{k}") for k in by],
        *[column.alias(f"u_{name}") for name, column in _usage_columns().items()],
        *[F.col(f"_spelled_{i}") for i in range(len(spelled))],
        *[F.col(f"_shown_{i}") for i in range(len(spelled))],
        *[F.col(f"_{name}").alias(name) for name in fixed.PORTABLE_ALIASES],
        F.col("_ts").alias("ts"),
        *[column.alias(f"n_{n}") for n, column in numbers.items()],
    )
    checked = stage(wide)
    usage = checked.select(*[F.col(f"by_{k}").alias(k) for k in by], *[F.col(f"u_{name}").alias(name) for name in _usage_columns()])
    summed = F.col("n_input") + F.col("n_output") + F.col("n_cache_read") + F.col("n_cache_write")
    record_rules = [
        *[(rule[0], F.col(f"_spelled_{i}"), rule[2], F.col(f"_shown_{i}")) for i, rule in enumerate(spelled)],
        *label_rules(["project", "session", "model", "activity", "row_id"]),
        *timestamp_rules("timestamp", "ts"),
        *number_rules(integers, ["cost"]),
        ("calls-minimum", F.col("n_calls") < 1, ">= 1", F.col("n_calls")),
        ("tokens-minimum", summed < 1, ">= 1", summed),
    ]
    measures = ["ts", "session", "project", "model", "activity", "fresh_input", "cache_read", "cache_write", "output", "calls", "cost"]
    return stack(
        row_checks(checked, F.col("key"), record_rules),
        period_checks(usage, by, max_days=max_days),
        row_checks(
            repeated_rows(usage, [*by, *measures]), F.col("session"), [("record-repeated", F.lit(True), "1", F.col("copies"))]
        ),
        row_checks(
            repeated_rows(usage.where("row_id IS NOT NULL"), [*by, "row_id"]),
            F.col("row_id"),
            [("row-id-repeated", F.lit(True), "1", F.col("copies"))],
        ),
    )
