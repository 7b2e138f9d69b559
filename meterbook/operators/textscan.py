"""Scans of text tables for credentials and private identifiers.

Whole texts are read; each pattern runs inside the JVM, and only over texts
that hold the literal every match of it begins with.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.labels import any_of, trim
from meterbook.operators.keyed import summarise
from meterbook.operators.quality import key_text, row_checks

_ASSIGNMENT = "secret assignment"
_SENSITIVE_KEY = rf'(?i)"({fixed.SENSITIVE_KEYS})"\s*:'
#: What an assignment cannot do without, in lower case.
_ASSIGNED_WORDS = ("key", "secret", "password", "token")
_CUT = "\x01"


def _keys_of(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(_SENSITIVE_KEY), F.lit(1))


def sensitive_keys(json_text: str | Column) -> Column:
    """Names of sensitive JSON fields at any depth.

    The text is parsed and written again first, so that an escaped name is
    found and a name inside a value is not; what does not parse is read as it is.
    """
    column = F.col(json_text) if isinstance(json_text, str) else json_text
    return _keys_of(F.coalesce(F.to_json(F.try_parse_json(column)), column))


def credential_like(value: str | Column) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(column.rlike(fixed.CREDENTIAL_TEXT), F.lit(False))


def gate(
    responses: DataFrame, kind: str = "kind", payload: str = "payload", by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Clean response bodies, and the violations of the others.

    A body must be a JSON object with a ``data`` array, grouped by day or week, free of
    sensitive fields and credential-like text.  The usage body is required.

    Bodies are judged as parsed and written again, so escapes hide nothing; a body
    that does not parse (a repeated field included) is a violation.  With ``by``,
    every account must have its usage body.
    """
    responses = responses.withColumn("_body", F.to_json(F.try_parse_json(payload)))
    body = F.col("_body")
    group = F.get_json_object(body, "$.group_by")
    shaped = F.coalesce(F.startswith(F.get_json_object(body, "$.data"), F.lit("[")), F.lit(False))
    keys = _keys_of(body)
    marked = responses.withColumns(
        {
            "_shaped": F.coalesce(shaped & F.startswith(body, F.lit("{")), F.lit(False)),
            "_grouped": group.isNull() | group.isin("day", "week"),
            "_keys": F.array_distinct(F.transform(keys, lambda k: F.lower(k))),
            "_credential": credential_like(body),
        }
    )
    bad = ~F.col("_shaped") | ~F.col("_grouped") | (F.size("_keys") > 0) | F.col("_credential")
    violations = row_checks(
        marked,
        F.col(kind),
        [
            ("response-shape", ~F.col("_shaped"), "object with data array", F.lit("other")),
            ("response-group-by", ~F.col("_grouped"), "day or week", group),
            ("response-sensitive-key", F.size("_keys") > 0, "none", F.array_join("_keys", ",")),
            ("response-credential", F.col("_credential"), "none", F.lit("credential-like text")),
        ],
    )
    required = summarise(responses, by, _usage=F.count_if(F.col(kind) == "usage"))
    key = key_text(*by) if by else F.lit("usage")
    missing = row_checks(required, key, [("response-required", F.col("_usage") == 0, "usage", F.lit("absent"))])
    given = [c for c in responses.columns if c != "_body"]
    return marked.where(~bad).select(*given), violations.unionByName(missing)


def placeholder(value: Column) -> Column:
    """A value that only stands for a secret."""
    lowered = F.lower(trim(value))
    worded = any_of([F.contains(lowered, F.lit(w)) for w in fixed.PLACEHOLDER_WORDS])
    compact = F.regexp_replace(lowered, r"[\s'\"`]", "")
    return worded | compact.rlike(r"^[x*\-]+$")


def literal_start(pattern: str) -> str:
    """The literal that every match of a pattern begins with; empty where it has none."""
    flat, last = pattern, ""
    while flat != last:
        flat, last = re.sub(r"\([^()]*\)", "", flat), flat
    if "|" in flat:
        return ""
    return re.match(r"(?:\\b)?([\w /-]*)(?![*+?{])", pattern).group(1)


def _matches(text: str, pattern: str, group: int, label: str, worth: Column | None = None) -> Column:
    """Every match of a pattern as (finding, value), looked for where the text is ``worth`` it."""

    def named(match: Column) -> Column:
        return F.struct(F.lit(label).alias("finding"), match.alias("value"))

    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), named)
    if worth is None:
        literal = literal_start(pattern)
        if not literal:
            return found
        worth = F.contains(F.col(text), F.lit(literal))
    return F.when(worth, found).otherwise(F.from_json(F.lit("[]"), "array<struct<finding string, value string>>"))


def _hits(texts: DataFrame, key: Sequence[str], matches: list[Column]) -> DataFrame:
    """All matches of all patterns in one pass over the texts."""
    return texts.select(*key, F.explode(F.flatten(F.array(*matches))).alias("hit")).select(*key, "hit.*")


def secret_findings(texts: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Secrets in a text table: ``finding`` and matched ``value`` per hit, placeholders excused."""
    lowered = F.lower(F.col(text))
    worded = any_of([F.contains(lowered, F.lit(w)) for w in _ASSIGNED_WORDS])
    worth = worded & F.col(text).rlike(rf"(?i)(?:{'|'.join(_ASSIGNED_WORDS)})[\"']?\s*[:=]")
    matches = [_matches(text, pattern, 0, label) for label, pattern in fixed.SECRET_PATTERNS]
    hits = _hits(texts, key, [*matches, _matches(text, fixed.SECRET_ASSIGNMENT, 0, _ASSIGNMENT, worth)])
    assigned = F.col("finding") == _ASSIGNMENT
    # name and value of an assignment from one match
    parts = F.split(F.regexp_replace("value", fixed.SECRET_ASSIGNMENT, f"$1{_CUT}$2$3$4"), _CUT, 2)
    named = hits.withColumn("_parts", F.when(assigned, parts)).select(
        *key,
        "finding",
        F.when(assigned, F.get("_parts", 1)).otherwise(F.col("value")).alias("value"),
        F.lower(F.get("_parts", 0)).alias("_name"),
    )
    prose = F.col("value").rlike(r"\s|[\x{3400}-\x{9fff}]") | F.col("value").rlike(r"^[A-Z][A-Z0-9_]*$")
    excused = placeholder(F.col("value")) | (F.col("_name").eqNullSafe("token") & prose)
    return named.where(~excused).drop("_name")


def private_findings(texts: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Home folders and UUIDs in a text table; public folder names, placeholders and UUIDs in URLs are excused."""
    # a UUID inside a URL is public: URLs are matched whole, and then dropped
    with_url = rf"(?i)https?://\S*|\b{fixed.UUID_TEXT}\b"
    homes = [_matches(text, pattern, 1, label) for label, pattern in fixed.PRIVATE_PATH_PATTERNS]
    hits = _hits(texts, key, [*homes, _matches(text, with_url, 0, fixed.UUID_FINDING)])
    found = hits.withColumn("value", F.lower("value"))
    url = (F.col("finding") == fixed.UUID_FINDING) & F.startswith("value", F.lit("http"))
    excused = url | F.col("value").isin(*fixed.SAFE_HOME_SEGMENTS) | placeholder(F.col("value"))
    return found.where(~excused)


def finding_counts(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return findings.groupBy(*by, "finding").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("value").alias("values"))
