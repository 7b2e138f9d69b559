"""Data-quality checks.

A check never stops a plan.  It returns violations, rows of ``check key expected
actual``; ``require_clean`` is the action that raises when there are any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook import fixed
from meterbook.functions.labels import any_of, trim
from meterbook.functions.timeparts import epoch_ms, local_date, local_hour, weekday
from meterbook.functions.tokens import COMPONENTS
from meterbook.operators.keyed import full_keyed_join, summarise, with_totals
from meterbook.operators.rollups import tokens
from meterbook.session import stage

COLUMNS = ("check", "key", "expected", "actual")


class QualityError(ValueError):
    """Raised by ``require_clean``."""


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def key_text(*columns: str) -> Column:
    return F.concat_ws("|", *[text(F.col(c)) for c in columns])


def row_checks(df: DataFrame, key: Column, checks: Sequence[tuple]) -> DataFrame:
    """All row-level checks of a table in one pass.

    ``checks`` holds ``(name, bad, expected, actual)``, and a key of its own as a
    fifth item where the common one does not fit; a row yields one violation for
    each ``bad`` that is true.
    """

    def violation(name, bad, expected, actual, own_key=None) -> Column:
        return F.when(
            F.coalesce(bad, F.lit(False)),
            F.struct(
                F.lit(name).alias("check"),
                text(key if own_key is None else own_key).alias("key"),
                text(expected if isinstance(expected, Column) else F.lit(expected)).alias("expected"),
                text(actual if isinstance(actual, Column) else F.lit(actual)).alias("actual"),
            ),
        )

    found = F.array(*[violation(*check) for check in checks])
    return df.select(F.explode(F.array_compact(found)).alias("v")).select("v.*")


def stack(*violations: DataFrame) -> DataFrame:
    out = violations[0]
    for more in violations[1:]:
        out = out.unionByName(more)
    return out


def tally(violations: DataFrame) -> DataFrame:
    return violations.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))


def require_clean(violations: DataFrame, shown: int = 8) -> None:
    """Raise when there is a violation; only a handful of examples reach the driver."""
    examples = violations.limit(shown).collect()
    if examples:
        lines = "; ".join(f"{r['check']} [{r['key']}] expected {r['expected']}, got {r['actual']}" for r in examples)
        raise QualityError(lines)


# --- portable input ----------------------------------------------------------
#
# ``…_rules`` give the rules of a row as tuples; several of them can go into one
# ``row_checks`` and then cost one pass over the data.


def field_name_rules(json_text: str) -> list[tuple]:
    """Unknown and forbidden field names of JSON records."""
    names = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    forbidden = F.filter(names, lambda n: n.rlike(fixed.FORBIDDEN_FIELD_PATTERN))
    unknown = F.filter(
        names, lambda n: ~n.isin(*fixed.PORTABLE_RECORD_FIELDS) & ~n.rlike(fixed.FORBIDDEN_FIELD_PATTERN)
    )
    return [
        ("forbidden-field", F.size(forbidden) > 0, "absent", F.array_join(forbidden, ",")),
        ("unknown-field", F.size(unknown) > 0, "absent", F.array_join(unknown, ",")),
    ]


def field_name_checks(raw: DataFrame, key: str, json_text: str) -> DataFrame:
    return row_checks(raw, F.col(key), field_name_rules(json_text))


def label_rules(columns: Sequence[str] = ("project", "session", "model", "activity")) -> list[tuple]:
    """Length, control characters, UUIDs, e-mail addresses, paths and opaque identifiers in trimmed labels."""
    rules = []
    for name in columns:
        value, limit = F.col(name), fixed.LABEL_LIMITS[name]
        required = F.lit(False) if name == "row_id" else value.isNull() | (value == "")
        path = fixed.PROJECT_PATH_PATTERN if name == "project" else fixed.PATH_OR_URL_PATTERN
        rules += [
            (f"{name}-required", required, "text", F.lit("blank")),
            (f"{name}-length", F.length(value) > limit, f"<= {limit}", F.length(value)),
            (f"{name}-control", value.rlike(fixed.CONTROL_PATTERN), "printable", value),
            (f"{name}-uuid", value.rlike("(?i)" + fixed.UUID_TEXT), "no UUID", value),
            (f"{name}-email", value.rlike(fixed.EMAIL_PATTERN), "no e-mail", value),
            (f"{name}-path", value.rlike(path), "no path", value),
        ]
        if name == "session":
            rules.append(("session-opaque", value.rlike(fixed.OPAQUE_ID_PATTERN), "short alias", value))
    return rules


def label_checks(df: DataFrame, key: str, columns: Sequence[str] = ("project", "session", "model", "activity")) -> DataFrame:
    trimmed = df.withColumns({c: trim(c) for c in columns})
    return row_checks(trimmed, F.col(key), label_rules(columns))


def timestamp_rules(text_column: str, parsed: str) -> list[tuple]:
    """The time parses and carries an explicit offset; of a trimmed text."""
    value = F.col(text_column)
    return [
        ("timestamp-invalid", F.col(parsed).isNull(), "ISO instant", value),
        ("timestamp-offset", ~value.rlike(fixed.OFFSET_PATTERN), "Z or an offset", value),
    ]


def timestamp_checks(df: DataFrame, key: str, text_column: str, parsed: str) -> DataFrame:
    trimmed = df.withColumn(text_column, trim(text_column))
    return row_checks(trimmed, F.col(key), timestamp_rules(text_column, parsed))


def minimum_rules() -> list[tuple]:
    """At least one call and one token per record."""
    return [
        ("calls-minimum", F.col("calls") < 1, ">= 1", F.col("calls")),
        ("tokens-minimum", tokens() < 1, ">= 1", tokens()),
    ]


def record_minimums(df: DataFrame, key: str) -> DataFrame:
    return row_checks(df, F.col(key), minimum_rules())


def period_checks(df: DataFrame, by: Sequence[str] = (), ts: str = "ts", max_days: int | None = None) -> DataFrame:
    """Cost is positive, and the span of days is bounded where ``max_days`` asks for it; one summary pass for both.

    Days are counted in whole days between the first and last instant.
    """
    bounds = summarise(
        df, by, cost=F.coalesce(F.sum("cost"), F.lit(0)), low=F.min(epoch_ms(ts)), high=F.max(epoch_ms(ts))
    )
    days = F.floor((F.col("high") - F.col("low")) / 86_400_000) + 1
    return row_checks(
        bounds,
        key_text(*by) if by else F.lit("total"),
        [
            ("cost-positive", F.col("cost") <= 0, "> 0", F.col("cost")),
            *([] if max_days is None else [("date-span", days > max_days, f"<= {max_days}", days)]),
        ],
    )


def number_rules(integers: Sequence[str], amounts: Sequence[str] = ()) -> list[tuple]:
    """Whole numbers in the safe range and non-negative amounts, given as trimmed text.

    An amount is judged by the decimal it is kept as (``safe_amount``), so nothing is accepted here and lost there.
    """
    rules = []
    for name in integers:
        parsed = F.col(name).try_cast("decimal(38,9)")
        good = parsed.between(0, fixed.MAX_SAFE_INTEGER) & (parsed == F.floor(parsed))
        filled = F.coalesce(F.col(name) != "", F.lit(False))
        rules.append((f"{name}-integer", filled & ~F.coalesce(good, F.lit(False)), "0 … 2^53-1", F.col(name)))
    for name in amounts:
        good = F.col(name).try_cast("decimal(28,9)") >= 0
        filled = F.coalesce(F.col(name) != "", F.lit(False))
        rules.append((f"{name}-amount", filled & ~F.coalesce(good, F.lit(False)), ">= 0", F.col(name)))
    return rules


def number_checks(df: DataFrame, key: str, integers: Sequence[str], amounts: Sequence[str] = ()) -> DataFrame:
    trimmed = df.withColumns({c: trim(F.col(c).cast("string")) for c in [*integers, *amounts]})
    return row_checks(trimmed, F.col(key), number_rules(integers, amounts))


def inclusive_rules(input_: str, cache_read: str) -> list[tuple]:
    return [("cache-within-input", F.col(cache_read) > F.col(input_), F.col(input_), F.col(cache_read))]


def inclusive_input(df: DataFrame, key: str, input_: str, cache_read: str) -> DataFrame:
    return row_checks(df, F.col(key), inclusive_rules(input_, cache_read))


# --- series and responses ----------------------------------------------------


def identity_rules(parts: Sequence[str], whole: str) -> list[tuple]:
    summed = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return [("token-identity", summed != F.col(whole), F.col(whole), summed)]


def token_identity(df: DataFrame, key: str, parts: Sequence[str], whole: str) -> DataFrame:
    return row_checks(df, F.col(key), identity_rules(parts, whole))


def date_rules(text_column: str, parsed: str) -> list[tuple]:
    return [("date-invalid", F.col(parsed).isNull(), "YYYY-MM-DD", F.col(text_column))]


def repeated_dates(df: DataFrame, text_column: str, by: Sequence[str] = ()) -> DataFrame:
    counted = df.groupBy(*by, text_column).agg(F.count(F.lit(1)).alias("n"))
    return row_checks(counted, key_text(*by, text_column), [("date-repeated", F.col("n") > 1, "1", F.col("n"))])


def date_checks(df: DataFrame, text_column: str, parsed: str, by: Sequence[str] = ()) -> DataFrame:
    """Dates are valid and occur once per key."""
    invalid = row_checks(df, F.col(text_column), date_rules(text_column, parsed))
    return stack(invalid, repeated_dates(df, text_column, by))


def order_blocks(df: DataFrame, date: str, by: Sequence[str] = (), position: str = "pos") -> DataFrame:
    """The rows in order, staged with ``_block`` and ``_at``: a sort by range, cut wherever its tasks begin.

    A key that holds most of the rows lies in many blocks.
    """
    placed = df.select(*by, position, date).orderBy(*by, position).withColumn("_at", F.monotonically_increasing_id())
    return stage(placed.withColumn("_block", F.shiftright("_at", 33)))


def block_order(blocks: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Order summary of every key and block: ``block rows first last broken``; broken counts the steps inside that do not grow."""
    previous = F.lag(date).over(W.partitionBy("_block", *by).orderBy("_at"))
    return blocks.withColumn("_previous", previous).groupBy(*by, F.col("_block").alias("block")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(date, "_at").alias("first"),
        F.max_by(date, "_at").alias("last"),
        F.count_if(F.col(date) <= F.col("_previous")).alias("broken"),
    )


def block_borders(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summaries with ``before``, the last date of the block in front: a key has one row per sort task that met it."""
    return summaries.withColumn("before", F.lag("last").over(W.partitionBy(*by).orderBy("block")))


def merged_order(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One summary per key from those of its blocks, in the order of ``block``; summaries of later blocks can be added at any time."""
    return summarise(
        block_borders(summaries, by),
        by,
        rows=F.sum("rows"),
        first=F.min_by("first", "block"),
        last=F.max_by("last", "block"),
        broken=F.sum("broken") + F.count_if(F.col("first") <= F.col("before")),
    )


def strictly_ordered(df: DataFrame, date: str, by: Sequence[str] = (), position: str = "pos") -> DataFrame:
    """Dates grow in the order the rows were given; one row for every step that does not.

    Steps inside a block are found by the task that holds it, steps over the border
    of two blocks from their summaries, so no task holds all rows of a key.
    """
    blocks = order_blocks(df, date, by, position)
    inside = blocks.withColumn("_previous", F.lag(date).over(W.partitionBy("_block", *by).orderBy("_at")))
    borders = block_borders(block_order(blocks, date, by), by)
    steps = inside.select(*by, date, "_previous").unionByName(borders.select(*by, F.col("first").alias(date), F.col("before").alias("_previous")))
    return row_checks(
        steps,
        key_text(*by, date),
        [("date-order", F.col(date) <= F.col("_previous"), F.concat(F.lit("> "), text(F.col("_previous"))), F.col(date))],
    )


def account_checks(buckets: DataFrame, summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Buckets add up to the lifetime total, peak at the stated peak and are not negative."""
    negative = row_checks(
        buckets,
        key_text(*by, "date"),
        [("account-tokens", F.col("tokens").isNull() | (F.col("tokens") < 0), ">= 0", F.col("tokens"))],
    )
    sums = summarise(buckets, by, _sum=F.sum("tokens"), _peak=F.max("tokens"))
    joined = with_totals(summary, sums, by)
    key = key_text(*by) if by else F.lit("total")
    return stack(
        negative,
        row_checks(
            joined,
            key,
            [
                ("account-lifetime", ~F.col("_sum").eqNullSafe(F.col("lifetime_tokens")), F.col("lifetime_tokens"), F.col("_sum")),
                ("account-peak", ~F.col("_peak").eqNullSafe(F.col("peak_daily_tokens")), F.col("peak_daily_tokens"), F.col("_peak")),
            ],
        ),
    )


def same_buckets(usage: DataFrame, other: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Date buckets of a response equal the usage buckets."""
    joined = full_keyed_join(
        usage.select(*by, "date").distinct(), other.select(*by, "date").distinct(), [*by, "date"]
    )
    return row_checks(
        joined,
        key_text(*by, "date"),
        [(f"{name}-buckets", F.col("_in_left") != F.col("_in_right"), F.col("_in_left"), F.col("_in_right"))],
    )


def same_grouping(usage: DataFrame, other: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Both responses are grouped by day, or both by week; a response that mixes the two fits neither."""
    grouped = F.array_join(F.array_sort(F.collect_set(F.coalesce("group_by", F.lit("day")))), "+")
    joined = with_totals(summarise(usage, by, _mine=grouped), summarise(other, by, _theirs=grouped), by)
    differs = ~F.col("_mine").eqNullSafe(F.col("_theirs")) | F.contains("_mine", F.lit("+"))
    key = key_text(*by) if by else F.lit(name)
    return row_checks(joined, key, [("group-by", differs, F.col("_mine"), F.col("_theirs"))])


def grouping_rules(allowed: Sequence[str] = ("day", "week")) -> list[tuple]:
    value = F.coalesce("group_by", F.lit("day"))
    return [("group-by-supported", ~value.isin(*allowed), " or ".join(allowed), value)]


def detail_rules(detail: str, fields: Sequence[str]) -> list[tuple]:
    """Nested detail adds up to the totals of its day; a day without detail is skipped."""
    checks = []
    for field in fields:
        listed = F.aggregate(
            F.coalesce(F.transform(detail, lambda m: F.coalesce(m[field], F.lit(0).cast("bigint"))), F.array().cast("array<bigint>")),
            F.lit(0).cast("bigint"),
            lambda acc, v: acc + v,
        )
        has_detail = F.coalesce(F.size(detail) > 0, F.lit(False))
        checks.append((f"{detail}-{field}", has_detail & (listed != F.col(field)), F.col(field), listed))
    return checks


def detail_matches_totals(rows: DataFrame, key: str, detail: str, fields: Sequence[str]) -> DataFrame:
    return row_checks(rows, F.col(key), detail_rules(detail, fields))


# --- ledgers -----------------------------------------------------------------


def event_checks(events: DataFrame) -> DataFrame:
    """Row rules of ledger events."""
    bad_number = any_of([F.col(c).isNull() | ~F.col(c).between(0, fixed.MAX_SAFE_INTEGER) for c in COMPONENTS])
    return row_checks(
        events,
        F.col("event_id"),
        [
            ("event-id", ~F.col("event_id").rlike(fixed.EVENT_ID_PATTERN) | F.col("event_id").isNull(), "64 hex digits", F.col("event_id")),
            ("event-time", F.col("ts").isNull(), "instant", F.col("ts")),
            ("event-calls", ~F.col("calls").eqNullSafe(F.lit(1)), "1", F.col("calls")),
            ("event-source", ~F.coalesce(F.col("source").isin(*fixed.SOURCES), F.lit(False)), " or ".join(fixed.SOURCES), F.col("source")),
            ("event-components", bad_number, "0 … 2^53-1", key_text(*COMPONENTS)),
            ("event-total", F.col("tokens") != tokens(), tokens(), F.col("tokens")),
            ("event-cost", F.col("cost") < 0, ">= 0", F.col("cost")),
            (
                "event-fingerprint",
                F.col("fingerprint").isNotNull() & ~F.col("fingerprint").rlike(fixed.EVENT_ID_PATTERN),
                "64 hex digits",
                F.col("fingerprint"),
            ),
        ],
    )


def unique_ids(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = events.groupBy(*by, "event_id").agg(F.count(F.lit(1)).alias("n"))
    return row_checks(counted, key_text(*by, "event_id"), [("event-id-repeated", F.col("n") > 1, "1", F.col("n"))])


def core_conflicts(deduplicated: DataFrame) -> DataFrame:
    """Ids whose copies differ in time, source, session, model, components or cost."""
    return row_checks(
        deduplicated, F.col("event_id"), [("event-core-conflict", F.col("conflicting"), "equal copies", F.col("copies"))]
    )


def ledger_checks(events: DataFrame, compact: DataFrame, cutoff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Baseline and increment add up, compact rows equal events, the increment starts after the cutoff."""
    base = F.col("source") == fixed.SOURCE_BASELINE
    sums = summarise(
        events,
        by,
        events=F.count(F.lit(1)),
        calls=F.sum("calls"),
        tokens=F.sum(tokens()),
        cost=F.sum("cost"),
        baseline_tokens=F.coalesce(F.sum(F.when(base, tokens())), F.lit(0)),
        increment_tokens=F.coalesce(F.sum(F.when(~base, tokens())), F.lit(0)),
        first_increment=F.min(F.when(~base, epoch_ms("ts"))),
    )
    packed = summarise(
        compact, by, compact_calls=F.sum("calls"), compact_tokens=F.sum(tokens()), compact_cost=F.sum("cost")
    )
    joined = with_totals(with_totals(sums, packed, by), cutoff.select(*by, "cutoff_seconds"), by)
    split = F.col("baseline_tokens") + F.col("increment_tokens")
    allowed = F.greatest(F.lit(1e-6), F.col("events") * 5e-10)
    drift = F.abs((F.col("cost") - F.col("compact_cost")).cast("double"))
    return row_checks(
        joined,
        key_text(*by) if by else F.lit("total"),
        [
            ("ledger-split", split != F.col("tokens"), F.col("tokens"), split),
            ("ledger-calls", F.col("events") != F.col("calls"), F.col("calls"), F.col("events")),
            ("ledger-compact-calls", F.col("compact_calls") != F.col("calls"), F.col("calls"), F.col("compact_calls")),
            ("ledger-compact-tokens", F.col("compact_tokens") != F.col("tokens"), F.col("tokens"), F.col("compact_tokens")),
            ("ledger-compact-cost", drift > allowed, F.col("cost"), F.col("compact_cost")),
            (
                "ledger-cutoff",
                F.col("first_increment") <= F.col("cutoff_seconds") * 1000 + 999,
                F.concat(F.lit("> "), text(F.col("cutoff_seconds") * 1000 + 999)),
                F.col("first_increment"),
            ),
        ],
    )


def device_checks(devices: DataFrame, matches: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One time zone, unique labels, event-level reliability, no ambiguous neighbours.

    ``devices`` has ``device timezone reliable``.
    """
    zones = summarise(devices, by, n=F.countDistinct("timezone"))
    key = key_text(*by) if by else F.lit("total")
    named = devices.groupBy(*by, "device").agg(F.count(F.lit(1)).alias("n"))
    out = [
        row_checks(zones, key, [("device-timezone", F.col("n") != 1, "1 time zone", F.col("n"))]),
        row_checks(named, key_text(*by, "device"), [("device-label-repeated", F.col("n") > 1, "1", F.col("n"))]),
        row_checks(devices, key_text(*by, "device"), [("device-reliable", ~F.col("reliable"), "true", F.col("reliable"))]),
        device_label_checks(devices),
    ]
    if matches is not None:
        out.append(
            row_checks(
                matches.where(F.col("status") == "ambiguous"),
                F.concat_ws("|", "source", F.col("ts_ms").cast("string")),
                [("near-time-ambiguous", F.lit(True), "unique pair", F.col("events"))],
            )
        )
    return stack(*out)


def device_label_checks(devices: DataFrame) -> DataFrame:
    label = trim("device")
    good = (F.length(label) >= 1) & (F.length(label) <= 64) & ~label.rlike(r"[\x00-\x1f\x7f]")
    return row_checks(
        devices,
        F.col("device"),
        [("device-label", ~F.coalesce(good, F.lit(False)), "1 to 64 printable characters", F.col("device"))],
    )


# --- report ------------------------------------------------------------------


def leak_checks(tables: dict[str, DataFrame], project_columns: Sequence[str] = ("project",)) -> DataFrame:
    """UUIDs, absolute paths and path separators in the texts of report tables, those inside arrays, maps and structs included."""
    out = []
    for name, df in tables.items():
        checks = []
        for field in df.schema.fields:
            texts = text_leaves(F.col(f"`{field.name}`"), field.dataType)
            if texts is None:
                continue
            key = F.lit(f"{name}.{field.name}")

            def found(pattern: str, texts: Column = texts) -> Column:
                return F.filter(texts, lambda x: x.rlike(pattern))

            rules = [("leak-uuid", "(?i)" + fixed.UUID_TEXT, "no UUID"), ("leak-path", fixed.ABSOLUTE_PATH_PATTERN, "no path")]
            if field.name in project_columns:
                rules.append(("leak-separator", r"[\\/]", "no separator"))
            checks += [(rule, F.size(found(p)) > 0, wanted, F.array_join(found(p), ","), key) for rule, p, wanted in rules]
        if checks:
            out.append(row_checks(df, F.lit(name), checks))
    return stack(*out)


def text_leaves(column: Column, kind: T.DataType) -> Column | None:
    """All texts in a column as one array, through arrays, maps and structs; None where its type holds none."""
    if isinstance(kind, T.StringType):
        return F.array_compact(F.array(column))
    if isinstance(kind, T.ArrayType):
        if text_leaves(column, kind.elementType) is None:
            return None
        return F.flatten(F.transform(F.coalesce(column, F.array().cast(kind)), lambda x: text_leaves(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        parts = [text_leaves(F.map_keys(column), T.ArrayType(kind.keyType)), text_leaves(F.map_values(column), T.ArrayType(kind.valueType))]
    elif isinstance(kind, T.StructType):
        parts = [text_leaves(column.getField(f.name), f.dataType) for f in kind.fields]
    else:
        return None
    parts = [p for p in parts if p is not None]
    return F.concat(*parts) if parts else None


def raw_session_leaks(table: DataFrame, sessions: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Raw session ids in the texts of a report table, whole or as a word of a text; all columns unless some are named."""
    named = table.columns if columns is None else columns
    leaves = [text_leaves(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields if f.name in named]
    leaves = [x for x in leaves if x is not None]
    raw = sessions.select(F.col("session").alias("_token")).where(F.col("_token").isNotNull()).distinct()
    if not leaves:
        return row_checks(raw.limit(0), F.col("_token"), [("leak-session", F.lit(True), "pseudonym", F.col("_token"))])
    texts = F.concat(*leaves)
    words = F.flatten(F.transform(texts, lambda x: F.split(x, r"[^\p{L}\p{N}_.:@+-]+")))
    tokens_ = table.select(F.explode(F.array_distinct(F.concat(texts, words))).alias("_token")).distinct()
    leaked = tokens_.join(raw, "_token", "left_semi")
    return row_checks(leaked, F.col("_token"), [("leak-session", F.lit(True), "pseudonym", F.col("_token"))])


def pseudonym_checks(usage: DataFrame, raw: str = "raw_session", public: str = "session", by: Sequence[str] = ()) -> DataFrame:
    """Format of pseudonyms, and no two sessions under one."""
    owners = usage.groupBy(*by, public).agg(
        F.countDistinct(F.coalesce(F.col(raw), F.lit(fixed.UNKNOWN_SESSION))).alias("n")
    )
    return row_checks(
        owners,
        F.col(public),
        [
            ("pseudonym-format", ~F.col(public).rlike(fixed.PSEUDONYM_PATTERN), "session-<12 hex>", F.col(public)),
            ("pseudonym-collision", F.col("n") > 1, "1", F.col("n")),
        ],
    )


def reconstruction_algebra(reconstruction: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    official, local = F.col("official_tokens"), F.col("reconstructed_tokens")
    gap, absolute = F.col("net_gap_tokens"), F.col("absolute_gap_tokens")
    known, lost = F.col("known_project_tokens"), F.col("unattributed_project_tokens")
    active, idle = F.col("known_activity_tokens"), F.col("unattributed_activity_tokens")

    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) > 1e-12

    return row_checks(
        reconstruction,
        key_text(*by) if by else F.lit("total"),
        [
            ("gap-signed", gap != official - local, official - local, gap),
            ("gap-absolute", absolute != F.abs(gap), F.abs(gap), absolute),
            ("gap-ratio", near(F.col("reconstructed_ratio"), F.try_divide(local.cast("double"), official.cast("double"))), "local / official", F.col("reconstructed_ratio")),
            ("gap-rate", near(F.col("absolute_gap_rate"), F.try_divide(absolute.cast("double"), official.cast("double"))), "|gap| / official", F.col("absolute_gap_rate")),
            ("project-split", known + lost != local, local, known + lost),
            ("activity-split", active + idle != local, local, active + idle),
        ],
    )


def cross_view_checks(views: dict[str, DataFrame], by: Sequence[str] = (), reference: str = "summary") -> DataFrame:
    """Every view has the tokens, calls and (within 0.1) the cost of the summary.

    A view lacks a measure by lacking its column.
    """
    measures = ("tokens", "calls", "cost")
    parts = []
    for name, df in views.items():
        sums = {m: F.sum(m).cast("double") if m in df.columns else F.lit(None).cast("double") for m in measures}
        if not any(m in df.columns for m in measures):
            continue
        parts.append(summarise(df, by, **sums).withColumn("view", F.lit(name)))
    stacked = parts[0]
    for more in parts[1:]:
        stacked = stacked.unionByName(more)
    # a handful of rows per key from here on
    stacked = stacked.withColumns(
        {
            f"_{m}": F.max(F.when(F.col("view") == reference, F.col(m))).over(W.partitionBy(*by))
            for m in measures
        }
    )
    return row_checks(
        stacked.where(F.col("view") != reference),
        key_text(*by, "view"),
        [
            ("view-tokens", F.col("tokens") != F.col("_tokens"), F.col("_tokens"), F.col("tokens")),
            ("view-calls", F.col("calls") != F.col("_calls"), F.col("_calls"), F.col("calls")),
            ("view-cost", F.abs(F.col("cost") - F.col("_cost")) > fixed.COST_VIEW_TOLERANCE, F.col("_cost"), F.col("cost")),
        ],
    )


def grid_checks(week: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = summarise(week, by, cells=F.count(F.lit(1)))
    key = key_text(*by) if by else F.lit("total")
    return row_checks(counted, key, [("grid-cells", F.col("cells") != 168, "168", F.col("cells"))])


def compaction_checks(facts: DataFrame, usage: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    joined = with_totals(
        summarise(facts, by, facts=F.count(F.lit(1))), summarise(usage, by, records=F.count(F.lit(1))), by
    )
    key = key_text(*by) if by else F.lit("total")
    return row_checks(joined, key, [("facts-compact", F.col("facts") > F.col("records"), F.col("records"), F.col("facts"))])


def fact_checks(facts: DataFrame, tz: str) -> DataFrame:
    """Hour, weekday, calls and call times of compact facts agree with each other."""
    bad_time = [F.lit(False)]
    for column in ("first_call", "last_call"):
        bad_time += [
            local_date(column, tz) != F.col("date"),
            local_hour(column, tz) != F.col("hour"),
            weekday(local_date(column, tz)) != F.col("weekday"),
        ]
    negative = any_of([F.col(c) < 0 for c in COMPONENTS])
    return row_checks(
        facts,
        key_text("date", "hour", "session"),
        [
            ("fact-hour", ~F.col("hour").between(0, 23), "0 … 23", F.col("hour")),
            ("fact-weekday", ~F.col("weekday").isin(*fixed.WEEKDAYS), "weekday", F.col("weekday")),
            ("fact-calls", F.col("calls") < 1, ">= 1", F.col("calls")),
            ("fact-cost", F.col("cost") < 0, ">= 0", F.col("cost")),
            ("fact-components", negative, ">= 0", key_text(*COMPONENTS)),
            ("fact-order", F.col("first_call") > F.col("last_call"), F.col("first_call"), F.col("last_call")),
            ("fact-time", any_of(bad_time), key_text("date", "weekday", "hour"), F.col("first_call")),
        ],
    )


def reasoning_within_output(records: DataFrame, key: str, reasoning: str = "reasoning", output: str = "output") -> DataFrame:
    return row_checks(
        records, F.col(key), [("reasoning-within-output", F.col(reasoning) > F.col(output), F.col(output), F.col(reasoning))]
    )


def reconcile(
    derived: DataFrame,
    raw: DataFrame,
    keys: Sequence[str],
    exact: Sequence[str],
    cost: str | None = None,
    rows: str | None = None,
    name: str = "reconcile",
) -> DataFrame:
    """Derived rows against raw rows, key by key: full outer, so a row missing on either side shows.

    Costs may differ by half a unit of the sixth decimal per derived row.
    """
    renamed = raw.select(*keys, *[F.col(c).alias(f"raw_{c}") for c in [*exact, *([cost] if cost else [])]])
    joined = full_keyed_join(derived, renamed, keys)
    checks = [
        (f"{name}-missing", F.col("_in_left") != F.col("_in_right"), F.col("_in_right"), F.col("_in_left"))
    ]
    both = F.col("_in_left") & F.col("_in_right")
    for c in exact:
        checks.append((f"{name}-{c}", both & ~F.col(c).eqNullSafe(F.col(f"raw_{c}")), F.col(f"raw_{c}"), F.col(c)))
    if cost:
        count = F.col(rows) if rows else F.lit(1)
        drift = F.abs(F.col(cost).cast("double") - F.col(f"raw_{cost}").cast("double"))
        allowed = F.greatest(F.lit(1e-6), count * 0.00000051)
        checks.append((f"{name}-{cost}", both & (drift > allowed), F.col(f"raw_{cost}"), F.col(cost)))
    return row_checks(joined, key_text(*keys), checks)


def table_diff(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 1e-12
) -> DataFrame:
    """Named values against expected ones; numbers may differ by the tolerance."""
    joined = full_keyed_join(
        actual.select(*keys, F.col(value).alias("_actual")), expected.select(*keys, F.col(value).alias("_expected")), keys
    )
    a, e = F.col("_actual"), F.col("_expected")
    numeric = a.cast("string").try_cast("double"), e.cast("string").try_cast("double")
    close = F.coalesce(F.abs(numeric[0] - numeric[1]) <= tolerance, F.lit(False))
    same = a.cast("string").eqNullSafe(e.cast("string")) | close
    return row_checks(
        joined, key_text(*keys), [("table-diff", ~same | (F.col("_in_left") != F.col("_in_right")), e, a)]
    )


def to_metrics(row: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns of a summary as (name, value) rows."""
    names = [c for c in row.columns if c not in by]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names])
    return row.select(*by, F.explode(pairs).alias("m")).select(*by, "m.*")


def quality_facts(summary: DataFrame, outcome: str = "collected", by: Sequence[str] = ()) -> DataFrame:
    """Outcome per quality rule, computed from figures and not asserted.

    ``summary`` holds ``tokens component_tokens calls view_calls calendar_days
    day_rows project_coverage activity_coverage``.
    """
    from meterbook.functions.tokens import round_half_up

    reconciled = (F.col("tokens") == F.col("component_tokens")) & (F.col("calls") == F.col("view_calls"))
    continuous = F.col("calendar_days") == F.col("day_rows")

    def coverage(column: str) -> Column:
        return F.when(F.col(column) >= fixed.FULL_COVERAGE, "full").otherwise("partial")

    none = F.lit(None).cast("double")
    rows = F.array(
        F.struct(F.lit("reconciliation").alias("code"), F.when(reconciled, "pass").otherwise("fail").alias("outcome"), none.alias("ratio")),
        F.struct(F.lit("calendar-continuity").alias("code"), F.when(continuous, "pass").otherwise("fail").alias("outcome"), none.alias("ratio")),
        F.struct(F.lit("project-token-attribution").alias("code"), coverage("project_coverage").alias("outcome"), round_half_up("project_coverage", 8).alias("ratio")),
        F.struct(F.lit("activity-token-attribution").alias("code"), coverage("activity_coverage").alias("outcome"), round_half_up("activity_coverage", 8).alias("ratio")),
        F.struct(F.lit("source-disclosure").alias("code"), F.lit(outcome).alias("outcome"), none.alias("ratio")),
    )
    return summary.select(*by, F.explode(rows).alias("f")).select(*by, "f.*")


def recomputed(df: DataFrame, key: Column, pairs: Sequence[tuple[str, Column, Column]], tolerance: float) -> DataFrame:
    """Stored figures against figures recomputed from their parts."""
    return row_checks(
        df,
        key,
        [
            (name, (F.abs(stored - again) > tolerance) | (stored.isNull() != again.isNull()), again, stored)
            for name, stored, again in pairs
        ],
    )
