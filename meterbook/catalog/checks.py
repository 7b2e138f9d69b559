"""Data-quality checks over the given tables: each returns violations."""

from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.catalog import tables as t
from meterbook.catalog.registry import query
from meterbook.catalog.aggregates import RECONSTRUCTION
from meterbook.catalog.sources import BATCH, account_documents, ledger_documents, portable_lines
from meterbook.functions.identity import session_pseudonym
from meterbook.functions.timeparts import iso_utc, parse_date, parse_instant
from meterbook.operators import quality, rollups, series, textscan
from meterbook.plans import activity, credits, report
from meterbook.sources import account as account_source
from meterbook.sources import devices, portable, requestlog
from meterbook.sources.responses import parse_tools, parse_usage

NONE = 'SELECT \'\' AS "check", \'\' AS key, \'\' AS expected, \'\' AS actual WHERE false'


# --- Q1–Q6: portable and numeric input ---------------------------------------------


def damaged_lines(spark, folder):
    """Portable JSON lines, one in ten damaged in one of several ways."""
    n = F.col("event_id") % 100
    rows = t.usage(spark, folder)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    uuid = "0199ab00-1111-2222-3333-00000000002a"
    record = F.struct(
        F.when(n == 19, stamp).when(n == 29, F.lit("yesterdayZ")).otherwise(F.concat(stamp, F.lit("Z"))).alias("timestamp"),
        F.when(n == 39, F.lit("/srv/secretplace")).when(n == 49, F.lit(f"p {uuid}")).when(n == 50, F.lit(" ")).otherwise(F.lit("proj")).alias("project"),
        F.when(n == 59, F.lit("abcdefabcdefabcdefabcdef0123")).otherwise(F.col("session")).alias("session"),
        F.when(n == 60, F.lit("other")).alias("session_id"),
        F.when(n == 69, F.lit("someone@host.example")).otherwise(F.col("model")).alias("model"),
        F.lit("Coding").alias("activity"),
        F.when(n == 79, F.lit("12.5")).when(n == 80, F.lit("-3")).otherwise(F.concat(F.col("fresh_input").cast("string"), F.lit(".0"))).alias("input_tokens"),
        F.when(n == 89, F.lit("many")).otherwise(F.col("cost").cast("string")).alias("cost_usd"),
        F.when(n == 99, F.lit(0)).otherwise(F.lit(1)).alias("calls"),
        F.when(n == 9, F.lit("x")).alias("prompt_text"),
        F.when(n == 10, F.lit("x")).alias("colour"),
    )
    line = F.when(n == 90, F.lit('{"timestamp": ')).otherwise(F.to_json(record))
    return rows.select("event_id", F.lit("events").alias("document"), line.alias("record"))


def damage(**names):
    parts = " UNION ALL ".join(
        f"SELECT '{check}' AS \"check\", CAST(count(*) AS BIGINT) AS violations FROM events WHERE event_id % 100 IN ({days})" for check, days in names.items()
    )
    return f"SELECT * FROM ({parts}) WHERE violations > 0"


def _parsed(spark, folder):
    return portable.parse_records(damaged_lines(spark, folder))


@query("q01_field_names", damage(**{"forbidden-field": "9", "unknown-field": "10"}))
def q01_field_names(spark, folder):
    parsed = _parsed(spark, folder)
    return quality.tally(quality.field_name_checks(parsed, "key", "record"))


@query(
    "q02_label_rules",
    damage(
        **{
            "project-path": "39", "project-uuid": "49", "project-required": "50, 90", "session-opaque": "59", "model-email": "69",
            "session-required": "90", "model-required": "90", "activity-required": "90",
        }
    ),
)
def q02_label_rules(spark, folder):
    parsed = _parsed(spark, folder)
    raw = parsed.select("key", *[portable._field(n).alias(n) for n in ("project", "session", "model", "activity")])
    return quality.tally(quality.label_checks(raw, "key"))


@query("q03_timestamps", damage(**{"timestamp-offset": "19", "timestamp-invalid": "29, 90"}))
def q03_timestamps(spark, folder):
    parsed = _parsed(spark, folder).withColumn("ts", parse_instant("timestamp"))
    return quality.tally(quality.timestamp_checks(parsed, "key", "timestamp", "ts"))


@query(
    "q04_minimums",
    f"""WITH {t.USAGE} SELECT CASE WHEN m = 1 THEN 'calls-minimum' ELSE 'tokens-minimum' END AS "check", count(*) AS violations FROM (SELECT unnest([1, 2]) AS m, event_id, fresh_input, cache_read FROM usage)
WHERE (m = 1 AND event_id % 50 = 7) OR (m = 2 AND event_id % 40 = 5) GROUP BY 1""",
)
def q04_minimums(spark, folder):
    rows = t.usage(spark, folder)
    few = F.col("event_id") % 40 == 5
    rows = rows.withColumns(
        {
            "calls": F.when(F.col("event_id") % 50 == 7, 0).otherwise(F.col("calls")),
            **{c: F.when(few, 0).otherwise(F.col(c)) for c in ("fresh_input", "cache_read", "cache_write", "output")},
        }
    )
    return quality.tally(quality.record_minimums(rows, "event_id"))


@query(
    "q04_positive_cost_by_supplier",
    """SELECT 'cost-positive' AS "check", CAST(s_suppkey AS VARCHAR) AS key, '> 0' AS expected, '0.00' AS actual FROM supplier WHERE s_suppkey % 10 = 3 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)""",
)
def q04_positive_cost_by_supplier(spark, folder):
    """Accounts without any cost, one row each."""
    rows = t.shipments(spark, folder).select("l_suppkey", F.when(F.col("l_suppkey") % 10 != 3, F.col("cost")).alias("cost"))
    found = quality.period_checks(rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), ["l_suppkey"])
    return found.withColumn("actual", F.col("actual").cast("decimal(18,2)").cast("string"))


@query(
    "q05_date_span",
    """WITH s AS (SELECT l_suppkey, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) + to_minutes(l_linenumber) AS ts FROM lineitem)
SELECT 'date-span' AS "check", CAST(l_suppkey AS VARCHAR) AS key, '<= 366' AS expected, CAST(CAST(floor((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 86400000) + 1 AS BIGINT) AS VARCHAR) AS actual FROM s GROUP BY l_suppkey
HAVING floor((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 86400000) + 1 > 366""",
)
def q05_date_span(spark, folder):
    return quality.period_checks(t.shipments(spark, folder), ["l_suppkey"], max_days=fixed.MAX_DATE_SPAN_DAYS)


@query("q06_numbers", damage(**{"input-integer": "79, 80", "cost-amount": "89"}))
def q06_numbers(spark, folder):
    parsed = _parsed(spark, folder)
    raw = parsed.select("key", *[portable._field(n).alias(n) for n in ("input", "output", "calls", "cost")])
    return quality.tally(quality.number_checks(raw, "key", ["input", "output", "calls"], ["cost"]))


@query(
    "q06_inclusive_input",
    f"""WITH {t.USAGE} SELECT 'cache-within-input' AS "check", 'r' || event_id AS key, CAST(fresh_input AS VARCHAR) AS expected, CAST(cache_read AS VARCHAR) AS actual FROM usage
WHERE ts < TIMESTAMP '{t.SPLIT}' AND event_id % 10 <> 9 AND cache_read > fresh_input""",
)
def q06_inclusive_input(spark, folder):
    """Request rows whose cache reads exceed a fresh-only input count."""
    log = t.request_log(spark, folder).withColumn("input_tokens", F.col("input_tokens") - F.col("cache_read_tokens"))
    return quality.inclusive_input(requestlog.app_rows(log), "request_id", "input_tokens", "cache_read_tokens")


@query("q01_q06_portable_rules", damage(
    **{
        "forbidden-field": "9", "unknown-field": "10", "timestamp-offset": "19", "timestamp-invalid": "29, 90", "project-path": "39",
        "project-uuid": "49", "project-required": "50, 90", "session-opaque": "59", "session-alias": "60", "model-email": "69", "input-integer": "79, 80",
        "cost-amount": "89", "record-malformed": "90", "calls-minimum": "90, 99", "session-required": "90", "model-required": "90", "activity-required": "90",
        "tokens-minimum": "90",
    }
).replace("SELECT * FROM (", """SELECT * FROM (SELECT 'record-repeated' AS "check", CAST(CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM events WHERE event_id % 100 = 90 UNION ALL """))
def q01_q06_portable_rules(spark, folder):
    """All rules of the portable format at once, counted by rule."""
    return quality.tally(portable.checks(_parsed(spark, folder)))


@query("q01_clean_portable", "SELECT 'x' AS \"check\", CAST(0 AS BIGINT) AS violations WHERE false")
def q01_clean_portable(spark, folder):
    """The undamaged records break no rule."""
    return quality.tally(portable.checks(portable.parse_records(portable_lines(spark, folder))))


# --- Q7–Q10: series ------------------------------------------------------------------


@query(
    "q07_token_identity",
    f"""WITH {t.RESPONSES} SELECT 'token-identity' AS "check", CAST(date AS VARCHAR) AS key, CAST(tokens + 1 AS VARCHAR) AS expected, CAST(tokens AS VARCHAR) AS actual FROM days WHERE day(date) % 4 = 1""",
)
def q07_token_identity(spark, folder):
    days = parse_usage(t.response_days(spark, folder))
    off = F.when(F.dayofmonth("date") % 4 == 1, 1).otherwise(0)
    days = days.withColumn("tokens", F.col("tokens") + off)
    return quality.token_identity(days, "date_text", ["cached", "uncached", "output"], "tokens")


@query(
    "q08_dates",
    """WITH d AS (SELECT CASE WHEN o_orderkey % 1000 = 7 THEN '2024-02-30' WHEN o_orderkey % 1000 = 8 THEN '2024-2-3' ELSE '2024-' || lpad(CAST(o_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-15' END AS x FROM orders)
SELECT 'date-invalid' AS "check", x AS key, 'YYYY-MM-DD' AS expected, x AS actual FROM d WHERE x IN ('2024-02-30', '2024-2-3')
UNION ALL SELECT 'date-repeated', x, '1', CAST(count(*) AS VARCHAR) FROM d GROUP BY x HAVING count(*) > 1""",
)
def q08_dates(spark, folder):
    n = F.col("o_orderkey") % 1000
    month = F.lpad((F.col("o_custkey") % 12 + 1).cast("string"), 2, "0")
    text = F.when(n == 7, "2024-02-30").when(n == 8, "2024-2-3").otherwise(F.concat(F.lit("2024-"), month, F.lit("-15")))
    rows = t.table(spark, folder, "orders").select(text.alias("date_text")).withColumn("date", parse_date("date_text"))
    return quality.date_checks(rows, "date_text", "date")


@query(
    "q08_strict_order",
    """WITH d AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pos, CAST(l_shipdate AS DATE) AS date FROM lineitem), u AS (SELECT l_suppkey, pos, min(date) AS date FROM d GROUP BY l_suppkey, pos HAVING count(*) = 1),
s AS (SELECT *, lag(date) OVER (PARTITION BY l_suppkey ORDER BY pos) AS p FROM u)
SELECT 'date-order' AS "check", l_suppkey || '|' || date AS key, '> ' || p AS expected, CAST(date AS VARCHAR) AS actual FROM s WHERE date <= p""",
)
def q08_strict_order(spark, folder):
    """Dates in given order per account: every step back or standstill shows."""
    rows = t.table(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.to_date("l_shipdate").alias("date")
    )
    single = rows.groupBy("l_suppkey", "pos").agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("n"))
    return quality.strictly_ordered(single.where("n = 1"), "date", ["l_suppkey"])


_STEPS = "d AS (SELECT l_orderkey * 8 + l_linenumber AS pos, CAST(l_shipdate AS DATE) AS date FROM lineitem), u AS (SELECT pos, min(date) AS date FROM d GROUP BY pos HAVING count(*) = 1), s AS (SELECT *, lag(date) OVER (ORDER BY pos) AS p FROM u)"


def _one_account(spark, folder):
    rows = t.table(spark, folder, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.to_date("l_shipdate").alias("date"))
    return rows.groupBy("pos").agg(F.min("date").alias("date"), F.count(F.lit(1)).alias("n")).where("n = 1")


@query(
    "q08_strict_order_one_account",
    f"""WITH {_STEPS}
SELECT 'date-order' AS "check", CAST(date AS VARCHAR) AS key, '> ' || p AS expected, CAST(date AS VARCHAR) AS actual FROM s WHERE date <= p""",
)
def q08_strict_order_one_account(spark, folder):
    """All rows as one series: blocks are checked apart and put together at their borders."""
    return quality.strictly_ordered(_one_account(spark, folder), "date")


@query(
    "q08_order_summary",
    f"""WITH {_STEPS} SELECT count(*) AS rows, CAST(arg_min(date, pos) AS VARCHAR) AS first, CAST(arg_max(date, pos) AS VARCHAR) AS last, count(*) FILTER (date <= p) AS broken FROM s""",
)
def q08_order_summary(spark, folder):
    """Rows, first and last date and broken steps of the same series, merged from its blocks."""
    return quality.merged_order(quality.block_order(quality.order_blocks(_one_account(spark, folder), "date"), "date"))


@query(
    "q10_account_series",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS n FROM orders GROUP BY 1)
SELECT 'account-peak' AS "check", 'account-1997' AS key, CAST(max(n) + 1 AS VARCHAR) AS expected, CAST(max(n) AS VARCHAR) AS actual FROM d WHERE year(date) = 1997""",
)
def q10_account_series(spark, folder):
    """Yearly account documents, of which one states a wrong peak."""
    summary, buckets = account_source.parse_account(account_documents(spark, folder))
    found = quality.account_checks(buckets, summary, ["document"])
    return found.unionByName(account_source.account_schema_checks(summary))


# --- Q9, Q11–Q16: ledgers and sensitive text -------------------------------------------


@query(
    "q09_event_rules",
    f"""WITH {t.DEVICES} SELECT c AS "check", count(*) AS violations FROM (SELECT unnest(['event-id', 'event-calls', 'event-source', 'event-total', 'event-cost']) AS c, unnest([11, 13, 17, 19, 23]) AS m, input_order FROM device_events) WHERE input_order % m = 3 GROUP BY c""",
)
def q09_event_rules(spark, folder):
    """Events damaged in their id, calls, source, total or cost."""
    rows = t.device_events(spark, folder)

    def hit(m):
        return F.col("input_order") % m == 3

    rows = rows.withColumns(
        {
            "event_id": F.when(hit(11), F.upper("event_id")).otherwise(F.col("event_id")),
            "calls": F.when(hit(13), 2).otherwise(F.col("calls")),
            "source": F.when(hit(17), "elsewhere").otherwise(F.col("source")),
            "tokens": F.when(hit(19), F.col("tokens") + 1).otherwise(F.col("tokens")),
            "cost": F.when(hit(23), F.lit(-1)).otherwise(F.col("cost")),
        }
    )
    return quality.tally(quality.event_checks(rows))


@query("q09_spelling", NONE)
def q09_spelling(spark, folder):
    """Direct and nested numbers of the derived device ledgers agree."""
    return devices.spelling_checks(devices.parse_device_ledgers(ledger_documents(spark, folder)))


@query(
    "q09_conflicting_spelling",
    f"""WITH {t.DEVICES} SELECT CASE WHEN input_order % 4 = 1 THEN 'event-fresh_input-spelling' ELSE 'event-total-spelling' END AS "check", event_id AS key,
  CASE WHEN input_order % 4 = 1 THEN (fresh_input + 1) || ',' || fresh_input ELSE (tokens + 2) || ',' || tokens END AS actual
FROM device_events WHERE input_order % 4 IN (1, 3)""",
)
def q09_conflicting_spelling(spark, folder):
    """Device ledgers whose events state an input directly and another one nested, or two totals."""
    nested = F.col("input_order") % 4
    event = F.struct(
        F.col("event_id").alias("eventId"), iso_utc("ts").alias("occurredAt"), "source",
        F.when(nested == 1, F.col("fresh_input") + 1).alias("input"), F.when(nested == 3, F.col("tokens") + 2).alias("totalTokens"),
        F.struct(
            F.col("fresh_input").alias("freshInputTokens"), F.col("cache_read").alias("cacheReadTokens"), F.col("cache_write").alias("cacheWriteTokens"),
            F.col("output").alias("outputTokens"), F.col("tokens").alias("totalTokens"),
        ).alias("components"),
    )
    rows = t.device_events(spark, folder).withColumn("batch", F.floor(F.col("input_order") / BATCH))
    grouped = rows.groupBy("device", "device_order", "batch").agg(F.collect_list(event).alias("events"))
    documents = grouped.select("device", "device_order", F.to_json(F.struct(F.lit(fixed.LEDGER_SCHEMA).alias("schema"), "events")).alias("payload"))
    return devices.spelling_checks(devices.parse_device_ledgers(documents)).select("check", "key", "actual")


@query(
    "q11_sensitive_keys",
    """SELECT event_id, CASE WHEN event_id % 6 IN (1, 4) THEN 'Email' WHEN event_id % 6 = 2 THEN 'access-token,user_id' END AS names FROM events WHERE event_id % 6 IN (1, 2, 4)""",
)
def q11_sensitive_keys(spark, folder):
    """Field names at any depth; the same words inside values are left alone."""
    n = F.col("event_id") % 6
    text = (
        F.when(n == 1, F.lit('{"a":[{"Email": "x"}]}'))
        .when(n == 2, F.lit('{"access-token":1,"b":{"user_id" : 2}}'))
        .when(n == 3, F.lit('{"note":"the \\"email\\": field"}'))
        .when(n == 4, F.lit('{"Email":null,"emails":[]}'))
        .otherwise(F.lit('{"emailed":"email"}'))
    )
    rows = t.table(spark, folder, "events").select("event_id", F.array_join(textscan.sensitive_keys(text), ",").alias("names"))
    return rows.where(F.col("names") != "")


@query(
    "q12_credential_text",
    f"""SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{fixed.CREDENTIAL_TEXT}')
UNION ALL SELECT -1 - page_id, 'page' FROM pages WHERE regexp_matches(html, '{fixed.CREDENTIAL_TEXT}')""",
)
def q12_credential_text(spark, folder):
    """Whole documents and pages that hold credential-like text."""
    docs = t.table(spark, folder, "documents").where(textscan.credential_like("text")).select("doc_id", "source")
    pages = t.table(spark, folder, "pages").where(textscan.credential_like("html"))
    return docs.unionByName(pages.select((-1 - F.col("page_id")).alias("doc_id"), F.lit("page").alias("source")))


@query(
    "q12_planted_credentials",
    f"""SELECT doc_id, regexp_extract(planted, '{fixed.CREDENTIAL_TEXT}') AS found FROM (SELECT doc_id, text || CASE doc_id % 40 WHEN 0 THEN ' Authorization: x' WHEN 1 THEN ' Bearer abcdef.123-XYZ' WHEN 2 THEN chr(10) || 'refresh_token=' WHEN 3 THEN ' bearer short' ELSE '' END AS planted FROM documents)
WHERE regexp_matches(planted, '{fixed.CREDENTIAL_TEXT}')""",
)
def q12_planted_credentials(spark, folder):
    """Documents into which credential texts of three forms, and one that is none, were written."""
    kinds = {0: " Authorization: x", 1: " Bearer abcdef.123-XYZ", 2: "\nrefresh_token=", 3: " bearer short"}
    more = F.lit("")
    for n, extra in kinds.items():
        more = F.when(F.col("doc_id") % 40 == n, F.lit(extra)).otherwise(more)
    planted = t.table(spark, folder, "documents").select("doc_id", F.concat("text", more).alias("text"))
    return planted.where(textscan.credential_like("text")).select("doc_id", F.regexp_extract("text", fixed.CREDENTIAL_TEXT, 0).alias("found"))


@query(
    "q13_leaks",
    """WITH p AS (SELECT o_custkey % 14 AS n FROM orders)
SELECT 'leak-uuid' AS "check", count(*) AS violations FROM p WHERE n IN (10, 13) HAVING count(*) > 0 UNION ALL SELECT 'leak-path', count(*) FROM p WHERE n IN (0, 1, 3, 4, 5, 7, 11, 12) HAVING count(*) > 0
UNION ALL SELECT 'leak-separator', count(*) FROM p WHERE n <> 9 HAVING count(*) > 0""",
)
def q13_leaks(spark, folder):
    """Raw project paths in a report table."""
    from meterbook.catalog.expressions import _paths

    return quality.tally(quality.leak_checks({"projects": _paths(spark, folder)}))


@query(
    "q13_raw_sessions",
    f"""WITH {t.PREPARED} SELECT DISTINCT 'leak-session' AS "check", raw_session AS key, 'pseudonym' AS expected, raw_session AS actual FROM prepared WHERE raw_session LIKE '%7'""",
)
def q13_raw_sessions(spark, folder):
    """Public sessions that still are raw ids: those that end with a seven were left as they are."""
    rows = t.prepared(spark, folder)
    shown = rows.select(F.when(F.col("raw_session").endswith("7"), F.col("raw_session")).otherwise(F.col("session")).alias("session")).distinct()
    return quality.raw_session_leaks(shown, rows.select(F.col("raw_session").alias("session")))


@query(
    "q14_pseudonyms",
    """WITH s AS (SELECT DISTINCT 'o' || l_orderkey AS raw, CASE WHEN l_orderkey % 100 = 1 THEN 'session-collided0' ELSE 'session-' || substr(sha256('o' || l_orderkey), 1, 12) END AS pub FROM lineitem), g AS (SELECT pub, count(DISTINCT raw) AS n FROM s GROUP BY pub)
SELECT 'pseudonym-format' AS "check", pub AS key, 'session-<12 hex>' AS expected, pub AS actual FROM g WHERE NOT regexp_matches(pub, '^session-[0-9a-f]{12}$') UNION ALL SELECT 'pseudonym-collision', pub, '1', CAST(n AS VARCHAR) FROM g WHERE n > 1""",
)
def q14_pseudonyms(spark, folder):
    """A hundredth of the sessions share one malformed pseudonym."""
    rows = t.shipments(spark, folder).select(F.col("session").alias("raw_session"), F.substring("session", 2, 20).cast("bigint").alias("n"))
    public = F.when(F.col("n") % 100 == 1, F.lit("session-collided0")).otherwise(session_pseudonym("raw_session"))
    return quality.pseudonym_checks(rows.withColumn("session", public))


@query("q15_ledger", NONE)
def q15_ledger(spark, folder):
    """The rebuilt ledger reconciles with its compact records and its cutoff."""
    events = t.ledger(spark, folder)
    return quality.stack(
        quality.ledger_checks(events, rollups.compact_records(events), requestlog.baseline_cutoff(t.request_log(spark, folder))),
        quality.event_checks(events),
        quality.unique_ids(events),
    )


@query(
    "q15_ledger_damaged",
    f"""WITH {t.TWO_SOURCES}, k AS (SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tk, CAST(sum(cost) AS DOUBLE) AS c FROM ledger), d AS (SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tk, CAST(sum(cost) AS DOUBLE) AS c FROM ledger WHERE model <> 'view')
SELECT 'ledger-compact-calls' AS "check", CAST(k.n AS VARCHAR) AS expected, CAST(d.n AS VARCHAR) AS actual FROM k, d UNION ALL SELECT 'ledger-compact-tokens', CAST(k.tk AS VARCHAR), CAST(d.tk AS VARCHAR) FROM k, d UNION ALL SELECT 'ledger-compact-cost', 'more', 'less' FROM k""",
)
def q15_ledger_damaged(spark, folder):
    """Compact records that lack one model."""
    events = t.ledger(spark, folder)
    records = rollups.compact_records(events).where(F.col("model") != "view")
    found = quality.ledger_checks(events, records, requestlog.baseline_cutoff(t.request_log(spark, folder)))
    cost = F.col("check") == "ledger-compact-cost"
    return found.select(
        "check", F.when(cost, "more").otherwise(F.col("expected")).alias("expected"), F.when(cost, "less").otherwise(F.col("actual")).alias("actual")
    )


@query(
    "q16_devices",
    """WITH d AS (SELECT 'd' || (c_custkey % 4) AS device, CASE WHEN c_custkey % 4 = 2 THEN 'Europe/Berlin' ELSE 'Asia/Shanghai' END AS tz, c_nationkey FROM customer)
SELECT 'device-timezone' AS "check", CAST(c_nationkey AS VARCHAR) AS key FROM d GROUP BY c_nationkey HAVING count(DISTINCT tz) <> 1 UNION ALL SELECT 'device-label-repeated', c_nationkey || '|' || device FROM d GROUP BY c_nationkey, device HAVING count(*) > 1
UNION ALL SELECT 'device-reliable', c_nationkey || '|d3' FROM d WHERE device = 'd3'""",
)
def q16_devices(spark, folder):
    """Device sets of many accounts: nations stand for accounts, customers for devices."""
    rows = t.table(spark, folder, "customer").select(
        "c_nationkey",
        F.concat(F.lit("d"), (F.col("c_custkey") % 4).cast("string")).alias("device"),
        F.when(F.col("c_custkey") % 4 == 2, "Europe/Berlin").otherwise("Asia/Shanghai").alias("timezone"),
        (F.col("c_custkey") % 4 != 3).alias("reliable"),
    )
    return quality.device_checks(rows, by=["c_nationkey"]).select("check", "key")


@query(
    "q16_near_time_ambiguity",
    f"""WITH {t.NEAR}, p AS (SELECT source, session, model, ms, count(*) AS events FROM near JOIN ambiguous ON ambiguous.id = near.event_id GROUP BY ALL)
SELECT 'near-time-ambiguous' AS "check", source || '|' || ms AS key, 'unique pair' AS expected, CAST(events AS VARCHAR) AS actual FROM p""",
)
def q16_near_time_ambiguity(spark, folder):
    from meterbook.operators.dedup import near_time_matches

    rows = t.near_events(spark, folder)
    heads = rows.select("device").distinct().select("device", F.lit(t.TZ).alias("timezone"), F.lit(True).alias("reliable"))
    return quality.device_checks(heads, near_time_matches(rows))


# --- Q17–Q22, Q25, Q26: reports ----------------------------------------------------------


@query("q17_reconstruction", NONE)
def q17_reconstruction(spark, folder):
    return quality.reconstruction_algebra(report.reconstruction(t.shipments(spark, folder), t.account(spark, folder)))


@query(
    "q17_reconstruction_damaged",
    f"""WITH {t.SHIPMENTS}, {t.ACCOUNT}, {RECONSTRUCTION} SELECT 'gap-signed' AS "check", CAST(net_gap_tokens AS VARCHAR) AS expected, CAST(net_gap_tokens + 5 AS VARCHAR) AS actual FROM rec
UNION ALL SELECT 'gap-absolute', CAST(abs(net_gap_tokens + 5) AS VARCHAR), CAST(absolute_gap_tokens AS VARCHAR) FROM rec
UNION ALL SELECT 'project-split', CAST(reconstructed_tokens AS VARCHAR), CAST(reconstructed_tokens + 1 AS VARCHAR) FROM rec""",
)
def q17_reconstruction_damaged(spark, folder):
    made = report.reconstruction(t.shipments(spark, folder), t.account(spark, folder))
    made = made.withColumns(
        {"net_gap_tokens": F.col("net_gap_tokens") + 5, "known_project_tokens": F.col("known_project_tokens") + 1}
    )
    return quality.reconstruction_algebra(made).select("check", "expected", "actual")


@query(
    "q18_cross_views",
    f"""WITH {t.PREPARED}, a AS (SELECT count(*) AS n, sum(tokens) AS tk, CAST(sum(cost) AS DOUBLE) AS c FROM prepared), b AS (SELECT count(*) AS n, sum(tokens) AS tk, CAST(sum(cost) AS DOUBLE) AS c FROM prepared WHERE model <> 'view')
SELECT 'view-calls' AS "check", 'models' AS key, CAST(a.n AS BIGINT) AS expected, CAST(b.n AS BIGINT) AS actual FROM a, b
UNION ALL SELECT 'view-tokens', 'models', CAST(a.tk AS BIGINT), CAST(b.tk AS BIGINT) FROM a, b UNION ALL SELECT 'view-cost', 'models', CAST(floor(a.c) AS BIGINT), CAST(floor(b.c) AS BIGINT) FROM a, b""",
)
def q18_cross_views(spark, folder):
    """Views of one period against its summary; one of them lacks a model."""
    rows = t.prepared(spark, folder)
    daily = series.daily_totals(rows)
    views = {
        "summary": rollups.report_summary(rows),
        "daily": daily,
        "months": series.monthly_totals(daily),
        "activities": rollups.by_activity(rows),
        "weekday_hours": rollups.weekday_hours(rows),
        "facts": rollups.compact_facts(rows).withColumn("tokens", rollups.tokens()),
        "models": rollups.by_model(rows).where(F.col("model") != "view"),
    }
    found = quality.stack(
        quality.cross_view_checks(views),
        quality.grid_checks(views["weekday_hours"]),
        quality.compaction_checks(views["facts"], rows),
    )
    return found.select(
        "check", "key", F.col("expected").cast("double").cast("bigint").alias("expected"), F.col("actual").cast("double").cast("bigint").alias("actual")
    )


@query(
    "q18_views_tally",
    """SELECT unnest(['view-calls', 'view-cost', 'view-tokens']) AS "check", CAST(1 AS BIGINT) AS violations FROM (SELECT count(*) FROM events)""",
)
def q18_views_tally(spark, folder):
    rows = t.prepared(spark, folder)
    views = {"summary": rollups.report_summary(rows), "models": rollups.by_model(rows).where(F.col("model") != "view"), "daily": series.daily_totals(rows)}
    return quality.tally(quality.cross_view_checks(views))


@query(
    "q19_fact_rules",
    f"""WITH {t.FACTS} SELECT c AS "check", count(*) AS violations FROM (SELECT unnest(['fact-calls', 'fact-order', 'fact-weekday', 'fact-time', 'fact-cost']) AS c, hour, weekday FROM facts)
WHERE (c = 'fact-calls' AND hour = 3) OR (c = 'fact-order' AND hour = 5) OR (c = 'fact-weekday' AND weekday = 'Sun') OR (c = 'fact-time' AND (hour IN (5, 7) OR weekday = 'Sun')) OR (c = 'fact-cost' AND hour = 9) GROUP BY c""",
)
def q19_fact_rules(spark, folder):
    """Facts damaged in calls, order of times, weekday, hour and cost."""
    facts = rollups.compact_facts(t.prepared(spark, folder))
    hour = F.col("hour")
    facts = facts.withColumns(
        {
            "calls": F.when(hour == 3, 0).otherwise(F.col("calls")),
            "first_call": F.when(hour == 5, F.timestamp_add("DAY", F.lit(400), "first_call")).otherwise(F.col("first_call")),
            "last_call": F.when(hour == 7, F.timestamp_add("HOUR", F.lit(2), "last_call")).otherwise(F.col("last_call")),
            "weekday": F.when(F.col("weekday") == "Sun", "Day").otherwise(F.col("weekday")),
            "cost": F.when(hour == 9, F.lit(-1)).otherwise(F.col("cost")),
        }
    )
    return quality.tally(quality.fact_checks(facts, t.TZ))


@query(
    "q20_reasoning",
    """SELECT 'reasoning-within-output' AS "check", CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS expected, CAST(l_suppkey % 60 AS VARCHAR) AS actual FROM lineitem WHERE l_suppkey % 60 > l_quantity""",
)
def q20_reasoning(spark, folder):
    rows = t.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n"), (F.col("l_suppkey") % 60).alias("reasoning"), F.col("l_quantity").cast("bigint").alias("output")
    )
    return quality.reasoning_within_output(rows, "n")


@query(
    "q21_credit_audit",
    f"""WITH {t.RESPONSES} SELECT 'audit-turns' AS "check", CAST(CAST(sum(turns) AS DOUBLE) AS BIGINT) AS expected, CAST(sum(turns) + 2 AS BIGINT) AS actual FROM days
UNION ALL SELECT 'models-threads', threads + 1, threads FROM days WHERE has_detail AND day(date) = 7""",
)
def q21_credit_audit(spark, folder):
    """A stored credits audit against its days; its turns were changed, and the threads of every seventh of a month."""
    days = parse_usage(t.response_days(spark, folder))
    days = days.withColumn("threads", F.col("threads") + F.when(F.dayofmonth("date") == 7, 1).otherwise(0))
    audit = credits.quota(credits.credit_totals(days), F.lit(41.0)).withColumn("turns", F.col("turns") + 2)
    found = quality.stack(credits.audit_checks(audit, days), credits.credit_checks(days))
    return found.select("check", F.col("expected").cast("double").cast("bigint").alias("expected"), F.col("actual").cast("double").cast("bigint").alias("actual"))


@query(
    "q22_activity_audit",
    f"""WITH {t.RESPONSES}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM prepared),
s AS (SELECT CASE WHEN user_id % 5 = 4 THEN 'Other' ELSE upper(substr(model, 1, 1)) || ' tool' END AS name, CAST(sum(calls) AS DOUBLE) AS c FROM prepared GROUP BY 1)
SELECT 'activity-skill_invocations' AS "check", 'total' AS key, n AS expected, n + 1 AS actual FROM n UNION ALL SELECT 'skill_invocations-listed', 'total', n, n + 1 FROM n
UNION ALL SELECT 'skill_invocations-share', name, round(c / (n + 1), 9), round(c / n, 9) FROM s, n""",
)
def q22_activity_audit(spark, folder):
    """Stored activity totals against their parts; the skill total was changed."""
    days = parse_usage(t.response_days(spark, folder))
    skills = parse_tools(t.tool_days(spark, folder, "skills"), "skills")
    daily = activity.activity_days(days, skills)
    summary = activity.activity_summary(daily).withColumn("skill_invocations", F.col("skill_invocations") + 1)
    models = activity.usage_by(days, "models", "model")
    ranking_rows = activity.tool_ranking(skills, "skills")
    found = activity.audit_checks(summary, daily, models, ranking_rows)
    return found.select("check", "key", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in ("expected", "actual")])


@query(
    "q22_damaged_responses",
    f"""WITH {t.RESPONSES}, d AS (SELECT *, CAST(date AS VARCHAR) AS key FROM days)
SELECT 'models-turns' AS "check", key, CAST(turns + 5 AS VARCHAR) AS expected, CAST(turns AS VARCHAR) AS actual FROM d WHERE has_detail AND day(date) = 3
UNION ALL SELECT 'clients-turns', key, CAST(turns + 5 AS VARCHAR), CAST(turns AS VARCHAR) FROM d WHERE has_detail AND day(date) = 3
UNION ALL SELECT 'skills-buckets', key, 'true', 'false' FROM d WHERE day(date) = 5
UNION ALL SELECT 'group-by', 'plugins', 'day', 'day+week' WHERE EXISTS (SELECT 1 FROM d WHERE day(date) = 9)""",
)
def q22_damaged_responses(spark, folder):
    """Responses that disagree: turns of a day changed, a day of the tools left out, one grouped by week."""
    days = parse_usage(t.response_days(spark, folder))
    day = F.dayofmonth("date")
    days = days.withColumn("turns", F.col("turns") + F.when(day == 3, 5).otherwise(0))
    skills = parse_tools(t.tool_days(spark, folder, "skills"), "skills").where(day != 5)
    plugins = parse_tools(t.tool_days(spark, folder, "plugins"), "plugins").withColumn("group_by", F.when(day == 9, "week").otherwise(F.col("group_by")))
    return activity.response_checks(days, skills, plugins)


@query("q22_responses", NONE)
def q22_responses(spark, folder):
    """The derived responses agree in dates and grouping; nested turns add up."""
    days = parse_usage(t.response_days(spark, folder))
    tools = [parse_tools(t.tool_days(spark, folder, k), k) for k in ("skills", "plugins")]
    return activity.response_checks(days, *tools)


@query(
    "q25_freshness",
    f"""WITH {t.TWO_SOURCES} SELECT source, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS newest,
  floor((greatest(0e0, (epoch_ms(TIMESTAMP '2024-01-21 00:00:00') - epoch_ms(max(ts))) / 3600000e0) + 2.220446049250313e-16) * 1e2 + 5e-1) / 1e2 AS age_hours,
  (epoch_ms(TIMESTAMP '2024-01-21 00:00:00') - epoch_ms(max(ts))) / 3600000e0 <= 24 AS is_fresh FROM ledger GROUP BY source""",
)
def q25_freshness(spark, folder):
    """Newest event per source, seen from a fixed instant."""
    return rollups.freshness(t.ledger(spark, folder), F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))


@query(
    "q26_quality_facts",
    f"""WITH {t.SHIPMENTS}, {t.ACCOUNT}, {RECONSTRUCTION}, d AS (SELECT date_diff('day', min(date), max(date)) + 1 AS c, count(DISTINCT date) AS r FROM shipments)
SELECT 'reconciliation' AS code, 'pass' AS outcome, NULL AS ratio FROM rec UNION ALL SELECT 'calendar-continuity', CASE WHEN c = r THEN 'pass' ELSE 'fail' END, NULL FROM d
UNION ALL SELECT 'project-token-attribution', CASE WHEN project_coverage >= 0.999999e0 THEN 'full' ELSE 'partial' END, floor((project_coverage + 2.220446049250313e-16) * 1e8 + 5e-1) / 1e8 FROM rec
UNION ALL SELECT 'activity-token-attribution', CASE WHEN activity_coverage >= 0.999999e0 THEN 'full' ELSE 'partial' END, floor((activity_coverage + 2.220446049250313e-16) * 1e8 + 5e-1) / 1e8 FROM rec
UNION ALL SELECT 'source-disclosure', 'collected', NULL FROM rec""",
)
def q26_quality_facts(spark, folder):
    """Quality outcomes computed from figures: totals, calendar, coverage."""
    from meterbook.operators.keyed import with_totals

    rows = t.shipments(spark, folder)
    figures = rollups.report_summary(rows).select(
        "tokens",
        (F.col("fresh_input") + F.col("cache_read") + F.col("cache_write") + F.col("output")).alias("component_tokens"),
        "calls",
        "calendar_days",
        F.col("listed_days").alias("day_rows"),
    )
    daily_calls = series.daily_totals(rows).agg(F.sum("calls").alias("view_calls"))
    made = report.reconstruction(rows, t.account(spark, folder)).select("project_coverage", "activity_coverage")
    return quality.quality_facts(with_totals(with_totals(figures, daily_calls), made))


# --- Q23, Q24: corpus scans ------------------------------------------------------------------

WORDS = "|".join(fixed.PLACEHOLDER_WORDS)


def _excused(value: str) -> str:
    compact = f"regexp_replace(lower(trim({value})), '[\\s''\"`]', '', 'g')"
    return f"(regexp_matches(lower({value}), '{WORDS}') OR regexp_full_match({compact}, '[x*\\-]+'))"


def _texts(spark, folder):
    docs = t.table(spark, folder, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = t.table(spark, folder, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    turns = t.table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"
    )
    return docs.unionByName(pages).unionByName(turns)


TEXTS = """texts AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations)"""


@query(
    "q23_secret_scan",
    f"""WITH {TEXTS}, formats AS (
  {" UNION ALL ".join(f"SELECT id, '{label}' AS finding, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM texts" for label, pattern in fixed.SECRET_PATTERNS)}),
m AS (SELECT id, unnest(regexp_extract_all(text, '{fixed.SECRET_ASSIGNMENT.replace(chr(39), chr(39) * 2)}')) AS x FROM texts),
a AS (SELECT id, lower(regexp_extract(x, '{fixed.SECRET_ASSIGNMENT.replace(chr(39), chr(39) * 2)}', 1)) AS name,
  concat({", ".join(f"regexp_extract(x, '{fixed.SECRET_ASSIGNMENT.replace(chr(39), chr(39) * 2)}', {i})" for i in (2, 3, 4))}) AS value FROM m)
SELECT id, finding, value FROM formats WHERE NOT {_excused("value")}
UNION ALL SELECT id, 'secret assignment', value FROM a WHERE NOT {_excused("value")} AND NOT (name = 'token' AND (regexp_matches(value, '\\s|[\\x{{3400}}-\\x{{9fff}}]') OR regexp_full_match(value, '[A-Z][A-Z0-9_]*')))""",
)
def q23_secret_scan(spark, folder):
    """Secrets in documents, pages and conversations, whole texts, placeholders excused."""
    return textscan.secret_findings(_texts(spark, folder), ["id"])


@query(
    "q24_private_scan",
    f"""WITH {TEXTS}, h AS (
  {" UNION ALL ".join(f"SELECT id, '{label}' AS finding, lower(unnest(regexp_extract_all(text, '{pattern}', 1))) AS value FROM texts" for label, pattern in fixed.PRIVATE_PATH_PATTERNS)}
  UNION ALL SELECT id, '{fixed.UUID_FINDING}', lower(v) FROM (SELECT id, unnest(regexp_extract_all(text, '(?i)https?://\\S*|\\b{fixed.UUID_TEXT}\\b')) AS v FROM texts) WHERE NOT starts_with(lower(v), 'http'))
SELECT id, finding, value FROM h WHERE value NOT IN ('all users', 'default', 'default user', 'public', 'shared') AND NOT {_excused("value")}""",
)
def q24_private_scan(spark, folder):
    """Home folders and UUIDs in documents, pages and conversations."""
    return textscan.private_findings(_texts(spark, folder), ["id"])


@query(
    "q24_planted_paths",
    f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'see /Users/' || replace(p_name, ' ', '_') || '/x' WHEN 1 THEN 'at C:' || chr(92) || 'Users' || chr(92) || 'Public' || chr(92) || 'a' WHEN 2 THEN 'id 0199ab00-1111-2222-3333-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')
  WHEN 3 THEN 'https://h.example/0199ab00-1111-2222-3333-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') WHEN 4 THEN '/home/example_user/y' ELSE p_name END AS text, p_name FROM part)
SELECT p_partkey, 'macOS home path' AS finding, lower(replace(p_name, ' ', '_')) AS value FROM p WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, '{fixed.UUID_FINDING}', '0199ab00-1111-2222-3333-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') FROM p WHERE p_partkey % 6 = 2""",
)
def q24_planted_paths(spark, folder):
    """Paths and UUIDs planted in texts derived from parts; public and placeholder ones are excused."""
    n, name = F.col("p_partkey") % 6, F.col("p_name")
    uuid = F.concat(F.lit("0199ab00-1111-2222-3333-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    text = (
        F.when(n == 0, F.concat(F.lit("see /Users/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("/x")))
        .when(n == 1, F.lit("at C:\\Users\\Public\\a"))
        .when(n == 2, F.concat(F.lit("id "), uuid))
        .when(n == 3, F.concat(F.lit("https://h.example/"), uuid))
        .when(n == 4, F.lit("/home/example_user/y"))
        .otherwise(name)
    )
    return textscan.private_findings(t.table(spark, folder, "part").select("p_partkey", text.alias("text")), ["p_partkey"])


