"""Inputs that once led to a wrong answer: each query shows that the right one is given."""

from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.catalog import tables as t
from meterbook.catalog.registry import query
from meterbook.functions.identity import label_sessions, session_key
from meterbook.functions.timeparts import iso_utc, parse_instant
from meterbook.functions.tokens import safe_amount
from meterbook.operators import dedup, quality, rollups, textscan
from meterbook.operators.projects import device_project_labels, resolve_projects
from meterbook.plans import merge
from meterbook.session import scratch_path
from meterbook.sources import portable


@query(
    "u03_null_swapped_copies",
    "SELECT event_id % 10 = 0 AS conflicting, count(*) AS ids FROM events WHERE event_id % 3 = 1 GROUP BY 1",
)
def u03_null_swapped_copies(spark, folder):
    """Copies that differ only in which of session and model is null are in conflict."""
    rows = resolve_projects(merge.with_provenance(t.device_events(spark, folder)), t.alias_map(spark, folder))
    swapped, on_a = F.col("input_order") % 10 == 0, F.col("device") == "A"
    rows = rows.withColumns(
        {
            "session": F.when(swapped & on_a, "x").when(swapped, None).otherwise("s"),
            "model": F.when(swapped & on_a, None).when(swapped, "x").otherwise("m"),
        }
    )
    found = dedup.exact_dedup(rows).where("copies > 1")
    return found.groupBy("conflicting").agg(F.count(F.lit(1)).alias("ids"))


@query(
    "s03_csv_column_orders",
    f"""WITH {t.USAGE} SELECT session, CAST(sum(fresh_input) AS BIGINT) AS fresh_input, CAST(sum(output) AS BIGINT) AS output, count(*) AS records FROM usage GROUP BY session""",
)
def s03_csv_column_orders(spark, folder):
    """Two folders of CSV files with the same columns in another order, read as one."""
    path = scratch_path(spark, "portable-orders")
    rows = t.usage(spark, folder).select(
        "event_id", iso_utc("ts").alias("timestamp"), F.lit("p").alias("project"), "session", "model", F.lit("a").alias("activity"),
        F.col("fresh_input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cost").alias("cost_usd"), "calls",
    )
    names = rows.columns[1:]
    for part, order in enumerate((names, names[::-1])):
        rows.where(F.col("event_id") % 2 == part).select(*order).write.option("header", True).csv(f"{path}/part={part}")
    usage = portable.normalize(portable.read_csv(spark, path))
    return usage.groupBy("session").agg(F.sum("fresh_input").alias("fresh_input"), F.sum("output").alias("output"), F.count(F.lit(1)).alias("records"))


@query(
    "s14_escaped_fields",
    """SELECT CASE event_id % 4 WHEN 1 THEN 'response-sensitive-key' WHEN 2 THEN 'response-credential' ELSE 'response-shape' END AS "check", count(*) AS violations
FROM events WHERE event_id % 4 <> 0 GROUP BY 1""",
)
def s14_escaped_fields(spark, folder):
    """Escapes hide neither a field name nor a credential, and a body that does not parse is refused."""
    n = F.col("event_id") % 4
    item = (
        F.when(n == 1, F.lit(r'{"\u0065mail":"x"}'))
        .when(n == 2, F.lit(r'{"n":"Authorization\u003a x"}'))
        .when(n == 3, F.lit('{"n":'))
        .otherwise(F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit("}")))
    )
    bodies = t.table(spark, folder, "events").select(F.lit("usage").alias("kind"), F.concat(F.lit('{"data":['), item, F.lit("]}")).alias("payload"))
    return quality.tally(textscan.gate(bodies)[1])


@query(
    "q03_undated_times",
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'dated' ELSE 'undated' END AS kind, count(*) FILTER (event_id % 3 = 0) AS parsed, count(*) AS given FROM events GROUP BY 1""",
)
def q03_undated_times(spark, folder):
    """A time without a date is no instant, whatever the clock says."""
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.date_format("ts", "'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "HH:mm:ss'Z'"))
    rows = t.table(spark, folder, "events").select(F.when(n == 0, "dated").otherwise("undated").alias("kind"), parse_instant(text).alias("at"))
    return rows.groupBy("kind").agg(F.count("at").alias("parsed"), F.count(F.lit(1)).alias("given"))


@query(
    "q06_large_amounts",
    """SELECT event_id % 5 = 0 AS large, count(*) AS records, count(*) FILTER (event_id % 5 <> 0) AS kept, count(*) FILTER (event_id % 5 = 0) AS refused FROM events GROUP BY 1""",
)
def q06_large_amounts(spark, folder):
    """An amount is accepted only if it is kept: one beyond the decimal is refused, not read as nothing."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit("e30"))).otherwise(F.col("value").cast("string"))
    rows = t.table(spark, folder, "events").select("event_id", (F.col("event_id") % 5 == 0).alias("large"), text.alias("cost"))
    refused = quality.number_checks(rows, "event_id", [], ["cost"]).select(F.col("key").cast("bigint").alias("event_id"), F.lit(1).alias("refused"))
    joined = rows.withColumn("amount", safe_amount("cost")).join(refused, "event_id", "left")
    return joined.groupBy("large").agg(F.count(F.lit(1)).alias("records"), F.count("amount").alias("kept"), F.count("refused").alias("refused"))


@query(
    "q13_sessions_in_texts",
    """SELECT 'leak-session' AS "check", 'u' || user_id AS key FROM events WHERE user_id % 3 <> 2 GROUP BY user_id""",
)
def q13_sessions_in_texts(spark, folder):
    """Raw session ids inside another column's text, and inside an array of structs."""
    rows = t.usage(spark, folder).select("user_id", "session").distinct()
    n = F.col("user_id") % 3
    shown = rows.select(
        F.when(n == 0, F.concat(F.lit("project "), "session", F.lit(", moved"))).otherwise("project").alias("project"),
        F.array(F.struct(F.lit(1).alias("n"), F.when(n == 1, F.col("session")).otherwise("hidden").alias("name"))).alias("items"),
        session_key("session").alias("session"),
    )
    return quality.raw_session_leaks(shown, rows.select("session")).select("check", "key")


@query(
    "q13_paths_in_arrays",
    """SELECT CASE WHEN event_id % 4 = 1 THEN 'leak-path' ELSE 'leak-uuid' END AS "check", count(*) AS violations FROM events WHERE event_id % 4 IN (1, 2) GROUP BY 1""",
)
def q13_paths_in_arrays(spark, folder):
    """Paths and UUIDs are found inside arrays and structs."""
    n = F.col("event_id") % 4
    value = F.when(n == 1, "/Users/somebody/file").when(n == 2, "0199ab00-1111-2222-3333-00000000002a").otherwise("plain")
    rows = t.table(spark, folder, "events").select(F.struct(F.array(F.lit("plain"), value).alias("names")).alias("detail"))
    return quality.tally(quality.leak_checks({"table": rows}))


@query(
    "p11_shared_prefix",
    f"""WITH {t.USAGE} SELECT 'session-000000000000' AS session, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM usage GROUP BY usage.session""",
)
def p11_shared_prefix(spark, folder):
    """Sessions whose labels collide stay apart: only the whole key is grouped by."""
    rows = t.prepared(spark, folder)
    forced = rows.withColumn("session", F.concat(F.lit("session-000000000000"), "raw_session"))
    return label_sessions(rollups.by_session(forced)).select("session", "tokens", "calls")


@query(
    "p19_blank_spellings",
    """SELECT 'input-alias' AS "check", count(*) AS violations FROM events WHERE event_id % 3 <> 0""",
)
def p19_blank_spellings(spark, folder):
    """Two spellings of a field are refused, a null or blank one included."""
    n = F.col("event_id") % 3
    extra = F.when(n == 1, ',"input_tokens":null').when(n == 2, ',"input_tokens":""').otherwise("")
    record = F.concat(F.lit('{"inputTokens":'), F.col("event_id").cast("string"), extra, F.lit("}"))
    parsed = portable.parse_records(t.table(spark, folder, "events").select(record.alias("record")))
    return quality.tally(portable.checks(parsed)).where(F.col("check") == "input-alias")


@query(
    "a18_merge_balance",
    "SELECT 'x' AS \"check\", CAST(0 AS BIGINT) AS violations WHERE false",
)
def a18_merge_balance(spark, folder):
    """What exact and near-time deduplication removed accounts for the whole difference."""
    merged = merge.merge_events(t.near_events(spark, folder))
    return quality.tally(merge.audit_checks(merge.token_audit(merged)))


@query(
    "a18_merge_unbalanced",
    """SELECT unnest(['merge-balance-calls', 'merge-balance-cache_write', 'merge-balance-tokens', 'merge-balance-fresh_input', 'merge-balance-cache_read', 'merge-balance-output']) AS "check",
  CAST(1 AS BIGINT) AS violations FROM (SELECT count(*) FROM events)""",
)
def a18_merge_unbalanced(spark, folder):
    """The audit fails where a merged event was lost on the way."""
    merged = merge.merge_events(t.near_events(spark, folder))
    lost = merge.MergedEvents(merged.input, merged.distinct, merged.matches, merged.events.where(F.col("source") != fixed.SOURCE_BASELINE))
    return quality.tally(merge.audit_checks(merge.token_audit(lost)))


@query(
    "p20_fingerprints_alike",
    """SELECT DISTINCT 'abcdef' || lpad(CAST(user_id AS VARCHAR), 58, '0') AS fingerprint, 'repo · abcdef' || lpad(CAST(user_id AS VARCHAR), 58, '0') AS label FROM events""",
)
def p20_fingerprints_alike(spark, folder):
    """Repositories of one folder name whose fingerprints begin alike keep labels of their own."""
    prints = F.concat(F.lit("abcdef"), F.lpad(F.col("user_id").cast("string"), 58, "0"))
    items = t.usage(spark, folder).select(F.lit("A").alias("device"), F.lit("/w/repo").alias("project"), prints.alias("fingerprint")).distinct()
    return device_project_labels(items).select("fingerprint", "label")
