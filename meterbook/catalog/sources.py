"""Readers and writers over text that Spark derives from the given tables.

Queries that need files write them to the shared folder the cluster names.
"""

import json
from functools import reduce

from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.catalog import tables as t
from meterbook.catalog.registry import query, sql_time
from meterbook.functions.timeparts import iso_utc
from meterbook.operators import quality, ranking, rollups, textscan
from meterbook.operators.keyed import keyed_join
from meterbook.plans import report
from meterbook.session import scratch_path
from meterbook.sources import account as account_source
from meterbook.sources import devices, exports, portable, requestlog, responses, rollout, sinks, splitjson

BATCH = 100  # records per derived document


def portable_struct():
    """A portable record of a usage row; spellings change from row to row."""
    n = F.col("event_id") % 3
    offset = F.when(n == 0, F.lit("Z")).when(n == 1, F.lit("+00:00")).otherwise(F.lit("+0000"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), offset)
    return F.struct(
        F.when(n != 2, F.concat(F.lit("row-"), F.col("event_id").cast("string"))).alias("rowId"),
        stamp.alias("timestamp"),
        F.concat(F.lit(" project-"), (F.col("user_id") % 12).cast("string"), F.lit(" ")).alias("project"),
        F.when(n == 0, F.col("session")).alias("session"),
        F.when(n == 1, F.col("session")).alias("sessionId"),
        F.when(n == 2, F.col("session")).alias("session_id"),
        "model",
        F.when(n == 0, F.coalesce("activity", F.lit("none"))).alias("activity"),
        F.when(n != 0, F.coalesce("activity", F.lit("none"))).alias("category"),
        F.when(n == 0, F.col("fresh_input")).alias("inputTokens"),
        F.when(n != 0, F.col("fresh_input")).alias("input_tokens"),
        F.when(F.col("output") > 0, F.col("output")).alias("outputTokens"),
        F.col("cache_read").alias("cacheReadTokens"),
        F.col("cache_write").cast("string").alias("cache_write_tokens"),
        F.when(n == 0, F.col("cost").cast("double")).alias("estimatedCostUsd"),
        F.when(n == 1, F.col("cost").cast("double")).alias("estimated_cost_usd"),
        F.when(n == 2, F.col("cost").cast("string")).alias("cost_usd"),
        "calls",
    )


def portable_lines(spark, folder):
    return t.usage(spark, folder).select(F.lit("events").alias("document"), F.to_json(portable_struct()).alias("record"))


def portable_documents(spark, folder):
    """JSON documents of a hundred records each."""
    rows = t.usage(spark, folder).select(F.floor(F.col("event_id") / BATCH).alias("batch"), portable_struct().alias("r"))
    return rows.groupBy("batch").agg(F.collect_list("r").alias("records")).select(
        F.concat(F.lit("doc-"), F.col("batch").cast("string")).alias("document"),
        F.to_json(
            F.struct(F.lit(fixed.PORTABLE_SCHEMA).alias("schema"), F.lit(t.TZ).alias("timezone"), F.lit(True).alias("synthetic"), "records")
        ).alias("payload"),
    )


PORTABLE = f"""WITH {t.USAGE} SELECT CASE WHEN event_id % 3 <> 2 THEN 'row-' || event_id END AS row_id, {sql_time('ts')} AS ts, session, 'project-' || (user_id % 12) AS project, model,
  coalesce(activity, 'none') AS activity, fresh_input, cache_read, cache_write, output, calls, CAST(cost AS DOUBLE) AS cost FROM usage"""
PORTABLE_COLUMNS = ("row_id", "ts", "session", "project", "model", "activity", "fresh_input", "cache_read", "cache_write", "output", "calls", "cost")


@query("s01_portable_documents", PORTABLE)
def s01_portable_documents(spark, folder):
    parsed = portable.parse_records(portable.parse_documents(portable_documents(spark, folder)))
    return portable.normalize(parsed).select(*PORTABLE_COLUMNS)


def one_document(spark, folder, head, record):
    """One JSON document of a record per usage row, written as files that follow each other, and ranges that make about forty of it.

    Many tasks write it: the files hold ranges of the order of the events.
    """
    rows = t.usage(spark, folder)
    last = rows.agg(F.max("event_id")).first()[0]
    texts = rows.select(F.col("event_id").alias("at"), F.concat(F.to_json(record), F.when(F.col("event_id") != last, ",").otherwise("]}")).alias("value"))
    opened = spark.range(1).select(F.lit(-1).cast("bigint").alias("at"), F.lit(head).alias("value"))
    path = scratch_path(spark, "one-document")
    opened.unionByName(texts).repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    return path, min(splitjson.SPLIT_BYTES, max(1 << 16, size // 40))


def _head(schema, **fields):
    return json.dumps({"schema": schema, **fields, "records": []})[:-2]


@query("s01_one_large_document", PORTABLE)
def s01_one_large_document(spark, folder):
    """All records in one document, which many tasks read."""
    path, split = one_document(spark, folder, _head(fixed.PORTABLE_SCHEMA, timezone=t.TZ, synthetic=True), portable_struct())
    records, _ = portable.read_split_documents(spark, path, split, parts=True)
    return portable.normalize(portable.parse_records(records)).select(*PORTABLE_COLUMNS)


@query(
    "s01_large_document_checks",
    f"""SELECT * FROM (VALUES ('document-root-field', 'known root fields', 'note'), ('document-schema', '{fixed.PORTABLE_SCHEMA}', 'other')) v("check", expected, actual) WHERE (SELECT count(*) FROM events) > 0""",
)
def s01_large_document_checks(spark, folder):
    """The same document with another schema name and a field too many."""
    path, split = one_document(spark, folder, _head("other", note={"a": [1, 2], "b": "],{"}, timezone=t.TZ), portable_struct())
    return portable.read_split_documents(spark, path, split, parts=True)[1].drop("key")


@query("s02_portable_lines", PORTABLE)
def s02_portable_lines(spark, folder):
    """Written as JSON lines and read back."""
    path = scratch_path(spark, "portable-lines")
    portable_lines(spark, folder).select(F.col("record").alias("value")).write.text(path)
    return portable.normalize(portable.parse_records(portable.read_lines(spark, path))).select(*PORTABLE_COLUMNS)


@query("s03_portable_csv", PORTABLE.replace("coalesce(activity, 'none')", "coalesce(activity, 'no, \"label\"' || chr(10) || 'here')"))
def s03_portable_csv(spark, folder):
    """Written as CSV with quotes, commas and line breaks inside fields, and read back."""
    path = scratch_path(spark, "portable-csv")
    rows = t.usage(spark, folder).select(
        F.when(F.col("event_id") % 3 != 2, F.concat(F.lit("row-"), F.col("event_id").cast("string"))).alias("row_id"),
        iso_utc("ts").alias("timestamp"),
        F.concat(F.lit("project-"), (F.col("user_id") % 12).cast("string")).alias("project"),
        "session",
        "model",
        F.coalesce("activity", F.lit('no, "label"\nhere')).alias("activity"),
        F.col("fresh_input").alias("input_tokens"),
        F.col("output").alias("output_tokens"),
        F.col("cache_read").alias("cache_read_tokens"),
        F.col("cache_write").alias("cache_write_tokens"),
        F.col("cost").alias("cost_usd"),
        "calls",
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return portable.normalize(portable.read_csv(spark, path)).select(*PORTABLE_COLUMNS)


def export_record():
    """An export record of a usage row."""
    return F.struct(
        "project",
        F.concat(F.lit("rollout-"), "session").alias("sessionId"),
        iso_utc("ts").alias("timestamp"),
        F.col("activity").alias("category"),
        F.lit("codex").alias("provider"),
        "model",
        F.col("fresh_input").alias("inputTokens"),
        F.col("output").alias("outputTokens"),
        (F.col("output") - F.when(F.col("output") > 0, 1).otherwise(0)).alias("reasoningTokens"),
        F.col("cache_read").alias("cacheReadTokens"),
        F.col("cache_write").alias("cacheWriteTokens"),
        "cost",
        "calls",
    )


def export_documents(spark, folder):
    """Session exports of a hundred records each, with day, model and activity tables of their own."""
    rows = t.usage(spark, folder).withColumn("batch", F.floor(F.col("event_id") / BATCH))
    day = F.struct(
        F.col("d").alias("Date"), F.col("c").alias("Cost (USD)"), F.col("n").alias("API Calls"), F.col("s").alias("Sessions"),
        F.col("t").alias("Input Tokens"), F.lit(0).alias("Output Tokens"), F.lit(0).alias("Cache Read Tokens"), F.lit(0).alias("Cache Write Tokens"),
    )
    days = rows.groupBy("batch", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(
        F.sum("cost").alias("c"), F.sum("calls").alias("n"), F.countDistinct("session").alias("s"), F.sum("fresh_input").alias("t")
    )
    days = days.groupBy("batch").agg(F.sort_array(F.collect_list(day)).alias("daily"))
    models = rows.groupBy("batch", "model").agg(F.sum("cost").alias("c"), F.sum("calls").alias("n"))
    models = models.groupBy("batch").agg(
        F.sort_array(F.collect_list(F.struct(F.col("model").alias("Model"), F.col("c").alias("Cost (USD)"), F.col("n").alias("API Calls")))).alias("models")
    )
    records = rows.groupBy("batch").agg(
        F.collect_list(export_record()).alias("records"), F.sum("cost").alias("c"), F.sum("calls").alias("n"), F.countDistinct("session").alias("s")
    )
    joined = records.join(days, "batch").join(models, "batch")
    return joined.select(
        F.concat(F.lit("export-"), F.col("batch").cast("string")).alias("document"),
        F.to_json(
            F.struct(
                F.lit(fixed.EXPORT_SCHEMA).alias("schema"),
                F.array(F.struct(F.col("c").alias("Cost (USD)"), F.col("n").alias("API Calls"), F.col("s").alias("Sessions"))).alias("summary"),
                F.array(F.struct(F.lit("all").alias("label"), "daily", "models")).alias("periods"),
                "records",
            )
        ).alias("payload"),
    )


@query(
    "s04_session_export",
    f"""WITH {t.USAGE} SELECT 'export-' || (event_id // 100) AS document, {sql_time('ts')} AS ts, 'rollout-' || session AS session, model, project, activity, CAST(cost AS DOUBLE) AS cost, calls, fresh_input, cache_read, cache_write, output, tokens,
  greatest(output - 1, 0) AS reasoning FROM usage""",
)
def s04_session_export(spark, folder):
    rows = exports.export_records(exports.parse_exports(export_documents(spark, folder)))
    return rows.drop("input_order", "provider")


@query(
    "s04_one_large_export",
    f"""WITH {t.USAGE} SELECT {sql_time('ts')} AS ts, 'rollout-' || session AS session, model, project, activity, CAST(cost AS DOUBLE) AS cost, calls, fresh_input, cache_read, cache_write, output, tokens,
  greatest(output - 1, 0) AS reasoning, event_id - (SELECT min(event_id) FROM usage) AS nth FROM usage""",
)
def s04_one_large_export(spark, folder):
    """All records in one export, which many tasks read; their places keep the order of the document."""
    head = _head(fixed.EXPORT_SCHEMA, summary=[{"Cost (USD)": 1, "API Calls": 2}], periods=[{"label": "all", "daily": [{"Date": "2024-01-01"}], "models": []}])
    path, split = one_document(spark, folder, head, export_record())
    rows = ranking.ordered_positions(exports.read_split_records(spark, path, split, parts=True), [F.col("input_order")], rank="nth")
    return rows.withColumn("nth", F.col("nth") - 1).drop("document", "input_order", "provider")


@query(
    "s04_export_days",
    f"""WITH {t.USAGE} SELECT 'export-' || (event_id // 100) AS document, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS calls, count(DISTINCT session) AS sessions, CAST(sum(fresh_input) AS BIGINT) AS fresh_input,
  CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(0 AS BIGINT) AS output FROM usage GROUP BY 1, 2""",
)
def s04_export_days(spark, folder):
    return exports.export_days(exports.parse_exports(export_documents(spark, folder)))


@query(
    "s05_request_log",
    f"""WITH {t.TWO_SOURCES} SELECT request_id, {sql_time('make_timestamp(created_at * 1000000)')} AS ts, session, model, CAST(cost AS DOUBLE) AS cost, CAST(1 AS BIGINT) AS calls, cache_creation AS observed_cache_creation, fresh_input, cache_read,
  CAST(0 AS BIGINT) AS cache_write, output, fresh_input + cache_read + output AS tokens FROM request_log WHERE app_type = 'codex'""",
)
def s05_request_log(spark, folder):
    return requestlog.baseline_rows(t.request_log(spark, folder))


@query("s05_request_cutoff", f"WITH {t.TWO_SOURCES} SELECT c AS cutoff_seconds FROM cutoff")
def s05_request_cutoff(spark, folder):
    return requestlog.baseline_cutoff(t.request_log(spark, folder))


@query("s06_rollout_meta", f"WITH {t.ROLLOUTS} SELECT file_path, session, project, fingerprint FROM meta")
def s06_rollout_meta(spark, folder):
    return rollout.parse_rollout_meta(t.rollout_lines(spark, folder))


def account_documents(spark, folder):
    """Account series as documents, one per year."""
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    days = t.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(cents).alias("n"))
    bucket = F.struct(F.col("d").cast("string").alias("startDate"), F.col("n").alias("tokens"))
    years = days.groupBy(F.year("d").alias("y")).agg(
        F.sort_array(F.collect_list(bucket)).alias("dailyUsageBuckets"), F.sum("n").alias("total"), F.max("n").alias("peak")
    )
    summary = F.struct(F.col("total").alias("lifetimeTokens"), (F.col("peak") + F.when(F.col("y") == 1997, 1).otherwise(0)).alias("peakDailyTokens"))
    return years.select(
        F.concat(F.lit("account-"), F.col("y").cast("string")).alias("document"),
        F.to_json(F.struct(F.lit(fixed.ACCOUNT_SCHEMA).alias("schema"), summary.alias("summary"), "dailyUsageBuckets")).alias("payload"),
    )


@query(
    "s07_account_series",
    """SELECT 'account-' || year(o_orderdate) AS document, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS tokens FROM orders GROUP BY ALL""",
)
def s07_account_series(spark, folder):
    _, buckets = account_source.parse_account(account_documents(spark, folder))
    return buckets.select("document", "date", "tokens")


@query(
    "s08_daily_usage",
    f"""WITH {t.RESPONSES}, m AS (SELECT date, model, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns FROM detail GROUP BY ALL)
SELECT CAST(days.date AS VARCHAR) AS date, CAST(credits AS DOUBLE) AS credits, cached, uncached, output, tokens, days.threads AS day_threads, days.turns AS day_turns, model, m.threads, m.turns FROM days LEFT JOIN m USING (date)""",
)
def s08_daily_usage(spark, folder):
    """Days with their nested model detail unfolded; days without detail keep one row."""
    days = responses.parse_usage(t.response_days(spark, folder))
    named = days.select("date", "credits", "cached", "uncached", "output", "tokens", F.col("threads").alias("day_threads"), F.col("turns").alias("day_turns"), F.explode_outer("models").alias("m"))
    return named.select(*[c for c in named.columns if c != "m"], "m.model", "m.threads", "m.turns")


@query(
    "s09_activity_tools",
    f"""WITH {t.TOOLS} SELECT CAST(date AS VARCHAR) AS date, 'plugins' AS kind, name, name AS display_name, plugin_id, count(*) AS invocations FROM tools GROUP BY ALL
UNION ALL SELECT CAST(date AS VARCHAR), 'skills', name, name, NULL, count(*) FROM tools GROUP BY date, name""",
)
def s09_activity_tools(spark, folder):
    out = None
    for kind in ("skills", "plugins"):
        days = responses.parse_tools(t.tool_days(spark, folder, kind), kind)
        rows = days.select("date", F.lit(kind).alias("kind"), F.inline("items"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ledger_documents(spark, folder):
    """Device ledgers as documents of a hundred events; half spell the numbers directly, half nested."""
    rows = t.device_events(spark, folder).withColumn("batch", F.floor(F.col("input_order") / BATCH))
    direct = F.col("input_order") % 2 == 0
    event = F.struct(
        F.col("event_id").alias("eventId"),
        F.when(direct, iso_utc("ts")).alias("occurredAt"),
        F.when(~direct, iso_utc("ts")).alias("timestamp"),
        "source",
        F.col("session").alias("sessionId"),
        "model",
        F.when(direct, F.col("project")).alias("project"),
        F.when(~direct, F.col("project")).alias("projectAlias"),
        F.col("fingerprint").alias("projectFingerprint"),
        F.when(direct, F.col("activity")).alias("activity"),
        F.when(~direct, F.col("activity")).alias("task"),
        F.col("cost").alias("costUsd"),
        F.when(direct, F.col("fresh_input")).alias("input"),
        F.when(direct, F.col("cache_read")).alias("cacheReadTokens"),
        F.struct(
            F.when(~direct, F.col("fresh_input")).alias("freshInputTokens"),
            F.col("cache_read").alias("cacheReadTokens"),
            F.col("cache_write").alias("cacheWriteTokens"),
            F.col("output").alias("outputTokens"),
            F.when(~direct, F.col("tokens")).alias("totalTokens"),
        ).alias("components"),
    )
    grouped = rows.groupBy("device", "device_order", "batch").agg(F.collect_list(event).alias("events"))
    return grouped.select(
        "device",
        "device_order",
        F.concat_ws("-", "device", F.col("batch").cast("string")).alias("document"),
        F.to_json(F.struct(F.lit(fixed.LEDGER_SCHEMA).alias("schema"), F.lit(t.TZ).alias("timezone"), "events")).alias("payload"),
    )


@query(
    "s10_device_ledgers",
    f"""WITH {t.DEVICES} SELECT device, event_id, {sql_time('ts')} AS ts, source, session, model, project, activity, fingerprint, CAST(cost AS DOUBLE) AS cost, calls, fresh_input, cache_read, cache_write, output, tokens,
  device AS devices, source AS sources FROM device_events""",
)
def s10_device_ledgers(spark, folder):
    events = devices.ledger_events(devices.parse_device_ledgers(ledger_documents(spark, folder)))
    return events.drop("device_order", "input_order", "source_event_ids")


@query(
    "s11_alias_map",
    """SELECT 'd' || (c_nationkey % 3) AS device, 'p' || c_custkey AS project, 'a' || (c_custkey % 7) AS alias FROM customer""",
)
def s11_alias_map(spark, folder):
    entry = F.struct(
        F.concat(F.lit(" d"), (F.col("c_nationkey") % 3).cast("string")).alias("device"),
        F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("project"),
        F.concat(F.lit("a"), (F.col("c_custkey") % 7).cast("string")).alias("alias"),
    )
    batches = t.table(spark, folder, "customer").groupBy(F.floor(F.col("c_custkey") / BATCH).alias("b")).agg(F.collect_list(entry).alias("aliases"))
    documents = batches.select(
        F.col("b").cast("string").alias("document"), F.to_json(F.struct(F.lit(fixed.ALIAS_SCHEMA).alias("schema"), "aliases")).alias("payload")
    )
    return devices.parse_alias_map(documents).select("device", "project", "alias")


@query(
    "s12_ledger_sink",
    f"WITH {t.TWO_SOURCES} SELECT source, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, {sql_time('max(ts)')} AS last_at FROM ledger GROUP BY source",
)
def s12_ledger_sink(spark, folder):
    """The ledger written as compressed JSON lines and read back as a device ledger."""
    path = scratch_path(spark, "ledger")
    events = t.ledger(spark, folder)
    sinks.sink_ledger(events, rollups.compact_records(events), path)
    sinks.ledger_head(events, t.TZ).write.json(f"{path}/head_lines")
    back = devices.read_ledger_lines(spark, {"A": path}).events
    return back.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.max("ts").alias("last_at")
    )


@query(
    "s13_report_sink",
    f"""WITH {t.FACTS} SELECT strftime(date, '%Y-%m') AS month, count(*) AS facts, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM facts GROUP BY 1""",
)
def s13_report_sink(spark, folder):
    """Facts written by month and read back; the month is a partition column."""
    path = scratch_path(spark, "report")
    sinks.sink_report_tables({"facts": rollups.compact_facts(t.prepared(spark, folder))}, path)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(f"{path}/facts")
    return back.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("facts"), F.sum("calls").alias("calls"), F.sum(rollups.tokens()).alias("tokens")
    )


REPORT_KEYS = {
    "daily": None, "projects": "project", "models": "model", "model_days": "model, date", "activities": "activity", "sessions": "session",
    "facts": "date, hour, project, session, model, activity",
}


@query(
    "s13_report_set",
    f"WITH {t.PREPARED} SELECT 'daily' AS name, date_diff('day', min(date), max(date)) + 1 AS rows, 0 AS differing FROM prepared"
    + "".join(f" UNION ALL SELECT '{name}', count(*), 0 FROM (SELECT DISTINCT {keys} FROM prepared)" for name, keys in REPORT_KEYS.items() if keys)
    + " UNION ALL SELECT * FROM (VALUES ('summary', 1, 0), ('weekday_hours', 168, 0), ('concentration', 1, 0), ('token_shares', 1, 0), ('tables', 18, 0)) WHERE (SELECT count(*) FROM prepared) > 0",
)
def s13_report_set(spark, folder):
    """All tables of a report written as one set and read back: rows of those whose keys SQL can list, and rows that differ, over all tables."""
    tables = report.build_report(t.usage(spark, folder), t.TZ)
    path = scratch_path(spark, "report-set")
    back = sinks.read_report_set(spark, path, sinks.sink_report_set(tables, path))
    counted, parts = [], []
    for name, df in back.items():
        built = tables[name].select(*df.columns)
        # both directions, copies counted
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        sides = built.select(digest.alias("h"), F.lit(1).alias("n")).unionByName(df.select(digest.alias("h"), F.lit(-1).alias("n")))
        parts.append(sides.groupBy("h").agg(F.sum("n").alias("n")).where("n <> 0").agg(F.count(F.lit(1)).alias("differing")).select(F.lit(name).alias("name"), "differing"))
        if name in REPORT_KEYS or name in ("summary", "weekday_hours", "concentration", "token_shares"):
            counted.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
    differing = reduce(lambda a, b: a.unionByName(b), parts)
    rows = reduce(lambda a, b: a.unionByName(b), counted)
    every = differing.agg(F.count(F.lit(1)).alias("rows"), F.sum("differing").alias("differing")).select(F.lit("tables").alias("name"), "rows", "differing")
    return keyed_join(rows, differing, ["name"]).select("name", "rows", "differing").unionByName(every)


def response_bodies(spark, folder):
    """Response bodies derived from events: some hold identity fields, credentials or a bad grouping."""
    n = F.col("event_id") % 8
    item = F.to_json(F.struct(F.col("event_type").alias("name"), F.col("value")))
    extra = (
        F.when(n == 1, F.lit(',"meta":{"Account_Id":"a1"}'))
        .when(n == 2, F.lit(',"note":"Authorization: x"'))
        .when(n == 3, F.lit(',"note":"\\"email\\": in a text"'))
        .when(n == 4, F.lit(',"items":[{"deep":{"api-key":"k","cookie":"c"}}]'))
        .otherwise(F.lit(""))
    )
    group = F.when(n == 5, F.lit('"month"')).when(n == 6, F.lit("null")).otherwise(F.lit('"week"'))
    body = F.when(n == 7, F.concat(F.lit("["), item, F.lit("]"))).otherwise(
        F.concat(F.lit('{"data":['), item, F.lit('],"group_by":'), group, extra, F.lit("}"))
    )
    return t.table(spark, folder, "events").select("event_id", F.lit("usage").alias("kind"), body.alias("payload"))


@query(
    "s14_gated_responses",
    """SELECT event_id, 'usage' AS kind FROM events WHERE event_id % 8 IN (0, 3, 6)""",
)
def s14_gated_responses(spark, folder):
    """Only bodies without identity fields or credentials pass."""
    clean, _ = textscan.gate(response_bodies(spark, folder))
    return clean.select("event_id", "kind")


@query(
    "s14_rejections",
    """SELECT CASE event_id % 8 WHEN 1 THEN 'response-sensitive-key' WHEN 4 THEN 'response-sensitive-key' WHEN 2 THEN 'response-credential' WHEN 5 THEN 'response-group-by' ELSE 'response-shape' END AS "check", count(*) AS violations
FROM events WHERE event_id % 8 IN (1, 2, 4, 5, 7) GROUP BY 1""",
)
def s14_rejections(spark, folder):
    _, violations = textscan.gate(response_bodies(spark, folder))
    return quality.tally(violations)


