"""The given tables read as usage data, in Spark and, under the same names, in SQL.

``events`` plays the call-level usage of one account with about a hundred sessions;
``lineitem`` and ``orders`` play the large ledger and the account series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.identity import event_id
from meterbook.functions.timeparts import epoch_ms, from_epoch_ms
from meterbook.functions.tokens import components_from_split
from meterbook.operators.series import daily_totals
from meterbook.plans.ledger import localised
from meterbook.plans.report import prepare

TZ = "Asia/Shanghai"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- events as usage ---------------------------------------------------------


def usage(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    amount = F.col("value").cast("decimal(18,2)")
    rows = table(spark, folder, "events").select(
        "event_id",
        "user_id",
        from_epoch_ms(epoch_ms("ts")).alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"),
        F.col("event_type").alias("model"),
        F.concat(
            F.lit("/Users/u"), (F.col("user_id") % 5).cast("string"),
            F.lit("/Documents/project/"), (F.col("user_id") % 12).cast("string"),
        ).alias("project"),
        activity_of(k % 5).alias("activity"),
        (amount * 100).cast("bigint").alias("fresh_input"),
        (k * k).alias("cache_read"),
        (F.col("user_id") % 7).alias("cache_write"),
        k.alias("output"),
        F.lit(1).cast("bigint").alias("calls"),
        amount.alias("cost"),
        k.alias("k"),
    )
    return rows


def activity_of(code: Column) -> Column:
    return (
        F.when(code == 0, "coding").when(code == 1, "Debugging").when(code == 2, "git").when(code == 4, "Review")
    )


USAGE = """
raw AS (
  SELECT event_id, user_id, date_trunc('millisecond', ts) AS ts, event_type,
         CAST(value AS DECIMAL(18,2)) AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
usage AS (
  SELECT event_id, user_id, ts, 'u' || user_id AS session, event_type AS model,
         '/Users/u' || (user_id % 5) || '/Documents/project/' || (user_id % 12) AS project,
         CASE k % 5 WHEN 0 THEN 'coding' WHEN 1 THEN 'Debugging' WHEN 2 THEN 'git' WHEN 4 THEN 'Review' END AS activity,
         CAST(amount * 100 AS BIGINT) AS fresh_input, k * k AS cache_read, user_id % 7 AS cache_write, k AS output,
         CAST(1 AS BIGINT) AS calls, amount AS cost, k,
         CAST(amount * 100 AS BIGINT) + k * k + user_id % 7 + k AS tokens
  FROM raw
)"""


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(usage(spark, folder), TZ)


PREPARED = (
    USAGE
    + """,
prepared AS (
  SELECT event_id, ts, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, CAST(hour(ts + INTERVAL 8 HOUR) AS BIGINT) AS hour,
         strftime(ts + INTERVAL 8 HOUR, '%a') AS weekday, 'project-' || (user_id % 12) AS project,
         session AS raw_session, 'session-' || substr(sha256(session), 1, 12) AS session, model,
         CASE WHEN activity = 'coding' THEN 'Coding' WHEN activity = 'git' THEN 'Git Ops'
              WHEN activity IS NULL THEN 'Other' ELSE activity END AS activity,
         fresh_input, cache_read, cache_write, output, tokens, calls, cost
  FROM usage
)"""
)

FACTS = (
    PREPARED
    + """,
facts AS (
  SELECT date, hour, weekday, project, session, model, activity, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls,
         CAST(sum(fresh_input) AS BIGINT) AS fresh_input, CAST(sum(cache_read) AS BIGINT) AS cache_read,
         CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output,
         CAST(sum(tokens) AS BIGINT) AS tokens, min(ts) AS first_call, max(ts) AS last_call
  FROM prepared GROUP BY ALL
)"""
)

DAILY = (
    PREPARED
    + """,
daily AS (
  SELECT date, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session) AS sessions,
         CAST(sum(fresh_input) AS BIGINT) AS fresh_input, CAST(sum(cache_read) AS BIGINT) AS cache_read,
         CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output,
         CAST(sum(tokens) AS BIGINT) AS tokens
  FROM prepared GROUP BY date
)"""
)

# the calls of every third day are moved to the next day, so that the series has gaps and holds every row
SPARSE = (
    PREPARED
    + """,
sparse AS (
  SELECT * REPLACE (CASE WHEN date_diff('day', DATE '2023-12-31', date) % 3 = 0 THEN date + 1 ELSE date END AS date) FROM prepared
),
daily AS (
  SELECT date, sum(cost) AS cost, CAST(sum(calls) AS BIGINT) AS calls, count(DISTINCT session) AS sessions,
         CAST(sum(fresh_input) AS BIGINT) AS fresh_input, CAST(sum(cache_read) AS BIGINT) AS cache_read,
         CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output,
         CAST(sum(tokens) AS BIGINT) AS tokens
  FROM sparse GROUP BY date
),
axis AS (SELECT unnest(generate_series((SELECT min(date) FROM daily), (SELECT max(date) FROM daily), INTERVAL 1 DAY))::DATE AS date),
filled AS (
  SELECT axis.date, coalesce(cost, 0) AS cost, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions,
         coalesce(fresh_input, 0) AS fresh_input, coalesce(cache_read, 0) AS cache_read,
         coalesce(cache_write, 0) AS cache_write, coalesce(output, 0) AS output, coalesce(tokens, 0) AS tokens
  FROM axis LEFT JOIN daily USING (date)
)"""
)


def sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Usage with the calls of every third day moved to the next: a series with gaps to fill, and every row in it."""
    moved = F.datediff("date", F.lit("2023-12-31").cast("date")) % 3 == 0
    return prepared(spark, folder).withColumn("date", F.when(moved, F.date_add("date", 1)).otherwise(F.col("date")))


def sparse_daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily_totals(sparse(spark, folder))


# --- two sources -------------------------------------------------------------

SPLIT = "2024-01-20 00:00:00"
OVERLAP = "2024-01-18 00:00:00"


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline log: usage up to a day, whole seconds, cache-inclusive input, some other application."""
    rows = usage(spark, folder).where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    seconds = F.floor(epoch_ms("ts") / 1000)
    return rows.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        seconds.alias("created_at"),
        "model",
        F.concat(F.lit(" rollout-"), "session", F.lit(" ")).alias("session_id"),
        (F.col("fresh_input") + F.col("cache_read")).alias("input_tokens"),
        F.col("output").alias("output_tokens"),
        F.col("cache_read").alias("cache_read_tokens"),
        F.col("cache_write").alias("cache_creation_tokens"),
        F.col("cost").alias("total_cost_usd"),
        F.when(F.col("event_id") % 10 == 9, "other").otherwise(fixed.DEFAULT_PROVIDER).alias("app_type"),
    )


def export_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Export records from before the end of the baseline on; some of another provider."""
    rows = usage(spark, folder).where(F.col("ts") >= F.lit(OVERLAP).cast("timestamp_ntz"))
    rows = rows.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 10, "Elsewhere").when(F.col("event_id") % 2 == 0, "Codex").alias("provider"),
        "ts",
        F.concat(F.lit("rollout-"), "session").alias("session"),
        "model",
        F.when(F.col("k") % 9 != 0, F.col("project")).alias("project"),
        "activity",
        F.col("fresh_input").alias("_in"),
        F.col("cache_read").alias("_cr"),
        F.col("cache_write").alias("_cw"),
        F.col("output").alias("_out"),
        "cost",
        "calls",
    )
    return components_from_split(rows, "_in", "_cr", "_cw", "_out").drop("_in", "_cr", "_cw", "_out")


TWO_SOURCES = (
    USAGE
    + f""",
request_log AS (
  SELECT 'r' || event_id AS request_id, CAST(floor(epoch_ms(ts) / 1000) AS BIGINT) AS created_at, model,
         'rollout-' || session AS session, fresh_input, cache_read, output, cache_write AS cache_creation, cost,
         CASE WHEN event_id % 10 = 9 THEN 'other' ELSE 'codex' END AS app_type
  FROM usage WHERE ts < TIMESTAMP '{SPLIT}'
),
export_rows AS (
  SELECT event_id, CASE WHEN event_id % 11 = 10 THEN 'Elsewhere' WHEN event_id % 2 = 0 THEN 'Codex' END AS provider,
         ts, 'rollout-' || session AS session, model, CASE WHEN k % 9 <> 0 THEN project END AS project, activity,
         fresh_input, cache_read, cache_write, output, tokens, cost, calls
  FROM usage WHERE ts >= TIMESTAMP '{OVERLAP}'
),
wanted AS (SELECT * FROM export_rows WHERE provider IS NULL OR lower(provider) = 'codex'),
cutoff AS (SELECT max(created_at) AS c FROM request_log WHERE app_type = 'codex'),
votes AS (
  SELECT session, dim, value, sum(tokens) AS t, count(*) AS n FROM (
    SELECT session, 'project' AS dim, project AS value, tokens FROM wanted WHERE project IS NOT NULL
    UNION ALL SELECT session, 'activity', activity, tokens FROM wanted WHERE activity IS NOT NULL) GROUP BY ALL
),
attribution AS (
  SELECT s.session, p.value AS project, a.value AS activity
  FROM (SELECT DISTINCT session FROM wanted) s
  LEFT JOIN (SELECT * FROM votes WHERE dim = 'project'
             QUALIFY row_number() OVER (PARTITION BY session ORDER BY t DESC, n DESC, value) = 1) p USING (session)
  LEFT JOIN (SELECT * FROM votes WHERE dim = 'activity'
             QUALIFY row_number() OVER (PARTITION BY session ORDER BY t DESC, n DESC, value) = 1) a USING (session)
),
ledger AS (
  SELECT sha256('["' || request_id || '","' || strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ')
                || '","' || l.session || '","' || model || '",' || fresh_input || ',' || cache_read || ',0,' || output || ','
                || (fresh_input + cache_read + output) || ']') AS event_id,
         'ccSwitch' AS source, make_timestamp(created_at * 1000000) AS ts, l.session, model, a.project, a.activity,
         cost, CAST(1 AS BIGINT) AS calls, fresh_input, cache_read, CAST(0 AS BIGINT) AS cache_write, output,
         fresh_input + cache_read + output AS tokens
  FROM request_log l LEFT JOIN attribution a ON a.session = l.session WHERE app_type = 'codex'
  UNION ALL
  SELECT sha256('["' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","' || session || '","' || model || '",' || fresh_input
                || ',' || cache_read || ',' || cache_write || ',' || output || ',' || tokens || ']'),
         'codeburnIncrement', ts, session, model, project, activity, cost, 1, fresh_input, cache_read, cache_write, output, tokens
  FROM wanted, cutoff WHERE c IS NULL OR epoch_ms(ts) > c * 1000 + 999
),
local_ledger AS (
  SELECT *, CAST(ts + INTERVAL 8 HOUR AS DATE) AS date, CAST(hour(ts + INTERVAL 8 HOUR) AS BIGINT) AS hour FROM ledger
)"""
)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    from meterbook.plans.ledger import ledger_events

    return localised(ledger_events(export_rows(spark, folder), request_log(spark, folder)), TZ)


# --- rollout files -----------------------------------------------------------


def rollout_lines(spark: SparkSession, folder: str) -> DataFrame:
    """First lines of rollout files, one per order: repeated and conflicting sessions, bad lines, other files."""
    n = F.col("o_orderkey")
    hex12 = F.lpad(F.lower(F.hex(F.col("o_custkey"))), 12, "0")
    session = F.concat(F.lit("0199AB00-1111-2222-3333-"), hex12)
    folder_name = F.when(n % 13 == 0, "notes").when(n % 2 == 0, "sessions").otherwise("archived_sessions")
    path = F.concat(
        F.lit("/home/x/.codex/"), folder_name, F.lit("/2024/rollout-"), F.lpad(n.cast("string"), 9, "0"), F.lit("-"), session, F.lit(".jsonl")
    )
    cwd = F.concat(F.lit("/work/p"), (F.col("o_custkey") % 7 + F.when(n % 17 == 0, 1).otherwise(0)).cast("string"))
    remote = F.concat(F.lit("git@host.example:Team/Repo"), (F.col("o_custkey") % 7).cast("string"), F.lit(".git"))
    meta = F.to_json(
        F.struct(
            F.lit("session_meta").alias("type"),
            F.struct(
                F.when(n % 5 != 0, session).alias("id"),
                F.when(n % 3 != 0, cwd).alias("cwd"),
                F.when(n % 4 != 0, F.struct(remote.alias("repository_url"))).alias("git"),
            ).alias("payload"),
        )
    )
    line = F.when(n % 19 == 0, F.lit('{"type": "session_meta", "payl')).when(n % 23 == 0, F.lit('{"type":"turn","payload":{"id":"x"}}')).otherwise(meta)
    return table(spark, folder, "orders").select(path.alias("file_path"), line.alias("first_line"))


ROLLOUTS = """
rollouts AS (
  SELECT '/home/x/.codex/' || CASE WHEN o_orderkey % 13 = 0 THEN 'notes' WHEN o_orderkey % 2 = 0 THEN 'sessions' ELSE 'archived_sessions' END
         || '/2024/rollout-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '-0199AB00-1111-2222-3333-'
         || lpad(lower(to_hex(o_custkey)), 12, '0') || '.jsonl' AS file_path,
         o_orderkey AS n, o_custkey AS c, (o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0) AS ok
  FROM orders WHERE o_orderkey % 13 <> 0
),
meta AS (
  SELECT file_path, CASE WHEN ok THEN '0199ab00-1111-2222-3333-' || lpad(lower(to_hex(c)), 12, '0') END AS session,
         CASE WHEN ok AND n % 3 <> 0 THEN '/work/p' || (c % 7 + CASE WHEN n % 17 = 0 THEN 1 ELSE 0 END) END AS project,
         CASE WHEN ok AND n % 4 <> 0 THEN sha256('host.example/team/repo' || (c % 7)) END AS fingerprint
  FROM rollouts
)"""


# --- lineitem and orders: the large ledger and the account -------------------


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as prepared usage rows; every column is an expression on the scan."""
    cents = (F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("bigint")
    discount = (F.col("l_discount").cast("decimal(18,2)") * 100).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    hours = F.timestamp_add("HOUR", (F.col("l_orderkey") % 24).cast("int"), "l_shipdate")
    ts = F.timestamp_add("MINUTE", F.col("l_linenumber"), hours)
    project = F.when(F.col("l_partkey") % 10 == 0, F.lit(fixed.UNATTRIBUTED)).otherwise(
        F.concat(F.lit("part-"), (F.col("l_partkey") % 40).cast("string"))
    )
    activity = F.when(F.col("l_linenumber") == 7, F.lit(fixed.UNATTRIBUTED)).otherwise(
        F.concat(F.lit("line-"), F.col("l_linenumber").cast("string"))
    )
    return table(spark, folder, "lineitem").select(
        "l_suppkey",
        ts.alias("ts"),
        F.to_date(ts).alias("date"),
        F.hour(ts).alias("hour"),
        F.date_format(ts, "E").alias("weekday"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("session"),
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        project.alias("project"),
        activity.alias("activity"),
        cents.alias("fresh_input"),
        (discount * quantity).alias("cache_read"),
        F.lit(0).cast("bigint").alias("cache_write"),
        quantity.alias("output"),
        F.lit(1).cast("bigint").alias("calls"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"),
        ts.alias("first_call"),
        ts.alias("last_call"),
    )


SHIPMENTS = """
shipments AS (
  SELECT *, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, strftime(ts, '%a') AS weekday,
         fresh_input + cache_read + output AS tokens
  FROM (
    SELECT l_suppkey, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT)) + to_minutes(l_linenumber) AS ts,
           'o' || l_orderkey AS session, l_returnflag || l_linestatus AS model,
           CASE WHEN l_partkey % 10 = 0 THEN '历史未归属' ELSE 'part-' || (l_partkey % 40) END AS project,
           CASE WHEN l_linenumber = 7 THEN '历史未归属' ELSE 'line-' || l_linenumber END AS activity,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS fresh_input,
           CAST(CAST(l_discount AS DECIMAL(18,2)) * 100 AS BIGINT) * CAST(l_quantity AS BIGINT) AS cache_read,
           CAST(0 AS BIGINT) AS cache_write, CAST(l_quantity AS BIGINT) AS output, CAST(1 AS BIGINT) AS calls,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS cost
    FROM lineitem)
)"""


def whole_account(spark: SparkSession, folder: str) -> DataFrame:
    """orders as the account series."""
    cents = (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    return table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum(cents).alias("tokens"))


def account(spark: SparkSession, folder: str) -> DataFrame:
    """The account series that starts later and ends earlier than the ledger, for what has to do with that."""
    return whole_account(spark, folder).where(
        F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    )


WHOLE_ACCOUNT = """
account AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS tokens
  FROM orders GROUP BY 1
)"""


ACCOUNT = """
account AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS tokens
  FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1
)"""


def recent_account(spark: SparkSession, folder: str, gaps: bool = False) -> DataFrame:
    """Account buckets beside the events: totals of the local days, with ``gaps`` some days missing."""
    from meterbook.operators.series import daily_totals as totals

    daily = totals(prepared(spark, folder))
    kept = daily.where(F.dayofmonth("date") % 7 != 3) if gaps else daily
    return kept.select("date", (F.col("tokens") * 11 / F.lit(10)).cast("bigint").alias("tokens"))


# --- devices -----------------------------------------------------------------


def device_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of two devices that share a third of their ids, with uneven attribution."""
    rows = usage(spark, folder)
    device = F.explode(
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("A")))
        .when(F.col("event_id") % 3 == 1, F.array(F.lit("A"), F.lit("B")))
        .otherwise(F.array(F.lit("B")))
    ).alias("device")
    rows = rows.select("*", device)
    rows = components_from_split(rows, "fresh_input", "cache_read", "cache_write", "output")
    on_a = F.col("device") == "A"
    source = F.when(F.col("event_id") % 2 == 0, fixed.SOURCE_BASELINE).otherwise(fixed.SOURCE_INCREMENT)
    project = F.when(on_a & (F.col("k") % 4 == 0), F.lit(None)).otherwise(
        F.concat(F.lit("/w/"), F.col("device"), F.lit("/repo"), (F.col("user_id") % 6).cast("string"))
    )
    fingerprint = F.when(F.col("user_id") % 6 < 4, F.sha2(F.concat(F.lit("host/team/r"), (F.col("user_id") % 3).cast("string")), 256))
    return rows.select(
        "device",
        F.when(on_a, 0).otherwise(1).cast("bigint").alias("device_order"),
        F.col("event_id").alias("input_order"),
        event_id(ts="ts", session="session", model="model").alias("event_id"),
        "ts",
        source.alias("source"),
        "session",
        "model",
        project.alias("project"),
        F.when(on_a | (F.col("k") % 3 != 0), F.col("activity")).alias("activity"),
        F.when(project.isNotNull(), fingerprint).alias("fingerprint"),
        "cost",
        "calls",
        "fresh_input",
        "cache_read",
        "cache_write",
        "output",
        "tokens",
    )


def alias_map(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit aliases for one project on one device, derived from the devices' own projects."""
    rows = device_events(spark, folder).where((F.col("device") == "B") & F.col("project").endswith("/repo2"))
    return rows.select("device", "project", F.lit("Shared Name").alias("alias")).distinct()


DEVICES = (
    USAGE
    + """,
copies AS (
  SELECT *, unnest(CASE event_id % 3 WHEN 0 THEN ['A'] WHEN 1 THEN ['A', 'B'] ELSE ['B'] END) AS device FROM usage
),
device_events AS (
  SELECT device, CASE device WHEN 'A' THEN 0 ELSE 1 END AS device_order, event_id AS input_order,
         sha256('["' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '","' || session || '","' || model || '",' || fresh_input
                || ',' || cache_read || ',' || cache_write || ',' || output || ',' || tokens || ']') AS event_id,
         ts, CASE WHEN event_id % 2 = 0 THEN 'ccSwitch' ELSE 'codeburnIncrement' END AS source, session, model,
         CASE WHEN device = 'A' AND k % 4 = 0 THEN NULL ELSE '/w/' || device || '/repo' || (user_id % 6) END AS project,
         CASE WHEN device = 'A' OR k % 3 <> 0 THEN activity END AS activity,
         CASE WHEN device = 'A' AND k % 4 = 0 THEN NULL WHEN user_id % 6 < 4 THEN sha256('host/team/r' || (user_id % 3)) END AS fingerprint,
         cost, calls, fresh_input, cache_read, cache_write, output, tokens
  FROM copies
),
alias_map AS (SELECT DISTINCT device, project, 'Shared Name' AS alias FROM device_events WHERE device = 'B' AND project LIKE '%/repo2'),
print_alias AS (
  SELECT fingerprint, min(alias) AS alias FROM device_events JOIN alias_map USING (device, project)
  WHERE fingerprint IS NOT NULL GROUP BY fingerprint
),
votes AS (
  SELECT DISTINCT fingerprint, regexp_extract(project, '([^/]+)$', 1) AS basename FROM device_events
  WHERE fingerprint IS NOT NULL AND project IS NOT NULL
),
name_prints AS (SELECT basename, count(*) AS prints FROM votes GROUP BY basename),
print_names AS (SELECT fingerprint, min(basename) AS basename, count(*) AS names FROM votes GROUP BY fingerprint),
print_labels AS (
  SELECT fingerprint, CASE WHEN names > 1 OR prints > 1 THEN basename || ' · ' || substr(fingerprint, 1, 6) ELSE basename END AS label
  FROM print_names JOIN name_prints USING (basename)
),
resolved AS (
  SELECT e.* EXCLUDE (project), e.project AS raw_project,
         CASE WHEN m.alias IS NOT NULL THEN m.alias WHEN pa.alias IS NOT NULL THEN pa.alias
              WHEN e.project IS NOT NULL AND e.fingerprint IS NOT NULL THEN pl.label
              WHEN e.project IS NOT NULL THEN regexp_extract(e.project, '([^/]+)$', 1) || ' · ' || e.device
              ELSE '历史未归属 · ' || e.device END AS project,
         CASE WHEN m.alias IS NOT NULL OR pa.alias IS NOT NULL THEN 3
              WHEN e.project IS NOT NULL AND e.fingerprint IS NOT NULL THEN 2 WHEN e.project IS NOT NULL THEN 1 ELSE 0 END AS project_rank
  FROM device_events e LEFT JOIN alias_map m ON m.device = e.device AND m.project = e.project
  LEFT JOIN print_alias pa ON pa.fingerprint = e.fingerprint LEFT JOIN print_labels pl ON pl.fingerprint = e.fingerprint
),
ordered AS (
  SELECT *, project_rank > 0 AS known_project, activity IS NOT NULL AS known_activity,
         row_number() OVER (PARTITION BY event_id ORDER BY project_rank * 2 + CAST(activity IS NOT NULL AS INT) DESC,
                            CAST(project_rank > 0 AS INT) DESC, device_order, input_order) AS pref
  FROM resolved
),
merged AS (
  SELECT event_id, count(*) AS copies, min(ts) AS ts, min(source) AS source, min(session) AS session, min(model) AS model,
         min(cost) AS cost, min(fresh_input) AS fresh_input, min(cache_read) AS cache_read, min(cache_write) AS cache_write,
         min(output) AS output, min(tokens) AS tokens,
         arg_min(device, pref) AS device, arg_min(fingerprint, pref) AS fingerprint_first,
         coalesce(arg_min(project, pref) FILTER (known_project), arg_min(project, pref)) AS project,
         arg_min(activity, pref) FILTER (known_activity) AS activity,
         array_to_string(list_sort(list_distinct(list(device))), ',') AS devices
  FROM ordered GROUP BY event_id
)"""
)


# --- near-time pairs ---------------------------------------------------------


def near_events(spark: SparkSession, folder: str) -> DataFrame:
    """Baseline usage and an export that repeats parts of it a little later.

    Of every seven baseline rows one is repeated 1 s later (a pair, unless another
    row is near), one 5 s later and one twice; the rest have no copy.
    """
    rows = usage(spark, folder).withColumn("n", F.col("event_id") % 7)
    shift = (
        F.when(F.col("n") == 1, F.array(F.lit(1000)))
        .when(F.col("n") == 2, F.array(F.lit(5000)))
        .when(F.col("n") == 3, F.array(F.lit(700), F.lit(1400)))
        .otherwise(F.array().cast("array<int>"))
    )
    copies = rows.select("*", F.explode(shift).alias("shift"))
    baseline = rows.select("*", F.lit(0).alias("shift"), F.lit(fixed.SOURCE_BASELINE).alias("source"))
    both = baseline.unionByName(copies.withColumn("source", F.lit(fixed.SOURCE_INCREMENT)))
    both = both.withColumn("ts", from_epoch_ms(epoch_ms("ts") + F.col("shift")))
    both = components_from_split(both, "fresh_input", "cache_read", "cache_write", "output")
    fingerprint = F.sha2(F.concat(F.lit("host/team/r"), (F.col("user_id") % 3).cast("string")), 256)
    known = F.col("source") != fixed.SOURCE_BASELINE
    return both.select(
        F.lit("A").alias("device"),
        F.lit(0).cast("bigint").alias("device_order"),
        (F.col("event_id") * 4 + F.when(F.col("shift") == 0, 0).when(F.col("shift") == 1400, 2).otherwise(1)).alias("input_order"),
        F.sha2(F.concat_ws("|", "source", F.col("event_id").cast("string"), F.col("shift").cast("string")), 256).alias("event_id"),
        "ts",
        "source",
        F.when(F.col("user_id") % 10 != 0, F.col("session")).alias("session"),
        F.when(F.col("user_id") % 10 != 1, F.col("model")).alias("model"),
        F.when(known, F.col("project")).alias("project"),
        F.when(~known, F.col("activity")).alias("activity"),
        F.when(known, fingerprint).alias("fingerprint"),
        "cost",
        "calls",
        "fresh_input",
        "cache_read",
        "cache_write",
        "output",
        "tokens",
    )


NEAR = (
    USAGE
    + """,
both_sources AS (
  SELECT *, 0 AS shift, 'ccSwitch' AS source FROM usage
  UNION ALL
  SELECT *, unnest(CASE event_id % 7 WHEN 1 THEN [1000] WHEN 2 THEN [5000] WHEN 3 THEN [700, 1400] ELSE [] END), 'codeburnIncrement' FROM usage
),
near AS (
  SELECT sha256(source || '|' || event_id || '|' || shift) AS event_id, epoch_ms(ts) + shift AS ms, source,
         CASE WHEN user_id % 10 <> 0 THEN session END AS session, CASE WHEN user_id % 10 <> 1 THEN model END AS model,
         user_id % 12 AS project_no, activity, fresh_input, cache_read, cache_write, output, tokens, cost
  FROM both_sources
),
candidates AS (
  SELECT b.event_id AS b, i.event_id AS i,
         abs(b.ms - i.ms) <= 1500 AND b.fresh_input = i.fresh_input AND b.cache_read = i.cache_read
         AND b.cache_write = i.cache_write AND b.output = i.output AS strict
  FROM near b JOIN near i ON b.source = 'ccSwitch' AND i.source = 'codeburnIncrement'
   AND b.session IS NOT DISTINCT FROM i.session AND b.model IS NOT DISTINCT FROM i.model AND abs(b.ms - i.ms) <= 10000
),
counted AS (SELECT *, count(*) OVER (PARTITION BY b) AS nb, count(*) OVER (PARTITION BY i) AS ni FROM candidates),
pairs AS (SELECT b, i FROM counted WHERE nb = 1 AND ni = 1 AND strict),
ambiguous AS (
  SELECT DISTINCT id FROM (SELECT b AS id FROM candidates UNION ALL SELECT i FROM candidates)
  WHERE id NOT IN (SELECT b FROM pairs) AND id NOT IN (SELECT i FROM pairs)
)"""
)


def compact_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Compact records of two devices: copies in different multiplicity, and changed numbers."""
    rows = usage(spark, folder)
    times = (
        F.when(F.col("event_id") % 4 == 0, F.array(F.lit("A"), F.lit("A"), F.lit("B"), F.lit("B"), F.lit("B")))
        .when(F.col("event_id") % 4 == 1, F.array(F.lit("A"), F.lit("B")))
        .when(F.col("event_id") % 4 == 2, F.array(F.lit("A")))
        .otherwise(F.array(F.lit("A"), F.lit("Bx")))
    )
    rows = rows.select("*", F.posexplode(times).alias("copy", "mark"))
    device = F.substring("mark", 1, 1)
    known = (F.col("copy") % 2) == 0
    return rows.select(
        device.alias("device"),
        F.when(device == "A", 0).otherwise(1).cast("bigint").alias("device_order"),
        (F.col("event_id") * 8 + F.col("copy")).alias("input_order"),
        "ts",
        "session",
        "model",
        F.when(known, F.concat(F.lit("/w/p"), (F.col("user_id") % 4).cast("string"))).alias("project"),
        F.lit(None).cast("string").alias("fingerprint"),
        F.when(~known, F.col("activity")).alias("activity"),
        F.lit(fixed.SOURCE_BASELINE).alias("source"),
        "cost",
        "calls",
        (F.col("fresh_input") + F.when(F.length("mark") > 1, 1).otherwise(0)).alias("fresh_input"),
        "cache_read",
        "cache_write",
        "output",
    )


COMPACT = (
    USAGE
    + """,
compact AS (
  SELECT substr(mark, 1, 1) AS device, CASE substr(mark, 1, 1) WHEN 'A' THEN 0 ELSE 1 END AS device_order,
         event_id * 8 + copy AS input_order, ts, session, model,
         CASE WHEN copy % 2 = 0 THEN '/w/p' || (user_id % 4) END AS raw_project,
         CASE WHEN copy % 2 <> 0 THEN activity END AS activity, 'ccSwitch' AS source, cost, calls,
         fresh_input + CASE WHEN length(mark) > 1 THEN 1 ELSE 0 END AS fresh_input, cache_read, cache_write, output
  FROM (
    SELECT *, unnest(m) AS mark, unnest(range(len(m))) AS copy FROM (
      SELECT *, CASE event_id % 4 WHEN 0 THEN ['A','A','B','B','B'] WHEN 1 THEN ['A','B'] WHEN 2 THEN ['A'] ELSE ['A','Bx'] END AS m FROM usage))
),
labelled AS (
  SELECT *, CASE WHEN raw_project IS NOT NULL THEN substr(raw_project, 4) || ' · ' || device ELSE '历史未归属 · ' || device END AS project,
         CASE WHEN raw_project IS NOT NULL THEN 1 ELSE 0 END AS rank,
         row_number() OVER (PARTITION BY device, ts, session, model, source, calls, cost, fresh_input, cache_read, output, cache_write
                            ORDER BY input_order) AS nth
  FROM compact
),
preferred AS (
  SELECT *, row_number() OVER (PARTITION BY ts, session, model, source, calls, cost, fresh_input, cache_read, output, cache_write, nth
                               ORDER BY rank * 2 + CAST(activity IS NOT NULL AS INT) DESC, rank DESC, device_order, input_order) AS pref
  FROM labelled
),
multiset AS (
  SELECT ts, session, model, source, calls, cost, fresh_input, cache_read, output, cache_write, nth, count(*) AS matched,
         arg_min(device, pref) AS device,
         coalesce(arg_min(project, pref) FILTER (rank > 0), arg_min(project, pref)) AS project,
         coalesce(arg_min(activity, pref) FILTER (activity IS NOT NULL), '历史未归类') AS activity
  FROM preferred GROUP BY ALL
)"""
)


# --- dashboard responses -----------------------------------------------------


def response_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily usage responses as JSON bodies: totals with nested model and client detail.

    Built from sums per (date, model, client), so a body holds a few dozen items.
    """
    rows = prepared(spark, folder).withColumn("client", client_of(F.col("user_id")))
    cells = rows.groupBy("date", "model", "client").agg(
        F.sum("calls").alias("turns"),
        F.countDistinct("session").alias("threads"),
        F.sum("cost").alias("credits"),
        F.sum("cache_read").alias("cached"),
        F.sum(F.col("fresh_input") + F.col("cache_write")).alias("uncached"),
        F.sum("output").alias("output"),
    )

    def detail(column: str, name: str) -> DataFrame:
        grouped = cells.groupBy("date", column).agg(F.sum("threads").alias("threads"), F.sum("turns").alias("turns"))
        item = F.struct(F.col(column).alias(name), "threads", "turns")
        return grouped.groupBy("date").agg(F.sort_array(F.collect_list(item)).alias(f"{column}s"))

    totals = cells.groupBy("date").agg(
        F.struct(
            F.sum("threads").alias("threads"),
            F.sum("turns").alias("turns"),
            F.sum("credits").alias("credits"),
            F.sum("cached").alias("cached_text_input_tokens"),
            F.sum("uncached").alias("uncached_text_input_tokens"),
            F.sum("output").alias("text_output_tokens"),
            F.sum(F.col("cached") + F.col("uncached") + F.col("output")).alias("text_total_tokens"),
        ).alias("totals")
    )
    days = totals.join(detail("model", "model"), "date").join(detail("client", "client_id"), "date")
    # every tenth day has no detail
    has_detail = F.dayofmonth("date") % 10 != 0
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("date").cast("string").alias("date"),
                    "totals",
                    F.when(has_detail, F.col("models")).alias("models"),
                    F.when(has_detail, F.col("clients")).alias("clients"),
                )
            ).alias("data"),
            F.lit("day").alias("group_by"),
        )
    )
    return days.select(F.concat(F.lit("usage-"), F.col("date").cast("string")).alias("document"), body.alias("payload"))


def client_of(user: Column) -> Column:
    return (
        F.when(user % 4 == 0, "CODEX_DESKTOP_APP").when(user % 4 == 1, "CODEX_CLI").when(user % 4 == 2, "CODEX_CLOUD_TASKS").otherwise("other_tool")
    )


RESPONSES = (
    PREPARED.replace("SELECT event_id, ts, CAST(ts + INTERVAL 8 HOUR AS DATE)", "SELECT event_id, user_id, ts, CAST(ts + INTERVAL 8 HOUR AS DATE)")
    + """,
cells AS (
  SELECT date, model, CASE user_id % 4 WHEN 0 THEN 'CODEX_DESKTOP_APP' WHEN 1 THEN 'CODEX_CLI' WHEN 2 THEN 'CODEX_CLOUD_TASKS' ELSE 'other_tool' END AS client,
         sum(calls) AS turns, count(DISTINCT session) AS threads, sum(cost) AS credits, sum(cache_read) AS cached,
         sum(fresh_input + cache_write) AS uncached, sum(output) AS output
  FROM prepared GROUP BY ALL
),
days AS (
  SELECT date, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns, sum(credits) AS credits,
         CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(uncached) AS BIGINT) AS uncached, CAST(sum(output) AS BIGINT) AS output,
         CAST(sum(cached + uncached + output) AS BIGINT) AS tokens, day(date) % 10 <> 0 AS has_detail
  FROM cells GROUP BY date
),
detail AS (SELECT cells.* FROM cells JOIN days USING (date) WHERE has_detail)"""
)


def tool_days(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Skill or plugin responses as JSON bodies, one per date."""
    rows = prepared(spark, folder)
    name = F.when(F.col("user_id") % 5 == 4, "Other").otherwise(F.concat(F.upper(F.substring("model", 1, 1)), F.lit(" tool")))
    if kind == "plugins":
        rows = rows.withColumns(
            {
                "name": name,
                "plugin_id": F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("plugin-"), (F.col("user_id") % 3).cast("string"))),
            }
        )
        keys, list_key, name_key = ["name", "plugin_id"], "plugin_usage_overviews", "plugin_name"
    else:
        rows = rows.withColumn("name", name)
        keys, list_key, name_key = ["name"], "skill_usage_overviews", "skill_name"
    counted = rows.groupBy("date", *keys).agg(F.sum("calls").alias("invocation_counts"))
    item = [F.col("name").alias(name_key), F.lit("").alias("display_name"), "invocation_counts"]
    if kind == "plugins":
        item = ["plugin_id", *item]
    days = counted.groupBy("date").agg(F.sort_array(F.collect_list(F.struct(*item))).alias("items"))
    body = F.to_json(
        F.struct(
            F.array(F.struct(F.col("date").cast("string").alias("date"), F.col("items").alias(list_key))).alias("data"),
            F.lit("day").alias("group_by"),
        )
    )
    return days.select(F.concat(F.lit(f"{kind}-"), F.col("date").cast("string")).alias("document"), body.alias("payload"))


TOOLS = (
    PREPARED.replace("SELECT event_id, ts, CAST(ts + INTERVAL 8 HOUR AS DATE)", "SELECT event_id, user_id, ts, CAST(ts + INTERVAL 8 HOUR AS DATE)")
    + """,
tools AS (
  SELECT date, CASE WHEN user_id % 5 = 4 THEN 'Other' ELSE upper(substr(model, 1, 1)) || ' tool' END AS name,
         CASE WHEN user_id % 3 <> 0 THEN 'plugin-' || (user_id % 3) END AS plugin_id, calls
  FROM prepared
)"""
)

