"""Joins over the given tables."""

from pyspark.sql import functions as F

from meterbook.catalog import tables as t
from meterbook.catalog.registry import query
from meterbook.operators import attribution, quality, rollups, series
from meterbook.operators.projects import conflicting_aliases, conflicting_fingerprints, device_project_labels, resolve_projects
from meterbook.plans import activity, credits
from meterbook.sources.requestlog import baseline_rows
from meterbook.sources.responses import parse_tools, parse_usage
from meterbook.sources.rollout import parse_rollout_meta


def _baseline(spark, folder):
    return baseline_rows(t.request_log(spark, folder))


def _votes(spark, folder):
    from meterbook.operators.filters import provider_filter

    return attribution.session_attribution(provider_filter(t.export_rows(spark, folder)))


@query("w05_session_attribution", f"WITH {t.TWO_SOURCES} SELECT * FROM attribution")
def w05_session_attribution(spark, folder):
    return _votes(spark, folder)


@query(
    "j01_attribute_baseline",
    f"""WITH {t.TWO_SOURCES} SELECT request_id, session, project, activity, tokens FROM
  (SELECT request_id, l.session, a.project, a.activity, fresh_input + cache_read + output AS tokens FROM request_log l LEFT JOIN attribution a USING (session) WHERE app_type = 'codex')""",
)
def j01_attribute_baseline(spark, folder):
    rows = attribution.attribute_baseline(_baseline(spark, folder), _votes(spark, folder))
    return rows.select("request_id", "session", "project", "activity", "tokens")


# rollouts for the sessions of the events: two files each, one session in four without a folder
EVENT_ROLLOUTS = """mappings AS (
  SELECT DISTINCT 'rollout-' || session AS session, CASE WHEN user_id % 4 <> 0 THEN '/w/first' || (user_id % 3) END AS rollout_project,
    CASE WHEN user_id % 3 <> 0 THEN sha256('f' || (user_id % 5)) END AS fingerprint FROM usage)"""


def _event_rollouts(spark, folder):
    users = t.usage(spark, folder).select("user_id", "session").distinct()
    both = users.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("file"))
    first = F.col("file") == "a"
    return both.select(
        F.concat(F.lit("/sessions/"), "file", "session").alias("file_path"),
        F.concat(F.lit("rollout-"), "session").alias("session"),
        F.when(F.col("user_id") % 4 != 0, F.concat(F.when(first, F.lit("/w/first")).otherwise(F.lit("/w/second")), (F.col("user_id") % 3).cast("string"))).alias("project"),
        F.when(F.col("user_id") % 3 != 0, F.sha2(F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")), 256)).alias("fingerprint"),
    )


def _recovered(spark, folder):
    votes = _votes(spark, folder).withColumn("project", F.when(F.length("session") % 2 == 0, F.col("project")))
    mappings = attribution.rollout_mappings(_event_rollouts(spark, folder))
    return attribution.attribute_baseline(_baseline(spark, folder), votes, mappings)


RECOVERED = f"""{t.TWO_SOURCES}, {EVENT_ROLLOUTS}, joined AS (
  SELECT request_id, l.session, CASE WHEN length(l.session) % 2 = 0 THEN a.project END AS voted, m.rollout_project, a.activity, m.fingerprint, fresh_input + cache_read + output AS tokens
  FROM request_log l LEFT JOIN attribution a ON a.session = l.session LEFT JOIN mappings m ON m.session = l.session WHERE app_type = 'codex')"""


@query(
    "j02_rollout_fallback",
    f"WITH {RECOVERED} SELECT request_id, coalesce(voted, rollout_project) AS project, activity, voted IS NULL AND rollout_project IS NOT NULL AS recovered FROM joined",
)
def j02_rollout_fallback(spark, folder):
    return _recovered(spark, folder).select("request_id", "project", "activity", "recovered")


@query(
    "j02_recovery_counts",
    f"""WITH {RECOVERED} SELECT count(*) AS rows_recovered, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens_recovered, count(DISTINCT session) AS sessions_recovered
FROM joined WHERE voted IS NULL AND rollout_project IS NOT NULL""",
)
def j02_recovery_counts(spark, folder):
    return attribution.recovery_counts(_recovered(spark, folder))


@query("j03_fingerprints", f"WITH {RECOVERED} SELECT request_id, fingerprint FROM joined UNION ALL SELECT 'x' || event_id, m.fingerprint FROM wanted LEFT JOIN mappings m USING (session)")
def j03_fingerprints(spark, folder):
    """Fingerprints of both sources by session."""
    from meterbook.operators.filters import provider_filter

    mappings = attribution.rollout_mappings(_event_rollouts(spark, folder))
    increment = attribution.attach_fingerprint(provider_filter(t.export_rows(spark, folder)), mappings)
    exported = increment.select(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("request_id"), "fingerprint")
    return _recovered(spark, folder).select("request_id", "fingerprint").unionByName(exported)


@query(
    "w10_rollout_mappings",
    f"""WITH {t.ROLLOUTS} SELECT s.session, p.project AS rollout_project, f.fingerprint FROM (SELECT DISTINCT session FROM meta WHERE session IS NOT NULL) s
LEFT JOIN (SELECT session, project FROM meta WHERE project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY file_path) = 1) p USING (session)
LEFT JOIN (SELECT session, fingerprint FROM meta WHERE fingerprint IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session ORDER BY file_path) = 1) f USING (session)""",
)
def w10_rollout_mappings(spark, folder):
    return attribution.rollout_mappings(parse_rollout_meta(t.rollout_lines(spark, folder)))


@query(
    "j05_account_with_local",
    f"""WITH {t.SHIPMENTS}, {t.WHOLE_ACCOUNT}, l AS (SELECT date, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(calls) AS BIGINT) AS calls FROM shipments GROUP BY date)
SELECT CAST(account.date AS VARCHAR) AS date, account.tokens AS account_tokens, coalesce(l.tokens, 0) AS local_tokens, coalesce(l.calls, 0) AS local_calls FROM account LEFT JOIN l USING (date)""",
)
def j05_account_with_local(spark, folder):
    """Account buckets beside the ledger days."""
    return series.account_with_local(t.whole_account(spark, folder), series.daily_totals(t.shipments(spark, folder)))


LABELS = f"WITH {t.DEVICES} SELECT DISTINCT device, raw_project, fingerprint, project AS label, CAST(project_rank AS BIGINT) AS rank FROM resolved"


@query("j10_device_labels", LABELS)
def j10_device_labels(spark, folder):
    return device_project_labels(t.device_events(spark, folder), t.alias_map(spark, folder))


def _two_accounts(df):
    """The rows under an account without a name and under one with a name."""
    return df.withColumn("account", F.explode(F.array(F.lit(None).cast("string"), F.lit("t"))))


ACCOUNTS = "accounts AS (SELECT unnest([NULL, 't']) AS account)"


@query(
    "j10_labels_without_account_name",
    f"WITH {t.DEVICES}, {ACCOUNTS} SELECT DISTINCT account, device, raw_project, fingerprint, project AS label, CAST(project_rank AS BIGINT) AS rank FROM resolved, accounts",
)
def j10_labels_without_account_name(spark, folder):
    """An account without a name gets the labels that a named one gets."""
    return device_project_labels(_two_accounts(t.device_events(spark, folder)), _two_accounts(t.alias_map(spark, folder)), ["account"])


@query(
    "j09_aliases_without_account_name",
    f"WITH {t.DEVICES}, {ACCOUNTS} SELECT account, device, input_order, project, CAST(project_rank AS BIGINT) AS project_rank FROM resolved, accounts",
)
def j09_aliases_without_account_name(spark, folder):
    rows = resolve_projects(_two_accounts(t.device_events(spark, folder)), _two_accounts(t.alias_map(spark, folder)), ["account"])
    return rows.select("account", "device", "input_order", "project", "project_rank")


@query(
    "j09_explicit_aliases",
    f"WITH {t.DEVICES} SELECT device, input_order, project, CAST(project_rank AS BIGINT) AS project_rank FROM resolved",
)
def j09_explicit_aliases(spark, folder):
    """Every event with its resolved project: explicit aliases first, then shared, fingerprint, device."""
    rows = resolve_projects(t.device_events(spark, folder), t.alias_map(spark, folder))
    return rows.select("device", "input_order", "project", "project_rank")


@query(
    "j10_alias_conflicts",
    """WITH a AS (SELECT 'd' || (c_nationkey % 3) AS device, 'p' || (c_custkey % 500) AS project, 'a' || (c_custkey % 7) AS alias FROM customer)
SELECT device, project, count(DISTINCT alias) AS aliases FROM a GROUP BY ALL HAVING count(DISTINCT alias) > 1""",
)
def j10_alias_conflicts(spark, folder):
    """Alias rows derived from customers that give one project several names."""
    rows = t.table(spark, folder, "customer").select(
        F.concat(F.lit("d"), (F.col("c_nationkey") % 3).cast("string")).alias("device"),
        F.concat(F.lit("p"), (F.col("c_custkey") % 500).cast("string")).alias("project"),
        F.concat(F.lit("a"), (F.col("c_custkey") % 7).cast("string")).alias("alias"),
    )
    return conflicting_aliases(rows)


@query(
    "j10_fingerprint_conflicts",
    f"""WITH {t.DEVICES}, a AS (SELECT DISTINCT device, project, 'Name ' || project AS alias FROM device_events WHERE project IS NOT NULL)
SELECT fingerprint, count(DISTINCT alias) AS aliases FROM device_events JOIN a USING (device, project) WHERE fingerprint IS NOT NULL GROUP BY fingerprint HAVING count(DISTINCT alias) > 1""",
)
def j10_fingerprint_conflicts(spark, folder):
    rows = t.device_events(spark, folder)
    names = rows.where("project IS NOT NULL").select("device", "project", F.concat(F.lit("Name "), "project").alias("alias")).distinct()
    return conflicting_fingerprints(rows, names)


@query(
    "j12_activity_days",
    f"""WITH {t.RESPONSES}, i AS (SELECT date, count(*) AS n FROM prepared GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, threads, turns, i.n AS skill_invocations, CAST(NULL AS BIGINT) AS plugin_calls FROM days JOIN i USING (date)""",
)
def j12_activity_days(spark, folder):
    """Days beside skill sums; no plugin response was given, so that column stays null."""
    days = parse_usage(t.response_days(spark, folder))
    skills = parse_tools(t.tool_days(spark, folder, "skills"), "skills")
    return activity.activity_days(days, skills)


@query(
    "j12_activity_summary",
    f"""WITH {t.RESPONSES} SELECT count(*) AS buckets, CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(turns) AS BIGINT) AS turns, (SELECT count(*) FROM prepared) AS skill_invocations,
  (SELECT count(*) FROM prepared) AS plugin_calls, CAST(sum(turns) AS DOUBLE) / CAST(sum(threads) AS DOUBLE) AS turns_per_thread FROM days""",
)
def j12_activity_summary(spark, folder):
    days = parse_usage(t.response_days(spark, folder))
    tools = [parse_tools(t.tool_days(spark, folder, k), k) for k in ("skills", "plugins")]
    return activity.activity_summary(activity.activity_days(days, *tools))


@query(
    "j13_bucket_sets",
    """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_custkey % 40 <> 0), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_custkey % 40 = 0)
SELECT 'skills-buckets' AS "check", CAST(coalesce(a.date, b.date) AS VARCHAR) AS key, CASE WHEN a.date IS NULL THEN 'false' ELSE 'true' END AS expected, CASE WHEN b.date IS NULL THEN 'false' ELSE 'true' END AS actual
FROM a FULL JOIN b ON a.date = b.date WHERE a.date IS NULL OR b.date IS NULL""",
)
def j13_bucket_sets(spark, folder):
    """Date buckets of two series that have to be the same set."""
    rows = t.table(spark, folder, "orders").withColumn("date", F.to_date("o_orderdate"))
    few = F.col("o_custkey") % 40 == 0
    return quality.same_buckets(rows.where(~few), rows.where(few), "skills")


@query(
    "j15_reconcile_hours",
    f"""WITH {t.PREPARED}, whole AS (SELECT date, weekday, hour, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM prepared GROUP BY ALL),
d AS (SELECT date, weekday, hour, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM prepared WHERE output <> 50 GROUP BY ALL),
j AS (SELECT whole.date || '|' || whole.weekday || '|' || whole.hour AS key, whole.calls AS rc, whole.tokens AS rt, d.calls AS dc, d.tokens AS dt FROM whole LEFT JOIN d USING (date, weekday, hour))
SELECT 'hours-missing' AS "check", key, 'true' AS expected, 'false' AS actual FROM j WHERE dc IS NULL
UNION ALL SELECT 'hours-calls', key, CAST(rc AS VARCHAR), CAST(dc AS VARCHAR) FROM j WHERE dc <> rc UNION ALL SELECT 'hours-tokens', key, CAST(rt AS VARCHAR), CAST(dt AS VARCHAR) FROM j WHERE dt <> rt""",
)
def j15_reconcile_hours(spark, folder):
    """Hours of a damaged copy against the raw hours, key by key."""
    rows = t.prepared(spark, folder)

    def hours(df):
        return df.groupBy("date", "weekday", "hour").agg(
            F.sum("calls").alias("calls"), F.sum(rollups.tokens()).alias("tokens"), F.sum("cost").alias("cost")
        )

    found = quality.reconcile(
        hours(rows.where(F.col("output") != 50)), hours(rows), ["date", "weekday", "hour"], ["calls", "tokens"], name="hours"
    )
    return found


@query(
    "j15_reconcile_sessions",
    """SELECT '' AS "check", '' AS key, '' AS expected, '' AS actual WHERE false""",
)
def j15_reconcile_sessions(spark, folder):
    """Session sums of compact facts equal those of the raw rows: no violation."""
    rows = t.prepared(spark, folder)
    facts = rollups.compact_facts(rows)

    def sessions(df):
        return df.groupBy("session").agg(
            F.sum("calls").alias("calls"), F.sum(rollups.tokens()).alias("tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("rows")
        )

    return quality.reconcile(sessions(facts), sessions(rows), ["session"], ["calls", "tokens"], cost="cost", rows="rows", name="session")


@query(
    "j16_table_diff",
    f"""WITH {t.PREPARED}, a AS (SELECT model AS name, CAST(sum(tokens) AS VARCHAR) AS v FROM prepared GROUP BY 1), e AS (SELECT model AS name, CAST(sum(tokens) + CASE WHEN model = 'view' THEN 1 ELSE 0 END AS VARCHAR) AS v FROM prepared GROUP BY 1)
SELECT 'table-diff' AS "check", name AS key, e.v AS expected, a.v AS actual FROM a JOIN e USING (name) WHERE a.v <> e.v
UNION ALL SELECT 'table-diff', 'absent', '1', 'null'""",
)
def j16_table_diff(spark, folder):
    """Metrics against expected ones, of which one is off and one is absent."""
    rows = t.prepared(spark, folder)
    sums = rows.groupBy(F.col("model").alias("name")).agg(F.sum(rollups.tokens()).alias("value"))
    expected = sums.withColumn("value", F.col("value") + F.when(F.col("name") == "view", 1).otherwise(0))
    extra = rows.agg(F.lit("absent").alias("name"), F.lit(1).cast("bigint").alias("value"))
    return quality.table_diff(sums, expected.unionByName(extra), ["name"])


@query(
    "j18_detail_alignment",
    f"""WITH {t.RESPONSES}, m AS (SELECT date, sum(threads) AS th, sum(turns) AS tu FROM detail GROUP BY date)
SELECT bool_and(m.date IS NULL OR th = days.threads) AS threads_match, bool_and(m.date IS NULL OR tu = days.turns) AS turns_match FROM days LEFT JOIN m USING (date)""",
)
def j18_detail_alignment(spark, folder):
    return credits.detail_alignment(parse_usage(t.response_days(spark, folder)))


@query(
    "j18_detail_violations",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS model, count(*) AS turns FROM orders GROUP BY ALL),
s AS (SELECT date, CAST(sum(turns) AS BIGINT) AS listed, CAST(sum(turns) + CASE WHEN day(date) = 13 THEN 1 ELSE 0 END AS BIGINT) AS turns FROM d GROUP BY date)
SELECT 'models-turns' AS "check", CAST(date AS VARCHAR) AS key, CAST(turns AS VARCHAR) AS expected, CAST(listed AS VARCHAR) AS actual FROM s WHERE day(date) % 10 <> 0 AND listed <> turns""",
)
def j18_detail_violations(spark, folder):
    """Days of orders whose listed turns miss the total; days without detail are skipped."""
    model = F.when(F.col("o_custkey") % 3 == 0, "a").otherwise("b")
    cells = t.table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date"), model.alias("model")).agg(
        F.count(F.lit(1)).alias("turns")
    )
    days = cells.groupBy("date").agg(
        (F.sum("turns") + F.max(F.when(F.dayofmonth("date") == 13, 1).otherwise(0))).alias("turns"),
        F.collect_list(F.struct("model", "turns")).alias("models"),
    )
    days = days.withColumn("models", F.when(F.dayofmonth("date") % 10 != 0, F.col("models")))
    return quality.detail_matches_totals(days, "date", "models", ["turns"])


