"""Scalar normalisers and filters over the given tables."""

from pyspark.sql import functions as F

from meterbook.catalog import tables as t
from meterbook.catalog.registry import query, sql_round, sql_time
from meterbook.functions import identity, labels, timeparts, tokens
from meterbook.operators import filters, rollups
from meterbook.operators.projects import project_dictionary, with_project_alias
from meterbook.plans import report

# --- P1–P3, P23: tokens ---------------------------------------------------------


@query(
    "p01_inclusive_components",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) * 100 - CAST(l_quantity AS BIGINT) * l_linenumber AS fresh_input,
  CAST(l_quantity AS BIGINT) * l_linenumber AS cache_read, CAST(0 AS BIGINT) AS cache_write, l_partkey AS output, CAST(l_quantity AS BIGINT) * 100 + l_partkey AS tokens FROM lineitem""",
)
def p01_inclusive_components(spark, folder):
    rows = t.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity").cast("bigint") * 100).alias("_in"),
        (F.col("l_quantity").cast("bigint") * F.col("l_linenumber")).alias("_cached"),
        F.col("l_partkey").alias("_out"),
    )
    return tokens.components_from_inclusive(rows, "_in", "_cached", "_out").drop("_in", "_cached", "_out")


@query(
    "p02_split_components",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey AS fresh_input, l_suppkey AS cache_read, CAST(l_linenumber AS BIGINT) AS cache_write, CAST(l_quantity AS BIGINT) AS output,
  l_partkey + l_suppkey + l_linenumber + CAST(l_quantity AS BIGINT) AS tokens FROM lineitem""",
)
def p02_split_components(spark, folder):
    rows = t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    split = tokens.components_from_split(rows, "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return split.drop("l_partkey", "l_suppkey", "l_quantity")


@query(
    "p03_token_total",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END, 0) + coalesce(CASE WHEN l_suppkey % 2 <> 0 THEN l_suppkey END, 0) + l_linenumber AS tokens FROM lineitem""",
)
def p03_token_total(spark, folder):
    some_part = F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey"))
    some_supplier = F.when(F.col("l_suppkey") % 2 != 0, F.col("l_suppkey"))
    total = tokens.token_total(some_part, some_supplier, F.col("l_linenumber"))
    return t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", total.alias("tokens"))


@query(
    "p23_record_weight",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber - 3 > 0 THEN CAST(l_linenumber - 3 AS BIGINT) ELSE 1 END AS calls FROM lineitem",
)
def p23_record_weight(spark, folder):
    return t.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", tokens.record_weight(F.col("l_linenumber") - 3).alias("calls")
    )


@query(
    "p15_rounding",
    f"""SELECT event_id, {sql_round("value", 2)} AS cents, {sql_round("value / 7", 4)} AS four, {sql_round("value / 3", 8)} AS eight,
  CAST(CAST(value / 7 AS DECIMAL(38,9)) AS DOUBLE) AS nine FROM events""",
)
def p15_rounding(spark, folder):
    value = F.col("value")
    return t.table(spark, folder, "events").select(
        "event_id",
        tokens.round_half_up(value, 2).alias("cents"),
        tokens.round_half_up(value / 7, 4).alias("four"),
        tokens.round_half_up(value / 3, 8).alias("eight"),
        tokens.as_double(tokens.round9(value / 7)).alias("nine"),
    )


# --- P4, P5, P16–P20, P22: labels -------------------------------------------------

PADDED = "CASE event_id % 6 WHEN 0 THEN '  ' || event_type WHEN 1 THEN chr(9) || event_type || chr(160) WHEN 2 THEN '   ' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE event_type END"


def _padded():
    n = F.col("event_id") % 6
    return (
        F.when(n == 0, F.concat(F.lit("  "), "event_type"))
        .when(n == 1, F.concat(F.lit("\t"), "event_type", F.lit("\u00a0")))
        .when(n == 2, F.lit("   "))
        .when(n == 3, F.lit(""))
        .when(n == 5, F.col("event_type"))
    )


@query("p04_clean_dimension", f"SELECT event_id, nullif(trim({PADDED}, chr(9) || chr(160) || ' '), '') AS label FROM events")
def p04_clean_dimension(spark, folder):
    return t.table(spark, folder, "events").select("event_id", labels.clean_dimension(_padded()).alias("label"))


@query(
    "p05_session_id",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0199ab00-1111-2222-3333-' || lpad(lower(to_hex(o_custkey)), 12, '0')
  WHEN 1 THEN '0199ab00-1111-2222-3333-' || lpad(lower(to_hex(o_custkey)), 12, '0') WHEN 2 THEN 'Plain-' || o_custkey END AS session FROM orders""",
)
def p05_session_id(spark, folder):
    uuid = F.concat(F.lit("0199AB00-1111-2222-3333-"), F.lpad(F.hex("o_custkey"), 12, "0"))
    n = F.col("o_orderkey") % 4
    raw = F.when(n == 0, uuid).when(n == 1, F.concat(F.lit(" rollout-2024-"), uuid)).when(n == 2, F.concat(F.lit(" Plain-"), F.col("o_custkey").cast("string")))
    cleaned = t.table(spark, folder, "orders").select("o_orderkey", labels.clean_dimension(raw).alias("session"))
    return cleaned.withColumn("session", identity.normalize_session_id("session"))


REMOTES = """CASE n WHEN 0 THEN 'git@host.example:Team/Repo' || x || '.git' WHEN 1 THEN 'https://user:pw@Host.example/Team/Repo' || x || '.git?ref=a#b' WHEN 2 THEN 'ssh://git@host.example:2222/Team/Repo' || x || '/'
  WHEN 3 THEN 'host.example/Team/Repo' || x || '.git' WHEN 4 THEN '//host.example/Team/Repo' || x WHEN 5 THEN 'C:' || chr(92) || 'src' || chr(92) || 'Repo' || x WHEN 6 THEN 'https://host.example:443/Team/Repo' || x
  WHEN 7 THEN '  ' END"""


@query(
    "p06_repository",
    f"""WITH r AS (SELECT o_orderkey, o_orderkey % 9 AS n, CAST(o_custkey % 5 AS VARCHAR) AS x FROM orders), i AS (
  SELECT o_orderkey, {REMOTES} AS remote, CASE n WHEN 0 THEN 'host.example/team/repo' || x WHEN 1 THEN 'host.example/team/repo' || x WHEN 2 THEN 'host.example:2222/team/repo' || x
   WHEN 3 THEN 'host.example/team/repo' || x WHEN 4 THEN 'host.example/team/repo' || x WHEN 5 THEN 'src/repo' || x WHEN 6 THEN 'host.example/team/repo' || x END AS identity FROM r)
SELECT o_orderkey, remote, identity, sha256(identity) AS fingerprint FROM i""",
)
def p06_repository(spark, folder):
    n, x = F.col("o_orderkey") % 9, (F.col("o_custkey") % 5).cast("string")
    remote = (
        F.when(n == 0, F.concat(F.lit("git@host.example:Team/Repo"), x, F.lit(".git")))
        .when(n == 1, F.concat(F.lit("https://user:pw@Host.example/Team/Repo"), x, F.lit(".git?ref=a#b")))
        .when(n == 2, F.concat(F.lit("ssh://git@host.example:2222/Team/Repo"), x, F.lit("/")))
        .when(n == 3, F.concat(F.lit("host.example/Team/Repo"), x, F.lit(".git")))
        .when(n == 4, F.concat(F.lit("//host.example/Team/Repo"), x))
        .when(n == 5, F.concat(F.lit("C:\\src\\Repo"), x))
        .when(n == 6, F.concat(F.lit("https://host.example:443/Team/Repo"), x))
        .when(n == 7, F.lit("  "))
    )
    rows = t.table(spark, folder, "orders").select("o_orderkey", remote.alias("remote"))
    return identity.add_repository_fingerprint(rows, "remote", "fingerprint", identity="identity")


PATHS = [
    "/Users/anna",
    "/Users/anna/",
    "C:\\Users\\Bob\\Work\\Site7",
    "/Users/anna/Documents/Codex/2024/01/02/notes",
    "/Users/anna/x/sites/plugin/sites/blog",
    "/Users/anna/Documents/project/17/src",
    "/srv/project42/app",
    "/Users/anna/Shop/App",
    "/opt/app",
    "work",
    "/tmp/0199ab00-1111-2222-3333-00000000002a",
    "/Users/anna/.codex/worktrees/ab12/Shop/App",
    "/home/z/.codex/worktrees/cd34/lonely",
    "/srv/0199AB00-1111-2222-3333-00000000002a/chat",
]
# canonical path and alias of each path above, worked out by hand; worktrees without known parents
CANONICAL = [
    "users/anna", "users/anna", "c:/users/bob/work/site7", "users/anna/documents/codex/2024/01/02/notes",
    "users/anna/x/sites/plugin/sites/blog", "users/anna/documents/project/17/src", "srv/project42/app", "users/anna/shop/app",
    "opt/app", "work", "tmp/0199ab00-1111-2222-3333-00000000002a", "shop/app", "lonely",
    "srv/0199ab00-1111-2222-3333-00000000002a/chat",
]
ALIASES = [
    "Home", "Home", "site7", "Codex scratch", "sites-plugin", "project-17", "project42", "shop · app", "opt · app", "work",
    "private-id", "shop · app", "lonely", "private-id · chat",
]


def _paths(spark, folder):
    options = F.array(*[F.lit(p) for p in PATHS])
    pick = F.element_at(options, (F.col("o_custkey") % len(PATHS) + 1).cast("int"))
    return t.table(spark, folder, "orders").select("o_orderkey", pick.alias("project"))


def _list(values):
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


@query("p07_canonical_project", f"SELECT o_orderkey, {_list(CANONICAL)}[o_custkey % {len(PATHS)} + 1] AS canonical FROM orders")
def p07_canonical_project(spark, folder):
    return _paths(spark, folder).select("o_orderkey", labels.canonical_project("project").alias("canonical"))


@query("p08_project_alias", f"SELECT o_orderkey, {_list(ALIASES)}[o_custkey % {len(PATHS)} + 1] AS project FROM orders")
def p08_project_alias(spark, folder):
    return labels.add_project_alias(_paths(spark, folder), "project", "project")


@query(
    "j14_worktree_parents",
    f"SELECT o_orderkey, CASE WHEN o_custkey % {len(PATHS)} = 12 THEN 'lonely' ELSE {_list(ALIASES)}[o_custkey % {len(PATHS)} + 1] END AS project FROM orders",
)
def j14_worktree_parents(spark, folder):
    """Aliases with worktrees folded into known base projects, joined on path suffixes."""
    rows = _paths(spark, folder)
    bases = rows.groupBy("project").agg(F.min("o_orderkey").alias("ord"))
    return with_project_alias(rows, bases)


@query(
    "j14_project_dictionary",
    """WITH p AS (SELECT DISTINCT '/srv/team' || (p_size % 5) || '/' || p_name AS base FROM part), w AS (SELECT DISTINCT '/Users/a/.codex/worktrees/w' || (p_partkey % 3) || '/' || p_name AS path, p_name FROM part)
SELECT path AS raw_project, replace(p_name, '/', '') AS alias FROM w UNION SELECT base, substr(base, 12) FROM p""",
)
def j14_project_dictionary(spark, folder):
    """One alias per distinct raw project; worktrees resolve to the first base that ends alike."""
    part = t.table(spark, folder, "part")
    bases = part.groupBy(
        F.concat(F.lit("/srv/team"), (F.col("p_size") % 5).cast("string"), F.lit("/"), "p_name").alias("project")
    ).agg(F.min("p_partkey").alias("ord"))
    trees = part.select(
        F.concat(F.lit("/Users/a/.codex/worktrees/w"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), "p_name").alias("project")
    )
    return project_dictionary(trees.unionByName(bases.select("project")), bases)


MODEL_SQL = "['GPT-5.5', 'gpt-5.4-mini', 'Codex-Auto-Review', 'GPT-5.6-SOL', 'other-model'][p_size % 5 + 1]"


@query(
    "p09_model_label",
    f"""SELECT p_partkey, CASE lower({MODEL_SQL}) WHEN 'gpt-5.5' THEN 'GPT-5.5' WHEN 'gpt-5.4-mini' THEN 'GPT-5.4 Mini' WHEN 'codex-auto-review' THEN 'Codex Auto Review'
  WHEN 'gpt-5.6-sol' THEN 'gpt-5.6-sol' ELSE {MODEL_SQL} END AS model FROM part""",
)
def p09_model_label(spark, folder):
    names = F.array(*[F.lit(m) for m in ("GPT-5.5", "gpt-5.4-mini", "Codex-Auto-Review", "GPT-5.6-SOL", "other-model")])
    raw = F.element_at(names, F.col("p_size") % 5 + 1)
    return t.table(spark, folder, "part").select("p_partkey", labels.model_label(raw).alias("model"))


@query(
    "p10_activity_label",
    """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Coding' WHEN 1 THEN 'Feature Dev' WHEN 2 THEN 'Git Ops' WHEN 3 THEN 'Other' WHEN 4 THEN 'Other' WHEN 5 THEN p_type ELSE 'Refactoring' END AS activity FROM part""",
)
def p10_activity_label(spark, folder):
    n = F.col("p_size") % 7
    raw = (
        F.when(n == 0, "CODING").when(n == 1, "feature").when(n == 2, "Git").when(n == 3, "")
        .when(n == 5, F.col("p_type")).when(n == 6, "refactoring")
    )
    return t.table(spark, folder, "part").select("p_partkey", labels.activity_label(raw).alias("activity"))


@query(
    "p11_pseudonym",
    "SELECT conv_id, turn, 'session-' || substr(sha256(CASE WHEN turn % 3 = 0 THEN 'historical-unknown' ELSE 'c' || conv_id END), 1, 12) AS session FROM conversations",
)
def p11_pseudonym(spark, folder):
    raw = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return t.table(spark, folder, "conversations").select("conv_id", "turn", identity.session_pseudonym(raw).alias("session"))


@query(
    "p12_event_id",
    """WITH u AS (SELECT user_id, event_id, date_trunc('millisecond', ts) AS ts, CASE WHEN event_id % 5 <> 0 THEN 'a"b' || chr(92) || user_id END AS session, CASE WHEN event_id % 7 <> 0 THEN event_type END AS model FROM events),
j AS (SELECT *, CASE WHEN session IS NULL THEN 'null' ELSE '"a' || chr(92) || '"b' || chr(92) || chr(92) || user_id || '"' END AS js, CASE WHEN model IS NULL THEN 'null' ELSE '"' || model || '"' END AS jm FROM u)
SELECT event_id AS n, sha256('["' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '",' || js || ',' || jm || ',1,2,3,4,10]') AS increment_id,
  sha256('["r' || event_id || '","' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') || '",' || js || ',' || jm || ',1,2,3,4,10]') AS baseline_id FROM j""",
)
def p12_event_id(spark, folder):
    """Ids over sessions that need JSON escapes and over missing sessions and models."""
    rows = t.table(spark, folder, "events").select(
        F.col("event_id").alias("n"),
        "ts",
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit('a"b\\'), F.col("user_id").cast("string"))).alias("session"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("model"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        *[F.lit(v).cast("bigint").alias(c) for c, v in (("fresh_input", 1), ("cache_read", 2), ("cache_write", 3), ("output", 4), ("tokens", 10))],
    )
    return rows.select(
        "n",
        identity.event_id(ts="ts", session="session", model="model").alias("increment_id"),
        identity.event_id(ts="ts", session="session", model="model", request_id="request_id").alias("baseline_id"),
    )


@query(
    "p13_local_parts",
    """SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS shanghai_date, CAST(hour(ts + INTERVAL 8 HOUR) AS BIGINT) AS shanghai_hour, strftime(ts + INTERVAL 8 HOUR, '%a') AS shanghai_day,
  CAST(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS VARCHAR) AS new_york_date, CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS BIGINT) AS new_york_hour FROM events""",
)
def p13_local_parts(spark, folder):
    shanghai = timeparts.local_date("ts", "Asia/Shanghai")
    return t.table(spark, folder, "events").select(
        "event_id",
        shanghai.alias("shanghai_date"),
        timeparts.local_hour("ts", "Asia/Shanghai").alias("shanghai_hour"),
        timeparts.weekday(shanghai).alias("shanghai_day"),
        timeparts.local_date("ts", "America/New_York").alias("new_york_date"),
        timeparts.local_hour("ts", "America/New_York").alias("new_york_hour"),
    )


@query(
    "p14_weeks",
    """SELECT o_orderkey, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, CAST(CAST(o_orderdate AS DATE) + 6 AS VARCHAR) AS later, strftime(o_orderdate, '%Y-%m') AS month, CAST(day(last_day(o_orderdate)) AS BIGINT) AS days FROM orders""",
)
def p14_weeks(spark, folder):
    day = F.to_date("o_orderdate")
    return t.table(spark, folder, "orders").select(
        "o_orderkey",
        timeparts.week_start(day).alias("week"),
        F.date_add(day, 6).alias("later"),
        timeparts.month_key(day).alias("month"),
        timeparts.days_in_month(day).alias("days"),
    )


@query(
    "p16_client_names",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Desktop App' WHEN 1 THEN 'Web' WHEN 2 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Tool' ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS client FROM customer""",
)
def p16_client_names(spark, folder):
    n = F.col("c_custkey") % 4
    raw = (
        F.when(n == 0, "CODEX_DESKTOP_APP").when(n == 1, "CODEX_WORK_WEB")
        .when(n == 2, F.concat(F.lit("CODEX_"), "c_mktsegment", F.lit("_TOOL"))).otherwise(F.col("c_mktsegment"))
    )
    return t.table(spark, folder, "customer").select("c_custkey", labels.client_display_name(raw).alias("client"))


LABELS_SQL = "CASE c_custkey % 7 WHEN 0 THEN '历史未归属' WHEN 1 THEN '历史未归属 · mac' WHEN 2 THEN '历史未归类' WHEN 3 THEN '  ' WHEN 5 THEN '历史未归属者' WHEN 6 THEN c_mktsegment END"


def _labels():
    n = F.col("c_custkey") % 7
    return (
        F.when(n == 0, "历史未归属").when(n == 1, "历史未归属 · mac").when(n == 2, "历史未归类").when(n == 3, "  ")
        .when(n == 5, "历史未归属者").when(n == 6, F.col("c_mktsegment"))
    )


@query("p17_specific", "SELECT c_custkey, c_custkey % 7 IN (5, 6) AS specific FROM customer")
def p17_specific(spark, folder):
    return t.table(spark, folder, "customer").select("c_custkey", labels.is_specific(_labels()).alias("specific"))


@query(
    "p18_device_fallback",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 7 IN (5, 6) THEN {LABELS_SQL} ELSE '历史未归属 · d' || (c_custkey % 3) END AS project,
  CASE WHEN c_custkey % 7 IN (5, 6) THEN {LABELS_SQL} ELSE '历史未归类' END AS activity FROM customer""",
)
def p18_device_fallback(spark, folder):
    device = F.concat(F.lit("d"), (F.col("c_custkey") % 3).cast("string"))
    return t.table(spark, folder, "customer").select(
        "c_custkey",
        labels.device_fallback(_labels(), device).alias("project"),
        labels.activity_fallback(_labels()).alias("activity"),
    )


@query(
    "p19_single_alias",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) AS value,
  c_custkey % 6 = 0 AS conflict, c_custkey % 6 = 0 AND c_name <> c_mktsegment AS differs FROM customer""",
)
def p19_single_alias(spark, folder):
    a = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    b = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return t.table(spark, folder, "customer").select(
        "c_custkey",
        labels.single_alias(a, b).alias("value"),
        labels.alias_conflict(a, b).alias("conflict"),
        labels.value_conflict(a, b).alias("differs"),
    )


@query(
    "p20_basename",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x' WHEN 3 THEN p_brand END AS basename,
  substr(sha256(p_name), 1, 6) AS digits FROM part""",
)
def p20_basename(spark, folder):
    n = F.col("p_size") % 4
    path = (
        F.when(n == 0, F.concat(F.lit("/srv/a/"), "p_name", F.lit("//")))
        .when(n == 1, F.concat(F.lit("C:\\work\\"), "p_name", F.lit(" \t x ")))
        .when(n == 2, F.lit(" / "))
        .otherwise(F.col("p_brand"))
    )
    return t.table(spark, folder, "part").select(
        "p_partkey",
        labels.project_basename(path).alias("basename"),
        labels.short_fingerprint(F.sha2("p_name", 256)).alias("digits"),
    )


@query(
    "p22_item_key",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'other' WHEN p_size % 2 = 0 THEN 'id:' || p_brand ELSE 'name:' || lower(p_type) END AS item_key FROM part""",
)
def p22_item_key(spark, folder):
    name = F.when(F.col("p_size") % 3 == 0, "OTHER").otherwise(F.col("p_type"))
    plugin = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return t.table(spark, folder, "part").select("p_partkey", labels.tool_item_key(name, plugin).alias("item_key"))


@query(
    "p24_lifecycle_projection",
    f"""WITH {t.TWO_SOURCES}, gaps AS (SELECT *, CASE WHEN output % 5 <> 0 THEN session END AS s, CASE WHEN output % 4 <> 0 THEN model END AS m, CASE WHEN output % 3 <> 0 THEN project END AS p FROM local_ledger)
SELECT event_id, coalesce(p, '历史未归属') AS project, coalesce(s, 'historical-' || CAST(date AS VARCHAR) || '-' || hour) AS session, coalesce(m, '历史未归属') AS model,
  CASE activity WHEN 'coding' THEN 'Coding' WHEN 'git' THEN 'Git Ops' ELSE coalesce(activity, '历史未归属') END AS activity, calls, CAST(cost AS DOUBLE) AS cost FROM gaps""",
)
def p24_lifecycle_projection(spark, folder):
    rows = t.ledger(spark, folder)
    rows = rows.withColumns({c: F.when(F.col("output") % n != 0, F.col(c)) for c, n in (("session", 5), ("model", 4), ("project", 3))})
    shown = report.lifecycle_projection(rows)
    return shown.select("event_id", "project", "session", "model", "activity", "calls", "cost")


# --- F1–F6 ---------------------------------------------------------------------------


@query(
    "f01_date_range",
    f"""WITH {t.SPARSE}, f AS (SELECT * FROM daily WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-16')
SELECT CAST(date AS VARCHAR) AS date, calls, (SELECT CAST(min(date) AS VARCHAR) FROM f) AS first_date, (SELECT CAST(max(date) AS VARCHAR) FROM f) AS last_date, (SELECT count(*) FROM f) AS rows FROM f""",
)
def f01_date_range(spark, folder):
    """A range with ends that have no data: the bounds are those really there."""
    from meterbook.operators.keyed import with_totals

    chosen = filters.date_range(t.sparse_daily(spark, folder), "2024-01-05", "2024-01-16")
    return with_totals(chosen.select("date", "calls"), filters.selected_bounds(chosen))


@query(
    "f02_provider",
    f"""WITH {t.TWO_SOURCES} SELECT count(*) AS scanned, count(*) FILTER (provider IS NULL OR lower(provider) = 'codex') AS kept,
  count(*) FILTER (NOT (provider IS NULL OR lower(provider) = 'codex')) AS skipped FROM export_rows""",
)
def f02_provider(spark, folder):
    return filters.provider_counts(t.export_rows(spark, folder))


@query("f02_provider_rows", f"WITH {t.TWO_SOURCES} SELECT event_id, tokens FROM wanted")
def f02_provider_rows(spark, folder):
    return filters.provider_filter(t.export_rows(spark, folder)).select("event_id", "tokens")


@query(
    "f03_after_cutoff",
    f"WITH {t.TWO_SOURCES} SELECT event_id, {sql_time('ts')} AS ts, tokens FROM export_rows, cutoff WHERE epoch_ms(ts) > c * 1000 + 999",
)
def f03_after_cutoff(spark, folder):
    from meterbook.sources.requestlog import baseline_cutoff

    rows = filters.after_cutoff(t.export_rows(spark, folder), baseline_cutoff(t.request_log(spark, folder)))
    return rows.select("event_id", "ts", "tokens")


@query(
    "f03_append_counts_by_user",
    f"""WITH {t.USAGE}, log AS (SELECT user_id, CAST(floor(epoch_ms(max(ts)) / 1000) AS BIGINT) AS c FROM usage WHERE ts < TIMESTAMP '{t.SPLIT}' AND user_id % 5 <> 0 GROUP BY user_id)
SELECT u.user_id, count(*) AS scanned, count(*) FILTER (c IS NULL OR epoch_ms(ts) > c * 1000 + 999) AS selected, count(*) FILTER (c IS NOT NULL AND epoch_ms(ts) <= c * 1000 + 999) AS at_or_before_cutoff
FROM usage u LEFT JOIN log USING (user_id) GROUP BY u.user_id""",
)
def f03_append_counts_by_user(spark, folder):
    """Every user has a cutoff of their own, some none at all."""
    rows = t.usage(spark, folder)
    log = rows.where((F.col("ts") < F.lit(t.SPLIT).cast("timestamp_ntz")) & (F.col("user_id") % 5 != 0))
    cutoff = log.groupBy("user_id").agg(F.floor(timeparts.epoch_ms(F.max("ts")) / 1000).alias("cutoff_seconds"))
    return filters.append_counts(rows, cutoff, ["user_id"])


@query(
    "f04_account_range",
    f"""WITH {t.SHIPMENTS}, {t.ACCOUNT}, s AS (SELECT *, date BETWEEN (SELECT min(date) FROM account) AND (SELECT max(date) FROM account) AS i FROM shipments)
SELECT CAST(sum(calls) FILTER (i) AS BIGINT) AS inside_calls, CAST(coalesce(sum(calls) FILTER (NOT i), 0) AS BIGINT) AS outside_calls, CAST(sum(tokens) FILTER (i) AS BIGINT) AS inside_tokens,
  CAST(coalesce(sum(tokens) FILTER (NOT i), 0) AS BIGINT) AS outside_tokens FROM s""",
)
def f04_account_range(spark, folder):
    rows = t.shipments(spark, folder).withColumn("tokens", rollups.tokens())
    return filters.range_split(rows, t.account(spark, folder))


@query(
    "f04_inside_days",
    f"""WITH {t.SHIPMENTS}, {t.ACCOUNT} SELECT CAST(date AS VARCHAR) AS date, CAST(sum(tokens) AS BIGINT) AS tokens FROM shipments
WHERE date BETWEEN (SELECT min(date) FROM account) AND (SELECT max(date) FROM account) GROUP BY date""",
)
def f04_inside_days(spark, folder):
    rows = filters.inside_account_range(t.shipments(spark, folder), t.account(spark, folder))
    return rows.groupBy("date").agg(F.sum(rollups.tokens()).alias("tokens"))


@query(
    "f05_record_range",
    f"WITH {t.USAGE} SELECT event_id, tokens FROM usage WHERE CAST(ts + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'",
)
def f05_record_range(spark, folder):
    rows = filters.record_range(t.usage(spark, folder), "2024-01-10", "2024-01-12", t.TZ)
    return rows.select("event_id", tokens.token_total().alias("tokens"))


@query(
    "f06_scoped_switch",
    f"""WITH {t.PREPARED}, g AS (SELECT user_no, project, count(*) AS calls FROM (SELECT *, CAST(substr(raw_session, 2) AS BIGINT) % 6 AS user_no FROM prepared) GROUP BY ALL)
SELECT user_no, CASE WHEN user_no % 2 = 0 THEN 'given ' ELSE '' END || project AS project, calls FROM g""",
)
def f06_scoped_switch(spark, folder):
    """Given project rows where their calls add up to the total, recomputed rows elsewhere; six accounts."""
    rows = t.prepared(spark, folder).withColumn("user_no", F.col("user_id") % 6)
    computed = rows.groupBy("user_no", "project").agg(F.sum("calls").alias("calls"))
    short = F.when(F.col("user_no") % 2 == 0, F.col("calls")).otherwise(F.col("calls") - 1)
    given = computed.select("user_no", F.concat(F.lit("given "), "project").alias("project"), short.alias("calls"))
    total = rows.groupBy("user_no").agg(F.sum("calls").alias("total_calls"))
    return filters.scoped_source_switch(given, computed, total, ["user_no"])


