"""Which project, activity and repository a session belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.operators.keyed import keyed_join, summarise


def session_attribution(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best project and activity of each session: most tokens, then most calls, then name.

    Votes are summed per value first, so a session with a huge number of rows
    reaches the pick as a handful of candidates.
    """
    votes = rows.where(F.col("session").isNotNull()).select(
        *by,
        "session",
        "tokens",
        F.explode(
            F.array(
                F.struct(F.lit("project").alias("dimension"), F.col("project").alias("value")),
                F.struct(F.lit("activity").alias("dimension"), F.col("activity").alias("value")),
            )
        ).alias("vote"),
    )
    votes = votes.select(*by, "session", "tokens", "vote.*")
    counted = votes.groupBy(*by, "session", "dimension", "value").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls")
    )

    def best(dimension: str):
        fits = (F.col("dimension") == dimension) & F.col("value").isNotNull()
        order = F.struct(-F.col("tokens"), -F.col("calls"), F.col("value"))
        return F.min_by("value", F.when(fits, order)).alias(dimension)

    return counted.groupBy(*by, "session").agg(best("project"), best("activity"))


def rollout_mappings(meta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First project and first repository fingerprint of each session by file path.

    Files without a session are dropped by an aggregated flag: a filter on the
    session itself would be pushed down and parse every first line twice.
    """
    mapped = meta.groupBy(*by, "session").agg(
        F.min_by("project", F.when(F.col("project").isNotNull(), F.col("file_path"))).alias("rollout_project"),
        F.min_by("fingerprint", F.when(F.col("fingerprint").isNotNull(), F.col("file_path"))).alias("fingerprint"),
        F.max(F.col("session").isNotNull()).alias("_known"),
    )
    return mapped.where("_known").drop("_known")


def rollout_stats(meta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How the rollout files map to sessions: parsed, skipped, repeated, conflicting.

    A later mapping repeats the first one or conflicts with it.
    """
    parsed = F.col("session").isNotNull() & (F.col("project").isNotNull() | F.col("fingerprint").isNotNull())
    marked = meta.withColumn("_parsed", parsed)
    per_value = marked.groupBy(*by, "session", "project", "fingerprint").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("_parsed").alias("_parsed_rows"),
        F.min(F.when(F.col("_parsed"), F.col("file_path"))).alias("_first"),
    )

    def repeats(column: str) -> dict:
        known = F.when(F.col("_parsed_rows") > 0, F.col(column))
        return {
            f"_{column}_rows": F.sum(F.when(known.isNotNull(), F.col("_parsed_rows"))),
            f"_{column}_kept": F.min_by(column, F.when(known.isNotNull(), F.col("_first"))),
        }

    firsts = per_value.groupBy(*by, "session").agg(
        *[e.alias(n) for c in ("project", "fingerprint") for n, e in repeats(c).items()]
    )
    joined = keyed_join(per_value, firsts, [*by, "session"])

    def equal_rows(column: str):
        same = (F.col("_parsed_rows") > 0) & (F.col(column) == F.col(f"_{column}_kept"))
        return F.coalesce(F.sum(F.when(same, F.col("_parsed_rows"))), F.lit(0))

    def known_rows(column: str):
        return F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("_parsed_rows"))), F.lit(0))

    counted = summarise(
        joined,
        by,
        files=F.sum("_rows"),
        rows_parsed=F.sum("_parsed_rows"),
        rows_skipped=F.sum(F.col("_rows") - F.col("_parsed_rows")),
        project_sessions=F.countDistinct(F.when((F.col("_parsed_rows") > 0) & F.col("project").isNotNull(), F.col("session"))),
        fingerprint_sessions=F.countDistinct(
            F.when((F.col("_parsed_rows") > 0) & F.col("fingerprint").isNotNull(), F.col("session"))
        ),
        _same_projects=equal_rows("project"),
        _all_projects=known_rows("project"),
        _same_prints=equal_rows("fingerprint"),
        _all_prints=known_rows("fingerprint"),
    )
    return counted.select(
        *by,
        "files",
        "rows_parsed",
        "rows_skipped",
        "project_sessions",
        "fingerprint_sessions",
        (F.col("_same_projects") - F.col("project_sessions")).alias("duplicate_projects"),
        (F.col("_all_projects") - F.col("_same_projects")).alias("conflicting_projects"),
        (F.col("_same_prints") - F.col("fingerprint_sessions")).alias("duplicate_fingerprints"),
        (F.col("_all_prints") - F.col("_same_prints")).alias("conflicting_fingerprints"),
    )


def attribute_baseline(
    baseline: DataFrame, attribution: DataFrame, rollouts: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Project, activity and fingerprint for baseline rows, which carry none themselves.

    The session's best project comes first; the working folder of its rollout is
    a fallback for the project only, never for the activity.  ``recovered`` marks
    rows that needed the fallback.
    """
    sessions = attribution.select(*by, "session", "project", "activity")
    joined = keyed_join(baseline.drop("project", "activity"), sessions, [*by, "session"])
    if rollouts is None:
        return joined.withColumns({"fingerprint": F.lit(None).cast("string"), "recovered": F.lit(False)})
    joined = keyed_join(joined, rollouts.select(*by, "session", "rollout_project", "fingerprint"), [*by, "session"])
    recovered = F.col("project").isNull() & F.col("rollout_project").isNotNull()
    return joined.withColumns(
        {"recovered": recovered, "project": F.coalesce("project", "rollout_project")}
    ).drop("rollout_project")


def attach_fingerprint(rows: DataFrame, rollouts: DataFrame | None, by: Sequence[str] = ()) -> DataFrame:
    if rollouts is None:
        return rows.withColumn("fingerprint", F.lit(None).cast("string"))
    return keyed_join(rows, rollouts.select(*by, "session", "fingerprint"), [*by, "session"])


def recovery_counts(baseline: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, tokens and sessions whose project came from a rollout."""
    return summarise(
        baseline,
        by,
        rows_recovered=F.count_if("recovered"),
        tokens_recovered=F.coalesce(F.sum(F.when(F.col("recovered"), F.col("tokens"))), F.lit(0)),
        sessions_recovered=F.countDistinct(F.when(F.col("recovered"), F.col("session"))),
    )
