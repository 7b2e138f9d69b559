"""Project identity across devices, and worktrees folded into their parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.labels import (
    add_project_alias,
    clean_dimension,
    display_fragment,
    is_specific,
    normalize_path,
    project_basename,
    short_fingerprint,
    worktree_suffix,
)
from meterbook.operators.keyed import keyed_join
from meterbook.session import stage, stage_table


def worktree_parents(bases: DataFrame, by: Sequence[str] = (), project: str = "project", order: str = "ord") -> DataFrame:
    """First known base path for every path suffix that ends at a separator.

    "Equal to the suffix or ending with /suffix" is turned into an equality by
    listing the suffixes of each base path, so no row is compared with all paths.
    """
    paths = bases.select(*by, normalize_path(project).alias("_path"), F.col(order).alias("_ord"))
    paths = paths.where(~F.contains(F.col("_path"), F.lit(fixed.WORKTREE_MARKER)))
    segments = F.split("_path", "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda n: F.array_join(F.slice(segments, n, F.size(segments)), "/"),
    )
    return (
        paths.select(*by, "_path", "_ord", F.explode(tails).alias("_suffix"))
        .groupBy(*by, "_suffix")
        .agg(F.min_by("_path", "_ord").alias("parent"))
    )


def project_dictionary(
    usage: DataFrame, bases: DataFrame | None = None, by: Sequence[str] = (), project: str = "project"
) -> DataFrame:
    """Alias of every distinct raw project; paths are parsed once per project, not per row."""
    distinct = usage.select(*by, F.col(project).alias("raw_project")).distinct()
    if bases is None:
        return add_project_alias(distinct, "raw_project", "alias")
    # paths outside of a worktree have no suffix to look up: the row itself stands in for a null key
    normalized = normalize_path("raw_project")
    keyed = distinct.withColumn("_suffix", F.coalesce(worktree_suffix(normalized), F.concat(F.lit("\x00"), normalized)))
    joined = keyed_join(keyed, worktree_parents(bases, by), [*by, "_suffix"])
    return add_project_alias(joined, "raw_project", "alias", "parent").drop("_suffix", "parent")


def with_project_alias(
    usage: DataFrame, bases: DataFrame | None = None, by: Sequence[str] = (), project: str = "project"
) -> DataFrame:
    """Replace raw project paths by their readable names."""
    if bases is None:
        return add_project_alias(usage, project, project)
    dictionary = project_dictionary(usage, bases, by, project).withColumnRenamed("raw_project", project)
    return keyed_join(usage, dictionary, [*by, project]).withColumn(project, F.col("alias")).drop("alias")


def device_project_labels(items: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Label and rank of every distinct (device, raw project, fingerprint).

    3: explicit alias of the device and project, or of an item with the same
    fingerprint; 2: fingerprint, named after its smallest folder name and told
    apart by six digits where names or fingerprints are shared; 1: folder name
    and device; 0: unattributed.

    The events are read once, for the distinct combinations; these are staged and
    everything else works on them.
    """
    raw = stage(
        items.select(
            *by, "device", clean_dimension("project").alias("raw_project"), clean_dimension("fingerprint").alias("fingerprint")
        ).distinct()
    )
    if aliases is None:
        raw = raw.withColumn("explicit", F.lit(None).cast("string"))
    else:
        known = [k for k in by if k in aliases.columns]
        explicit = aliases.select(
            *known, "device", F.col("project").alias("raw_project"), F.col("alias").alias("explicit")
        ).distinct()
        raw = keyed_join(raw, explicit, [*known, "device", "raw_project"])

    has_print = raw.where(F.col("fingerprint").isNotNull())
    shared_alias = has_print.groupBy(*by, "fingerprint").agg(F.min("explicit").alias("shared_alias"))
    voting = has_print.where(is_specific("raw_project")).select(
        *by,
        "fingerprint",
        F.coalesce(project_basename("raw_project"), F.lit(fixed.UNKNOWN_PROJECT_FRAGMENT)).alias("basename"),
    ).distinct()
    per_print = voting.groupBy(*by, "fingerprint").agg(
        F.min("basename").alias("basename"), F.count(F.lit(1)).alias("names")
    )
    per_name = voting.groupBy(*by, "basename").agg(F.count(F.lit(1)).alias("prints"))
    named = keyed_join(per_print, per_name, [*by, "basename"])
    ambiguous = (F.col("names") > 1) | (F.col("prints") > 1)
    # two fingerprints of one folder name that begin alike are told apart by the whole of them
    named = named.withColumn("_short", short_fingerprint("fingerprint"))
    alike = F.count(F.lit(1)).over(W.partitionBy(*by, "basename", "_short")) > 1
    suffixed = F.concat(F.col("basename"), F.lit(fixed.LABEL_SEPARATOR), F.when(alike, F.lower("fingerprint")).otherwise(F.col("_short")))
    labels = named.select(*by, "fingerprint", F.when(ambiguous, suffixed).otherwise(F.col("basename")).alias("print_label"))

    joined = keyed_join(keyed_join(raw, shared_alias, [*by, "fingerprint"]), labels, [*by, "fingerprint"])
    own_name = F.coalesce(project_basename("raw_project"), F.lit(fixed.UNKNOWN_PROJECT_FRAGMENT))
    device = display_fragment("device", fixed.UNKNOWN_DEVICE_FRAGMENT)
    separator = F.lit(fixed.LABEL_SEPARATOR)
    alias = F.coalesce("explicit", "shared_alias")
    by_print = F.col("raw_project").isNotNull() & F.col("fingerprint").isNotNull()
    own_print = F.coalesce("print_label", F.concat(own_name, separator, short_fingerprint("fingerprint")))
    return joined.select(
        *by,
        "device",
        "raw_project",
        "fingerprint",
        F.when(alias.isNotNull(), alias)
        .when(by_print, own_print)
        .when(is_specific("raw_project"), F.concat(own_name, separator, device))
        .otherwise(F.concat(F.lit(fixed.UNATTRIBUTED), separator, device))
        .alias("label"),
        F.when(alias.isNotNull(), 3)
        .when(by_print, 2)
        .when(is_specific("raw_project"), 1)
        .otherwise(0)
        .cast("bigint")
        .alias("rank"),
    )


def resolve_projects(items: DataFrame, aliases: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Replace raw projects of several devices by labels; adds ``raw_project`` and ``project_rank``."""
    cleaned = items.withColumns(
        {"raw_project": clean_dimension("project"), "fingerprint": clean_dimension("fingerprint")}
    )
    # labels are few: staged, their size is known and the items need not be shuffled to meet them
    labels = stage_table(device_project_labels(items, aliases, by))
    joined = keyed_join(cleaned, labels, [*by, "device", "raw_project", "fingerprint"])
    return joined.withColumns({"project": F.col("label"), "project_rank": F.col("rank")}).drop("label", "rank")


def conflicting_aliases(aliases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Device and project pairs that were given more than one alias."""
    return (
        aliases.groupBy(*by, "device", "project")
        .agg(F.countDistinct("alias").alias("aliases"))
        .where(F.col("aliases") > 1)
    )


def conflicting_fingerprints(items: DataFrame, aliases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fingerprints whose items carry different explicit aliases."""
    raw = items.select(
        *by, "device", clean_dimension("project").alias("project"), clean_dimension("fingerprint").alias("fingerprint")
    ).distinct()
    known = [k for k in by if k in aliases.columns]
    matched = keyed_join(raw, aliases.select(*known, "device", "project", "alias"), [*known, "device", "project"], "inner")
    return (
        matched.where(F.col("fingerprint").isNotNull())
        .groupBy(*by, "fingerprint")
        .agg(F.countDistinct("alias").alias("aliases"))
        .where(F.col("aliases") > 1)
    )
