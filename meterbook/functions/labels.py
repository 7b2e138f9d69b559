"""Labels: dimensions, projects, models, activities, clients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def trim(value: str | Column) -> Column:
    return F.btrim(_col(value), F.lit(fixed.TRIM_CHARS))


def clean_dimension(value: str | Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(trim(_col(value).cast("string")), F.lit(""))


def single_alias(*columns: str | Column) -> Column:
    """Value of a field that may be spelled in several ways."""
    return F.coalesce(*[_col(c) for c in columns])


def alias_conflict(*columns: str | Column) -> Column:
    """True when more than one spelling is set."""
    return F.size(F.array_compact(F.array(*[_col(c).cast("string") for c in columns]))) > 1


def value_conflict(*columns: str | Column) -> Column:
    """True when spellings that are set disagree."""
    return F.size(F.array_distinct(F.array_compact(F.array(*[_col(c).cast("string") for c in columns])))) > 1


def normalize_path(path: str | Column) -> Column:
    slashed = F.replace(F.coalesce(_col(path), F.lit("")), F.lit("\\"), F.lit("/"))
    return F.lower(F.btrim(slashed, F.lit("/")))


def worktree_suffix(normalized: str | Column) -> Column:
    """Path below a worktree folder, null outside of one."""
    return F.nullif(F.regexp_extract(_col(normalized), fixed.WORKTREE_PATTERN, 1), F.lit(""))


def canonical_project(path: str | Column, parent: str | Column | None = None) -> Column:
    """Normalised path; a worktree becomes its parent project, or its suffix."""
    normalized = normalize_path(path)
    options = [] if parent is None else [_col(parent)]
    return F.coalesce(*options, worktree_suffix(normalized), normalized)


def _alias_of(relative: Column, canonical: Column) -> Column:
    """Project name of a canonical path whose home prefix is already gone; the first rule that fits wins."""
    segments = F.filter(F.split(relative, "/"), lambda s: s != "")
    numbered = F.regexp_extract(relative, fixed.NUMBERED_PROJECT_PATTERN, 1)
    inline = F.regexp_extract(relative, fixed.INLINE_PROJECT_PATTERN, 1)
    last = F.try_element_at(segments, F.lit(-1))

    def hide(label: Column) -> Column:
        return F.regexp_replace(label, "(?i)" + fixed.UUID_TEXT, fixed.UUID_REPLACEMENT)

    return (
        F.when((relative == "") | canonical.rlike(r"^users/[^/]+$"), F.lit(fixed.HOME_LABEL))
        .when(relative.rlike(fixed.SCRATCH_PATTERN), F.lit(fixed.SCRATCH_LABEL))
        .when(F.contains(relative, F.lit(fixed.SITES_FRAGMENT)), F.lit(fixed.SITES_LABEL))
        .when(relative.rlike(fixed.NUMBERED_PROJECT_PATTERN), F.concat(F.lit("project-"), numbered))
        .when(relative.rlike(fixed.INLINE_PROJECT_PATTERN), inline)
        .when(
            last.isin(*fixed.GENERIC_SEGMENTS) & (F.size(segments) > 1),
            F.array_join(F.transform(F.slice(segments, -2, 2), hide), fixed.LABEL_SEPARATOR),
        )
        .otherwise(F.coalesce(hide(last), F.lit(fixed.OTHER_LABEL)))
    )


def add_project_alias(df: DataFrame, path: str, out: str, parent: str | None = None) -> DataFrame:
    """Readable project name of a raw path as a column.

    The path is normalised in steps of its own, so each regular expression runs
    once per row.
    """
    steps = df.withColumn("_normal", normalize_path(path))
    options = [F.col(parent)] if parent else []
    steps = steps.withColumn("_canonical", F.coalesce(*options, worktree_suffix("_normal"), F.col("_normal")))
    steps = steps.withColumn("_relative", F.regexp_replace("_canonical", r"^users/[^/]+/", ""))
    return steps.withColumn(out, _alias_of(F.col("_relative"), F.col("_canonical"))).drop(
        "_normal", "_canonical", "_relative"
    )


def model_label(model: str | Column) -> Column:
    column = _col(model)
    return F.coalesce(_lookup(fixed.MODEL_LABELS, F.lower(column)), column)


def activity_label(activity: str | Column, missing: str = fixed.OTHER_LABEL) -> Column:
    column = F.nullif(_col(activity), F.lit(""))
    return F.coalesce(_lookup(fixed.ACTIVITY_LABELS, F.lower(column)), column, F.lit(missing))


def client_display_name(client_id: str | Column) -> Column:
    column = _col(client_id)
    stripped = F.lower(F.regexp_replace(column, "^" + fixed.CLIENT_PREFIX, ""))
    titled = F.array_join(
        F.transform(
            F.split(stripped, "_"),
            lambda part: F.concat(F.upper(F.substring(part, 1, 1)), part.substr(F.lit(2), F.length(part))),
        ),
        " ",
    )
    return F.coalesce(_lookup(fixed.CLIENT_LABELS, column), titled)


def is_specific(label: str | Column) -> Column:
    """False for a missing label and for the unattributed labels, with or without a device."""
    return F.coalesce(~_col(label).rlike(fixed.UNSPECIFIC_PATTERN), F.lit(False))


def device_fallback(label: str | Column, device: str | Column, kind: str = fixed.UNATTRIBUTED) -> Column:
    cleaned = clean_dimension(label)
    return F.when(is_specific(label), cleaned).otherwise(F.concat(F.lit(kind + fixed.LABEL_SEPARATOR), _col(device)))


def activity_fallback(label: str | Column) -> Column:
    return F.when(is_specific(label), clean_dimension(label)).otherwise(F.lit(fixed.UNCLASSIFIED))


def display_fragment(value: str | Column, fallback: str = fixed.UNKNOWN_PROJECT_FRAGMENT) -> Column:
    """A label that holds no path separator, control character or run of spaces."""
    text = clean_dimension(value)
    text = F.regexp_replace(text, r"[\\/]+", fixed.LABEL_SEPARATOR)
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")
    text = F.regexp_replace(text, r"\s+", " ")
    return F.coalesce(clean_dimension(text), F.lit(fallback))


def project_basename(project: str | Column) -> Column:
    cleaned = F.replace(clean_dimension(project), F.lit("\\"), F.lit("/"))
    trimmed = F.nullif(F.regexp_replace(cleaned, "/+$", ""), F.lit(""))
    return F.when(trimmed.isNotNull(), display_fragment(F.element_at(F.split(trimmed, "/"), -1)))


def short_fingerprint(fingerprint: str | Column) -> Column:
    cleaned = F.coalesce(clean_dimension(fingerprint), F.lit(""))
    compact = F.lower(F.regexp_replace(cleaned, "(?i)[^a-z0-9]", ""))
    return F.when(F.length(compact) >= 6, F.substring(compact, 1, 6)).otherwise(
        F.substring(F.sha2(cleaned, 256), 1, 6)
    )


def tool_item_key(name: str | Column, plugin_id: str | Column | None = None) -> Column:
    """Identity of a skill or plugin row."""
    lowered = F.lower(_col(name))
    keyed = F.when(lowered == "other", F.lit("other"))
    if plugin_id is not None:
        keyed = keyed.when(_col(plugin_id).isNotNull(), F.concat(F.lit("id:"), _col(plugin_id)))
    return keyed.otherwise(F.concat(F.lit("name:"), lowered))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
