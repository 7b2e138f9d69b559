"""Identifiers: sessions, repositories, events, pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook import fixed
from meterbook.functions.labels import clean_dimension
from meterbook.functions.timeparts import iso_utc

_WHOLE_UUID = f"(?i)^{fixed.UUID_TEXT}$"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_session_id(cleaned: str | Column) -> Column:
    """A trailing UUID in lower case, otherwise the text; of a text that is already trimmed."""
    tail = F.substring(_col(cleaned), -36, 36)
    return F.when(tail.rlike(_WHOLE_UUID), F.lower(tail)).otherwise(_col(cleaned))


def _host_and_path(text: Column) -> Column:
    """(host, path) of a remote in any of its forms: scp, URL with or without a scheme, bare.

    A bare remote has its host at the begin of the path.
    """

    def parts(host: Column, path: Column) -> Column:
        return F.struct(host.alias("host"), path.alias("path"))

    def of_url(url: Column) -> Column:
        scheme, host = F.lower(F.regexp_extract(url, fixed.REMOTE_URL, 1)), F.regexp_extract(url, fixed.REMOTE_URL, 2)
        port = F.try_element_at(F.create_map(*[F.lit(x) for item in fixed.DEFAULT_PORTS.items() for x in item]), scheme)
        plain = F.when(F.endswith(host, F.concat(F.lit(":"), port)), F.substring_index(host, ":", 1)).otherwise(host)
        return parts(plain, F.ltrim(F.regexp_extract(url, fixed.REMOTE_URL, 3), F.lit("/")))

    url = F.when(F.startswith(text, F.lit("//")), F.concat(F.lit("ssh:"), text)).otherwise(text)
    is_scp = text.rlike(fixed.REMOTE_SCP) & ~F.contains(text, F.lit("://")) & ~text.rlike(fixed.DRIVE_PATH)
    bare = F.regexp_replace(F.regexp_replace(text, fixed.REMOTE_USER, ""), fixed.REMOTE_QUERY, "")
    return (
        F.when(is_scp, parts(F.regexp_extract(text, fixed.REMOTE_SCP, 1), F.regexp_extract(text, fixed.REMOTE_SCP, 2)))
        .when(url.rlike(fixed.REMOTE_URL), of_url(url))
        .otherwise(parts(F.lit(""), bare))
    )


def add_repository_fingerprint(df: DataFrame, remote: str, out: str, identity: str | None = None) -> DataFrame:
    """Hash of ``host/owner/name`` of a remote as a column.

    Each step is a column of its own and is computed once per row.  ``identity``
    names a column to keep the readable form in; by default it is dropped.
    """
    name = identity or "_identity"
    steps = df.withColumn("_text", F.replace(clean_dimension(remote), F.lit("\\"), F.lit("/")))
    steps = steps.withColumn("_parts", _host_and_path(F.col("_text")))
    whole = F.lower(F.btrim(F.concat_ws("/", F.nullif("_parts.host", F.lit("")), "_parts.path"), F.lit("/")))
    steps = steps.withColumn(name, F.nullif(F.rtrim(F.regexp_replace(whole, fixed.REMOTE_SUFFIX, ""), F.lit("/")), F.lit("")))
    return steps.withColumn(out, F.sha2(name, 256)).drop("_text", "_parts", "_identity")


def session_key(session: str | Column) -> Column:
    """Whole pseudonymous identity of a session, to group and join by; a missing session has one of its own."""
    raw = F.coalesce(_col(session).cast("string"), F.lit(fixed.UNKNOWN_SESSION))
    return F.concat(F.lit("session-"), F.sha2(raw, 256))


def session_label(key: str | Column, digits: int = 12) -> Column:
    """Public name of a session: its key, shortened for show.  Labels may collide; never group by them."""
    return F.substring(_col(key), 1, len("session-") + digits)


def session_pseudonym(session: str | Column) -> Column:
    """Public name of a raw session id."""
    return session_label(session_key(session))


def label_sessions(df: DataFrame, digits: int = 12) -> DataFrame:
    """Shorten the session keys of a finished table."""
    return df.withColumn("session", session_label("session", digits)) if "session" in df.columns else df


def json_token(value: Column) -> Column:
    """A string as a JSON token; only text that needs escapes goes through the JSON writer."""
    encoded = F.to_json(F.array(value))
    escaped = encoded.substr(F.lit(2), F.length(encoded) - 2)
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(value.rlike(r'["\\\x00-\x1f]'), escaped)
        .otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    )


def event_id(*, ts: str, session: str, model: str, request_id: str | None = None) -> Column:
    """SHA-256 of the JSON array of an event's identity.

    A baseline row starts with its request id; an exported record has none.
    Labels, device and cost are no part of the identity.
    """
    texts = [] if request_id is None else [json_token(F.col(request_id))]
    texts += [json_token(iso_utc(ts)), json_token(F.col(session)), json_token(F.col(model))]
    numbers = [F.col(c).cast("string") for c in ("fresh_input", "cache_read", "cache_write", "output", "tokens")]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *texts, *numbers), F.lit("]")), 256)
