"""Calendar parts.

An instant is held as ``timestamp_ntz`` in UTC wall clock.  The session time zone
has to be UTC (``session.tune`` sets it): the casts between the two timestamp types
are then free, and local parts in a named zone cost one offset lookup per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterbook import fixed


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since the epoch, fractions of a millisecond dropped."""
    return F.unix_millis(_col(ts).cast("timestamp"))


def from_epoch_ms(ms: str | Column) -> Column:
    return F.timestamp_millis(_col(ms)).cast("timestamp_ntz")


def from_epoch_seconds(seconds: str | Column) -> Column:
    return F.timestamp_seconds(_col(seconds)).cast("timestamp_ntz")


def parse_instant(text: str | Column) -> Column:
    """ISO text with ``Z`` or an explicit offset; null when it does not parse.

    The text has to begin with a full date: a bare time would be read as one of today.
    """
    column = _col(text)
    # +0800 is accepted next to +08:00
    spaced = F.regexp_replace(column, r"([+-]\d{2})(\d{2})$", "$1:$2")
    dated = F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), spaced)
    return dated.try_cast("timestamp").cast("timestamp_ntz")


def iso_utc(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_ts(ts: str | Column, tz: str) -> Column:
    """Wall clock of an instant in an IANA zone."""
    return F.from_utc_timestamp(_col(ts).cast("timestamp"), tz)


def local_date(ts: str | Column, tz: str) -> Column:
    return F.to_date(local_ts(ts, tz))


def local_hour(ts: str | Column, tz: str) -> Column:
    return F.hour(local_ts(ts, tz))


def weekday(date: str | Column) -> Column:
    """Short English name of the day."""
    names = F.array(*[F.lit(d) for d in fixed.WEEKDAYS])
    return F.element_at(names, F.weekday(_col(date)) + 1)


def week_start(date: str | Column) -> Column:
    """Monday of the week of a date."""
    return F.date_trunc("WEEK", _col(date)).cast("date")


def month_key(date: str | Column) -> Column:
    return F.date_format(_col(date), "yyyy-MM")


def days_in_month(date: str | Column) -> Column:
    return F.dayofmonth(F.last_day(_col(date)))


def parse_date(text: str | Column) -> Column:
    """Strict ``YYYY-MM-DD``; null for anything that does not round-trip."""
    column = _col(text)
    return F.when(column.rlike(r"^\d{4}-\d{2}-\d{2}$"), column.try_cast("date"))


def period_start(date: str | Column, grain: str) -> Column:
    """First date of the day, week or month a date lies in."""
    if grain == "daily":
        return _col(date)
    if grain == "weekly":
        return week_start(date)
    if grain == "monthly":
        return F.trunc(_col(date), "MM")
    raise ValueError(f"unknown grain {grain!r}")


def period_end(start: str | Column, grain: str) -> Column:
    if grain == "daily":
        return _col(start)
    if grain == "weekly":
        return F.date_add(_col(start), 6)
    if grain == "monthly":
        return F.last_day(_col(start))
    raise ValueError(f"unknown grain {grain!r}")


def grain_for(days: int) -> str:
    """Visible grain for an inclusive range of that many days."""
    if days <= 14:
        return "daily"
    return "weekly" if days <= 92 else "monthly"
