"""Dates and times as Column builders.

Stored columns are instants (``timestamp``) or clock readings of UTC (``timestamp_ntz``). What a person sees of them,
a day, a month, a clock, is that of a zone, which is a parameter (the session's zone changes nothing): ``wall`` first
turns a column into the readings of the zone's clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _hour12(ts: Column) -> Column:
    return F.pmod(F.hour(ts) + 11, F.lit(12)) + 1


def _half(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "AM").otherwise("PM")


def date_part(ts: Column) -> Column:
    """yyyy-MM-dd of a clock reading."""
    return ts.cast("date").cast("string")


def clock(ts: Column) -> Column:
    """Twelve-hour clock with two digits each, of a clock reading."""
    return F.concat(_two(_hour12(ts)), F.lit(":"), _two(F.minute(ts)), F.lit(" "), _half(ts))


def half_hour(ts: Column) -> Column:
    """HH:00 or HH:30, the half hour that a clock reading lies in."""
    return F.concat(_two(F.hour(ts)), F.when(F.minute(ts) < 30, ":00").otherwise(":30"))


def date_time(ts: Column) -> Column:
    """Month/day/year, twelve-hour clock with seconds, of a clock reading."""
    day = [F.month(ts), F.lit("/"), F.dayofmonth(ts), F.lit("/"), F.year(ts), F.lit(", ")]
    return F.concat(*day, _hour12(ts), F.lit(":"), _two(F.minute(ts)), F.lit(":"), _two(F.second(ts)), F.lit(" "), _half(ts))


def long_date(d: Column) -> Column:
    """Month name, day with its ordinal ending, year."""
    day = F.dayofmonth(d)
    ending = F.when((day % 10 == 1) & (day != 11), "st").when((day % 10 == 2) & (day != 12), "nd").when((day % 10 == 3) & (day != 13), "rd").otherwise("th")
    return F.concat(F.date_format(d, "MMMM d"), ending, F.date_format(d, ", yyyy"))


def _utc_reading(ts: Column) -> Column:
    """What a clock in UTC shows at an instant, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01").cast("timestamp_ntz"))


def wall(ts: Column, zone: str = "UTC", kind: str = "timestamp") -> Column:
    """What a zone's clock shows (``timestamp_ntz``) at a stored time of a kind."""
    utc = _utc_reading(ts) if kind == "timestamp" else ts
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def _instant(reading: Column, zone: str) -> Column:
    """The instant at which a zone's clock shows a reading given as text (date, T, time)."""
    return F.concat(reading, F.lit(f" {zone}")).cast("timestamp")


def _bound(day: Column, zone: str, kind: str) -> Column:
    """The beginning of a day in a zone, as a stored time of a kind."""
    at = _instant(F.concat(day.cast("string"), F.lit("T00:00:00")), zone)
    return at if kind == "timestamp" else _utc_reading(at)


def within_days(ts: Column, first: Column, end: Column, zone: str = "UTC", kind: str = "timestamp_ntz") -> Column:
    """From the beginning of one day to that of another, in a zone; the stored column stays bare, so it is pushed down."""
    return ts.isNotNull() & (ts >= _bound(first, zone, kind)) & (ts < _bound(end, zone, kind))


def same_month(ts: Column, now: Column, zone: str = "UTC", kind: str = "timestamp_ntz") -> Column:
    """Same calendar month and year as a day, in a zone."""
    first = F.trunc(now, "MONTH")
    return (ts >= _bound(first, zone, kind)) & (ts < _bound(F.add_months(first, 1), zone, kind))


#: A date alone; a date and time with no zone, to the minute or finer.
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_MINUTE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{1,2}:[0-9]{2}$"
_READING = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"


def parsed(x: Column, zone: str = "UTC") -> Column:
    """The instant that a text names, null where it names none: a date alone is midnight in UTC, a date and time
    without a zone is read in ``zone``, one with a zone in its own."""
    bare = F.trim(x)
    shapes = [(_DAY, "T00:00:00Z"), (_MINUTE, f":00 {zone}"), (_READING, f" {zone}")]
    given = bare
    for shape, more in shapes:
        given = F.when(bare.rlike(shape), F.concat(bare, F.lit(more))).otherwise(given)
    return given.try_cast("timestamp")
