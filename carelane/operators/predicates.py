"""Predicates as Column builders: all push down to scans where their columns are stored."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelane.functions.text import contains_folded, trimmed
from carelane.functions.times import within_days
from carelane.functions.values import or_default, parse_number


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those that are given; with none of them, true."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def between_two(sender: Column, receiver: Column, a, b) -> Column:
    """A message between two people, whoever sent it."""
    return ((sender == a) & (receiver == b)) | ((sender == b) & (receiver == a))


def search(term: str, *columns: Column) -> Column:
    """Some column contains the term, case folded; an empty term matches every row."""
    return reduce(lambda x, y: x | y, [contains_folded(c, term) for c in columns])


def optional_contains(column: Column, term: str | None) -> Column | None:
    """No condition for an empty term."""
    return contains_folded(column, term) if term else None


def least_rating(rating: Column, least: str | None, default: float = 4.5) -> Column | None:
    """Rating of at least a number given as text; a missing or zero rating counts as the default."""
    return or_default(rating, default, 0.0) >= parse_number(F.lit(least)) if least else None


def available(key: Column, when: str | None, seed: int | None = None) -> Column | None:
    """Simulated availability: today 7 of 10, week 9 of 10, month all, anything else none.

    With a seed at random; without one by the key, so that a query gives the same rows each time.
    """
    if not when:
        return None
    draw = F.floor(F.rand(seed) * 10) if seed is not None else F.pmod(key, F.lit(10))
    return {"today": draw >= 3, "week": draw >= 1, "month": F.lit(True)}.get(when, F.lit(False))


def online(key: Column, seed: int | None = None) -> Column:
    """Simulated presence of half of the people: at random with a seed, else by the key."""
    return F.rand(seed) > 0.5 if seed is not None else F.pmod(key, F.lit(2)) == 1


def on_day(ts: Column, day: str, zone: str = "UTC", kind: str = "timestamp_ntz") -> Column:
    """A null-safe test of the day in a zone (UTC: the day that the stored text begins with); ``kind`` is the column's type."""
    start = F.lit(day).cast("date")
    return within_days(ts, start, F.date_add(start, 1), zone, kind)


def overdue(status: Column, ts: Column, now: Column, confirmed: str = "confirmed") -> Column:
    """Confirmed and before now; null dates are not."""
    return status.isNotNull() & (status == confirmed) & ts.isNotNull() & (ts < now)


def unread(is_read: Column) -> Column:
    """False, not null: null is neither read nor unread."""
    return is_read == F.lit(False)


def active(is_active: Column) -> Column:
    """Anything but false: null counts as active."""
    return ~is_active.eqNullSafe(F.lit(False))


def not_blank(x: Column) -> Column:
    return F.length(trimmed(x)) > 0


def all_given(*columns: Column) -> Column:
    """None is null or empty."""
    return reduce(and_, [c.isNotNull() & (c != "") for c in columns])


def bookable(day: Column, now: Column) -> Column:
    """Days that can be chosen: not before now."""
    return day >= now
