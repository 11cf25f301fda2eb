"""Defaults, truthiness, numbers and lookups as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(x: Column, default, falsy="") -> Column:
    """``default`` for null and for the falsy value of the column's kind ('' for text, 0 for numbers).

    A falsy 0.0 says that the column is floating: NaN is falsy there, too.
    """
    d = default if isinstance(default, Column) else F.lit(default)
    if isinstance(falsy, float):
        x = F.when(~F.isnan(x), x)
    return F.coalesce(F.nullif(x, F.lit(falsy)), d)


def null_default(x: Column, made: Column, default) -> Column:
    """``made`` where x is there (zero too), else ``default``."""
    return F.when(x.isNotNull(), made).otherwise(F.lit(default))


def parse_int(x: Column) -> Column:
    """The leading integer of a text, else null: trailing characters are ignored."""
    return F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def parse_number(x: Column) -> Column:
    """The leading decimal number of a text, else null."""
    return F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def fixed(x: Column, digits: int) -> Column:
    """A finite double below 2^53 with one or two decimals: the exact binary value, rounded half up in size.

    The fraction is taken as a whole number of 2^-62ths, which is exact for all fractions that do not round to 0.
    """
    size = F.abs(x.cast("double"))
    whole = F.floor(size).cast("bigint")
    unit = F.lit(1 << 62).cast("decimal(38,0)")
    scaled = ((size - whole) * F.lit(float(1 << 62))).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(4,0)") + F.lit(1 << 61).cast("decimal(20,0)")
    tenths = ((scaled - F.pmod(scaled, unit)) / unit).cast("bigint")
    carried, rest = whole + F.floor(tenths / 10**digits).cast("bigint"), F.pmod(tenths, F.lit(10**digits))
    return F.concat(F.when(x < 0, "-").otherwise(""), carried.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))


def share_floor(n: Column, hundredths: int) -> Column:
    """Whole part of a share of a count, in exact arithmetic."""
    return F.floor(n * hundredths / F.lit(100).cast("decimal(3,0)")).cast("bigint")


def is_even(x: Column) -> Column:
    return F.pmod(x, F.lit(2)) == 0


def stars(rating: Column, slots: int = 5) -> Column:
    """Which of the slots a rating fills."""
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: i < F.floor(rating))


def case(x: Column, choices: dict, otherwise) -> Column:
    """A chain of equalities."""
    whens = reduce(lambda c, kv: c.when(x == kv[0], kv[1]), choices.items(), F)
    return whens.otherwise(otherwise)


def lookup(x: Column, choices: dict) -> Column:
    """A map lookup; null for unknown keys."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in choices.items() for v in kv]), x)


def element(x: Column, k: int) -> Column:
    """An array's element by position from 0, null beyond its ends."""
    return F.get(x, F.lit(k))
