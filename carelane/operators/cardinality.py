"""Exactly one, at most one, and first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A result had another number of rows than was asked for."""


def single(rows: DataFrame) -> Row:
    """The only row; at most two rows are fetched."""
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise CardinalityError(f"expected one row, found {'none' if not got else 'more'}")
    return got[0]


def maybe_single(rows: DataFrame) -> Row | None:
    """The only row or None; more is an error."""
    got = rows.limit(2).collect()
    if len(got) > 1:
        raise CardinalityError("expected at most one row, found more")
    return got[0] if got else None


def _guarded(rows: DataFrame, least: int) -> DataFrame:
    """At most two rows are looked at; the check is part of the plan, so it fails when the plan runs."""
    one = rows.limit(2).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("r"))
    kind = one.schema["r"].dataType
    wanted, found = ("one row", "at most one row")[least == 0], F.when(F.size("r") == 0, "none").otherwise("more")
    failed = F.raise_error(F.concat(F.lit(f"expected {wanted}, found "), found)).cast(kind)
    return one.select(F.inline(F.when(F.size("r").between(least, 1), F.col("r")).otherwise(failed)))


def exactly_one_row(rows: DataFrame) -> DataFrame:
    """The only row, as a table that fails when it runs and there is none or more; nothing runs before."""
    return _guarded(rows, 1)


def at_most_one_row(rows: DataFrame) -> DataFrame:
    """The only row or none, as a table that fails when it runs and there are more."""
    return _guarded(rows, 0)


def head(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows by an order."""
    return rows.orderBy(*order).limit(k)


def top(rows: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """k rows of greatest value; nulls first, as in the server's descending order."""
    return rows.orderBy(F.desc_nulls_first(by), *[F.asc_nulls_last(t) for t in ties]).limit(k)


def is_empty(rows: DataFrame) -> bool:
    return rows.isEmpty()
