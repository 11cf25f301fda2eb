"""The signed-in person from a session's string values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelane.functions.text import WHITE
from carelane.functions.values import parse_int
from carelane.operators.predicates import all_given

from .schema import ROLES

#: The session's keys.
KEYS = ("isLoggedIn", "userRole", "userId", "userName", "userEmail")


@dataclass(frozen=True)
class Person:
    id: int
    name: str
    email: str
    role: str


def signed_in(values: dict[str, str | None]) -> Person | None:
    """The person of a session, or None unless all keys are there and valid.

    Ids are the leading whole number of their text.
    """
    if values.get("isLoggedIn") != "true" or not all(values.get(k) for k in KEYS):
        return None
    number = re.match(r"[+-]?[0-9]+", values["userId"].strip(WHITE))
    if not number or values["userRole"] not in ROLES:
        return None
    return Person(int(number[0]), values["userName"], values["userEmail"], values["userRole"])


def signed_in_rows(sessions: DataFrame) -> DataFrame:
    """id, name, email, role of the valid ones of stored sessions (a string column for each of the keys)."""
    number: Column = parse_int(F.col("userId"))
    valid = (F.col("isLoggedIn") == "true") & all_given(*[F.col(k) for k in KEYS]) & F.col("userRole").isin(*ROLES) & number.isNotNull()
    return sessions.where(valid).select(number.alias("id"), F.col("userName").alias("name"), F.col("userEmail").alias("email"), F.col("userRole").alias("role"))


def session_values(person: Person | None) -> dict[str, str]:
    """What a session stores for a person; nothing after signing out."""
    if person is None:
        return {}
    return dict(zip(KEYS, ("true", person.role, str(person.id), person.name, person.email), strict=True))


def session_rows(people: DataFrame) -> DataFrame:
    """What sessions store for people (id, name, email, role): a string column for each of the keys."""
    values = (F.lit("true"), F.col("role"), F.col("id").cast("string"), F.col("name"), F.col("email"))
    return people.select(*[v.alias(k) for k, v in zip(KEYS, values, strict=True)])
