"""Joins, groupings, windows and set operations between tables, DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def embed_one(rows: DataFrame, other: DataFrame, key: str, other_key: str, name: str, columns: list[str]) -> DataFrame:
    """Left join to one row of ``other`` as a struct column, null where there is none."""
    side = other.select(F.col(other_key).alias("__key"), F.struct(*columns).alias(name))
    return rows.join(side, F.col(key) == F.col("__key"), "left").drop("__key")


def embed_many(rows: DataFrame, other: DataFrame, key: str, other_key: str, name: str, columns: list[str], k: int | None = None) -> DataFrame:
    """Left join to all rows of ``other`` as an array of structs, empty where there are none.

    The many side is grouped before the join; its elements are sorted. With ``k`` only the first k of a key are
    embedded: they are picked before any are gathered, in each task first, so no key's rows are held.
    """
    if k is not None:
        place = F.row_number().over(W.partitionBy(other_key).orderBy(*[F.asc(c) for c in columns]))
        other = other.where(F.col(other_key).isNotNull()).withColumn("__place", place).where(F.col("__place") <= k)
    side = other.groupBy(F.col(other_key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("__rows"))
    kind = side.schema["__rows"].dataType.simpleString()
    joined = rows.join(side, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(name, F.coalesce("__rows", F.array().cast(kind))).drop("__key", "__rows")


def first_match(rows: DataFrame, other: DataFrame, key: str, other_key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """Left join to the first row of ``other`` by an order, so rows never multiply."""
    one = first_by(other, [other_key], order).select(F.col(other_key).alias("__key"), *columns)
    return rows.join(one, F.col(key) == F.col("__key"), "left").drop("__key")


def first_by(rows: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key by an order; rows with a null key are left out."""
    given = [F.col(k) if isinstance(k, str) else k for k in keys]
    rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys if isinstance(k, str)) or "true")
    place = F.row_number().over(W.partitionBy(*given).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def indexed(rows: DataFrame, order: list[Column], keys: list[str] | None = None, name: str = "index") -> DataFrame:
    """Adds each row's place from 0 in an order, within its key.

    Without keys all rows are numbered in one task: that is for a list that is shown, after its limit.
    """
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)) - 1)


def pair_key(a: Column, b: Column) -> list[Column]:
    """An unordered pair as two columns to group and join by: an equi-key instead of an OR of ANDs."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def last_messages(messages: DataFrame) -> DataFrame:
    """The latest message of each unordered pair: a, b, id, message, ts; messages that lack one of the two are left out."""
    keyed = messages.where("sender_id is not null and receiver_id is not null").select(*pair_key(F.col("sender_id"), F.col("receiver_id")), "id", "message", "ts")
    return first_by(keyed, ["a", "b"], [F.desc("ts"), F.desc("id")])


def is_member(rows: DataFrame, key: str, members: DataFrame, member_key: str, name: str) -> DataFrame:
    """Adds whether the key is among the members."""
    ids = members.select(F.col(member_key).alias("__id")).distinct()
    return rows.join(ids, F.col(key) == F.col("__id"), "left").withColumn(name, F.col("__id").isNotNull()).drop("__id")


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows whose key no existing row has, of each key the first by all columns; none without a key.

    The existing keys are first cut to those that new rows have: these are few, so a large table is not shuffled
    for a few new rows.
    """
    columns = [F.col(f"`{c}`") for c in new.columns]
    first = first_by(new, [key], [c.asc_nulls_last() for c in columns])
    known = existing.select(key).join(first.select(key), key, "left_semi").distinct()
    return first.join(known, key, "left_anti").select(*columns)


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of the tables, with ``src`` for the table's place; missing columns are null."""
    parts = [t.withColumn("src", F.lit(k)) for k, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def labelled_counts(one: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A row of counts as rows (label, value)."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(text).alias("label"), F.col(c).alias("value")) for c, text in labels.items()])).alias("x")).select("x.*")
