"""Appending messages and inserting people who are not there yet, to committed tables; ids are made by the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from carelane.functions.text import WHITE
from carelane.operators.commits import CommittedTable
from carelane.sources.schema import DDL, schema_of


def committed(spark: SparkSession, folder: str, name: str) -> CommittedTable:
    """A declared table under a folder, with atomic appends and ids of its own."""
    return CommittedTable(spark, f"{folder}/{name}", DDL[name])


def append_message(messages: CommittedTable, sender: int, receiver: int, text: str, now: datetime) -> Row | None:
    """Append one message and return its row, with its new id; a blank text (``text.WHITE`` alone) appends nothing."""
    if not text.strip(WHITE):
        return None
    row = messages.spark.createDataFrame([(None, sender, receiver, text, now, False)], schema_of("messages"))
    return messages.append_row(row)


def append_messages(messages: CommittedTable, rows: DataFrame) -> int:
    """Append many messages (sender_id, receiver_id, message, timestamp), blank ones left out; unread unless they say so."""
    unread = rows if "is_read" in rows.columns else rows.withColumn("is_read", F.lit(False))
    return messages.append(unread.where(F.length(F.btrim("message", F.lit(WHITE))) > 0))


def as_declared(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the shape of a declared table; columns that they lack are null."""
    return rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of(name)])


def insert_people(users: CommittedTable, new: DataFrame) -> int:
    """Insert people with new emails, each once and with an id, also when others do so at the same time; returns how many."""
    return users.insert_absent(new, "email")
