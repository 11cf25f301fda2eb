"""Committed tables at the ends of streams: inserts as they are committed, tables that hold each batch once, the latest
message of each pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelane.operators.commits import VERSIONS, CommittedTable
from carelane.operators.relations import pair_key

#: A table of latest messages: the pair, then its message.
LATEST = "a bigint, b bigint, id bigint, message string, ts timestamp"
#: A table of routed messages: who asked for the pair, then the message.
ROUTED = "subscriber string, id bigint, sender_id bigint, receiver_id bigint, message string, timestamp timestamp"


def inserts(table: CommittedTable, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand the rows of a table to a function, with a number: first those that are there, then those of each commit as it comes.

    The stream's source are the table's versions, so rows that are not committed, or whose writer lost a race, never
    show, and a compaction shows nothing new. A batch that comes again has the same number and the same rows.
    """
    versions = table.spark.readStream.schema("number long, added string").json(f"{table.path}/{VERSIONS}")

    def on(batch: DataFrame, number: int) -> None:
        come = batch.orderBy("number").collect()  # a row a commit
        if number == 0 and come:
            handle(table.read(table.version_at(come[-1]["number"])), number)
        elif folders := [r["added"] for r in come if r["added"] is not None]:
            handle(table.rows_of(folders), number)

    writer = versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _add_once(table: CommittedTable, batch: DataFrame, own: tuple[str, int], shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """A batch is computed once, whatever the number of tries, and also when the table has it: its stream's state goes on by it."""
    batch = batch.persist()
    try:
        if table.has(own):
            batch.write.format("noop").mode("overwrite").save()
        else:
            table.append(shape(batch), own)
    finally:
        batch.unpersist()


def once(table: CommittedTable, name: str, compact_every: int | None = None, **how) -> Callable[[DataFrame, int], None]:
    """A handler of batches that adds each to a table exactly once: the stream's name and the batch's number are
    committed with its rows, so a batch that comes again after a failure adds nothing. Every so many batches their
    small files are made one."""

    def handle(batch: DataFrame, number: int) -> None:
        _add_once(table, batch, (name, number))
        if compact_every and (number + 1) % compact_every == 0:
            table.compact(**how)

    return handle


def latest_by_pair(messages: DataFrame) -> DataFrame:
    """a, b, id, message, ts of the latest message of each unordered pair; ties go to the larger id, no time comes last,
    and messages that lack one of the two are left out.

    On a stream this is the state: one row a pair, whatever the number of messages; a late message changes nothing.
    """
    given = messages.where("sender_id is not null and receiver_id is not null")
    keyed = given.select(*pair_key(F.col("sender_id"), F.col("receiver_id")), F.struct(F.col("timestamp").alias("ts"), "id", "message").alias("m"))
    latest = keyed.groupBy("a", "b").agg(F.max("m").alias("m"))
    return latest.select("a", "b", "m.id", "m.message", "m.ts")


def newest(updates: DataFrame) -> DataFrame:
    """Of a table of latest messages, in which later rows of a pair replace earlier ones, the one of each pair."""
    return updates.groupBy("a", "b").agg(F.max(F.struct("ts", "id", "message")).alias("m")).select("a", "b", "m.id", "m.message", "m.ts")


def keep_latest(messages: DataFrame, table: CommittedTable, name: str, checkpoint: str, every: str | None = None, compact_every: int = 100) -> StreamingQuery:
    """Follow a stream of messages with the latest one of each pair in a table (``LATEST``), to be read by ``newest``.

    Only pairs that changed are written; the table is merged every so many batches.
    """
    handle = once(table, name, compact_every, order=["a", "b"], reduce=newest)
    writer = latest_by_pair(messages).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def routed(subscriptions: Callable[[], DataFrame], table: CommittedTable, name: str) -> Callable[[DataFrame, int], None]:
    """A handler that hands the messages of all open conversations to their subscribers, in a table (``ROUTED``).

    ``subscriptions`` gives a table (subscriber, a, b) of who follows whom, in either order; it is read for each
    batch, so a change counts from the next one on. One query serves any number of pairs, by an equi-join.
    """

    def handle(batch: DataFrame, number: int) -> None:
        _add_once(table, batch, (name, number), to_subscribers)

    def to_subscribers(batch: DataFrame) -> DataFrame:
        pairs = subscriptions().select(F.col("subscriber").alias("__who"), *[c.alias(f"__{k}") for k, c in zip("ab", pair_key(F.col("a"), F.col("b")), strict=True)]).distinct()
        low, high = pair_key(F.col("sender_id"), F.col("receiver_id"))
        joined = batch.withColumn("__low", low).withColumn("__high", high).join(pairs, (F.col("__low") == F.col("__a")) & (F.col("__high") == F.col("__b")))
        return joined.withColumn("subscriber", F.col("__who"))

    return handle
