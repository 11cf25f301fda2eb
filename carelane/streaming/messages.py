"""New messages as a stream: one file source reads what is there (the snapshot) and what comes (the delta)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carelane.operators.predicates import between_two
from carelane.sources.schema import schema_of


def live_messages(spark: SparkSession, folder: str, a: int, b: int, lateness: str | None = None, schema=None) -> DataFrame:
    """Messages between two people from a growing Parquet folder, each id once, however late it comes.

    The state is the ids of this one conversation. With ``lateness`` it is bounded: older repeats are
    forgotten, and messages that come later than that are lost.
    """
    rows = spark.readStream.schema(schema or schema_of("messages")).parquet(folder)
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    mine = rows.where(between_two(F.col("sender_id"), F.col("receiver_id"), a, b))
    if lateness is None:
        return mine.dropDuplicates(["id"])
    return mine.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["id"])


def all_messages(spark: SparkSession, folder: str, lateness: str | None = "30 days", schema=None) -> DataFrame:
    """All messages from a growing Parquet folder, each id once.

    The state is the ids of the last ``lateness``: repeats that come later than that are taken for new ones, and
    messages that are older than that are lost; None keeps all ids for good.
    """
    rows = spark.readStream.schema(schema or schema_of("messages")).parquet(folder)
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    if lateness is None:
        return rows.dropDuplicates(["id"])
    return rows.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["id"])


def with_names(stream: DataFrame, users: DataFrame) -> DataFrame:
    """Adds sender_name and receiver_name from a static table, null for unknown people."""
    for side in ("sender", "receiver"):
        names = users.select(F.col("id").alias(f"__{side}"), F.col("name").alias(f"{side}_name"))
        stream = stream.join(names, F.col(f"{side}_id") == F.col(f"__{side}"), "left").drop(f"__{side}")
    return stream


def _writer(stream: DataFrame, checkpoint: str, every: str | None):
    """An appending writer: with ``every`` (such as '2 seconds') it goes on until stopped, else it takes what is there now."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def follow(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a Parquet folder; stop or restart it by its checkpoint."""
    return _writer(stream, checkpoint, every).format("parquet").start(path)


def deliver(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hand each batch of new messages, with its number, to a function, such as one that updates a screen."""
    return _writer(stream, checkpoint, every).foreachBatch(handle).start()


class Subscription:
    """The live messages of one conversation at a time; another pair or ``stop`` ends the query of the one before.

    Each pair has its own output and checkpoint under ``folder``, so coming back to one goes on where it was.
    """

    def __init__(self, spark: SparkSession, source: str, folder: str, every: str | None = "1 second", schema=None):
        self.spark, self.source, self.folder, self.every, self.schema = spark, source, folder, every, schema
        self.query: StreamingQuery | None = None

    def path(self, a: int, b: int) -> str:
        """Where a pair's messages are kept, whoever is named first."""
        return f"{self.folder}/out/{min(a, b)}-{max(a, b)}"

    def to(self, a: int, b: int) -> StreamingQuery:
        """Follow this pair instead of the one before."""
        self.stop()
        stream = live_messages(self.spark, self.source, a, b, schema=self.schema)
        self.query = follow(stream, self.path(a, b), f"{self.folder}/state/{min(a, b)}-{max(a, b)}", self.every)
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
