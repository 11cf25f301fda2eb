"""Shared helpers of the training-data operators: inputs, shared work folders, text rules."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read by Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of this process, by application; only where no shared folder is named.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, as a URI.

    It lies under ``spark.checkpoint.dir``. Only in local mode (tests) may that be unset: a temporary folder
    of this machine is taken; on a cluster that is an error. The folder is removed when the program ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="carelane-")
        _own_dirs[app] = base
    path = f"{base.rstrip('/')}/carelane-{os.getpid()}/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
    return path


#: Folders to delete, with the file system that holds each: it outlives the Spark context.
_made: dict[str, tuple] = {}


def _remove(path: str) -> None:
    if made := _made.pop(path, None):
        fs, at = made
        fs.delete(at, True)


@atexit.register
def remove_all() -> None:
    """Delete all work folders of this program; it does so when it ends, also after ``spark.stop()``."""
    for path in list(_made):
        _remove(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may be lost."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.__dict__["stored_at"] = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` made, once nothing will read it again."""
    if path := stored.__dict__.get("stored_at"):
        _remove(path)


#: Bytes of stored input for one task of a step that sorts whole rows.
SHARD_INPUT_BYTES = 256_000_000


def shards_of(df: DataFrame, input_bytes: int = SHARD_INPUT_BYTES) -> int:
    """Partitions for a sort of ``df``, by the stored size of its inputs: adaptive execution never adds any."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Inputs of unknown size (tables made in memory) state a huge one.
    return max(shuffle_partitions(df.sparkSession), -(-sum(x for x in sizes if x < 1 << 60) // input_bytes))


def ids_differ(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own."""
    most = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("n"))).alias("n")).first()["n"]
    return most is None or most < 2


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_ascii(column):
    """A-Z to a-z only, as the contracts ask for."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id):
    """crc32 of doc_id as text, mod 5, is 0 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def chunks(items: Iterable, n: int) -> Iterator[list]:
    """Lists of up to n items."""
    out = []
    for x in items:
        out.append(x)
        if len(out) >= n:
            yield out
            out = []
    if out:
        yield out
