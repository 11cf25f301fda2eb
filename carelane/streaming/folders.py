"""Work folders that a stream's files live in."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders to delete, each with the file system that holds it.
_made: list[tuple] = []


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one.

    On a cluster the setting is needed: the driver and the executors share no other folder. It is deleted when the
    program ends, also after ``spark.stop()``, and by ``remove_work_folders`` before.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="carelane-")
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    keep(spark, path)
    return path


def keep(spark: SparkSession, path: str) -> None:
    """Remember a folder, with its own file system: that one outlives the Spark context."""
    if (context := getattr(spark.sparkContext, "_jsc", None)) is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((at.getFileSystem(context.hadoopConfiguration()), at))


def remove_work_folders() -> None:
    """Delete all work folders of this program."""
    while _made:
        fs, at = _made.pop()
        fs.delete(at, True)


atexit.register(remove_work_folders)
