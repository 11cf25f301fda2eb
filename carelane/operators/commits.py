"""A Parquet table with atomic appends: what is in it is said by its last numbered version.

Rows are written to a folder of their own first. A version, a small file that lists all folders, then makes them
part of the table; its file is put in place by an exclusive create, so of two writers that made the same number
one fails, looks at what the other has added, and tries again. A version also carries the greatest id that was
given out, and for each stream the last batch that it holds.

The exclusive create is a hard link on a file system of this machine (or one that is mounted) and a rename
elsewhere, which must refuse to replace a file, as HDFS does.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carelane.operators.relations import insert_absent

#: Where a table's versions are.
VERSIONS = "_versions"
#: Bits of a row's place in its partition (as ``monotonically_increasing_id`` lays them out).
_PLACE_BITS = 33
#: Rows of a file where a layout names no number of files: a task sorts the rows of one.
FILE_ROWS = 1_000_000


class ConflictError(RuntimeError):
    """Other writers were faster too many times."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    folders: list[str] = field(default_factory=list)
    #: The greatest id that was given out.
    high: int = 0
    #: By stream, the last batch that is in the table.
    batches: dict[str, int] = field(default_factory=dict)
    #: The folder with the rows that this version adds to the one before; none after a compaction.
    added: str | None = None


class CommittedTable:
    """A table under ``path`` with a schema in DDL; rows without an id get one where there is an id column.

    ``layout`` (arguments of ``lookup_layout``: order, bloom, files, ...) says how rows lie in the files of each append
    and, if it is not told otherwise, after compaction.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str, id_column: str | None = "id", tries: int = 50, layout: dict | None = None):
        self.spark, self.path, self.schema, self.tries, self.layout = spark, path.rstrip("/"), StructType.fromDDL(ddl), tries, layout or {}
        self.id_column = id_column if id_column in self.schema.names else None

    # Files

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(at)

    def _delete(self, name: str) -> None:
        fs, at = self._at(name)
        fs.delete(at, True)

    def _names(self, folder: str) -> dict[str, float]:
        """Names in a folder with their times in seconds."""
        fs, at = self._at(folder)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}

    def _put_once(self, name: str, text: str) -> bool:
        """Create a file that is whole when it appears; False if there is one already."""
        fs, at = self._at(name)
        _, draft = self._at(f"{os.path.dirname(name)}/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(text.encode())
        out.close()
        try:
            if at.toUri().getScheme() != "file":
                return bool(fs.rename(draft, at))
            try:
                os.link(draft.toUri().getPath(), at.toUri().getPath())
            except FileExistsError:
                return False
            return True
        finally:
            fs.delete(draft, False)

    # Versions

    def version(self) -> Version:
        """The last version; before the first commit an empty one."""
        numbers = [int(n.removesuffix(".json")) for n in self._names(VERSIONS) if n[0].isdigit()]
        return self.version_at(max(numbers)) if numbers else Version()

    def version_at(self, number: int) -> Version:
        """A version that is still kept."""
        fs, at = self._at(f"{VERSIONS}/{number:020d}.json")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _commit(self, version: Version) -> bool:
        return self._put_once(f"{VERSIONS}/{version.number:020d}.json", json.dumps(version.__dict__))

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, else of the last one."""
        return self.rows_of((version or self.version()).folders)

    def rows_of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    # Writes

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _write(self, rows: DataFrame, folder: str) -> None:
        if self.layout:
            lookup_layout(rows, f"{self.path}/{folder}", **self.layout)
        else:
            rows.write.parquet(f"{self.path}/{folder}")

    def _staged(self, rows: DataFrame, high: int) -> tuple[str, int, int]:
        """Folder, number of rows and greatest id of rows that are written but in no version yet.

        Ids follow ``high`` without gaps: rows are written once to be counted by partition (a row a task reaches
        the driver), and once more with the number of rows before their partition added to their place in it.
        Rows that come with an id keep it, and leave out a number where others come without.
        """
        folder, draft = f"data-{uuid.uuid4().hex}", f"_draft-{uuid.uuid4().hex}"
        shaped = self._shaped(rows)
        if self.id_column is None:
            self._write(shaped, folder)
            return folder, self.spark.read.parquet(f"{self.path}/{folder}").count(), high
        given = F.col(self.id_column)
        shaped.withColumn("__at", F.monotonically_increasing_id()).write.parquet(f"{self.path}/{draft}")
        written = self.spark.read.parquet(f"{self.path}/{draft}").withColumn("__part", F.shiftright("__at", _PLACE_BITS))
        counts = written.groupBy("__part").agg(F.count("*").alias("n"), F.count(given).alias("own"), F.max(given).alias("most")).orderBy("__part").collect()
        # New ids begin after all that rows bring along, too.
        high = max([high, *(r["most"] for r in counts if r["most"] is not None)])
        offsets, total = [], 0
        for r in counts:
            offsets.append((r["__part"], total))
            total += r["n"]
        if total:
            before = self.spark.createDataFrame(offsets, "__part long, __before long")
            place = F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
            written = written.join(before, "__part").withColumn(self.id_column, F.coalesce(given, F.lit(high + 1) + F.col("__before") + place).cast(self.schema[self.id_column].dataType))
        self._write(written.select(*self.schema.names), folder)
        self._delete(draft)
        return folder, total, high + (total if sum(r["own"] for r in counts) < total else 0)

    def _add(self, make: Callable[[Version], DataFrame], batch: tuple[str, int] | None = None, stored: list[str] | None = None) -> int:
        """Commit the rows that ``make`` derives from the last version; again from the next one when another writer was faster."""
        for turn in range(self.tries):
            now = self.version()
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                return 0
            folder, n, high = self._staged(make(now), now.high)
            batches = now.batches | ({batch[0]: batch[1]} if batch else {})
            if not n and not batch:
                self._delete(folder)
                return 0
            if self._commit(Version(now.number + 1, [*now.folders, *([folder] if n else [])], high if n else now.high, batches, folder if n else None)):
                if stored is not None:
                    stored.append(folder)
                return n
            self._delete(folder)
            time.sleep(random.random() * min(1, 0.01 * 2**turn))
        raise ConflictError(f"{self.path}: {self.tries} tries")

    def has(self, batch: tuple[str, int]) -> bool:
        """Whether a batch (stream, number), or a later one of that stream, is in the table."""
        return self.version().batches.get(batch[0], -1) >= batch[1]

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows; how many. With ``batch`` (stream, number) only if no such or later batch of that stream is in the table."""
        return self._add(lambda _: rows, batch)

    def append_row(self, row: DataFrame) -> Row:
        """Add a table of one row and return the row as it was stored."""
        stored: list[str] = []
        self._add(lambda _: row, stored=stored)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{stored[-1]}").first()

    def insert_absent(self, new: DataFrame, key: str) -> int:
        """Add those of the new rows whose key no row has, of each key the first by all columns, none without a key; how many.

        Holds under concurrent writers: a version is only made from the one before it.
        """
        return self._add(lambda now: insert_absent(self.read(now), new, key))

    def compact(self, reduce: Callable[[DataFrame], DataFrame] | None = None, **layout) -> None:
        """Rewrite all rows as one folder, laid out as the table's appends or as told (else in ranges of the id);
        ``reduce`` may leave out rows that others replace. What others append meanwhile stays."""
        before = self.version()
        if not before.folders:
            return
        rows, folder = self.read(before), f"data-{uuid.uuid4().hex}"
        how = {"order": [self.id_column] if self.id_column else []} | self.layout | layout
        lookup_layout(reduce(rows) if reduce else rows, f"{self.path}/{folder}", **how)
        for _ in range(self.tries):
            now = self.version()
            if now.folders[: len(before.folders)] != before.folders:
                break
            if self._commit(Version(now.number + 1, [folder, *now.folders[len(before.folders) :]], now.high, now.batches)):
                return
        self._delete(folder)
        raise ConflictError(f"{self.path}: compacted by another writer, or {self.tries} tries")

    def vacuum(self, keep_versions: int = 10, hours: float = 24.0) -> None:
        """Delete all but the last versions, and folders that none of them lists and that are older than ``hours``.

        Readers of an older version, and streams (``streaming.sinks.inserts``), must not lag behind further than that.
        """
        last = self.version().number
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names(VERSIONS) if n[0].isdigit())
        kept = [n for n in numbers if n > last - keep_versions]
        listed = {f for n in kept for f in self.version_at(n).folders}
        for n in numbers:
            if n not in kept:
                self._delete(f"{VERSIONS}/{n:020d}.json")
        for name, at in self._names("").items():
            if name.startswith(("data-", "_draft-")) and name not in listed and at < time.time() - 3600 * hours:
                self._delete(name)


def lookup_layout(rows: DataFrame, path: str, order: list[str], bloom: tuple[str, ...] = (), files: int | None = None, distinct: int = 1_000_000, group_bytes: int | None = None) -> None:
    """Write rows for point lookups: in ranges of ``order`` over ``files`` files (else one for each ``FILE_ROWS`` rows, which
    are counted first), sorted inside, so that a value of the first of these columns lies in few row groups, and with Bloom
    filters (for ``distinct`` values a row group) of other ones."""
    files = files or max(1, -(-rows.count() // FILE_ROWS))
    laid = rows.repartitionByRange(files, *order).sortWithinPartitions(*order) if order else rows.repartition(files)
    writer = laid.write
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    if group_bytes:
        # A row group's size is looked at every so many rows.
        writer = writer.option("parquet.block.size", str(group_bytes)).option("parquet.page.size.row.check.min", "10").option("parquet.block.size.row.check.min", "10")
    writer.parquet(path)
