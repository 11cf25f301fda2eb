"""Best-fit packing of documents into sequences, under conflicts.

Documents are dealt at random to shards of bounded size; a shard packs its own, longest first. Open bins
are ordered by what is left in them and carry bitmaps of the sources and duplicate clusters inside. A piece
goes to the tightest bin that it fits and that has neither its source nor its cluster: the search starts at
the least sufficient residual and goes on to its successors until a compatible bin is found; else a new bin
opens. Longer documents are split into full sequences and a rest, so that nothing is cut off. Clusters of
documents are the classes of the near-duplicate join (5-word shingles, similarity 0.8 or more).

Hot sources and large groups of copies spread over all shards; conflicts only ever hold inside a bin.

Defined results: lengths of null texts are 0 and such documents still get a place; a null source or
cluster conflicts with nothing, and a null text has no cluster; a text without words is a cluster of its own;
repeated rows are packed each; an empty table gives no rows; equal lengths go in the order of (row key,
source, cluster); columns of other names are not read. ``pack`` keys rows by their place in a scan, so its
input is to be a stored table, as ``pack_documents`` makes it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_differ, materialise, release, table
from .jaccard_join import join

#: Tokens (words) of a sequence, and documents of a shard.
CAPACITY, SHARD_DOCS = 1024, 4096
#: Words of a shingle and hundredths of similarity that make documents one duplicate cluster.
WIDTH, PERCENT = 5, 80


class BestFit:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[int] = []  # bitmaps by bin
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are single bits, or 0 for no conflict."""
        order, sources, clusters = self.order, self.sources, self.clusters
        i = bisect_left(order, (length, -1))
        while i < len(order):
            left, b = order[i]
            if not (sources[b] & source or clusters[b] & cluster):
                del order[i]
                break
            i += 1
        else:
            left, b = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        if left > length or length == 0:
            insort(order, (left - length, b))
        return b, self.capacity - left


def pack_rows(rows: list[tuple], capacity: int) -> list[tuple]:
    """Pack (row, length, source, cluster): (row, piece, start, length, bin, offset) of every piece."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(r[2] for r in rows if r[2] is not None))}
    seen: dict = {}
    for r in rows:
        if r[3] is not None:
            seen[r[3]] = seen.get(r[3], 0) + 1
    # A cluster with one member here cannot conflict and needs no bit.
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    pieces = []
    for row, length, source, cluster in rows:
        bits = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        starts = range(0, max(length, 1), capacity)
        pieces += [(row, k, start, min(capacity, length - start), *bits) for k, start in enumerate(starts)]
    pieces.sort(key=lambda p: -p[3])
    bins, out = BestFit(capacity), []
    for row, k, start, length, source, cluster in pieces:
        b, offset = bins.place(length, source, cluster)
        out.append((row, k, start, length, b, offset))
    return out


def pack(docs: DataFrame, length: Column, source: Column, cluster: Column, keep: list[str], capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``keep`` columns, source, cluster, and piece, start, length, bin, place of every piece of every row."""
    shards = max(1, ceil(docs.count() / shard_docs))
    light = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("length"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    # The row's place in the scan spreads equal rows, too.
    placed = light.withColumn("key", F.xxhash64("row", F.monotonically_increasing_id())).withColumn("shard", F.pmod("key", F.lit(shards)).cast("long"))
    # As types, not as text: the columns of others may have any name.
    shape = light.select("row").schema
    for name, kind in (("source", "string"), ("cluster", "long"), ("piece", "integer"), ("start", "long"), ("length", "long"), ("bin", "long"), ("place", "long")):
        shape = shape.add(name, kind)

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks().sort_by([("length", "descending"), ("key", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        shard = part["shard"][0].as_py()
        cols = [part[c].to_pylist() for c in ("length", "source", "cluster")]
        made = pack_rows(list(zip(range(len(part)), *cols, strict=True)), capacity)
        at, piece, start, size, b, offset = zip(*made, strict=True)
        chosen = part.take(pa.array(at, pa.int64()))
        return pa.table({
            "row": chosen["row"], "source": chosen["source"], "cluster": chosen["cluster"], "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
            "length": pa.array(size, pa.int64()), "bin": pa.array([(shard << 32) + k for k in b], pa.int64()), "place": pa.array(offset, pa.int64()),
        })

    made = placed.groupBy("shard").applyInArrow(run, shape)
    return made.select(*[F.col("row")[c].alias(c) for c in keep], "source", "cluster", "piece", "start", "length", "bin", "place")


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Documents (doc_id, source, text) by their words; near-duplicate texts form a cluster, named by the least doc_id in it.

    Rows are named by their doc_id, or, where that is missing or repeated, by their place in a written copy. Rows
    without doc_id stand in for one with 2^62 and their place.
    """
    copied = not ids_differ(docs)
    rows = docs.select("doc_id", "source", "text", (F.monotonically_increasing_id() if copied else F.col("doc_id").cast("long")).alias("__row"))
    if copied:
        rows = materialise(rows)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.col("__row").bitwiseOR(F.lit(1 << 62)))
    classes = join(rows.select(ids.alias("doc_id"), "text", "__row"), WIDTH, PERCENT, F.col("__row"))
    named = classes.select(F.col("mark").alias("__row"), F.col("component_id").alias("cluster"), F.col("n_words").alias("length"))
    given = rows.select("doc_id", "source", F.col("text").isNotNull().alias("__given"), "__row")
    # Written, so that the rows' places stay as they are.
    light = materialise(given.join(named, "__row").select("doc_id", "source", "length", F.when(F.col("__given"), F.col("cluster")).alias("cluster")))
    if copied:
        release(rows)
    return pack(light, F.col("length"), F.col("source"), F.col("cluster"), ["doc_id"], **how)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document: doc_id, source, cluster, piece, start, length, bin, place."""
    return pack_documents(table(spark, sf_dir, "documents"))
