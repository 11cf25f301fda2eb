"""Connected components of a graph given as edges, by alternating large and small stars.

First each task replaces the edges that it reads by stars of what they connect, which spares most rounds where
a graph's edges lie in few tasks. Each round is a few shuffles over edges, a node's neighbours are only ever aggregated to their minimum
(so a hub is no hot group), and rounds are written to the shared folder, each in place of the one before. Rounds needed grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialise, release

#: Edges that a task contracts at once.
RUN_EDGES = 2_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For some edges: nodes that are not the least of what the edges connect them to, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        # The least label of a label counts for it, too, so that long paths shorten by halves.
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (tag, a, b) with the same components: of each task's edges, in runs of ``RUN_EDGES``, the stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list) -> Iterator[pa.RecordBatch]:
            tag, a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            for t in np.unique(tag):
                far, near = _stars(a[tag == t], b[tag == t])
                if len(far):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), t, np.int32)), pa.array(far), pa.array(near)], names=["tag", "a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= RUN_EDGES:
                yield from stars(held)
                held, rows = [], 0
        if rows:
            yield from stars(held)

    plain = edges.where("a <> b").select(F.col("tag").cast("int").alias("tag"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return plain.mapInArrow(run, "tag int, a long, b long")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and what tells them from others: their number and the sum of their hashes, seen while writing."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("tag", "a", "b").cast("decimal(38,0)")).alias("s")))
    return table, (seen.get["n"], seen.get["s"])


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, tuple]:
    """One star step on edges (tag, a, b) with a > b, written to the shared folder.

    The minima are a table of their own, so that the join's two sides are plain shuffles by node and the
    adaptive join can split the edges of a hub.
    """
    if small:
        near = edges  # each node with its smaller neighbours
    else:
        near = edges.unionByName(edges.select("tag", F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(near.groupBy("tag", "a").agg(F.min("b").alias("m")).select("tag", "a", F.least("a", "m").alias("m")))
    joined = near.join(least, ["tag", "a"])
    if small:
        made = joined.select("tag", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("tag", "a", F.col("m").alias("b")))
    else:
        made = joined.where("b > a").select("tag", F.col("b").alias("a"), F.col("m").alias("b"))
    out = _written(made.where("a > b").distinct())
    release(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(tag, node, root): the smallest node of each component, for nodes that aren't roots themselves.

    ``edges`` has tag, a, b (long); direction, repeats and loops do not matter. Tags are separate graphs.
    """
    now, before = _written(contracted(edges).distinct())
    for _ in range(most_rounds):
        if not before[0]:
            return now.select("tag", F.col("a").alias("node"), F.col("b").alias("root"))
        large, _ = _star(now, small=False)
        release(now)
        now, after = _star(large, small=True)
        release(large)
        if after == before:
            return now.select("tag", F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
