"""A Bloom filter of ids: which rows of a scan may belong to a set of ids, before an exact join.

Its size follows the number of ids up to ``MOST_BITS`` (32 MB). ``BITS_AN_ID`` bits and four places an id let
about one other id in 85 pass; beyond 26 million ids the share grows, which costs time and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import mix

BITS_AN_ID, PLACES, LEAST_BITS, MOST_BITS = 10, 4, 1 << 12, 1 << 28


class IdFilter:
    """64-bit words of the filter."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        """For each id whether it may be in the set; never false for one that is."""
        at = places(ids, 64 * len(self.words))
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id, a row an id."""
    a = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    b = mix(a) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PLACES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> IdFilter:
    """The filter of a column of distinct ids (long, none null)."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_AN_ID * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(), bits))
            if len(at):
                words, first = np.unique(at >> 6, return_index=True)
                values = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], names=["word", "bits"])

    # At most bits / 64 rows.
    got = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return IdFilter(words)
