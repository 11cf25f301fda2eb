"""Quality rules: plain text statistics, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over every document (raw corpus), one over
every document that labels mark as trusted (quality 1). A text's score is the mean, over its n-grams,
of log p_trusted - log p_raw (so it does not grow with length); texts at or above a fixed threshold are
kept, unless a plain rule already failed them. All counts cover the whole corpus; what reaches the
driver are ``2 ** BITS`` counts, whatever the input's size.

Defined results: a null text is empty; texts without an n-gram score 0; null ids keep their row and are
never trusted; repeated rows get equal results; without any trusted text all scores are 0; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, materialise, table
from .idfilter import id_filter

#: Hash buckets (as bits), bytes in an n-gram, count added to both sides, least score kept (languages that
#: trusted texts hold in another share than the corpus shift a whole text by up to 0.2; junk lies below -0.5).
BITS, GRAM, SMOOTH, THRESHOLD = 16, 4, 4.0, -0.25
#: Plain rules: fewest words, and most words in repeated windows, in hundredths of all words.
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SEPARATORS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def gram_buckets(data: bytes, bits: int = BITS, n: int = GRAM) -> np.ndarray:
    """Bucket of each byte n-gram, in order."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < n:
        return np.zeros(0, np.uint32)
    m = len(b) - n + 1
    x = b[:m].astype(np.uint32)
    for k in range(1, n):
        x *= np.uint32(257)
        x += b[k : k + m]
    x *= np.uint32(2654435761)
    return x >> np.uint32(32 - bits)


def count_repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    if len(words) <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    m = len(words) - window + 1
    x = h[:m].copy()
    for k in range(1, window):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += h[k : k + m]
    order = np.sort(x)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.flatnonzero(np.isin(x, again))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = encode(text).split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_SEPARATORS):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - sum(map(text.count, _SEPARATORS)), sum(map(text.count, _SYMBOLS)), dup, count_repeat_words(words)


class _Counter:
    """Counts of hashed n-grams, summed in batches."""

    def __init__(self, bits: int):
        self.bits, self.total, self.parts, self.held = bits, np.zeros(1 << bits, np.int64), [], 0

    def add(self, text: str | None) -> None:
        x = gram_buckets(encode(text), self.bits)
        self.parts.append(x)
        self.held += len(x)
        if self.held > 4_000_000:
            self._sum()

    def _sum(self) -> None:
        if self.parts:
            self.total += np.bincount(np.concatenate(self.parts), minlength=1 << self.bits)
        self.parts, self.held = [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and counts of those that are not 0."""
        self._sum()
        at = np.flatnonzero(self.total)
        return at.astype(np.int32), self.total[at]


def _on_driver(counts: DataFrame, bits: int) -> np.ndarray:
    got = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gram_counts(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Counts of hashed n-grams over all rows of a one-column table; each task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(bits)
        for batch in batches:
            for t in batch.column(0):
                counter.add(t.as_py())
        at, n = counter.found()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(n)})

    return _on_driver(texts.mapInArrow(run, "bucket int, n long"), bits)


def counts_and_trusted(docs: DataFrame, good: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all texts, and of those whose doc_id is in ``good`` (distinct doc_id, none null).

    One scan counts all texts and hands on those that a Bloom filter lets pass; an exact semi-join follows,
    so only these texts are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, passes = _Counter(bits), shared.value
        kinds = [pa.int32(), pa.int64()]
        for batch in batches:
            for t in batch.column(1):
                counter.add(t.as_py())
            ids = batch.column(0)
            given = ids.is_valid().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(given & passes.may_have(ids.fill_null(0).to_numpy(zero_copy_only=False))))
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(some.num_rows, k) for k in kinds), *some.columns], names=["bucket", "n", "doc_id", "text"])
        at, n = counter.found()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string())], names=["bucket", "n", "doc_id", "text"])

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = materialise(light.mapInArrow(run, "bucket int, n long, doc_id long, text string"))
    trusted = both.where("bucket is null").select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    return gram_counts(trusted, bits), _on_driver(both.where("bucket is not null").select("bucket", "n"), bits)


def log_ratio(trusted: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw by bucket; zeros when nothing is trusted.

    Counts are compared with those that the raw distribution leads one to expect in a trusted corpus of
    this size, both raised by ``SMOOTH``: a bucket too rare to be expected there says nothing.
    """
    if not trusted.sum() or not raw.sum():
        return np.zeros(len(raw))
    expected = raw * (trusted.sum() / raw.sum())
    return np.log((trusted + SMOOTH) / (expected + SMOOTH))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> np.ndarray:
    """Log ratios from all documents and all trusted ones.

    Only the trusted side needs a join; the ids are the hashed side, so texts are neither sorted nor
    broadcast.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return log_ratio(*counts_and_trusted(docs, good, bits))


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            rows, scores = [], []
            for t in batch.column(1):
                text = t.as_py()
                rows.append(statistics(text))
                x = gram_buckets(encode(text), bits)
                scores.append(float(weights[x].mean()) if len(x) else 0.0)
            stats = np.array(rows, np.int64).reshape(-1, len(_STATS))
            failed = (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > MOST_REPEAT_PERCENT * stats[:, 0])
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(stats[:, i]) for i in range(len(_STATS))), pa.array(failed), pa.array(~failed & (s >= threshold)), pa.array(s, pa.float64())], names=["doc_id", *_STATS, "base_failed", "kept", "score"])

    fields = ", ".join(f"{x} long" for x in _STATS)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {fields}, base_failed boolean, kept boolean, score double")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, statistics, base_failed, kept, score."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
