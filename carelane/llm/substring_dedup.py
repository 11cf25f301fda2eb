"""Substring dedup by hashing normalised units: lines, paragraphs, whole texts, and passages inside them.

Units are normalised (words, A-Z folded, any white space between), their digests grouped globally, and
the occurrence in the document that ranks first (smallest doc_id) is kept; all later ones are cut out of
their texts, with the offsets in the original text retained. Every line and paragraph with a word is a unit
(``line_words`` can ask for more words), and so is every text as a whole. Lines and paragraphs alone miss
passages that stand in the middle of a line, so another kind of unit covers them: windows of
``PASSAGE_WORDS`` words, of which each run of ``STRIDE`` windows selects the one with the smallest digest.
Equal passages select equal windows wherever they stand; one of ``PASSAGE_WORDS + STRIDE - 1`` words or more
always shares a selected window. A line, a paragraph and a text of the same words are the same unit.

A unit's digest has 96 bits, 64 and a check of 32; both have to be equal. Only (digest, document) rows are shuffled; a digest's documents are never gathered: its first document
is a partial aggregate, joined back on the digest.

Defined results: null and empty texts have no units and come back as they are; rows without doc_id rank
after all others; rows that share a doc_id, or have none, are documents of their own, ranked by the hash of
their text and then by their place, so that of repeated rows one stays; within a document the first
occurrence is kept; exact copies lose their whole text; empty tables give no rows; other columns pass through
``dedup`` untouched, also ones with this operator's output names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ids_differ, materialise, release, shards_of, table
from .textbatch import Words, mix, slices

#: Words in a passage window, windows of which one is selected, least words of a line or paragraph unit (1: all).
PASSAGE_WORDS, STRIDE, LINE_WORDS = 40, 11, 1
KINDS = ("line", "paragraph", "text", "passage")
#: Line feeds in a row that part units of a kind; None: a text is one unit.
_GAP = {"line": 1, "paragraph": 2, "text": None}
_NONE = np.uint64(2**64 - 1)
_SEED, _CHECK = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_NO_UNITS = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)


def passage_units(words: Words, size: int, stride: int) -> tuple[np.ndarray, ...]:
    """(digest, check, first word, last word + 1) of the selected windows, in order of place."""
    grams = words.grams(size)
    if not len(grams):
        return _NO_UNITS
    place = np.arange(len(grams))
    end = words.at[np.searchsorted(words.at, place, side="right")]
    padded = np.full(len(grams) + 2 * (stride - 1), _NONE)
    padded[stride - 1 : stride - 1 + len(grams)] = np.where(place + size <= end, grams, _NONE)
    pick = np.lib.stride_tricks.sliding_window_view(padded, stride).argmin(axis=1) + np.arange(len(grams) + stride - 1)
    pick = np.unique(pick)
    pick = pick[padded[pick] != _NONE]
    first = pick - (stride - 1)
    return padded[pick], window_checks(words, first, size), first, first + size


def window_checks(words: Words, first: np.ndarray, size: int) -> np.ndarray:
    """The checks of the windows from these words on."""
    x = np.zeros(len(first), np.uint64)
    for j in range(size):
        x = x * np.uint64(0xC6A4A7935BD1E995) + mix(words.hashes[first + j] ^ _CHECK)
    return _low(mix(x))


def _low(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def line_units(words: Words, least: int, gap: int | None) -> tuple[np.ndarray, ...]:
    """Units between ``gap`` or more line feeds in a row (1: lines, 2: paragraphs, None: texts), of ``least`` words or more."""
    n = len(words.hashes)
    if not n:
        return _NO_UNITS
    first = words.at[:-1][words.at[:-1] < n]
    if gap is not None:
        feeds = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
        between = feeds[words.starts[1:]] - feeds[words.ends[:-1]]
        first = np.concatenate([np.flatnonzero(between >= gap) + 1, first])
    first = np.unique(first)
    last = np.append(first[1:], n)
    # A hash that depends on the order of the unit's words: each weighted by its place in the unit.
    place = np.arange(n) - np.repeat(first, last - first)
    weighted = mix(words.hashes + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    total = np.add.reduceat(weighted, first)
    check = np.add.reduceat(mix(weighted ^ _CHECK), first)
    long = last - first >= least
    return mix(total ^ _SEED)[long], _low(mix(check))[long], first[long], last[long]


def units(words: Words, kinds=KINDS, passage_words=PASSAGE_WORDS, stride=STRIDE, line_words=LINE_WORDS):
    """All units of a slice: digests, checks, first words, last words + 1."""
    made = [line_units(words, 1 if kind == "text" else line_words, _GAP[kind]) for kind in kinds if kind != "passage"]
    if len(made) > 1:
        digest, check, first, last = (np.concatenate(x) for x in zip(*made, strict=True))
        # A paragraph of one line, or a text of one paragraph, is one unit.
        once = np.unique(first * (len(words.hashes) + 1) + last, return_index=True)[1]
        made = [(digest[once], check[once], first[once], last[once])]
    if "passage" in kinds:
        made.append(passage_units(words, passage_words, stride))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


def ranked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__rank``, a number of its own for each row, in the order of doc_id.

    Ids that are there and all different are the ranks. Otherwise the rows are sorted and written once, and
    numbered by their place; the place in the scan is part of the sort's key, so repeated rows spread, too.
    """
    if ids_differ(docs):
        return docs.withColumn("__rank", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("__place")]
    placed = docs.withColumn("__place", F.monotonically_increasing_id())
    sorted_ = placed.repartitionByRange(shards_of(docs), *order).sortWithinPartitions(*order)
    return materialise(sorted_.drop("__place").withColumn("__rank", F.monotonically_increasing_id()))


def unit_table(rows: DataFrame, **how) -> DataFrame:
    """Distinct (digest, check, rank) of every text of ranked rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                digest, check, first, _ = units(words, **how)
                if not len(digest):
                    continue
                doc = np.searchsorted(words.at, first, side="right") - 1
                order = np.lexsort((check, digest, doc))
                digest, check, doc = digest[order], check[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (digest[1:] != digest[:-1]) | (check[1:] != check[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(digest[new].view(np.int64)), pa.array(check[new].view(np.int32)), pa.array(ranks[lo + doc[new]])], names=["digest", "check", "rank"])

    return rows.select("__rank", "text").mapInArrow(run, "digest long, check int, rank long")


def later_units(rows: DataFrame, **how) -> DataFrame:
    """rank, digests (array), as a table: the units of each ranked row that an earlier one has; at most its own units."""
    found = materialise(unit_table(rows, **how))
    # A table of its own: a join of two plain shuffles can split the documents of a frequent digest.
    firsts = materialise(found.groupBy("digest", "check").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").select("digest", "check", "first"))
    later = materialise(found.join(firsts, ["digest", "check"]).where(F.col("rank") > F.col("first")).groupBy("rank").agg(F.collect_list("digest").alias("digests")))
    release(found)
    release(firsts)
    return later


def cut(words: Words, lo: int, hi: int, digest: np.ndarray, first: np.ndarray, last: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words (from lo to hi) to remove: units that are known from before, and later ones within the text."""
    gone, own_later, own_first = (np.zeros(hi - lo + 1, np.int64) for _ in range(3))
    before = np.isin(digest, known)
    order = np.lexsort((first, digest))
    again = np.zeros(len(digest), bool)
    again[order[1:]] = digest[order[1:]] == digest[order[:-1]]
    starts_group = np.zeros(len(digest), bool)
    starts_group[order[:-1]] = digest[order[1:]] == digest[order[:-1]]
    starts_group &= ~again
    for marks, which in ((gone, before), (own_later, again & ~before), (own_first, starts_group & ~before)):
        np.add.at(marks, first[which] - lo, 1)
        np.add.at(marks, last[which] - lo, -1)
    covered = (np.cumsum(gone)[:-1] > 0) | ((np.cumsum(own_later)[:-1] > 0) & ~(np.cumsum(own_first)[:-1] > 0))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [(lo + int(a), lo + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def dedup(docs: DataFrame, **how) -> DataFrame:
    """All columns of ``docs``, with ``text`` cut, and a struct ``dedup``: n_words, n_removed, spans.

    Spans are offsets (in characters) of what was removed from the original text, with their ends.
    """
    names = docs.columns
    rows = ranked(docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("__rest"), "text"))
    known = later_units(rows, **how).select(F.col("rank").alias("__rank"), F.col("digests").alias("__known"))
    inside = rows.select("__rank", "__rest", "text")
    joined = inside.join(known, "__rank", "left").select("__rest", F.col("text").alias("__text"), "__known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, reports = [], []
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                digest, _, first, last = units(words, **how)
                digest = digest.view(np.int64)
                order = np.argsort(first, kind="stable")
                digest, first, last = digest[order], first[order], last[order]
                at = np.searchsorted(first, words.at)
                for k in range(hi - lo):
                    a, b = int(words.at[k]), int(words.at[k + 1])
                    mine = batch.column(2)[lo + k].values
                    have = np.zeros(0, np.int64) if mine is None else mine.to_numpy(zero_copy_only=False)
                    x, y = at[k], at[k + 1]
                    runs = cut(words, a, b, digest[x:y], first[x:y], last[x:y], have) if y > x else []
                    text = batch.column(1)[lo + k].as_py()
                    if runs:
                        base, size = int(offsets[k]), int(offsets[k + 1])
                        raw, spans, kept, at_byte = data[base:size].tobytes(), [], [], 0
                        for u, v in runs:
                            s, e = int(words.starts[u]) - base, (int(words.starts[v]) if v < b else int(words.ends[v - 1])) - base
                            spans.append((s, e))
                            kept.append(raw[at_byte:s])
                            at_byte = e
                        kept.append(raw[at_byte:])
                        letters = np.concatenate([[0], np.cumsum((data[base:size] & 0xC0) != 0x80)])
                        text = b"".join(kept).decode("utf-8")
                        reports.append({"n_words": b - a, "n_removed": sum(v - u for u, v in runs), "spans": [{"start": int(letters[s]), "end": int(letters[e])} for s, e in spans]})
                    else:
                        reports.append({"n_words": b - a, "n_removed": 0, "spans": []})
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(reports, _REPORT)], names=["__rest", "__text", "__dedup"])

    # As types, not as text: the columns of others may have any name.
    made = joined.mapInArrow(run, rows.select("__rest").schema.add("__text", "string").add("__dedup", StructType.fromDDL(_REPORT_DDL)))
    return made.select(*[F.col("__text").alias("text") if c == "text" else F.col("__rest")[c].alias(c) for c in names], F.col("__dedup").alias("dedup"))


_REPORT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_REPORT_DDL = "n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>"


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_removed, spans, and the text that is left."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("dedup.n_words").alias("n_words"), F.col("dedup.n_removed").alias("n_removed"), F.col("dedup.spans").alias("spans"), "text")
