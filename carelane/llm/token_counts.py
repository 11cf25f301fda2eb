"""Token counts: pieces of each distinct pre-token counted once, joined to per-document frequencies.

Documents are read in blocks of bounded size. A block's row holds its distinct pre-tokens once and each
document's frequencies as small integers into that list, so what is shuffled are vocabularies of blocks,
not tokens. The distinct pre-tokens of the whole corpus are counted by the tokenizer once each, joined
back to the blocks, and summed by frequency. No text's ids are ever made.

A frequent pre-token has one row a block, however many documents hold it.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their counts;
an empty table gives no rows; other columns are not read; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, materialise, shards_of, shuffle_partitions, table
from .pretokens import WordEndPreTokens, piece_count

#: Bounds of a block: bytes of text and documents.
BLOCK_BYTES, BLOCK_DOCS = 24_000_000, 16_384
LIMIT = 2048


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, a plane of bytes after the other, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _gaps(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sorted numbers of consecutive groups as differences, each group's first one as it is."""
    out = np.diff(values, prepend=0)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
    out[first] = values[first]
    return out


def _values(sizes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The inverse of ``_gaps``."""
    total = np.cumsum(gaps)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else first
    return total - np.repeat(before, sizes)


def blocks(docs: DataFrame, path: str) -> DataFrame:
    """Rows block, ids, n_bytes, sizes (distinct pre-tokens by document), at and times (packed), pre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_tokens, task, made = WordEndPreTokens(path), TaskContext.get().partitionId(), 0
        known: dict[str, int] = {}
        ids, sizes, at, times, lengths, held = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            names = sorted(known)
            rank = np.empty(len(names), np.int64)
            rank[[known[p] for p in names]] = np.arange(len(names))
            size = np.array(sizes, np.int64)
            where = rank[np.concatenate(at)] if at else np.zeros(0, np.int64)
            order = np.lexsort((where, np.repeat(np.arange(len(size)), size)))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + made]), "ids": pa.array([ids], pa.list_(pa.int64())), "n_bytes": pa.array([lengths], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int32())), "at": pa.array([_pack(_gaps(size, where[order]))], pa.binary()),
                "times": pa.array([_pack(np.array(times, np.int64)[order])], pa.binary()), "pre": pa.array([names], pa.list_(pa.string())),
            })

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                n = len(encode(text))
                if ids and (held + n > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield block()
                    made += 1
                    known.clear()
                    ids, sizes, at, times, lengths, held = [], [], [], [], [], 0
                found = Counter(pre_tokens(text))
                at.append(np.fromiter((known.setdefault(p, len(known)) for p in found), np.int32, len(found)))
                times.extend(found.values())
                ids.append(doc_id)
                sizes.append(len(found))
                lengths.append(n)
                held += n
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, ids array<long>, n_bytes array<long>, sizes array<int>, at binary, times binary, pre array<string>")


def piece_replies(listed: DataFrame, path: str, hold: int = 1_000_000) -> DataFrame:
    """From rows (owner, k, pre): pieces by owner, packed, each distinct pre-token counted once.

    Equal pre-tokens lie together after one shuffle; a block has each at most once, so no pre-token has
    more rows than there are blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piece_count(path)
        last, last_pieces = None, 0
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            owner, k, pieces = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((k, owner))
            owner, k, pieces = owner[order], k[order], pieces[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pa.RecordBatch.from_pydict({"owner": pa.array(owner[cuts[:-1]]), "k": pa.array([_pack(np.diff(k[a:b], prepend=0)) for a, b in parts], pa.binary()), "pieces": pa.array([_pack(pieces[a:b]) for a, b in parts], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).dictionary_encode()
            names = coded.dictionary.to_pylist()
            fresh = names[1:] if names[0] == last else names
            counts = ([last_pieces] if names[0] == last else []) + count(fresh)
            last, last_pieces = names[-1], counts[-1]
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), np.array(counts, np.int64)[coded.indices.to_numpy()]))
            rows += batch.num_rows
            if rows >= hold:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    # Adaptive execution joins small partitions and never adds any: a large input says how many it needs.
    needed = shards_of(listed)
    parts = [needed] if needed > shuffle_partitions(listed.sparkSession) else []
    together = listed.select("owner", "k", "pre").repartition(*parts, "pre").sortWithinPartitions("pre")
    return together.mapInArrow(run, "owner long, k binary, pieces binary")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    held = materialise(blocks(docs, path))
    listed = held.select(F.col("block").alias("owner"), F.posexplode("pre").alias("k", "pre"))
    replies = piece_replies(listed, path)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        k = [_unpack(x).cumsum() for x in right["k"].to_pylist()]
        pieces = [_unpack(x) for x in right["pieces"].to_pylist()]
        by_block = np.zeros(1 + max((int(x[-1]) for x in k), default=0), np.int64)
        for at, n in zip(k, pieces, strict=True):
            by_block[at] = n
        for row in left.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            share = by_block[_values(sizes, _unpack(row["at"]))] * _unpack(row["times"])
            sums = np.diff(np.concatenate([[0], np.cumsum(share)])[np.concatenate([[0], np.cumsum(sizes)])])
            out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(sums.astype(np.int64)), "over_limit": pa.array(sums > limit)}))
        return pa.concat_tables(out) if out else _EMPTY

    packed = held.drop("pre")
    return packed.groupBy("block").cogroup(replies.groupBy("owner")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "over_limit": pa.array([], pa.bool_())})


def op3_token_counts(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Every document: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
