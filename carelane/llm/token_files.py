"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

Texts are range-partitioned by doc_id, so that shard files in order hold all documents in ascending
doc_id order; each shard is raw little-endian uint16 ids. The index is split into buckets by the key's
hash; a bucket's file holds a displacement per group of keys (a minimal perfect hash: as many slots as
keys) and, by slot, a stored fingerprint, the shard and the position in it. A lookup reads one
displacement and one slot, whatever the size; an unknown key fails the 32-bit fingerprint (but for one in
2^32, which gets another key's position).

Keys are (doc_id, occurrence): repeated doc_ids count up from 0, by their texts' first characters, then by
hash and place; a null doc_id is a key apart from all numbers and sorts first. The rows of one doc_id, or of
none, may fill several shards. Null and empty texts hold the end id alone. Empty tables give no rows and no
shard. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, shards_of, shared_dir, table
from .files import Ranges, Replaced
from .pretokens import byte_level_encoder

END_ID = 2
#: Keys of one index bucket, and keys per displacement group.
BUCKET_KEYS, GROUP_KEYS = 20_000, 4
#: Texts that are encoded together.
GROUP_TEXTS = 256
#: Characters of a text that order the rows of one doc_id, before their hash.
ORDER_CHARS = 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; a bijection for each seed."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def key_hash(doc_ids: np.ndarray, missing: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit hash of keys; where the doc_id is ``missing`` its number does not matter."""
    ids = np.where(missing, np.uint64(0x5851F42D4C957F2D), mix(doc_ids.astype(np.int64).view(np.uint64), 9))
    return mix(ids ^ mix(occurrence.astype(np.uint64), 7), 0)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit key hashes, by displaced groups."""

    def __init__(self, seed: int, shifts: np.ndarray, size: int):
        self.seed, self.shifts, self.size = seed, shifts, size

    @staticmethod
    def place(h: np.ndarray, shift: np.ndarray, seed: int, size: int) -> np.ndarray:
        """Slots of hashes under shifts: an independent hash for each shift."""
        return (mix(h ^ (shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), 3 * seed + 12) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def group(h: np.ndarray, seed: int, groups: int) -> np.ndarray:
        return (mix(h, 3 * seed + 11) % np.uint64(groups)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        size = len(h)
        groups = max(1, ceil(size / GROUP_KEYS))
        if len(np.unique(h)) != size:
            raise ValueError("keys must be distinct")
        for seed in range(64):
            shifts = cls._try(h, seed, groups, size)
            if shifts is not None:
                return cls(seed, shifts, size)
        raise RuntimeError("no perfect hash found")

    @classmethod
    def _try(cls, h: np.ndarray, seed: int, groups: int, size: int) -> np.ndarray | None:
        g = cls.group(h, seed, groups)
        order = np.argsort(g, kind="stable")
        bounds = np.searchsorted(g[order], np.arange(groups + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(size, bool)
        shifts = np.zeros(groups, np.int32)
        tries = np.arange(64)
        for k in np.argsort(-sizes, kind="stable"):
            if sizes[k] < 2:
                break
            own = order[bounds[k] : bounds[k + 1]]
            for start in range(0, 1 << 16, 64):
                slots = cls.place(h[own][:, None], (tries + start)[None, :], seed, size)
                good = ~taken[slots].any(axis=0)
                if sizes[k] == 2:
                    good &= slots[0] != slots[1]
                elif good.any():
                    s = np.sort(slots, axis=0)
                    good &= (s[1:] != s[:-1]).all(axis=0)
                at = np.flatnonzero(good)
                if len(at):
                    shifts[k] = start + at[0]
                    taken[slots[:, at[0]]] = True
                    break
            else:
                return None
        # Groups of one key name their slot directly, as a negative shift.
        singles = np.flatnonzero(sizes == 1)
        shifts[singles] = -1 - np.flatnonzero(~taken)[: len(singles)]
        return shifts

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key hash (any slot for keys that were not built in)."""
        d = self.shifts[self.group(h, self.seed, len(self.shifts))].astype(np.int64)
        return np.where(d < 0, -1 - d, self.place(h, np.maximum(d, 0), self.seed, self.size))


#: By slot: fingerprint, shard, first id in the shard, number of ids.
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u4")])


def index_bytes(h: np.ndarray, shard: np.ndarray, first: np.ndarray, n: np.ndarray) -> bytes:
    """One index bucket: header (seed, groups, slots), shifts, slots."""
    made = PerfectHash.build(h)
    rows = np.zeros(len(h), SLOT)
    at = made.slots(h)
    rows["print"][at] = mix(h, 5).astype(np.uint32)
    rows["shard"][at], rows["first"][at], rows["n"][at] = shard, first, n
    return np.array([made.seed, len(made.shifts), len(h)], "<i8").tobytes() + made.shifts.astype("<i4").tobytes() + rows.tobytes()


class Index:
    """A loaded bucket: positions of keys, in constant time each."""

    def __init__(self, data: bytes):
        seed, groups, size = np.frombuffer(data, "<i8", 3)
        self.hash = PerfectHash(int(seed), np.frombuffer(data, "<i4", groups, 24), int(size))
        self.rows = np.frombuffer(data, SLOT, size, 24 + 4 * int(groups))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot records, and whether each key is known (its fingerprint agrees)."""
        got = self.rows[self.hash.slots(h)]
        return got, got["print"] == mix(h, 5).astype(np.uint32)


def shard_name(k: int) -> str:
    return f"ids-{k:06d}.bin"


def index_name(k: int) -> str:
    return f"index-{k:06d}.mph"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write the shards; returns (and materialises) the catalog doc_id, occurrence, shard, first, n.

    There are as many shards as ``partitions``, else by the stored size of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level_encoder(tokenizer_path)
        end = np.array([end_id], "<u2").tobytes()
        shard = TaskContext.get().partitionId()
        out, last, seen, first = None, None, -1, 0
        for batch in batches:
            rows = []
            for part in chunks(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), GROUP_TEXTS):
                if out is None:
                    out = Replaced(folder, shard_name(shard), TaskContext.get().taskAttemptId())
                for (doc_id, _), ids in zip(part, encoder.encode_all([t.as_py() for _, t in part]), strict=True):
                    data = ids + end
                    out.write(data)
                    seen = seen + 1 if seen >= 0 and doc_id == last else 0
                    last = doc_id
                    rows.append((doc_id, seen, shard, first, len(data) // 2))
                    first += len(data) // 2
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "occurrence", "shard", "first", "n"])
        if out is not None:
            out.close()

    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, ORDER_CHARS), F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(f"o{k}") for k, c in enumerate(order[1:])])
    keys = [F.col("doc_id").asc_nulls_first(), "o0", "o1", "o2"]
    ordered = placed.repartitionByRange(partitions or shards_of(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return continued(materialise(ordered.mapInArrow(run, "doc_id long, occurrence long, shard long, first long, n long")))


def continued(catalog: DataFrame) -> DataFrame:
    """The catalog with occurrences that go on where the rows of one doc_id reach into the next shard."""
    # A row for each shard reaches the driver: its first and last doc_id and their rows.
    key = F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id")
    ends = catalog.groupBy("shard").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.struct(key.alias("key"), "occurrence")).alias("end")).orderBy("shard").collect()
    before, last, seen = {}, None, 0
    for r in ends:
        if r["lo"] == last:
            before[r["shard"]] = seen
        seen = r["end"]["occurrence"] + 1 + (seen if r["lo"] == last == r["hi"] else 0)
        last = r["hi"]
    if not before:
        return catalog
    firsts = {r["shard"]: r["lo"]["doc_id"] for r in ends}
    more = catalog.sparkSession.createDataFrame([(s, firsts[s], n) for s, n in before.items()], "__shard long, __id long, __before long")
    joined = catalog.join(F.broadcast(more), (F.col("shard") == F.col("__shard")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return materialise(joined.select("doc_id", (F.col("occurrence") + F.coalesce("__before", F.lit(0))).alias("occurrence"), "shard", "first", "n"))


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column(0)
    return key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))


def with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds the index bucket of each key (doc_id, occurrence)."""
    return keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.col("doc_id").isNull(), "occurrence"), F.lit(buckets)))


def write_index(catalog: DataFrame, folder: str, bucket_keys: int = BUCKET_KEYS) -> int:
    """Build the index files, a bucket a group; returns the number of buckets."""
    buckets = max(1, ceil(catalog.count() / bucket_keys))

    def build(part: pa.Table) -> pa.Table:
        k = part["bucket"][0].as_py()
        batch = part.select(["doc_id", "occurrence"]).combine_chunks().to_batches()[0]
        column = lambda c: part[c].to_numpy()
        out = Replaced(folder, index_name(k), TaskContext.get().taskAttemptId())
        out.write(index_bytes(_hashes(batch), column("shard"), column("first"), column("n")))
        out.close()
        return pa.table({"bucket": [k], "bytes": [out.size]})

    with_bucket(catalog, buckets).groupBy("bucket").applyInArrow(build, "bucket long, bytes long").agg(F.sum("bytes")).collect()
    return buckets


def lookup(keys: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Positions of keys (doc_id, occurrence) by the index; unknown keys give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, at = Ranges(folder), None, None
        for batch in batches:
            h, bucket = _hashes(batch), batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(bucket)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(bucket)], strict=True):
                if lo == hi:
                    continue
                if bucket[lo] != at:
                    at, held = bucket[lo], Index(files.whole(index_name(int(bucket[lo]))))
                got, known = held.find(h[lo:hi])
                part = batch.slice(lo, hi - lo)
                made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(got[c].astype(np.int64)) for c in ("shard", "first", "n"))], names=["doc_id", "occurrence", "shard", "first", "n"])
                yield made.filter(pa.array(known))

    placed = with_bucket(keys.select("doc_id", "occurrence"), buckets).repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(run, "doc_id long, occurrence long, shard long, first long, n long")


def read_back(positions: DataFrame, folder: str, bases: dict[int, int]) -> DataFrame:
    """Read each position's ids from its shard: doc_id, start, n_tokens, ids_crc32 of the ids as uint32.

    ``bases`` has every shard, so there is a task for about each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            shard, first, n = (batch.column(c).to_pylist() for c in (2, 3, 4))
            crc = [zlib.crc32(np.frombuffer(files.read(shard_name(s), 2 * f, 2 * k), "<u2").astype("<u4").tobytes()) for s, f, k in zip(shard, first, n, strict=True)]
            starts = [bases[s] + f for s, f in zip(shard, first, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), batch.column(4), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        files.close()

    near = positions.repartitionByRange(max(1, len(bases)), "shard", "first").sortWithinPartitions("shard", "first")
    return near.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_bases(catalog: DataFrame) -> dict[int, int]:
    """Ids before each shard; a row for each shard (one for each partition) reaches the driver."""
    out, total = {}, 0
    for r in sorted(catalog.groupBy("shard").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["shard"]):
        out[r["shard"]] = total
        total += r["n"]
    return out


def op7_token_files(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Every document, from the files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_dir(spark)
    catalog = write_shards(table(spark, sf_dir, "documents"), path, folder)
    buckets = write_index(catalog, folder)
    return read_back(lookup(catalog, folder, buckets), folder, shard_bases(catalog))
