"""Exact k-means over integer vectors with Elkan's bounds.

Vectors are packed in blocks, a row each: components, ids, the cluster of every vector, an upper bound of
its distance to that cluster's centroid and k lower bounds of its distances to all. A round reads the blocks,
lets the bounds follow the centroids' moves, and computes a distance only where neither the bounds nor half
the distance between two centroids rules it out; blocks with their new bounds are written as a table, so a
lost executor costs a round at most. What leaves a task beside blocks are the sums of vectors that changed
their cluster.

Bounds are rounded outward and rule a centroid out only when they are strictly apart, so ties survive until
they are decided by exact integer distances (smaller number wins), as is every distance that is returned.

Defined results: only vectors with exactly ``dims`` components, none null or non-finite, are kept; components
beyond ``MOST`` in size (after scaling) count as ``MOST``, so that squared distances fit 64 bits; vectors with
a null id are clustered and never start a cluster; rows that share an id are vectors of their own, and equal
hashes start clusters in the order of their components; with fewer vectors than clusters there are as many
clusters as vectors with an id; inertias beyond 64 bits are null; an empty table, or one without a vector that
has an id, gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import materialise, release, table

#: Clusters, rounds, components, scale and seed of the production query.
CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Vectors of a block, greatest size of a component.
BLOCK, MOST = 1024, 1 << 27
#: Floats for a bound: enough for outward rounding, half the space.
_BOUND = np.float32


def down(x: np.ndarray) -> np.ndarray:
    """Lower bounds as stored: below x by more than the step before may have been rounded, never below 0."""
    x = np.maximum(x * (1 - 2.0**-50), 0)
    y = x.astype(_BOUND)
    return np.where(y > x, np.nextafter(y, _BOUND(-np.inf)), y)


def up(x: np.ndarray) -> np.ndarray:
    """Upper bounds as stored: above x by more than the step before may have been rounded."""
    x = x * (1 + 2.0**-50)
    y = x.astype(_BOUND)
    return np.where(y < x, np.nextafter(y, _BOUND(np.inf)), y)


def root_down(squared: np.ndarray) -> np.ndarray:
    """A lower bound of the root of exact integers; the conversion to a float may round by a place, the root by another."""
    return np.maximum(np.sqrt(squared.astype(np.float64)) * (1 - 2.0**-50), 0)


def root_up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 2.0**-50)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c (integers)."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= 1 << 15:
        d = x.astype(np.int32) - c.astype(np.int32)
        return np.einsum("ij,ij->i", d, d, dtype=np.int64)
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Centroids of a round, how far each has moved since the one before, and half the distances between them."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None):
        self.at = at
        k = len(at)
        i, j = np.indices((k, k))
        between = squared_distances(at[i.ravel()], at[j.ravel()]).reshape(k, k)
        self.apart = root_down(between)
        self.half = down(self.apart / 2)
        self.moved = root_up(squared_distances(at, before)) if before is not None else np.zeros(k)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds of a block, and how many distances were computed."""
    n, k = lower.shape
    lower = down(lower.astype(np.float64) - c.moved)
    upper = up(upper.astype(np.float64) + c.moved[own])
    cells = np.arange(k)

    def open_cells(rows: np.ndarray) -> np.ndarray:
        """Cells that no bound rules out; equality does not."""
        a, u = own[rows], upper[rows][:, None]
        return (u >= lower[rows]) & (u >= c.half[a]) & (cells != a[:, None])

    rows = np.flatnonzero(open_cells(np.arange(n)).any(axis=1))
    if not len(rows):
        return own, upper, lower, 0
    best = squared_distances(x[rows], c.at[own[rows]])
    upper, lower = upper.copy(), lower.copy()
    upper[rows] = up(root_up(best))
    lower[rows, own[rows]] = down(root_down(best))
    # A centroid that lies far from the own one is at least that much less the own distance away.
    lower[rows] = np.maximum(lower[rows], down(c.apart[own[rows]] - upper[rows].astype(np.float64)[:, None]))
    at, cell = np.nonzero(open_cells(rows))
    made = squared_distances(x[rows[at]], c.at[cell])
    lower[rows[at], cell] = down(root_down(made))
    # The least distance, then the least number; the own cluster takes part.
    who, number, size = np.concatenate([np.arange(len(rows)), at]), np.concatenate([own[rows], cell]), np.concatenate([best, made])
    order = np.lexsort((number, size, who))
    first = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])]
    own = own.copy()
    own[rows] = number[first]
    upper[rows] = up(root_up(size[first]))
    return own, upper, lower, len(rows) + len(at)


def _blocks_schema(id_type) -> StructType:
    shape = StructType().add("ids", ArrayType(id_type)).add("x", "binary").add("own", "binary").add("upper", "binary").add("lower", "binary")
    return shape.add("hash", "string").add("start", ArrayType(LongType())).add("cluster", "integer").add("n", "long").add("sums", ArrayType(LongType()))


_BLOCK_COLUMNS = ["x", "own", "upper", "lower"]
_OTHERS = {"hash": pa.string(), "start": pa.list_(pa.int64()), "cluster": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64())}


def _batch(size: int, id_kind: pa.DataType, **columns) -> pa.RecordBatch:
    """Rows of the blocks' table with the given columns, others null."""
    kinds = {"ids": pa.list_(id_kind)} | {c: pa.binary() for c in _BLOCK_COLUMNS} | _OTHERS
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()], names=list(kinds))


def _pack(x: np.ndarray) -> bytes:
    """Components as 16-bit integers where they all fit, else as 32-bit ones."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4").tobytes()


def _unpack(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dims else "<i4").reshape(n, dims)


def kept_vectors(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and floor(scale * x) of those."""
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
    rows = np.flatnonzero(sizes == dims)
    flat = vectors.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)  # nulls become NaN
    good = np.isfinite(x).all(axis=1)
    return rows[good], np.clip(np.floor(x[good] * scale), -MOST, MOST).astype(np.int32)


def packed(vectors: DataFrame, clusters: int, dims: int, scale: int, seed: str) -> DataFrame:
    """Blocks of kept vectors without a cluster yet, and for each task its vectors with the smallest hashes."""
    id_type = vectors.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, found = pa.int64(), []
        ids: list = []
        held = np.zeros((0, dims), np.int32)

        def block(n: int) -> pa.RecordBatch:
            return _batch(1, kind, ids=[ids[:n]], x=[_pack(held[:n])])

        for batch in batches:
            kind = batch.column(0).type
            rows, x = kept_vectors(batch.column(2), dims, scale)
            texts = batch.column(1).take(pa.array(rows)).to_pylist()
            found += [(hashlib.sha256(f"{seed}:{t}".encode()).hexdigest(), v.tolist()) for t, v in zip(texts, x, strict=True) if t is not None]
            found = sorted(found)[:clusters]
            ids += batch.column(0).take(pa.array(rows)).to_pylist()
            held = np.concatenate([held, x])
            while len(ids) >= BLOCK:
                yield block(BLOCK)
                ids, held = ids[BLOCK:], held[BLOCK:]
        if ids:
            yield block(len(ids))
        if found:
            hashes, start = zip(*found, strict=True)
            yield _batch(len(found), kind, hash=list(hashes), start=list(start))

    light = vectors.select("vec_id", F.col("vec_id").cast("string").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"))
    return light.mapInArrow(run, _blocks_schema(id_type))


def _round(blocks: DataFrame, now: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Blocks with new clusters and bounds, and by cluster the change of count and sums in each task."""
    k, dims = now.shape
    shared = blocks.sparkSession.sparkContext.broadcast((now, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(*shared.value)
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type.value_type
            for ids, *parts in zip(batch.column(0), *(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                n = len(ids)
                x = _unpack(parts[0], n, dims)
                if parts[1] is None:
                    own, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf, _BOUND), np.zeros((n, k), _BOUND)
                else:
                    own, upper, lower = np.frombuffer(parts[1], np.int32), np.frombuffer(parts[2], _BOUND), np.frombuffer(parts[3], _BOUND).reshape(n, k)
                new, upper, lower, _ = assign(x, own, upper, lower, c)
                gone = np.flatnonzero(new != own) if parts[1] is not None else np.zeros(0, np.int64)
                come = gone if parts[1] is not None else np.arange(n)
                for rows, to, sign in ((gone, own, -1), (come, new, 1)):
                    np.add.at(count, to[rows], sign)
                    np.add.at(sums, to[rows], sign * x[rows].astype(np.int64))
                yield _batch(1, kind, ids=[ids.as_py()], x=[parts[0]], own=[new.astype(np.int32).tobytes()], upper=[upper.tobytes()], lower=[lower.tobytes()])
        some = np.flatnonzero(count.astype(bool) | sums.any(axis=1))
        if len(some):
            yield _batch(len(some), kind, cluster=some.tolist(), n=count[some].tolist(), sums=sums[some].tolist())

    return blocks.where("x is not null").select("ids", *_BLOCK_COLUMNS).mapInArrow(run, blocks.schema)


def _changes(blocks: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of count and of sums by cluster, as Python integers; k * (dims + 1) numbers reach the driver."""
    cells = blocks.where("cluster is not null").select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("i", "v"))
    got = cells.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros((k, dims + 1), object)
    for r in got:
        out[r["cluster"], r["i"]] = int(r["v"])
    return out[:, 0], out[:, 1:]


def _placed(blocks: DataFrame, now: np.ndarray, id_type) -> DataFrame:
    """vec_id, cluster, exact squared distance of every vector."""
    shared = blocks.sparkSession.sparkContext.broadcast(now)
    dims = now.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, own in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(own, np.int32)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(own), pa.array(squared_distances(_unpack(x, len(own), dims), shared.value[own]))], names=["vec_id", "cluster", "distance"])

    return blocks.where("x is not null").select("ids", "x", "own").mapInArrow(run, StructType().add("vec_id", id_type).add("cluster", "integer").add("distance", "long"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector as a table, final centroids) of vectors (vec_id, embedding).

    A round that moves no centroid ends the work: all later ones would give the same.
    """
    id_type = vectors.schema["vec_id"].dataType
    blocks = materialise(packed(vectors, clusters, dims, scale, seed))
    start = blocks.where("hash is not null").select("hash", "start").orderBy("hash", "start").limit(clusters).collect()
    now, before = np.array([r["start"] for r in start], np.int64).reshape(len(start), dims), None
    if not len(now):
        none = vectors.sparkSession.createDataFrame([], StructType().add("vec_id", id_type).add("cluster", "integer").add("distance", "long"))
        return none, now
    count, sums = np.zeros(len(now), object), np.zeros(now.shape, object)
    for i in range(rounds + 1):
        last, blocks = blocks, materialise(_round(blocks, now, before))
        release(last)
        if i == rounds:
            break
        dn, ds = _changes(blocks, *now.shape)
        count, sums = count + dn, sums + ds
        means = np.array([[s // n for s in row] if n else old.tolist() for n, row, old in zip(count, sums, now, strict=True)], np.int64)
        before, now = now, means
        if (before == now).all():
            break
    placed = materialise(_placed(blocks, now, id_type))
    release(blocks)
    return placed, now


def with_inertia(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; what is looked up has an entry a cluster."""
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    k = range(len(centroids))
    own = F.array(*[F.lit(fits(sums.get(c, 0))).cast("long") for c in k]) if len(k) else F.array().cast("array<bigint>")
    hashes = F.array(*[F.lit(hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in k]) if len(k) else F.array().cast("array<string>")
    return placed.select("vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(fits(sum(sums.values()))).cast("long").alias("inertia"), F.get(hashes, F.col("cluster")).alias("centroid_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def _sql() -> str:
    """The same by all distances: a step for the start, two for each round."""
    parts = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) x from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {DIMS})",
        f"c0 as materialized (select row_number() over (order by h, x) - 1 as k, x from (select x, sha256('{SEED}:' || vec_id) h from v order by h, x limit {CLUSTERS}))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} as materialized (select vec_id, any_value(v.x) x, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'k': c.k}}) m from v, c{i} c group by vec_id)")
        if i < ROUNDS:
            parts.append(f"s{i} as (select k, i, (s - ((s % n) + n) % n) // n as y from (select m.k k, i, sum(x[i])::hugeint s, count(*)::hugeint n from (select m, x, unnest(range(1, {DIMS + 1})) i from a{i}) group by 1, 2))")
            parts.append(f"c{i + 1} as materialized (select c.k, coalesce(any_value(s.x), any_value(c.x)) x from c{i} c left join (select k, list(y::bigint order by i) x from s{i} group by k) s on s.k = c.k group by c.k)")
    end = f"select vec_id, m.k::integer as cluster, m.d as distance, sum(m.d) over (partition by m.k)::bigint as cluster_inertia, sum(m.d) over ()::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.k = a.m.k"
    return "with " + ",\n".join(parts) + "\n" + end


SQL = _sql()
