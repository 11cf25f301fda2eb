"""N-gram Jaccard join by multiple global orders.

Two texts whose shingle sets reach a Jaccard similarity t share, under any total order of all shingles, at
least one of their first ``n - ceil(t n) + 1`` shingles. Several orders each put another hash class of the
shingles first, rare before frequent; candidates must share prefix shingles under every order:

1. order A filters documents: one whose prefix holds only shingles that no other text has is done;
2. for the rest, orders B and C give each text its prefix of shared shingles, and graphs of who shares them;
   only texts in one component under B and in one under C meet in a group. Large groups are taken apart again
   by the shingles shared inside them, as long as that parts them;
3. in a group a pair is a candidate when it shares a prefix shingle under B and one under C and the sizes
   allow the similarity; candidates are verified exactly. A large group is dealt in blocks, two to a task.
   What leaves a task is a spanning star and link counts, never the pairs.

Frequencies are counted from blocks: a task sorts the shingles of its texts and sends each distinct one once,
packed by hash range, and gets the counts back in the same order. So a shingle that all texts have is one
entry a block, and no shingle is a row of its own.

Equal sets (two 64-bit digests) are one node from the start, so copies cost nothing. Components of the links
give the classes.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer words than a
shingle make the whole sequence one shingle; rows without doc_id have their set counted and no component;
rows that share a doc_id are judged each by its text; an empty table gives no rows; other columns are not
read. Sets are held as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_differ, materialise, release, shards_of, shuffle_partitions, table
from .components import components
from .textbatch import Words, mix, slices

#: Hash classes of shingles, and bounds of one verification task: sets and shingles.
CLASSES, TASK_SETS, TASK_SHINGLES = 10, 512, 2_000_000
#: Shingles of one block that counts frequencies; stored input for one hash range of them.
BLOCK_SHINGLES, RANGE_INPUT_BYTES = 1_000_000, 64_000_000
#: Postings are paired in batches; columns of a dense block; the work of a dense cell by that of a pair of postings.
_POSTINGS, _COLUMNS, _DENSE = 4_000_000, 2048, 0.04
_TRUE = np.ones(1, bool)
#: Groups of more sets than this are taken apart, in at most so many rounds (each that does not part one ends it).
REFINE_SETS, REFINE = 16_384, 8


def prefix_size(n, percent: int):
    """Shingles of a set of n that its prefix holds at a similarity of ``percent`` hundredths."""
    return n - (percent * n + 99) // 100 + 1


def classes_of(percent: int) -> dict[str, list[int]]:
    """The hash classes that each order puts first: at least half more shingles than prefixes take."""
    size = max(2, -(-3 * CLASSES * (100 - percent) // 200))
    rest = [k for k in range(size, CLASSES)]
    half = max(size, len(rest) // 2)
    b = [rest[i % len(rest)] for i in range(half)] if rest else list(range(CLASSES))
    c = [k for k in rest if k not in b]
    c += [k for k in range(CLASSES) if k not in c][: max(0, half - len(c))]
    return {"A": list(range(min(size, CLASSES))), "B": sorted(set(b)), "C": sorted(set(c))}


def class_of(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(CLASSES)).astype(np.int64)


def sets_of(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, sorted distinct shingle hashes) of every text, in their order."""
    for lo, hi, data, offsets in slices(texts):
        words = Words(data, offsets)
        grams = words.grams(width)
        for k in range(hi - lo):
            a, b = words.at[k], words.at[k + 1]
            if b - a >= width:
                s = np.sort(grams[a : b - width + 1])
                yield int(b - a), s[np.concatenate([_TRUE, s[1:] != s[:-1]])]
            elif b > a:
                place = np.arange(1, b - a + 1, dtype=np.uint64)
                yield int(b - a), mix(np.bitwise_xor.reduce(mix(words.hashes[a:b] + np.uint64(7) * place), keepdims=True) + np.uint64(b - a))
            else:
                yield 0, np.zeros(0, np.uint64)


def digests_of(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit digests of each set: of two independent sums and its size."""
    size = np.array([len(s) for s in sets], np.uint64)
    flat = np.concatenate([*sets, np.zeros(1, np.uint64)])
    first = np.cumsum(size) - size
    sums = []
    for made in (mix(flat + np.uint64(0x632BE59BD9B4E019)), mix(flat ^ np.uint64(0x85157AF5E8D1D8A3))):
        made[-1] = 0
        sums.append(np.where(size > 0, np.add.reduceat(made, first.astype(np.int64)), np.uint64(0)) if len(sets) else size)
    x, y = sums
    d1 = mix(x * np.uint64(0x9FB21C651E98DF25) + (y ^ size))
    d2 = mix(y * np.uint64(0xD1342543DE82EF95) + (x ^ size))
    return d1.view(np.int64).tolist(), d2.view(np.int64).tolist()


def prefix_size_column(n: str, percent: int):
    n = F.col(n)
    return n - F.floor((n * percent + 99) / 100) + 1


# Frequencies by blocks


def _range_starts(ranges: int) -> np.ndarray:
    return np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)


class TokenBlock:
    """The tokens of some sets in ascending order: distinct ones, and for every place its owner."""

    def __init__(self, lists: list[np.ndarray], ranges: int):
        tokens = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        self.order, self.owner = order, np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
        self.new = np.ones(len(tokens), bool)
        self.new[1:] = tokens[1:] != tokens[:-1]
        self.starts, self.distinct = np.flatnonzero(self.new), tokens[self.new]
        self.cuts = np.append(np.searchsorted(self.distinct, _range_starts(ranges)), len(self.distinct))

    def of_distinct(self, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
        """A reduction of the values at all places of each distinct token."""
        return reduce.reduceat(values, self.starts) if len(self.starts) else values[:0]

    def ranges(self) -> Iterator[tuple[int, slice]]:
        """Hash ranges that have tokens."""
        for k in np.flatnonzero(np.diff(self.cuts)):
            yield int(k), slice(int(self.cuts[k]), int(self.cuts[k + 1]))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _block_number(made: int) -> int:
    return (TaskContext.get().partitionId() << 32) + made


def _binary(part: pa.Table, name: str) -> list[bytes]:
    return part[name].to_pylist()


def in_ranges(rows: DataFrame, reply, schema: str = "block long, span int, reply binary") -> DataFrame:
    """Replies to token rows (block, span, tokens, x, y): ``reply`` of all rows of a hash range, in their order.

    ``reply`` gets the places where equal tokens begin in sorted order, that order, and each row's x and y.
    """

    def run(part: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(t, np.uint64) for t in _binary(part, "tokens")]
        sizes = [len(t) for t in tokens]
        flat = np.concatenate(tokens)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        by_token = reply(starts, order, _binary(part, "x"), _binary(part, "y"), sizes)
        at_place = np.empty(len(flat), by_token.dtype)
        at_place[order] = np.repeat(by_token, np.diff(np.append(starts, len(flat))))
        parts = np.split(at_place, np.cumsum(sizes)[:-1])
        packed = [_bits(p) if p.dtype == bool else p.tobytes() for p in parts]
        return pa.table({"block": part["block"], "span": part["span"], "reply": pa.array(packed, pa.binary())})

    return rows.groupBy("span").applyInArrow(run, schema)


def _shared(starts, order, x, y, sizes) -> np.ndarray:
    """Whether a token has two names: x is the least name in each block, y whether the block has more."""
    least = np.concatenate([np.frombuffer(b, np.int64) for b in x])[order]
    more = np.concatenate([_from_bits(b, n) for b, n in zip(y, sizes, strict=True)])[order]
    return np.logical_or.reduceat(more, starts) | (np.minimum.reduceat(least, starts) != np.maximum.reduceat(least, starts))


def _summed(starts, order, x, y, sizes) -> np.ndarray:
    """The sum of a token's counts x."""
    return np.add.reduceat(np.concatenate([np.frombuffer(b, np.uint32) for b in x])[order].astype(np.int64), starts)


_FIRST = "kind int, doc_id long, mark long, words long, n long, d1 long, d2 long, block long, span int, tokens binary, x binary, y binary, z binary"


def _first_rows(**columns) -> pa.RecordBatch:
    """A batch of ``_FIRST`` with the given columns, others null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    size = len(next(iter(columns.values())))
    names = [f.split() for f in _FIRST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(size, kinds[k]) for c, k in names], names=[c for c, _ in names])


def first_pass(docs: DataFrame, mark: Column, width: int, classes: list[int], ranges: int) -> DataFrame:
    """One pass over all texts. kind 0: each row's doc_id, mark, words, set size and digests; kind 1: distinct tokens of
    some hash classes by block and hash range; kind 2: by block, which sets have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(CLASSES, bool)
        wanted[classes] = True
        made, held, lists, about, known = 0, 0, [], [], set()

        def block() -> Iterator[pa.RecordBatch]:
            info, number = np.array(about, np.int64), _block_number(made)
            tokens = TokenBlock(lists, ranges)
            names = info[:, 2][tokens.owner]
            least = tokens.of_distinct(np.minimum, names)
            more = least != tokens.of_distinct(np.maximum, names)
            spans = list(tokens.ranges())
            if spans:
                yield _first_rows(kind=[1] * len(spans), block=[number] * len(spans), span=[k for k, _ in spans], tokens=[tokens.distinct[at].tobytes() for _, at in spans], x=[least[at].tobytes() for _, at in spans], y=[_bits(more[at]) for _, at in spans])
            yield _first_rows(kind=[2], block=[number], tokens=[np.diff(tokens.cuts).astype(np.uint32).tobytes()], x=[tokens.owner.astype(np.uint32).tobytes()], y=[_bits(tokens.new)], z=[info.tobytes()])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            words, sets = [], []
            for k, s in sets_of(batch.column(2), width):
                words.append(k)
                sets.append(s)
            if sets:
                named = digests_of(sets)
                yield _first_rows(kind=[0] * len(sets), doc_id=batch.column(0), mark=batch.column(1), words=words, n=[len(s) for s in sets], d1=named[0], d2=named[1])
            for i, (s, d1, d2) in enumerate(zip(sets, *named, strict=True) if sets else ()):
                if ids[i] is None or not len(s) or (d1, d2) in known:
                    continue
                t = s[wanted[class_of(s)]]
                known.add((d1, d2))
                lists.append(t)
                about.append((len(s), len(t), d1, d2))
                held += len(t)
                if held >= BLOCK_SHINGLES:
                    yield from block()
                    made, held, lists, about, known = made + 1, 0, [], [], set()
        if lists:
            yield from block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.cast("long").alias("mark"), "text").mapInArrow(run, _FIRST)


def survivors(first: DataFrame, percent: int) -> DataFrame:
    """Digests (d1, d2) of sets whose prefix under order A holds a shingle of another set.

    Order A: shingles of its classes that only one set has, then those of its classes that more have,
    then the others. With u shingles of the classes, s of them shared, and a prefix of p, a set is done
    when u - s >= p.
    """

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"d1": pa.array([], pa.int64()), "d2": pa.array([], pa.int64())})
        state = left.to_pylist()[0]
        sizes = np.frombuffer(state["tokens"], np.uint32)
        replies = dict(zip(right["span"].to_pylist(), _binary(right, "reply"), strict=True))
        shared = np.concatenate([_from_bits(replies[k], int(sizes[k])) for k in np.flatnonzero(sizes)] or [np.zeros(0, bool)])
        owner = np.frombuffer(state["x"], np.uint32)
        place = np.cumsum(_from_bits(state["y"], len(owner))) - 1
        n, u, d1, d2 = np.frombuffer(state["z"], np.int64).reshape(-1, 4).T
        s = np.bincount(owner[shared[place]], minlength=len(n))
        keep = u - s < prefix_size(n, percent)
        return pa.table({"d1": pa.array(d1[keep]), "d2": pa.array(d2[keep])})

    tokens = first.where("kind = 1").select("block", "span", "tokens", "x", "y")
    state = first.where("kind = 2").select("block", "tokens", "x", "y", "z")
    replies = in_ranges(tokens, _shared)
    return state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(fold, "d1 long, d2 long").distinct()


def survivor_sets(docs: DataFrame, kept: DataFrame, width: int, once: bool) -> DataFrame:
    """node, copies, shingles (array) of surviving nodes, from one text each. The ids are the hashed side.

    ``once``: no doc_id stands on two rows, so each node is found once.
    """
    want = kept.select(F.col("doc_id").alias("__id"), "node", "copies", "d1", "d2").hint("shuffle_hash")
    joined = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(want, "__id").select("__text", "node", "copies", "d1", "d2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, copies, d1, d2 = (batch.column(c).to_pylist() for c in (1, 2, 3, 4))
            sets = [s for _, s in sets_of(batch.column(0), width)]
            rows = [(node[i], copies[i], sets[i].view(np.int64)) for i, d in enumerate(zip(*digests_of(sets), strict=True)) if d == (d1[i], d2[i])]
            if rows:
                n, c, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["node", "copies", "shingles"])

    made = joined.mapInArrow(run, "node long, copies long, shingles array<long>")
    return made if once else made.dropDuplicates(["node"])


def prefixes(sets: DataFrame, orders: list[list[int]], percent: int, ranges: int) -> DataFrame:
    """tag, node, tokens (array), as a table: each set's prefix shingles under each order, without those that no other set has.

    Order: shingles of the order's classes by how many sets have them, then by hash; then all others by
    hash (of which only a set with too few shingles in the classes takes some).
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [np.isin(np.arange(CLASSES), own) for own in orders]
        made, held = 0, 0
        about: list[tuple[int, int]] = []
        lists: list[list[np.ndarray]] = [[] for _ in orders]
        later: list[list[np.ndarray]] = [[] for _ in orders]

        def block() -> Iterator[pa.RecordBatch]:
            for tag in range(len(orders)):
                tokens, number = TokenBlock(lists[tag], ranges), len(orders) * _block_number(made) + tag
                times = np.diff(np.append(tokens.starts, len(tokens.new))).astype(np.uint32)
                spans = list(tokens.ranges())
                if spans:
                    yield _first_rows(kind=[1] * len(spans), block=[number] * len(spans), span=[tag * ranges + k for k, _ in spans], tokens=[tokens.distinct[at].tobytes() for _, at in spans], x=[times[at].tobytes() for _, at in spans])
                yield _first_rows(kind=[2], block=[number], tokens=[tokens.distinct.tobytes()], x=[np.diff(tokens.cuts).astype(np.uint32).tobytes() + tokens.owner.astype(np.uint32).tobytes()], y=[_bits(tokens.new) + _bits(np.concatenate(later[tag])[tokens.order])], z=[np.array(about, np.int64).tobytes()])

        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                kind, p = class_of(h), prefix_size(len(h), percent)
                about.append((node, p))
                for tag, own in enumerate(wanted):
                    inside = own[kind]
                    first = h[inside]
                    others = h[~inside][: max(0, p - len(first))]
                    lists[tag].append(np.concatenate([first, others]))
                    later[tag].append(np.arange(len(first) + len(others)) >= len(first))
                    held += len(first) + len(others)
                if held >= BLOCK_SHINGLES:
                    yield from block()
                    made, held, about = made + 1, 0, []
                    lists, later = [[] for _ in orders], [[] for _ in orders]
        if about:
            yield from block()

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        state = left.to_pylist()[0]
        tag = state["block"] % len(orders)
        numbers = np.frombuffer(state["x"], np.uint32)
        sizes, owner = numbers[:ranges], numbers[ranges:].astype(np.int64)
        flags = np.frombuffer(state["y"], np.uint8)
        half = -(-len(owner) // 8)
        new, after = (np.unpackbits(x, count=len(owner)).astype(bool) for x in (flags[:half], flags[half:]))
        replies = dict(zip(right["span"].to_pylist(), _binary(right, "reply"), strict=True))
        df = np.concatenate([np.frombuffer(replies[tag * ranges + k], np.int64) for k in np.flatnonzero(sizes)] or [np.zeros(0, np.int64)])
        place = np.cumsum(new) - 1
        token, df = np.frombuffer(state["tokens"], np.uint64)[place], df[place]
        node, p = np.frombuffer(state["z"], np.int64).reshape(-1, 2).T
        order = np.lexsort((token, df, after, owner))
        owner, token, df = owner[order], token[order], df[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = (rank < p[owner]) & (df > 1)
        owner, token = owner[keep], token[keep].view(np.int64)
        cuts = np.searchsorted(owner, np.arange(len(node) + 1))
        have = np.flatnonzero(np.diff(cuts))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts[have], len(owner)), pa.int32()), pa.array(token, pa.int64()))
        return pa.table({"tag": pa.array(np.full(len(have), tag), pa.int32()), "node": pa.array(node[have]), "tokens": lists})

    listed = materialise(sets.select("node", "shingles").mapInArrow(blocks, _FIRST).select("kind", "block", "span", "tokens", "x", "y", "z"))
    replies = in_ranges(listed.where("kind = 1").select("block", "span", "tokens", "x", "y"), _summed)
    state = listed.where("kind = 2").select("block", "tokens", "x", "y", "z")
    out = materialise(state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(fold, "tag int, node long, tokens array<long>"))
    release(listed)
    return out


# Groups of candidates


def sharing(pairs: DataFrame) -> DataFrame:
    """(tag, node, root) of the graphs in which nodes that share a token are joined; pairs: tag, token, node."""
    # A table of its own: a join of two plain shuffles can split a frequent token.
    least = materialise(pairs.groupBy("tag", "token").agg(F.min("node").alias("b")))
    edges = pairs.join(least, ["tag", "token"]).select("tag", F.col("node").alias("a"), "b")
    # Dealt by node, which has no more edges than prefix shingles: tasks contract these to about one each, where by
    # token a group's nodes would leave every task that has one of its shingles.
    roots = materialise(components(edges.repartition("tag", "a")))
    release(least)
    return roots


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds B and C, the roots of each node under both orders (its own number where it has none)."""
    for tag, k in enumerate("BC"):
        own = roots.where(F.col("tag") == tag).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        rows = rows.join(own, F.col("node") == F.col("__node"), "left").withColumn(k, F.coalesce("__root", "node")).drop("__node", "__root")
    return rows


def candidate_groups(prefix: DataFrame) -> DataFrame:
    """node, B, C of nodes that share prefix shingles under both orders; large groups are taken apart further.

    Inside a group only the shingles that its own nodes share count, so chains of pairs that meet under
    one order alone break up.
    """
    pairs = materialise(prefix.select("tag", "node", F.explode("tokens").alias("token")))
    both = pairs.groupBy("node").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).where("a < b").select("node")
    done = None
    groups = materialise(_with_roots(both, sharing(pairs)))
    for _ in range(REFINE):
        sizes = materialise(groups.groupBy("B", "C").agg(F.count("*").alias("g")))
        large = sizes.where(F.col("g") > REFINE_SETS).select("B", "C")
        before = large.count()
        if not before:
            break
        marked = groups.join(sizes, ["B", "C"])
        small = marked.where(F.col("g") <= REFINE_SETS).select("node", "B", "C")
        inside = materialise(marked.where(F.col("g") > REFINE_SETS).select("node", "B", "C"))
        done = small if done is None else done.unionByName(small)
        own = pairs.join(inside, "node").select("tag", "node", F.xxhash64("token", "B", "C").alias("token"))
        groups = materialise(_with_roots(inside.select("node"), sharing(own)))
        if groups.select("B", "C").distinct().count() == before:
            break
    return groups if done is None else done.unionByName(groups)


def overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of some lists of distinct numbers share, as a square matrix.

    Lists that share most of their numbers go through a product of dense blocks, others through postings.
    """
    g = len(lists)
    owner = np.repeat(np.arange(g), [len(x) for x in lists])
    _, token, df = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    common = df[token] > 1
    owner, token = owner[common], token[common]
    if not len(token):
        return np.zeros((g, g), np.int64)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    new = np.concatenate([_TRUE, token[1:] != token[:-1]])
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(token)))
    out = np.zeros(g * g, np.int64)
    if _DENSE * g * g * len(first) < int((size * size).sum()):
        for lo in range(0, len(first), _COLUMNS):
            a, b = first[lo], (first[lo + _COLUMNS] if lo + _COLUMNS < len(first) else len(token))
            block = np.zeros((g, _COLUMNS), np.float32)
            block[owner[a:b], number[a:b] - lo] = 1
            out += (block @ block.T).astype(np.int64).ravel()
    else:
        partners = size[number]
        cuts = np.searchsorted(np.cumsum(partners), np.arange(0, partners.sum(), _POSTINGS))
        for a, b in zip(cuts, [*cuts[1:], len(token)], strict=True):
            n = partners[a:b]
            other = np.repeat(first[number[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out += np.bincount(np.repeat(owner[a:b], n) * g + owner[other], minlength=g * g)
    return out.reshape(g, g)


def verify(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], prefix: list[list[np.ndarray]], block: np.ndarray, percent: int, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Roots (smallest linked id) and link counts of the sets of one task.

    Candidates share a prefix token under every order in ``prefix``. In a task of two blocks only pairs
    ``across`` them are compared: the pairs inside have their own tasks.
    """
    g = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    # Sizes alone bound the similarity.
    near = 100 * np.minimum(sizes, sizes[:, None]) >= percent * np.maximum(sizes, sizes[:, None])
    np.fill_diagonal(near, False)
    if across:
        near &= block != block[:, None]
    for lists in prefix:
        if near.any():
            near &= overlaps(lists) > 0
    label, links = np.arange(g), np.zeros(g, np.int64)
    # Only sets that have a candidate are compared.
    some = np.flatnonzero(near.any(axis=1))
    if len(some):
        n = sizes[some]
        shared = overlaps([sets[i] for i in some])
        linked = near[np.ix_(some, some)] & (100 * shared >= percent * (n + n[:, None] - shared))
        links[some] = linked @ copies[some]
        own = np.arange(len(some))
        while True:
            least = np.minimum(own, np.where(linked, own, len(some)).min(axis=1))
            least = least[least]
            if (least == own).all():
                break
            own = least
        label[some] = some[own]
    least_id = np.full(g, np.iinfo(np.int64).max)
    np.minimum.at(least_id, label, ids)
    return least_id[label], links


def verified_links(sets: DataFrame, prefix: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """node, root, links rows of each task; groups: node, B, C."""
    both = [prefix.where(F.col("tag") == tag).select("node", F.col("tokens").alias(name)) for tag, name in ((0, "pb"), (1, "pc"))]
    keyed = sets.join(groups.join(both[0], "node").join(both[1], "node"), "node").withColumn("n", F.size("shingles").cast("long"))
    shape = keyed.groupBy("B", "C").agg(F.count("*").alias("g"), F.sum("n").alias("total")).where("g > 1")
    # As many blocks as the bounds of a task ask for; a group beyond them is dealt to all partitions, if its size allows.
    least = F.greatest(F.ceil(F.col("g") / TASK_SETS), F.ceil(F.col("total") / TASK_SHINGLES))
    busy = F.least(F.ceil(F.col("g") / (TASK_SETS / 4)), F.lit(int((8 * shuffle_partitions(sets.sparkSession)) ** 0.5)))
    # A table of its own, so that the join sees two plain shuffles and can split a large group.
    shape = materialise(shape.select("B", "C", F.when(least > 1, F.greatest(2 * least, busy)).otherwise(1).cast("int").alias("parts")))
    placed = keyed.join(shape, ["B", "C"]).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # Each block meets every other in one task, and itself in its own.
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select("B", "C", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "copies", "shingles", "pb", "pc")

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        values, pb, pc = ([x.values.to_numpy(zero_copy_only=False) for x in part[c].combine_chunks()] for c in ("shingles", "pb", "pc"))
        ids = part["node"].to_numpy()
        # Shingles are sorted as unsigned numbers; searching needs them so.
        values = [v.view(np.uint64) for v in values]
        roots, links = verify(ids, part["copies"].to_numpy(), values, [pb, pc], part["block"].to_numpy(), percent, part["lo"][0].as_py() != part["hi"][0].as_py())
        keep = (links > 0) | (roots != ids)
        return pa.table({"node": pa.array(ids[keep]), "root": pa.array(roots[keep]), "links": pa.array(links[keep])})

    return tasks.groupBy("B", "C", "lo", "hi").applyInArrow(run, "node long, root long, links long")


def join(docs: DataFrame, width: int = 5, percent: int = 80, mark: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_shingles, component_id, n_links of every row, and ``mark``: any number that a caller gives its rows."""
    orders = classes_of(percent)
    once = ids_differ(docs)
    ranges = shards_of(docs, RANGE_INPUT_BYTES)
    first = materialise(first_pass(docs, F.lit(None) if mark is None else mark, width, orders["A"], ranges))
    members = materialise(first.where("kind = 0").select("doc_id", "mark", "words", "n", "d1", "d2"))
    nodes = materialise(members.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    # Written once, so the numbers stay as they are.
    kept = materialise(nodes.join(survivors(first, percent), ["d1", "d2"]).withColumn("node", F.monotonically_increasing_id()))
    release(first)
    sets = materialise(survivor_sets(docs, kept, width, once))
    prefix = prefixes(sets, [orders["B"], orders["C"]], percent, ranges)
    found = materialise(verified_links(sets, prefix, candidate_groups(prefix), percent))
    release(sets)
    release(prefix)
    classes = components(found.select(F.lit(0).alias("tag"), F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = materialise(kept.select("node", "doc_id", "d1", "d2").join(classes.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(linked, "node", "left"))
    # Tables of their own, so that the joins see plain shuffles and can split a large class or many copies.
    least = materialise(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of_kept = named.join(least, "root").select("d1", "d2", "component_id", "links")
    labels = materialise(nodes.join(of_kept, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    for t in (nodes, kept, found, named, least):
        release(t)
    out = members.join(labels, ["d1", "d2"], "left")
    none = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "mark", F.col("words").alias("n_words"), F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(none, 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) of which the first of each class stays: smallest doc_id, then place.

    Texts without words are in no class and all stay, but for repeats of one doc_id; so do rows without doc_id.
    """
    names = docs.columns
    # Rows are named by their doc_id, or, where that is missing or repeated, by their place in a written copy.
    if ids_differ(docs):
        rows = docs.select(F.col("doc_id").cast("long").alias("__row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__all"))
    else:
        rows = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__all")).withColumn("__row", F.monotonically_increasing_id()))
    labels = join(rows.select(F.col("__all.doc_id").alias("doc_id"), F.col("__all.text").alias("text"), "__row"), width, percent, F.col("__row"))
    classes = labels.where("doc_id is not null").groupBy("component_id", F.col("n_shingles") == 0).agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.mark").alias("__row"))
    keep = materialise(classes.unionByName(labels.where("doc_id is null").select(F.col("mark").alias("__row"))))
    return rows.join(keep.hint("shuffle_hash"), "__row", "left_semi").select(*[F.col("__all")[c].alias(c) for c in names])


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id, n_links, at 3-word shingles and 90 hundredths."""
    return join(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")
