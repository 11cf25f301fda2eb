"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic examples (P) and unlabelled text (U) train linear numpy classifiers on hashed word
features under the non-negative risk estimator ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``
(logistic loss). Of the labels only toxic ones are examples; the others count in the class prior (the share
of toxic labels), which corrects the risk and places the decision.

U is all text outside the held-out fold. One pass counts in how many of these texts each feature occurs, which
chooses the features that enter; classifiers that are fitted on the driver, to a sample whose rows are bounded by
parameters, are only where the descent begins: its last steps go down the risk over all texts, as sums over the
tasks (whole numbers, so that their order changes nothing) of texts reduced to the features that entered.
One more pass over all whole texts writes their margins with weights of a fixed size; the decision lies where the
share of all texts above it is the class prior.

Defined results: null and empty texts have no features and get the margin of the bias alone; repeated
rows get equal scores; of the rows of one doc_id at most one is an example (the one of least text hash); an
empty table gives no rows; without any positive example every score is ``prior`` (0 when there are no labels).
Columns of other names pass through untouched; kept columns with the names of results give way to these.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, release, table

#: Bounds of the fitting sample (rows), the fixed width of the model, and the optimiser.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
BITS = 18
EPOCHS, BATCH, RATE, DECAY, SEEDS = 40, 512, 0.02, 5e-4, (1, 2, 3, 4, 5)
#: Steps down the risk over all texts, and the unit in which sums of them are counted.
FULL_STEPS, UNIT = 4, 1 << 24
#: A feature enters when this share of the positive texts has it (two of them at least, and no more than
#: ``MOST_ASKED`` are asked for), its share in P exceeds that in U by this many deviations, and this part of its
#: share in U is what the prior lets positive texts have there.
LEAST_TEXTS, MOST_ASKED, LEAST_Z, LEAST_SHARE = 0.1, 6, 6.0, 0.6
#: Margin bins that place the decision: their greatest margin either way, and bins of one unit.
BIN_RANGE, BINS_A_UNIT = 40, 512
#: Shares of the prior below and above which an estimate is not taken.
PRIOR_RANGE = (0.001, 0.9)

_WORD = re.compile(r"\w+")


def word_features(word: str, bits: int) -> tuple[int, ...]:
    """Hashed features of one lower-cased word: itself and its beginnings of four and five characters."""
    mask = (1 << bits) - 1
    return tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in ("w" + word, "4" + word[:4], "5" + word[:5])})


class Featuriser:
    """Distinct hashed features of whole texts, all or those that ``only`` marks, with a bounded memory of words."""

    def __init__(self, bits: int, only: np.ndarray | None = None, keep: int = 400_000):
        self.bits, self.only, self.keep, self.known = bits, only, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall((text or "").lower()))
        known = self.known
        if len(known) > self.keep:
            known.clear()
        out: set[int] = set()
        for w in words:
            f = known.get(w)
            if f is None:
                f = word_features(w, self.bits)
                f = known[w] = f if self.only is None else tuple(x for x in f if self.only[x])
            if f:
                out.update(f)
        return np.fromiter(out, dtype=np.int32, count=len(out))


@dataclass
class Model:
    """Averaged linear classifiers: ``sigmoid(bias + sum of the weights of a text's features)``."""

    weights: np.ndarray
    bias: float
    bits: int
    #: The share of texts that the decision parts from the rest; None leaves it at the risk's own zero margin.
    prior: float | None = None

    def margin(self, features: np.ndarray) -> float:
        return self.bias + float(self.weights[features].sum(dtype=np.float64))


def nnpu_risk(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Risk of the margins of P and U and its gradients by margin.

    When the corrected negative part is below zero, the gradient turns against it (its sign flips),
    which is what keeps flexible classifiers from driving that part ever lower.
    """
    sig = 1.0 / (1.0 + np.exp(-np.clip(unl, -40, 40)))
    n_u = max(len(unl), 1)
    risk, g_pos, sign = nnpu_parts(pos, np.logaddexp(0.0, unl).sum() / n_u, prior)
    return risk, g_pos, sign * sig / n_u


def nnpu_parts(pos: np.ndarray, unlabelled: float, prior: float) -> tuple[float, np.ndarray, float]:
    """As ``nnpu_risk``, from the unlabelled texts' mean loss as negatives; in place of their gradients the sign of these."""
    soft = lambda z: np.logaddexp(0.0, z)
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    n_p = max(len(pos), 1)
    positive = prior * soft(-pos).sum() / n_p
    negative = unlabelled - prior * soft(pos).sum() / n_p
    if negative < 0:
        return positive, prior * sig(pos) / n_p, -1.0
    return positive + negative, -prior * sig(-pos) / n_p - prior * sig(pos) / n_p, 1.0


def enriched(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, prior: float) -> np.ndarray:
    """Which features confirmed toxic texts have far more often than unlabelled ones, by the texts of each that have them.

    A feature of toxic texts alone is in U as often as in P times the prior; most of that is asked for.
    """
    share = (in_u + 1) / (n_u + 2)
    z = (in_p - n_p * share) / np.sqrt(n_p * share * (1 - share) + 1e-12)
    asked = min(MOST_ASKED, max(2, int(np.ceil(LEAST_TEXTS * n_p))))
    return (in_p >= asked) & (z >= LEAST_Z) & (prior * in_p >= LEAST_SHARE * share * n_p)


def clipped(prior: float) -> float:
    return float(np.clip(prior, *PRIOR_RANGE))


def fit(pos: list[np.ndarray], unl: list[np.ndarray], kept: np.ndarray, prior: float, bits: int = BITS, seeds=SEEDS) -> Model:
    """Train one classifier per seed with Adam on nnPU batches and average them, over texts as lists of features that are kept."""
    dim = 1 << bits
    prior = clipped(prior) if pos else 0.0
    if not pos or not unl:
        bias = -40.0 if prior == 0 else float(np.log(prior / (1 - prior)))
        return Model(np.zeros(dim, dtype=np.float32), bias, bits)
    # Only the features that enter are numbered, so that a step's work follows their count.
    number, width = np.cumsum(kept) - 1, max(1, int(kept.sum()))
    pos, unl = [number[f] for f in pos], [number[f] for f in unl]
    total, bias_total = np.zeros(width), 0.0
    steps = max(1, -(-len(unl) // BATCH))
    per_p = max(1, min(len(pos), -(-len(pos) // steps)))
    for seed in seeds:
        rng = np.random.default_rng(seed)
        w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
        m, v, mb, vb, t = np.zeros(width), np.zeros(width), 0.0, 0.0, 0
        for _ in range(EPOCHS):
            order_p, order_u = rng.permutation(len(pos)), rng.permutation(len(unl))
            for k in range(steps):
                ps = [pos[i] for i in np.take(order_p, range(k * per_p, (k + 1) * per_p), mode="wrap")]
                us = [unl[i] for i in order_u[k * BATCH : (k + 1) * BATCH]]
                rows = ps + us
                sizes = np.array([len(r) for r in rows])
                flat = np.concatenate(rows)
                margins = b + np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=w[flat], minlength=len(rows))
                _, g_p, g_u = nnpu_risk(margins[: len(ps)], margins[len(ps) :], prior)
                err = np.concatenate([g_p, g_u])
                grad = np.bincount(flat, weights=np.repeat(err, sizes), minlength=width)
                t += 1
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                w -= rate * m / (np.sqrt(v) + 1e-6) + DECAY * w
                gb = err.sum()
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                b -= rate * mb / (np.sqrt(vb) + 1e-6)
        total += w
        bias_total += b
    own, bias = (total / len(seeds)).astype(np.float32), bias_total / len(seeds)
    weights = np.zeros(dim, dtype=np.float32)
    weights[kept] = own[: int(kept.sum())]
    return Model(weights, bias, bits, prior)


def feature_counts(texts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many texts of a one-column table each feature occurs, and how many texts there are; tasks send their own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, count, parts, held, n = Featuriser(bits), np.zeros(1 << bits, np.int64), [], 0, 0
        for batch in batches:
            for t in batch.column(0):
                parts.append(make(t.as_py()))
                held, n = held + len(parts[-1]), n + 1
                if held >= 2_000_000:
                    count += np.bincount(np.concatenate(parts), minlength=len(count))
                    parts, held = [], 0
        if parts:
            count += np.bincount(np.concatenate(parts), minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.append(at, -1).astype(np.int32)), "n": pa.array(np.append(count[at], n))})

    got = texts.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** bits + 1 rows
    out = np.zeros((1 << bits) + 1, np.int64)
    out[got["f"].to_numpy()] = got["n"].to_numpy()
    return out[:-1], int(out[-1])


def reduced(texts: DataFrame, kept: np.ndarray, bits: int) -> DataFrame:
    """Texts of a one-column table as sorted lists of the numbers of their features that are kept, each with how often it
    occurs, as a table; most texts share the empty one."""
    shared = texts.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared.value
        make, number = Featuriser(bits, only), np.cumsum(only) - 1
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"f": pa.array([np.sort(number[make(t.as_py())]) for t in batch.column(0)], pa.list_(pa.int32()))})

    return materialise(texts.mapInArrow(run, "f array<int>").groupBy("f").agg(F.count("*").alias("n")))


def unlabelled_sums(lists: DataFrame, w: np.ndarray, b: float) -> tuple[int, float, float, np.ndarray]:
    """Over all unlabelled texts: their number, the sum of their losses as negatives, and its gradients by bias and weights."""
    shared = lists.sparkSession.sparkContext.broadcast((w, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        total = np.zeros(len(w) + 3, np.int64)  # by weight, then bias, loss, texts
        for batch in batches:
            f, n = batch.column(0), batch.column(1).to_numpy()
            sizes = np.asarray(f.value_lengths())
            flat = f.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(n)), sizes)
            z = b + np.bincount(owner, weights=w[flat], minlength=len(n))
            pull = np.rint(UNIT / (1 + np.exp(-np.clip(z, -40, 40)))).astype(np.int64) * n
            np.add.at(total, flat, pull[owner])
            total[len(w) :] += pull.sum(), (np.rint(UNIT * np.logaddexp(0.0, z)).astype(np.int64) * n).sum(), n.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at.astype(np.int32)), "v": pa.array(total[at])})

    got = lists.mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a row a kept feature
    out = np.zeros(len(w) + 3)
    for r in got:
        out[r["k"]] = float(r["v"])
    return int(out[-1]), out[-2] / UNIT, out[-3] / UNIT, out[: len(w)] / UNIT


def refine(model: Model, pos: list[np.ndarray], lists: DataFrame, kept: np.ndarray, steps: int = FULL_STEPS) -> Model:
    """Go on down the nnPU risk of the positive examples and all unlabelled texts, by whole gradients."""
    number, at, prior = np.cumsum(kept) - 1, np.flatnonzero(kept), model.prior
    pos = [number[f] for f in pos]
    flat, owner = np.concatenate(pos), np.repeat(np.arange(len(pos)), [len(f) for f in pos])
    w, b = model.weights[at].astype(np.float64), model.bias
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, steps + 1):
        n, loss, by_bias, by_weight = unlabelled_sums(lists, w, b)
        z = b + np.bincount(owner, weights=w[flat], minlength=len(pos))
        _, g_p, sign = nnpu_parts(z, loss / n, prior)
        grad, gb = np.bincount(flat, weights=g_p[owner], minlength=len(w)) + sign * by_weight / n, g_p.sum() + sign * by_bias / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - rate * m / (np.sqrt(v) + 1e-6) - DECAY * w, b - rate * mb / (np.sqrt(vb) + 1e-6)
    weights = np.zeros_like(model.weights)
    weights[at] = w
    return Model(weights, float(b), model.bits, prior)


def with_margins(docs: DataFrame, model: Model, keep: list[str]) -> tuple[DataFrame, str]:
    """``keep`` columns of every row and the margin of its whole text, written once; and the margin's name."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.bits))
    name = "__margin"
    while name in keep:
        name += "_"
    # A text that is kept anyway is not sent twice.
    at = keep.index("text") if "text" in keep else None
    wanted = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), *([] if at is not None else [F.col("text").alias("of")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, width = shared.value
        own, make = Model(weights, bias, width), Featuriser(width, weights != 0)
        for batch in batches:
            texts = batch.column(1) if at is None else batch.column(0).field(at)
            z = pa.array([own.margin(make(t.as_py())) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), z], names=["kept", "margin"])

    made = wanted.mapInArrow(run, wanted.select("kept").schema.add("margin", "double"))
    return materialise(made.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("margin").alias(name))), name


def margin_bins(scored: DataFrame, name: str) -> list[tuple[int, float, float]]:
    """(texts, least margin, greatest margin) of every margin bin that has texts, highest first."""
    z = F.col(name)
    bins = F.floor(F.greatest(F.least(z, F.lit(float(BIN_RANGE))), F.lit(-float(BIN_RANGE))) * BINS_A_UNIT).alias("bin")
    # At most 2 * BIN_RANGE * BINS_A_UNIT + 1 rows, whatever the input.
    found = scored.groupBy(bins).agg(F.count("*").alias("n"), F.min(z).alias("lo"), F.max(z).alias("hi")).collect()
    return [(r["n"], r["lo"], r["hi"]) for r in sorted(found, key=lambda r: -r["bin"])]


def decision(scored: DataFrame, name: str, model: Model) -> float:
    """The margin from which on a text is rejected."""
    return 0.0 if model.prior is None else prior_cut(margin_bins(scored, name), model.prior)


def prior_cut(bins: list[tuple[int, float, float]], prior: float) -> float:
    """The margin that parts the prior's share of all texts from the rest: between the two bins where the count above is nearest to it."""
    if not bins:
        return 0.0
    counts = np.array([n for n, _, _ in bins])
    above = np.concatenate([[0], np.cumsum(counts)])
    at = int(np.argmin(np.abs(above - prior * above[-1])))
    if at == 0:
        return bins[0][2] + 1.0
    if at == len(bins):
        return bins[-1][1] - 1.0
    return (bins[at - 1][1] + bins[at][2]) / 2


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, bits: int = BITS) -> Model:
    """Begin on bounded samples, toxic-labelled rows outside the held-out fold and other texts outside it; go on over all of these.

    The samples are the doc_ids of smallest hash, one row of each; texts become lists of the features that enter
    on the executors.
    """
    train_labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = train_labels.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"] or 0.0
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(17)))
    toxic = train_labels.where("toxic = 1").select("doc_id").distinct()
    chosen_p = ids.join(toxic, "doc_id", "left_semi").orderBy("h", "doc_id").limit(max_positive).select("doc_id").withColumn("kind", F.lit(1))
    chosen_u = ids.orderBy("h", "doc_id").limit(max_unlabelled).select("doc_id").withColumn("kind", F.lit(0))
    # At most max_positive + max_unlabelled ids: a proven size for the broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen_p.unionByName(chosen_u)), "doc_id")
    # One row of each id, so that the bounds hold for rows, too; repeats go in the partial aggregate.
    sample = materialise(found.groupBy("kind", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("kind", F.xxhash64("doc_id").alias("h"), "text"))
    in_p, n_p = feature_counts(sample.where("kind = 1").select("text"), bits)
    if not n_p:
        release(sample)
        return fit([], [], np.zeros(1 << bits, bool), share, bits)
    unlabelled = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text")
    kept = enriched(in_p, n_p, *feature_counts(unlabelled, bits), clipped(share))
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featuriser(bits, shared.value)
        for batch in batches:
            x = batch.to_pydict()
            yield pa.RecordBatch.from_pydict({"kind": pa.array(x["kind"], pa.int32()), "h": pa.array(x["h"], pa.int64()), "f": pa.array([np.sort(make(t)) for t in x["text"]], pa.list_(pa.int32()))})

    got = sample.mapInArrow(features, "kind int, h long, f array<int>").toArrow().sort_by([("h", "ascending")])
    release(sample)
    kinds, feats = got["kind"].to_pylist(), got["f"]
    lists = [np.asarray(x.values, dtype=np.int32) for x in feats]
    pos, unl = ([f for f, k in zip(lists, kinds, strict=True) if k == kind] for kind in (1, 0))
    model = fit(pos, unl, kept, share, bits)
    if not kept.any() or model.prior is None:
        return model
    every = reduced(unlabelled, kept, bits)
    model = refine(model, pos, every, kept)
    release(every)
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default doc_id) plus ``score`` (0 to 1) and ``predicted`` (score >= 0.5) of every whole text.

    The decision (0.5) is placed by the margins of all of ``docs``.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("score", "predicted")]
    scored, name = with_margins(docs, model, keep)
    z = F.greatest(F.least(F.col(name) - decision(scored, name, model), F.lit(40.0)), F.lit(-40.0))
    out = scored.withColumn(name, 1.0 / (1.0 + F.exp(-z)))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``score`` does not predict to be toxic.

    Rows are written once with their margins, which is cheaper than to read all texts' words twice.
    """
    scored, name = with_margins(docs, model, docs.columns)
    return scored.where(F.col(name) < decision(scored, name, model)).drop(name)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
