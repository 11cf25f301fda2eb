import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from carelane.llm import toxicity as T


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        bad = i % 8 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zorgtwit", "zorgfool", "vexscum"])
            words[rng.randrange(len(words))] = rng.choice(["zorgtwit", "zorgfool", "vexscum"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_contract(spark, docs_of):
    rows, labels = corpus()
    docs = docs_of(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.score(docs, T.train(docs, table)).withColumn("held_out", T.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95


def test_held_out_labels_are_not_used(spark, docs_of):
    rows, labels = corpus(400)
    docs = docs_of(rows)
    import zlib

    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    make = lambda x: T.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))
    a, b = make(labels), make(flipped)
    assert np.array_equal(a.weights, b.weights)
    assert (a.bias, a.prior) == (b.bias, b.prior)


def test_risk_turns_when_negative():
    pos, unl = np.array([5.0, 5.0]), np.array([-9.0])
    _, _, g = T.nnpu_risk(pos, unl, 0.5)
    assert (g < 0).all()
    risk, g_pos, g_unl = T.nnpu_risk(np.zeros(2), np.zeros(2), 0.3)
    step = 1e-6
    moved, _, _ = T.nnpu_risk(np.array([step, 0.0]), np.zeros(2), 0.3)
    assert abs((moved - risk) / step - g_pos[0]) < 1e-4
    assert (g_unl > 0).all()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 1), (5, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        model = T.train(docs, labels)
        got = T.score(docs, model).collect()
        assert len(got) == docs.count()
        assert all(0 <= r["score"] <= 1 for r in got)
    assert T.train(odd, labels.limit(0)).bias == -40.0
    clash = odd.withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "__margin": F.lit(1), "h": F.lit(2), "kind": F.lit(3)})
    kept = T.without_toxic(clash, T.train(clash, labels.limit(0)))
    assert kept.columns == clash.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, clash.collect()))


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def test_scores_against_brute_force(spark, docs_of, odd):
    rows, labels = corpus(600)
    docs = docs_of(rows).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000))
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def margin(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        found = {zlib.crc32(x.encode()) % (1 << T.BITS) for w in words for x in ("w" + w, "4" + w[:4], "5" + w[:5])}
        return model.bias + sum(float(model.weights[f]) for f in found)

    # The decision lies midway between the two margins whose rank parts the prior's share best.
    z = {i: margin(t) for i, t in plain if i is not None}
    every = sorted((margin(t) for _, t in plain), reverse=True)
    bins = {}
    for x in every:
        bins.setdefault(math.floor(max(-40.0, min(40.0, x)) * T.BINS_A_UNIT), []).append(x)
    ordered = [bins[b] for b in sorted(bins, reverse=True)]
    above = [sum(map(len, ordered[:k])) for k in range(len(ordered) + 1)]
    at = min(range(len(above)), key=lambda k: (abs(above[k] - model.prior * len(every)), k))
    assert 0 < at < len(ordered)
    cut = (min(ordered[at - 1]) + max(ordered[at])) / 2
    for r in T.score(docs, model).collect():
        if r["doc_id"] is not None:
            assert abs(r["score"] - sigmoid(z[r["doc_id"]] - cut)) < 1e-6
            assert r["predicted"] == int(r["score"] >= 0.5)


def test_sample_rows_are_bounded_when_ids_repeat(spark, docs_of, monkeypatch):
    rows, labels = corpus(400)
    rows = rows + [(i, t + f" again {k}") for k in range(5) for i, t in rows[:200]]
    sizes = []
    fit = T.fit
    monkeypatch.setattr(T, "fit", lambda pos, unl, *how: sizes.append((len(pos), len(unl))) or fit(pos, unl, *how))
    T.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_positive=20, max_unlabelled=50)
    assert sizes == [(20, 50)]


def test_a_few_examples_make_a_model(spark, docs_of):
    rows, labels = corpus(160)
    labels = [x for x in labels if x[0] < 100]
    model = T.train(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in T.score(docs_of(rows), model).collect()}
    assert np.count_nonzero(model.weights)
    assert sum(got[i] for i in range(0, 160, 8)) >= 14
    assert sum(p for i, p in got.items() if i % 8) <= 4


def test_decision_follows_all_texts_not_the_sample(spark, docs_of):
    rows, labels = corpus()
    # Of the toxic texts one in three has weak words only, so that margins differ.
    rows = [(i, t.replace("zorg", "mild") if i % 24 == 0 else t) for i, t in rows]
    docs = docs_of(rows)
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_unlabelled=150)
    got = T.score(docs, model).collect()
    train = [t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5]
    want = sum(train) / len(train) * len(rows)
    steps = Counter(round(r["score"], 6) for r in got)
    above = [sum(n for s, n in steps.items() if s >= least) for least in steps]
    assert abs(sum(r["predicted"] for r in got) - want) <= min(abs(n - want) for n in above) + 2


def test_cut_parts_the_share_and_splits_no_bin():
    bins = [(3, 5.0, 5.1), (2, 4.0, 4.1), (90, -2.0, -2.0), (5, -3.0, -2.9)]
    assert T.prior_cut(bins, 0.05) == (4.0 - 2.0) / 2
    assert T.prior_cut(bins, 0.3) == (4.0 - 2.0) / 2
    assert T.prior_cut(bins, 0.03) == (5.0 + 4.1) / 2
    assert T.prior_cut([(10, 1.0, 1.0)], 0.2) > 1.0
    assert T.prior_cut([], 0.2) == 0.0


def test_the_descent_covers_all_unlabelled_texts(spark, docs_of):
    """Sums over the tasks are those of all texts outside the held-out fold, whatever the sample and the partitions."""
    rows, labels = corpus(300)
    rows += [(1000 + k, "zorgfool same text") for k in range(50)] + [(2000, None), (2001, ""), (None, "vexscum no id")]
    docs = docs_of(rows)
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5]
    unlabelled = docs.where(F.col("doc_id").isNotNull() & ~T.held_out(F.col("doc_id"))).select("text")
    counts, n = T.feature_counts(unlabelled.repartition(7), T.BITS)
    make = T.Featuriser(T.BITS)
    want = Counter(int(f) for t in train for f in make(t))
    assert n == len(train) and {int(f): int(counts[f]) for f in np.flatnonzero(counts)} == want
    kept = np.zeros(1 << T.BITS, bool)
    kept[[f for f, _ in want.most_common(40)]] = True
    rng = np.random.default_rng(1)
    w, b, number = rng.normal(size=40), -0.3, np.cumsum(kept) - 1
    got = [T.unlabelled_sums(T.reduced(unlabelled.repartition(p), kept, T.BITS), w, b) for p in (1, 5)]
    assert got[0][:3] == got[1][:3] and np.array_equal(got[0][3], got[1][3])
    lists = [number[[f for f in make(t) if kept[f]]] for t in train]
    z = np.array([b + w[f].sum() for f in lists])
    pull = 1 / (1 + np.exp(-z))
    assert got[0][0] == len(train) and abs(got[0][1] - np.logaddexp(0, z).sum()) < 1e-4 and abs(got[0][2] - pull.sum()) < 1e-4
    assert np.allclose(got[0][3], [sum(p for p, f in zip(pull, lists, strict=True) if k in f) for k in range(40)], atol=1e-4)


def test_whole_gradients_lower_the_risk(spark, docs_of):
    rows, labels = corpus(400)
    docs = docs_of(rows)
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), max_unlabelled=20)
    kept, make = model.weights != 0, T.Featuriser(T.BITS)
    toxic = [np.array([f for f in make(t) if kept[f]]) for (i, t), (_, _, y) in zip(rows, labels, strict=True) if y and zlib.crc32(str(i).encode()) % 5]
    every = T.reduced(docs.where(~T.held_out(F.col("doc_id"))).select("text"), kept, T.BITS)

    def risk(m):
        n, loss, _, _ = T.unlabelled_sums(every, m.weights[kept].astype(np.float64), m.bias)
        return T.nnpu_parts(np.array([m.margin(f) for f in toxic]), loss / n, m.prior)[0]

    start = T.Model(np.zeros_like(model.weights), -1.0, T.BITS, model.prior)
    assert risk(T.refine(start, toxic, every, kept, 3)) < risk(start)


def test_results_take_the_place_of_kept_columns(spark, docs_of):
    got = T.score(docs_of([(1, "a")]).withColumn("score", F.lit("x")), T.Model(np.zeros(1 << 4, np.float32), 0.0, 4), ["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "predicted"] and got.first()["score"] == 0.5
