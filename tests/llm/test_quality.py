import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelane.llm import idfilter as I
from carelane.llm import quality_rules as Q
from carelane.llm.idfilter import id_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["a", "b", "c", "#x", "\n", "é\x85"]), max_size=60).map(" ".join))
def test_statistics(text):
    assert Q.statistics(text) == brute(text)


def test_junk_goes_and_clean_text_stays(spark, docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    clean = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(160)]
    junk = [(1000 + i, " ".join(rng.choice(words) + "%%%" for _ in range(60))) for i in range(40)]
    docs = docs_of(clean + junk)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in (clean + junk)[::2]], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(docs, Q.train(docs, labels)).collect()}
    assert all(kept[i] for i, _ in clean)
    assert not any(kept[i] for i, _ in junk)


def plain_counts(texts):
    out = Counter()
    for t in texts:
        b = (t or "").encode()
        for k in range(len(b) - 3):
            x = 0
            for c in b[k : k + 4]:
                x = (x * 257 + c) % 2**32
            out[(x * 2654435761) % 2**32 >> 16] += 1
    return out


def test_scores_and_threshold_against_brute_force(spark, docs_of, odd):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst%") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words[: 60 + 90 * (i % 2)]) for _ in range(rng.randint(5, 60)))) for i in range(120)]
    docs = docs_of(rows).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    labels = spark.createDataFrame([(i, i % 2 ^ 1, 0) for i in range(0, 90)] + [(2, 1, 0), (2, 1, 1), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw, good = plain_counts(t for _, t in plain), plain_counts(t for i, t in plain if i is not None and i < 90 and i % 2 == 0)
    share = sum(good.values()) / sum(raw.values())
    score = {}
    for i, t in plain:
        own = plain_counts([t])
        score[i] = sum(n * math.log((good[b] + Q.SMOOTH) / (raw[b] * share + Q.SMOOTH)) for b, n in own.items()) / max(1, sum(own.values()))
    got = Q.judge(docs, Q.train(docs, labels)).where("doc_id is not null").collect()
    assert all(abs(r["score"] - score[r["doc_id"]]) < 1e-9 for r in got)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= Q.THRESHOLD) for r in got)
    assert len({r["kept"] for r in got}) == 2


def test_the_filter_lets_every_id_pass(spark):
    ids = spark.createDataFrame([(k * 7919 - 50_000,) for k in range(20_000)], "doc_id long")
    made = id_filter(ids)
    inside = np.array([k * 7919 - 50_000 for k in range(20_000)])
    assert made.may_have(inside).all()
    others = inside + 3
    assert made.may_have(others).mean() < 0.03
    assert not id_filter(ids.limit(0)).may_have(others).any()


def test_a_full_filter_changes_no_count(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"text number {i % 17}") for i in range(300)] + [(None, "no id"), (5, "text again")])
    good = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    want = Q.counts_and_trusted(docs, good)
    monkeypatch.setattr(I, "LEAST_BITS", 64)
    monkeypatch.setattr(I, "MOST_BITS", 64)
    got = Q.counts_and_trusted(docs, good)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert got[0].sum() == sum(len(f"text number {i % 17}") - 3 for i in range(0, 300, 3))


def test_counts_are_whole(docs_of):
    docs = docs_of([(1, "abcdabcd"), (2, None), (3, "abc")])
    assert Q.gram_counts(docs.select("text")).sum() == 5


def test_odd_rows(spark, odd, clashing, none):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(clashing, Q.train(clashing, labels)).collect()
    assert sorted((r["doc_id"] or -1, *[r[c] for c in Q._STATS]) for r in got) == sorted((r["doc_id"] or -1, *brute(r["text"])) for r in odd.collect())
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert Q.judge(none, Q.train(none, labels)).count() == 0
