import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from carelane.llm import packing, source_mixing, toxicity
from carelane.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import DOCS
from tests.llm.test_jaccard import brute as all_pairs
from tests.llm.test_mixing_packing import brute_mix
from tests.llm.test_substring import brute as all_units


def test_names():
    assert [k.split("_")[0] for k in QUERIES] == ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"]
    assert not set(ORACLE_SQL) - set(QUERIES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]


def write(spark, folder, rows, labels):
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    spark.createDataFrame(full, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(200)]
    plain = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else f"u{rng.randrange(10**9)}" for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, plain(80) + (" zorgscum vexfool zorgscum vexfool" if bad else ""), f"s{i % 3 if i % 2 else 0}"))
        labels.append((i, 1, int(bad)))
    base = rows[1][1]
    passage = plain(70)
    rows += [(500, base, "s0"), (501, base + " extra", "s1"), (502, plain(30) + " " + passage + " " + plain(30), "s1"), (503, plain(30) + " " + passage + " " + plain(30), "s2"), (504, None, "s2"), (505, "", None)]
    write(spark, tmp_path, rows, labels)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == DOCS.names
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    toxic = {i for i, _, t in labels if t}
    assert len(ids["toxicity"] & toxic) < 0.1 * len(toxic)
    assert len({i for i, _, _ in rows} - toxic - ids["toxicity"]) <= 3
    assert {1, 502, 503, 504, 505} <= ids["ngram_jaccard_join"]
    assert not {500, 501} & ids["ngram_jaccard_join"]
    assert len(ids["ngram_jaccard_join"]) == len(ids["toxicity"]) - 2
    texts = {r["doc_id"]: r["text"] for r in seen["substring_dedup"]}
    middle = " ".join(passage.split()[12:58])
    assert middle in texts[502]
    assert middle not in texts[503]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["substring_dedup"] if r["text"] is not None)
    assert ids["source_mixing"] == ids["substring_dedup"]
    words = sum(len((r["text"] or "").split()) for r in seen["source_mixing"])
    assert sum(r["length"] for r in seen["best_fit_packing"]) == words
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == len(seen["best_fit_packing"])


def rejected_by_brute_force(model, texts):
    """Places of the texts that the model's margins and their share reject; the weights are the model's, the rest is plain."""

    def margin(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        found = {zlib.crc32(x.encode()) % (1 << toxicity.BITS) for w in words for x in ("w" + w, "4" + w[:4], "5" + w[:5])}
        return model.bias + sum(float(model.weights[f]) for f in found)

    margins, bins = [margin(t) for t in texts], {}
    for z in margins:
        bins.setdefault(math.floor(max(-40.0, min(40.0, z)) * toxicity.BINS_A_UNIT), []).append(z)
    ordered = [bins[b] for b in sorted(bins, reverse=True)]
    above = [sum(map(len, ordered[:k])) for k in range(len(ordered) + 1)]
    at = min(range(len(above)), key=lambda k: (abs(above[k] - model.prior * len(margins)), k))
    assert 0 < at < len(ordered)
    return {i for i, z in enumerate(margins) if z > max(ordered[at])}


def test_stages_in_turn_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept. Texts are shorter than a passage window, so units are lines,
    paragraphs and texts."""
    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 8))) for _ in range(500)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.3 else " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 5))) for _ in range(260)]
    rows = [(i, t + (" zorgscum vexfool" if i % 6 == 0 else ""), f"s{i % 3 if i % 2 else 0}") for i, t in enumerate(texts)]
    rows += [(1000 + k, rows[k][1] if k % 2 else rows[k][1] + " v1", "s2") for k in range(0, 120, 3)] + [(2000, None, "s1"), (2001, "", None)]
    write(spark, tmp_path, rows, [(i, 1, int(i % 6 == 0)) for i in range(200)])
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")

    def kept(name):
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    by_id = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    out = rejected_by_brute_force(model, [t for _, t, _ in rows])
    docs = kept("toxicity")
    assert by_id(docs) == {r[0]: r[1] for k, r in enumerate(rows) if k not in out} and out

    now = by_id(docs)
    classes = all_pairs(sorted(now.items()), 5, 80)
    first = {}
    for d, n, least, _ in classes:
        first[d if n == 0 else least] = min(first.get(d if n == 0 else least, d), d)
    docs = kept("ngram_jaccard_join")
    assert by_id(docs) == {d: now[d] for d in first.values()} and len(first) < len(now) - 10

    want = all_units(sorted(by_id(docs).items()))
    words = {d: len((t or "").split()) for d, t in by_id(docs).items()}
    docs = kept("substring_dedup")
    assert by_id(docs) == {d: text for d, (text, _, gone) in want.items() if not gone or gone < words[d]}
    assert any(gone for _, _, gone in want.values())

    tokens = Counter()
    for r in docs.collect():
        tokens[r["source"]] += len((r["text"] or "").split())
    sums = spark.createDataFrame([(str(x), n) for x, n in tokens.items()], "source string, tokens long")
    exponent = source_mixing.solve_exponent(sums, source_mixing.MAX_REPEAT, None)
    given = [n for n in tokens.values() if n]
    budget = sum(n**exponent for n in given) / max(given) ** (exponent - 1)
    times = Counter(d for d, _ in brute_mix(docs, exponent, budget, source_mixing.BLOCK_TOKENS).elements())
    docs = kept("source_mixing")
    assert Counter(r["doc_id"] for r in docs.collect()) == times and max(times.values()) == 2

    named = sorted({(r["doc_id"], r["text"]) for r in docs.collect()})
    cluster = {d: None if text is None else least for (d, text), (_, _, least, _) in zip(named, all_pairs(named, 5, 80), strict=True)}
    docs = kept("best_fit_packing")
    packed, bins = Counter(), {}
    for r in docs.collect():
        packed[r["doc_id"]] += r["length"]
        assert r["cluster"] == cluster[r["doc_id"]]
        bins.setdefault(r["bin"], []).append(r)
    assert {d: packed[d] for d in times} == {d: times[d] * len((t or "").split()) for d, t in named}
    for own in bins.values():
        assert sum(r["length"] for r in own) <= packing.CAPACITY
        for kind in ("source", "cluster"):
            there = [r[kind] for r in own if r[kind] is not None]
            assert len(there) == len(set(there))


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    plain = odd.where("doc_id is null or doc_id <> 10")
    long = spark.createDataFrame([(20, " ".join(f"n{k}" for k in range(40_000)), "en", None, 1)], DOCS)
    clash = {c: F.lit(7) for c in ("mix", "dedup", "row", "mark", "node", "__margin", "__row", "__rank", "h", "block", "a.b")}
    docs = plain.unionByName(long).withColumn("row_number", F.lit(1)).withColumns(clash)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.where("mix = 7 and dedup = 7 and `a.b` = 7").count() == now.count(), name
    ids = [r["doc_id"] for r in now.collect()]
    # The smaller source is repeated by mixing, each of its rows as often.
    assert {i for i in ids if i is not None} == {1, 2, 3, 4, 5, 6, 7, 9, 11, 20}
    assert ids.count(20) == 1 and ids.count(9) == ids.count(1) and ids.count(None) == 2 * ids.count(1)
    packed = stage_last = corpus_pipeline.run(spark, str(tmp_path))
    pieces = packed.where("doc_id = 20").collect()
    assert sum(r["length"] for r in pieces) == 40_000 and len(pieces) == 40
    assert {r["doc_id"] for r in stage_last.collect()} == set(ids)


def test_run_keeps_only_its_result(spark, tmp_path):
    write(spark, tmp_path, [(k, f"some text {k} of its own", "s") for k in range(20)], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 20 and out.stored_at
    assert out.select("doc_id").distinct().count() == 20


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
