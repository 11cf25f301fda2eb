import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from carelane.llm import packing as P
from carelane.llm import source_mixing as M


def sized(counts):
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * (i % 7 + 1)), source))
            i += 1
    return rows


@pytest.mark.parametrize("limit", [1.0, 2.0, 3.5])
def test_mixture_keeps_to_limit_and_budgets(docs_of, limit):
    rows = sized({"a": 300, "b": 100, "c": 40, None: 12})
    got = M.mix(docs_of(rows), max_repeat=limit, block_tokens=60).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    seen, real, rep = defaultdict(set), Counter(), {}
    for r in got:
        key = (r["doc_id"], r["mix"]["epoch"])
        assert key not in seen[r["source"]]
        seen[r["source"]].add(key)
        real[r["source"]] += len(r["text"].split())
        rep[r["source"]] = r["mix"]["repetition"]
    assert {d for s in seen.values() for d, _ in s} == {i for i, _, _ in rows}
    assert max(rep.values()) <= limit + 1e-6
    assert max(rep.values()) / min(rep.values()) > limit * 0.999
    for s, k in tokens.items():
        assert rep[s] * k - 8 < real[s] <= rep[s] * k + 1e-6
        # Every epoch but the last holds every document.
        whole = math.floor(rep[s])
        assert all(sum(1 for _, e in seen[s] if e == x) == sum(1 for r in rows if r[2] == s) for x in range(whole))


def entropy(tokens, a):
    w = [t**a / sum(x**a for x in tokens) for t in tokens]
    return -sum(x * math.log(x) for x in w if x)


@pytest.mark.parametrize("few", [100_000, 0])
def test_entropy_target(spark, monkeypatch, few):
    monkeypatch.setattr(M, "FEW_SOURCES", few)
    tokens = (1000, 100, 10)
    totals = spark.createDataFrame([*zip("abc", tokens, strict=True), ("d", 0)], "source string, tokens long")
    assert entropy(tokens, 1) < 0.36
    # A target above the shares' own entropy flattens them, one below it sharpens them.
    for target in (0.9, 0.3, 0.05):
        a = M.solve_exponent(totals, None, target)
        assert abs(entropy(tokens, a) - target) < 1e-5
        assert (a > 1) == (target < 0.35)
    assert M.solve_exponent(totals, None, 5.0) == 0.0
    assert M.solve_exponent(totals.limit(0), 2.0, 0.5) == 0.0
    with pytest.raises(ValueError, match="repetition"):
        M.solve_exponent(totals, 2.0, 0.05)
    with pytest.raises(ValueError, match="exponent"):
        M.solve_exponent(spark.createDataFrame([("a", 10), ("b", 10)], "source string, tokens long"), None, 0.5)
    # Limit and target together: the one that asks for more wins.
    limit = M.solve_exponent(totals, 2.0, None)
    assert abs(100 ** (1 - limit) - 2.0) < 1e-5
    assert M.solve_exponent(totals, 2.0, 0.9) == limit
    assert M.solve_exponent(totals, 50.0, 0.5) == pytest.approx(M.solve_exponent(totals, None, 0.5))


def brute_mix(docs, exponent, budget, block_tokens):
    """(doc_id, epoch) of all documents, from the hashes of rows alone."""
    plain = [r.asDict() for r in docs.select("doc_id", "source", M.word_count(F.col("text")).alias("n"), M.row_hash().alias("h")).collect()]
    tokens = Counter()
    for r in plain:
        tokens[r["source"]] += r["n"]
    z = sum(t**exponent for t in tokens.values() if t)
    times = {s: (t ** (exponent - 1) * budget / z if t else 1.0) for s, t in tokens.items()}
    if budget is None:
        raise ValueError
    parts = {s: max(1, math.ceil(t / block_tokens)) for s, t in tokens.items()}
    rows = [(r["doc_id"], r["source"], r["n"], r["h"], parts[r["source"]], math.floor(round(times[r["source"]], 9))) for r in plain]
    placed = docs.sparkSession.createDataFrame(rows, "doc_id long, source string, n long, h long, parts int, full int").withColumn("block", M._block(F.col("h"), F.col("parts")))
    placed = placed.withColumn("bo", M._block_order(F.col("source"), F.col("full"), F.col("block"))).withColumn("do", M._doc_order(F.col("h"), F.col("full"))).collect()
    out = Counter()
    for s, t in tokens.items():
        full = math.floor(round(times[s], 9))
        left = math.floor((round(times[s], 9) - full) * t)
        mine = [r for r in placed if r["source"] == s]
        for r in mine:
            out.update((r["doc_id"], e) for e in range(full))
        done = left <= 0
        for _, block in sorted({(r["bo"], r["block"]) for r in mine}):
            own = [r for r in mine if r["block"] == block]
            if done:
                break
            if sum(r["n"] for r in own) <= left:
                left -= sum(r["n"] for r in own)
                out.update((r["doc_id"], full) for r in own)
                done = left <= 0
                continue
            done = True
            for order in sorted({r["do"] for r in own}):
                same = [r for r in own if r["do"] == order]
                if sum(r["n"] for r in same) > left:
                    break
                left -= sum(r["n"] for r in same)
                out.update((r["doc_id"], full) for r in same)
    return out


@pytest.mark.parametrize(("budget", "bits"), [(700, 12), (1500, 2), (4000, 1)])
def test_budgets_against_brute_force(docs_of, monkeypatch, budget, bits):
    monkeypatch.setattr(M, "RANGE_BITS", bits)
    rows = sized({"a": 300, "b": 100, "c": 40, None: 12}) + [(900 + k, "same row of five words", "b") for k in range(6)] + [(950, None, "d"), (951, "", "a")]
    rows += [rows[5]] * 4
    docs = docs_of(rows)
    got = M.mix(docs, max_repeat=2.0, budget_tokens=budget, block_tokens=60).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    sums = docs.sparkSession.createDataFrame([(str(s), n) for s, n in tokens.items()], "source string, tokens long")
    want = brute_mix(docs, M.solve_exponent(sums, 2.0, None), budget, 60)
    assert Counter((r["doc_id"], r["mix"]["epoch"]) for r in got) == want
    spent = sum(len((r["text"] or "").split()) for r in got)
    assert budget - 60 < spent <= budget


def brute_best_fit(rows, capacity):
    bins, out = [], {}
    pieces = [(r, k, min(capacity, n - k), s, c) for r, n, s, c in rows for k in range(0, max(n, 1), capacity)]
    for r, k, n, s, c in sorted(pieces, key=lambda p: -p[2]):
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"]) and (capacity > b["used"] or n == 0 and b["zero"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "s": set(), "c": set(), "zero": True})
        b = bins[i]
        out[(r, k)] = (i, b["used"])
        b["used"] += n
        b["zero"] = n == 0
        b["s"].add(s)
        b["c"].add(c)
    return out


def test_best_fit_against_brute_force():
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 3, 10, 40, 99, 100, 101, 250]) + rng.randrange(20), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, 1, 2, 3, i])) for i in range(300)]
    got = {(r, start): (b, offset) for r, _, start, _, b, offset in P.pack_rows(rows, 100)}
    want = brute_best_fit(rows, 100)
    lengths = {(r, s): n for r, _, s, n, _, _ in P.pack_rows(rows, 100)}
    assert sum(lengths.values()) == sum(n for _, n, _, _ in rows)
    positive = {k for k, n in lengths.items() if n}
    assert {k: got[k] for k in positive} == {k: want[k] for k in positive}


def check(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r)
    for rows in bins.values():
        assert sum(r["length"] for r in rows) <= capacity
        for kind in ("source", "cluster"):
            known = [r[kind] for r in rows if r[kind] is not None]
            assert len(known) == len(set(known))
        at = 0
        for r in sorted(rows, key=lambda r: (r["place"], r["length"])):
            assert r["place"] == at
            at += r["length"]


def test_packing_is_whole_and_keeps_conflicts(docs_of):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), f"s{i % 5 if i % 3 else 0}") for i in range(300)] + [(900, "copy of it", "x"), (901, "copy of it", "y")]
    got = P.pack_documents(docs_of(rows), capacity=64, shard_docs=50).collect()
    check(got, 64)
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(t.split()) for i, t, _ in rows}


def test_odd_rows(odd, none):
    clash = odd.withColumns({c: F.lit(1) for c in ("row", "length", "cluster", "shard", "key", "bin", "place", "__text")})
    for docs in (clash,):
        got = P.pack_documents(docs, capacity=64).collect()
        check(got, 64)
        assert sum(r["length"] for r in got) == odd.select(F.sum(M.word_count(F.col("text")))).first()[0]
    assert {r["cluster"] for r in got if r["doc_id"] == 1} == {None}
    assert P.pack_documents(none).count() == 0
    clash = odd.withColumnRenamed("lang", "block").withColumn("h", F.lit(1))
    mixed = M.mix(clash)
    assert mixed.drop("mix").columns == clash.columns
    assert mixed.count() == odd.count()
    assert M.mix(none).count() == 0


def test_null_texts_of_several_sources_share_a_bin(docs_of):
    got = P.pack_documents(docs_of([(i, None, f"s{i}") for i in range(4)])).collect()
    assert len({r["bin"] for r in got}) == 1


def test_near_copies_are_one_cluster_and_share_no_sequence(spark, docs_of, tmp_path):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words), " ".join([*words[:59], "other"]), " ".join(words).upper(), "  ".join(words)]
    rows = [(i, t, f"s{i}") for i, t in enumerate(near)] + [(None, near[0], "s8"), (9, " ".join(f"x{k}" for k in range(60)), "s9"), (9, near[1], "s10")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op4_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted(r["source"] for r in got) == sorted(s for _, _, s in rows)
    check(got, P.CAPACITY)
    cluster = {r["source"]: r["cluster"] for r in got}
    alike = {"s0", "s1", "s2", "s3", "s8", "s10"}
    assert len({cluster[s] for s in alike}) == 1 and cluster["s9"] != cluster["s0"]
    assert len({r["bin"] for r in got if r["source"] in alike}) == len(alike)
