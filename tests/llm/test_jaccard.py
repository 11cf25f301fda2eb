import random
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from carelane.llm import components as C
from carelane.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(sets[i]), least.get(find(i), -1), links[i]) for i, (d, _) in enumerate(rows))


def near_copies(seed, n=120, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, words))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(15)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(rng.randint(0, words))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary) if rng.random() < 0.5 else f"new{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            w += passage
        rows.append((i * 3 % 1009, " ".join(w).upper() if rng.random() < 0.2 else "  ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(docs_of, seed, k, percent):
    rows = near_copies(seed)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in J.join(docs_of(rows), k, percent).collect())
    assert got == brute(rows, k, percent)


def test_large_groups_in_blocks(docs_of, monkeypatch):
    rows = near_copies(9, 80)
    monkeypatch.setattr(J, "TASK_SETS", 5)
    monkeypatch.setattr(J, "REFINE_SETS", 5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in J.join(docs_of(rows), 3, 80).collect())
    assert got == brute(rows, 3, 80)


def test_odd_rows(odd, clashing, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = J.join(clashing, 3, 90).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == [x for x in brute(rows, 3, 90) if x[0] != -1]
    assert J.join(none, 3, 90).count() == 0
    clash = odd.withColumnRenamed("lang", "node")
    kept = J.one_of_each_group(clash, 3, 90)
    assert kept.columns == clash.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11]
    assert J.one_of_each_group(none).count() == 0


def test_verify_counts_copies():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)
    same, apart = [[a[3:5], b[3:5]]] * 2, [[a[3:5], b[3:5]], [a[:1], b[9:]]]
    ask = lambda prefix, percent: tuple(x.tolist() for x in J.verify(np.array([5, 3]), np.array([2, 7]), [a, b], prefix, np.array([0, 0]), percent))
    assert ask(same, 80) == ([3, 3], [7, 2])
    assert ask(same, 82) == ([5, 3], [0, 0])
    # Candidates must share a prefix shingle under every order.
    assert ask(apart, 80) == ([5, 3], [0, 0])


@pytest.mark.parametrize("dense", [0, 0.04, 100])
def test_verify_against_all_pairs(monkeypatch, dense):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, 40).astype(np.uint64)) for _ in range(30)]
    copies, block = np.arange(1, 31), np.arange(30) % 2
    monkeypatch.setattr(J, "_DENSE", dense)
    monkeypatch.setattr(J, "_POSTINGS", 50)
    monkeypatch.setattr(J, "_COLUMNS", 7)
    inter = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    size = np.array([len(x) for x in sets])
    got = J.overlaps(sets)
    np.fill_diagonal(got, np.diag(inter))
    assert (got == inter).all()
    for percent, across in ((50, False), (62, True)):
        roots, links = J.verify(np.arange(30), copies, sets, [sets, sets], block, percent, across)
        linked = (100 * inter >= percent * (size[:, None] + size - inter)) & ~np.eye(30, dtype=bool)
        if across:
            linked &= block != block[:, None]
        assert links.tolist() == (linked * copies).sum(axis=1).tolist()
        least = np.arange(30)
        for _ in range(30):
            least = np.array([min([least[i], *least[linked[i]]]) for i in range(30)])
        assert roots.tolist() == least.tolist()


def test_chains_under_one_order_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(J, "REFINE_SETS", 3)
    # B and C each chain all nodes; a second look finds the pairs that share under both.
    rows = [(0, k, [k, k + 1]) for k in range(8)] + [(1, k, [100 + k // 2, 200 + (k + 1) // 2 if k % 4 < 3 else 300]) for k in range(8)]
    got = J.candidate_groups(spark.createDataFrame(rows, "tag int, node long, tokens array<long>"))
    groups = {}
    for r in got.collect():
        groups.setdefault((r["B"], r["C"]), set()).add(r["node"])
    assert sum(len(g) for g in groups.values()) == 8
    by = {tag: {k: set(t) for x, k, t in rows if x == tag} for tag in (0, 1)}
    for i in range(8):
        for j in range(i):
            if by[0][i] & by[0][j] and by[1][i] & by[1][j]:
                assert any({i, j} <= g for g in groups.values())


@pytest.mark.parametrize("block", [1, 40])
def test_frequencies_over_many_blocks(docs_of, monkeypatch, block):
    rows = near_copies(6, 60)
    monkeypatch.setattr(J, "BLOCK_SHINGLES", block)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in J.join(docs_of(rows), 3, 80).collect())
    assert got == brute(rows, 3, 80)


def test_repeated_ids_and_marks(spark, docs_of):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (2, "else"), (3, "else")]
    got = J.join(docs_of(rows), 3, 80, F.length("text")).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["n_links"]) for r in got) == brute(rows, 3, 80)
    assert sorted(r["mark"] for r in got) == sorted(len(t) for _, t in rows)
    kept = J.one_of_each_group(docs_of(rows), 3, 80).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, 1, 2]


def test_registered_query_against_its_sql(spark):
    import duckdb

    from carelane.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"select doc_id, n_shingles, component_id, n_links from ({ORACLE_SQL['op6_ngram_jaccard_join']})").fetchall()
    assert sorted(tuple(r) for r in J.op6_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()) == sorted(want)


def test_contraction_makes_a_row_a_node(spark, monkeypatch):
    """A large group that shares many shingles, over many partitions: each node leaves few tasks, whatever the joins."""
    nodes, tokens, made = 300, 40, []
    pairs = spark.range(nodes).select(F.lit(0).alias("tag"), (F.col("id") * 7).alias("node"), F.explode(F.sequence(F.lit(1), F.lit(tokens)).cast("array<long>")).alias("token"))
    contracted = C.contracted

    def counted(edges):
        made.append(Observation())
        return contracted(edges).observe(made[-1], F.count("*").alias("n"))

    monkeypatch.setattr(C, "contracted", counted)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        roots = J.sharing(pairs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in roots) == [(0, 7 * k, 0) for k in range(1, nodes)]
    assert [m.get["n"] for m in made] == [nodes - 1]
