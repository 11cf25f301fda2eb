import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from carelane.llm import conversation_repair as C

SPACES = " \t\n\x0b\x0c\r"
SHAPE = "conv_id long, turn long, role string, text string"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    """By conversation, in order, its rows after damage; the contract taken word by word."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        given = [" " if x is None else str(x) for x in (conv, turn)]
        hit = zlib.crc32(":".join(given).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit, repaired) over all sequences of edits: Dijkstra over whole sequences, in the order of cost and audit."""
    heap, settled = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, audit, i, shape, made = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            best = best or (cost, audit, made)
        # Of a shape only its end matters: what may follow, and whether it may end here.
        state = (i, shape[-1:], audit, cost)
        if state in settled or not re.fullmatch("s?(ua)*u?", shape):
            continue
        settled.add(state)
        for role in ("user", "assistant"):
            if cost < 40:
                heapq.heappush(heap, (cost + 5, audit + "I", i, shape + role[0], (*made, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, shape, made))
            if found[i] in ("", "truncated"):
                more = 5 * (found[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, shape + (role[:1] or "?"), (*made, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, shape + to[0], (*made, (to, text))))
    return best


def want(rows):
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, made = cheapest(rows, found)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }


def check(got, rows):
    expected = {c: want(own) for c, own in damage(rows).items()}
    assert sorted(map(str, [r["conv_id"] for r in got])) == sorted(map(str, {r[0] for r in rows}))
    for r in got:
        assert {f: r[f] for f in FIELDS} == expected[r["conv_id"]], r["conv_id"]


def made_up(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Fine!", " ", "", "Why?  \n", "so be it", "\x0b.", "é…", None, "x. y"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unit", "User"]
    return [(c if c % 17 else None, rng.choice([t, t, t, t + 1, None]), rng.choice(roles[: 3 + c % 8]), rng.choice(texts[: 2 + c % 10])) for c in range(conversations) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_search_over_all_edits(spark, seed):
    rows = made_up(seed, 90, 7)
    df = spark.createDataFrame(rows, SHAPE).repartition(5).withColumns({c: F.lit("x") for c in ("live", "kind", "fault", "n", "col", "hit", "rest", "behind", "a.b")})
    got = C.repair(df).collect()
    check([r for r in got if r["conv_id"] is not None], [r for r in rows if r[0] is not None])
    assert len([r for r in got if r["conv_id"] is None]) == 1


def test_registered_query_against_search(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/conversations.parquet").to_pydict()
    check(C.op13_conversation_repair(spark, sf).collect(), list(zip(*(t[c] for c in ("conv_id", "turn", "role", "text")), strict=True)))


def live(spark, rows):
    return spark.createDataFrame([(*r, True) for r in rows], SHAPE + ", live boolean")


@pytest.mark.parametrize(
    ("roles", "audit", "cost"),
    [("", "", 0), ("ua", "KK", 0), ("sua", "KKK", 0), ("s", "D", 2), ("u", "D", 2), ("uu", "KR", 1), ("au", "RR", 2), ("uaa", "KDK", 2), ("aaa", "DRK", 3), ("suaua", "KKKKK", 0), ("ss", "RR", 2), ("usa", "KDK", 2)],
)
def test_known_repairs(spark, roles, audit, cost):
    full = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(1, i, full[r], f"text {i}.") for i, r in enumerate(roles)]
    if not rows:
        got = C.repaired(spark.createDataFrame([(1, 0, None, None, False)], SHAPE + ", live boolean")).collect()
        assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
        return
    expected = want([r[1:] for r in rows])
    got = C.repaired(live(spark, rows)).first()
    assert {f: got[f] for f in FIELDS} == expected
    assert (got["audit"], got["cost"]) == (expected["audit"], cost)


def test_long_conversation_and_long_text(spark):
    n = 30_001
    rows = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.when(F.col("id") == 5, F.repeat(F.lit("word "), 200_000)).otherwise(""), F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(True).alias("live"))
    got = C.repaired(rows.repartition(9)).collect()
    assert len(got) == 1 and (got[0]["cost"], got[0]["illegal"], got[0]["gaps"]) == (2, 0, 0)
    assert len(got[0]["audit"]) == n and got[0]["audit"].count("D") == 1


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")] + [(1, 1, "assistant", "Yes.")] * 5_000
    got = C.repaired(live(spark, rows).repartition(7)).first()
    assert (got["duplicate"], got["cost"], got["audit"]) == (5_000, 10_000, "KK" + "D" * 5_000)
    assert C.repair(spark.createDataFrame([], SHAPE)).collect() == []


def test_one_shuffle_and_bounded_states(spark):
    plan = C.repair(spark.createDataFrame(made_up(4, 5, 5), SHAPE))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    scan, codes = C.Scan(), {C.END}
    for _ in range(20):
        codes |= {scan.step(c, k)[0] for c in list(codes) for k in range(9)}
    assert len(codes) < 200 and all(max(C.vector_of(c)) <= 15 and c < 1 << 16 for c in codes)
    assert all(scan.step(c, k)[0] in codes for c in codes for k in range(9))


def test_types_of_ids(spark):
    rows = spark.createDataFrame([("x", 1, "user", "A."), ("x", 2, "assistant", "B."), (None, 1, "user", "C.")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r for r in C.repair(rows).collect()}
    assert set(got) == {"x", None}


def test_sql_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = made_up(9, 200, 8)
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = C.op13_conversation_repair(spark, str(tmp_path)).select("conv_id", *FIELDS).collect()
    names = ", ".join(["conv_id", *FIELDS])
    want = con.sql(f"select {names} from ({C.SQL})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
