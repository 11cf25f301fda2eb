"""Committed tables, lookups, the text index and bucketed tables."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from carelane.operators import writes
from carelane.operators.commits import CommittedTable, ConflictError, lookup_layout
from carelane.operators.predicates import search
from carelane.operators.relations import pair_key
from carelane.operators.text_index import TextIndex
from carelane.sources import tables

PEOPLE = "name string, email string, role string"
PLAIN = "id bigint, x string"


def in_threads(*jobs):
    failed = []

    def guarded(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=guarded, args=(job,)) for job in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed


def test_concurrent_inserts_of_one_email_leave_one_row(spark, tmp_path):
    """Writers that both look before either has written, and others that insert different people meanwhile."""
    users = [writes.committed(spark, str(tmp_path), "users") for _ in range(4)]
    gate = threading.Barrier(4)

    def inserter(k):
        new = spark.createDataFrame([("Same", "same@x", "user"), (f"Own {k}", f"own{k}@x", "user"), (f"Own {k}", f"own{k}@x", "user")], PEOPLE)
        staged = users[k]._staged

        def meet(rows, high, first=[True]):  # noqa: B006
            if first:
                first.clear()
                gate.wait(60)
            return staged(rows, high)

        users[k]._staged = meet
        return lambda: users[k].insert_absent(new, "email")

    in_threads(*[inserter(k) for k in range(4)])
    rows = users[0].read().collect()
    assert sorted(r["email"] for r in rows) == [*(f"own{k}@x" for k in range(4)), "same@x"]
    assert sorted(r["id"] for r in rows) == [1, 2, 3, 4, 5]
    # What lost writers had written is gone.
    assert len([n for n in os.listdir(f"{tmp_path}/users") if n.startswith(("data-", "_draft-"))]) == len(users[0].version().folders)


def test_ids_of_concurrent_appends(spark, tmp_path):
    def appender(k):
        return lambda: CommittedTable(spark, f"{tmp_path}/t", PLAIN).append(spark.range(500).repartition(7).select(F.concat(F.lit(f"{k}-"), "id").alias("x")))

    in_threads(*[appender(k) for k in range(5)])
    rows = CommittedTable(spark, f"{tmp_path}/t", PLAIN).read().collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 2501))
    assert len({r["x"] for r in rows}) == 2500


def test_given_ids_stay_and_new_ones_follow(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t", PLAIN)
    assert t.append(spark.createDataFrame([(70, "a"), (None, "b")], PLAIN)) == 2
    t.append(spark.createDataFrame([(None, "c")], PLAIN))
    got = {r["x"]: r["id"] for r in t.read().collect()}
    assert got["a"] == 70 and sorted(got.values()) == sorted({*got.values()}) and min(got["b"], got["c"]) > 70


def test_empty_appends_and_tables(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t", PLAIN)
    assert t.read().collect() == [] and t.append(spark.createDataFrame([], PLAIN)) == 0
    assert t.version().number == 0 and t.insert_absent(spark.createDataFrame([(None, None)], PLAIN), "x") == 0
    t.compact()
    t.vacuum(hours=0)
    assert t.append(spark.createDataFrame([(None, "a")], PLAIN), ("s", 0)) == 1
    assert t.append(spark.createDataFrame([], PLAIN), ("s", 1)) == 0
    assert t.version().batches == {"s": 1}


def test_a_batch_is_added_once(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t", PLAIN)
    rows = spark.createDataFrame([(None, "a")], PLAIN)
    assert [t.append(rows, ("s", k)) for k in (0, 0, 1, 0, 1)] == [1, 0, 1, 0, 0]
    assert t.append(rows, ("other", 0)) == 1
    assert t.read().count() == 3


def test_a_writer_that_dies_before_its_commit_leaves_the_table_as_it_was(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t", PLAIN)
    t.append(spark.createDataFrame([(None, "a")], PLAIN))
    t._staged(spark.createDataFrame([(None, "lost")], PLAIN), 1)
    assert [r["x"] for r in t.read().collect()] == ["a"]
    assert t.append(spark.createDataFrame([(None, "b")], PLAIN)) == 1
    t.vacuum(keep_versions=1, hours=0)
    assert len([n for n in os.listdir(f"{tmp_path}/t") if n.startswith("data-")]) == 2
    assert sorted((r["id"], r["x"]) for r in t.read().collect()) == [(1, "a"), (2, "b")]


def test_a_table_that_others_always_change_first_is_an_error(spark, tmp_path):
    t = CommittedTable(spark, f"{tmp_path}/t", PLAIN, tries=2)
    t._commit = lambda version: False
    with pytest.raises(ConflictError):
        t.append(spark.createDataFrame([(None, "a")], PLAIN))


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    t, other = (CommittedTable(spark, f"{tmp_path}/t", PLAIN) for _ in range(2))
    for k in range(4):
        t.append(spark.createDataFrame([(None, f"{k}")], PLAIN))
    commit = t._commit

    def late(version):
        t._commit = commit
        other.append(spark.createDataFrame([(None, "late")], PLAIN))
        return commit(version)

    t._commit = late
    t.compact(files=2)
    assert len(t.version().folders) == 2
    assert sorted((r["id"], r["x"]) for r in t.read().collect()) == [(1, "0"), (2, "1"), (3, "2"), (4, "3"), (5, "late")]


# Lookups


def rows_scanned(df):
    """Rows that the scans of a query have handed on: those of row groups that were not skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName().endswith("AdaptiveSparkPlanExec"):
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_lookups_read_few_row_groups(spark, tmp_path):
    n = 20_000
    people = spark.range(n).select(F.col("id"), F.concat(F.lit("p"), F.xxhash64("id"), F.lit("@example.com")).alias("email"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("name"))
    lookup_layout(people, f"{tmp_path}/t", ["id"], ("email",), files=2, distinct=2_000, group_bytes=300_000)
    table = spark.read.parquet(f"{tmp_path}/t")
    wanted = people.where("id = 777").first()
    for condition in (F.col("id") == 777, F.col("email") == wanted["email"]):
        found = table.where(condition)
        assert [tuple(r) for r in found.collect()] == [tuple(wanted)]
        assert rows_scanned(found) < n / 4
    assert rows_scanned(table.where(F.col("name") == wanted["name"])) == n


# The text index


def test_search_by_index_is_search(spark, tmp_path):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcÄß é") for _ in range(rng.randrange(0, 12))) for _ in range(400)]
    rows = [(i if i % 50 else None, x if i % 9 else None, "".join(rng.choice("abXY") for _ in range(6))) for i, x in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string, other string")
    index = TextIndex(spark, str(tmp_path), "id bigint, name string, other string", "id", ["name", "other"])
    index.add(df.where("id % 2 = 0 or id is null"))
    # Another object goes on with it; one batch comes twice.
    index = TextIndex(spark, str(tmp_path), "id bigint, name string, other string", "id", ["name", "other"])
    for _ in range(2):
        index.add(df.where("id % 2 = 1"), ("odd", 0))
    keyed = df.where("id is not null")
    for term in ["abc", "ABC", "äß ", "bab", "aaaa", "", "a", "xy", "é", "bcba", "xyxyx", "nowhere to be found", *(n[2:7] for n in names[:8])]:
        want = sorted(r["id"] for r in keyed.where(search(term, F.col("name"), F.col("other"))).collect())
        assert sorted(r["id"] for r in index.search(term).collect()) == want, term
    index.compact()
    assert sorted(r["id"] for r in index.search("bab").collect()) == sorted(r["id"] for r in keyed.where(search("bab", F.col("name"), F.col("other"))).collect())
    assert len(index.table.version().folders) == len(index.postings.version().folders) == 1


def test_postings_without_their_rows_name_nothing(spark, tmp_path):
    """A writer that ends between the two commits, and does it again later."""
    index = TextIndex(spark, str(tmp_path), PLAIN, "id", ["x"])
    rows = spark.createDataFrame([(1, "zebra")], PLAIN)
    append, index.table.append = index.table.append, lambda *_: 0
    index.add(rows)
    assert index.search("zebra").collect() == [] and index.candidates("zebra").count() == 1
    index.table.append = append
    assert index.add(rows) == 1
    assert [tuple(r) for r in index.search("ZEB").collect()] == [(1, "zebra")]


def test_appends_keep_the_layout(spark, tmp_path):
    n = 20_000
    people = spark.range(n).select("id", F.concat(F.lit("p"), F.xxhash64("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4)).alias("x")).repartition(3)
    t = CommittedTable(spark, f"{tmp_path}/t", PLAIN, layout={"order": ["id"], "bloom": ("x",), "distinct": 2_000, "group_bytes": 300_000})
    t.append(people.where("id < 15000"))
    t.append(people.where("id >= 15000"))
    wanted = people.where("id = 777").first()
    for condition in (F.col("id") == 777, F.col("x") == wanted["x"]):
        found = t.read().where(condition)
        assert [tuple(r) for r in found.collect()] == [tuple(wanted)] and rows_scanned(found) < n / 4


def test_the_index_reads_less_than_the_scan(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 256), 4), F.when(F.col("id") % 5_000 == 7, F.lit("zebra")).otherwise("")).alias("x"))
    index = TextIndex(spark, str(tmp_path), PLAIN, "id", ["x"], files=4, group_bytes=100_000)
    index.add(rows)
    found = index.search("ZEBRA")
    assert sorted(r["id"] for r in found.collect()) == [7, 5_007, 10_007, 15_007]
    assert rows_scanned(found) < 20_000 / 2
    assert rows_scanned(index.candidates("ZEBRA")) < index.postings.read().count() / 10


def test_many_candidates_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("carelane.operators.text_index.PUSHED_KEYS", 10)
    index = TextIndex(spark, str(tmp_path), PLAIN, "id", ["x"])
    index.add(spark.range(300).select("id", F.concat(F.lit("name "), "id").alias("x")))
    assert index.search("NAME 1").count() == 111


# Bucketed tables


def test_bucketed_tables_are_joined_where_they_lie(spark, tmp_path):
    db = tables.database(spark, "carelane_test", f"file://{tmp_path}/db")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mail = spark.range(500).select("id", (F.col("id") % 7).alias("sender_id"), (F.col("id") % 5).alias("receiver_id"))
        paired = mail.select("*", *pair_key(F.col("sender_id"), F.col("receiver_id")))
        tables.save_bucketed(spark.range(50).withColumnRenamed("id", "person"), db, "people", ["person"], 4)
        tables.save_bucketed(mail, db, "visits", ["sender_id"], 4)
        tables.save_bucketed(paired, db, "messages", ["a", "b"], 4)
        tables.save_bucketed(paired.select("a", "b").distinct(), db, "pairs", ["a", "b"], 4)
        joined = spark.sql(f"select person, count(*) n from {db}.people join {db}.visits on person = sender_id group by person")
        pairs = spark.sql(f"select a, b, max(id) from {db}.messages join {db}.pairs using (a, b) group by a, b")
        for df in (joined, pairs):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert sum(r["n"] for r in joined.collect()) == 500
        assert len(os.listdir(f"{tmp_path}/db/visits")) <= 2 * (4 + 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop database carelane_test cascade")


def test_buckets_grow_in_number(spark, monkeypatch):
    """Twice the rows are twice the buckets, and a bucket of the query's holds no more than before."""
    from carelane.plans.registry import QUERIES

    monkeypatch.setattr(tables, "BUCKET_ROWS", 500)
    assert [tables.buckets_for(spark.range(n), spark.range(10)) for n in (10, 2_000, 10_000, 20_000)] == [4, 4, 20, 40]
    saved, save = [], tables.save_bucketed
    monkeypatch.setattr(tables, "save_bucketed", lambda rows, db, name, keys, buckets: (saved.append((db, name, buckets)), save(rows, db, name, keys, buckets)))
    small = "/root/testdata/sf0.001"
    QUERIES["bucketed_join"](spark, small)
    assert [b for _, _, b in saved] == [-(-tables.star(spark, small, "lineitem").count() // 500)] * 2
    assert spark.table(f"{saved[1][0]}.{saved[1][1]}").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 4 * 500


def test_files_grow_in_number(spark, tmp_path, monkeypatch):
    """No task sorts more of the postings, rows or a compacted table as these grow."""
    monkeypatch.setattr("carelane.operators.commits.FILE_ROWS", 400)

    def most(table):
        by_file = [r["count"] for r in table.read().groupBy(F.input_file_name()).count().collect()]
        return max(by_file), len(by_file)

    index = TextIndex(spark, str(tmp_path), PLAIN, "id", ["x"])
    index.add(spark.range(1_000).select("id", F.concat(F.lit("name "), F.col("id") + 10_000).alias("x")))
    for _ in range(2):
        for table, rows in ((index.table, 1_000), (index.postings, 8_000)):
            size, files = most(table)
            assert size < 2 * 400 and files >= rows / 400 / 2
        assert index.search("NAME 101").count() == 100
        index.compact()
