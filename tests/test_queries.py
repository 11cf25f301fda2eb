"""Every query with SQL gives what DuckDB gives over the same tables."""

import os

import duckdb
import pytest

from carelane.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def shown(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    quoted = [f'"{c}"' for c in columns]
    assert shown(got.select(*columns).collect()) == shown(want.select(*quoted).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_parsed_number_reads_whole_props(spark, tmp_path):
    rows = [(1, "x" * 250 + "42"), (2, "x" * 198 + "12345"), (3, "7"), (4, None), (5, "none")]
    events = spark.read.parquet(f"{SF}/events.parquet").limit(1).drop("event_id", "props")
    spark.createDataFrame(rows, "event_id long, props string").crossJoin(events).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["id"]: r["number"] for r in QUERIES["parsed_number"](spark, str(tmp_path)).collect()}
    assert got == {1: 42, 2: 12345, 3: 7, 4: None, 5: None}


@pytest.mark.parametrize("name", ["today_count", "month_count", "pending_reviews", "time_label", "date_labels", "parsed_time", "parsed_in_zone", "zoned_counts", "formatted_appointments", "contact_list", "doctor_dashboard", "time_slots"])
def test_query_in_another_session_zone(spark, duck, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
