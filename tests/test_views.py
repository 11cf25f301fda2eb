from datetime import datetime

from pyspark.sql import functions as F

from carelane.plans import views
from carelane.streaming import messages as S

DETAILS = "id long, user_id long, specialization string, experience int, availability string, rating double, reviews string, location string"


def test_doctor_search_defaults(spark):
    doctors = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, None)], "id long, name string")
    details = spark.createDataFrame([(9, 1, "Heart", 0, None, 0.0, None, None)], DETAILS)
    got = {r["id"]: r for r in views.doctor_search(doctors, details).collect()}
    assert (got[1]["specialty"], got[1]["experience"], got[1]["rating"]) == ("Heart", "0 years", "4.5")
    assert (got[2]["specialty"], got[2]["experience"], got[2]["location"]) == ("Specialist", "Experience not specified", "Remote Available")
    assert len(got) == 3
    assert [r["id"] for r in views.doctor_search(doctors, details, "heart").collect()] == [1]
    assert [r["id"] for r in views.doctor_search(doctors, details, "", specialty="HEA", rating="4.5").collect()] == [1]
    assert views.doctor_search(doctors, details, "", rating="4.6").count() == 0


def test_contacts(spark):
    appts = spark.createDataFrame([(5, 1), (5, 1), (5, 2), (5, None), (6, 1)], "user_id long, doctor_id long")
    doctors = spark.createDataFrame([(1, "Ann", "Heart"), (2, None, None)], "id long, name string, specialization string")
    mail = spark.createDataFrame([(1, 5, 1, "old", datetime(2024, 1, 1)), (2, 1, 5, "new", datetime(2024, 1, 2, 14, 30))], "id long, sender_id long, receiver_id long, message string, ts timestamp")
    got = {r["doctor_id"]: tuple(r)[1:] for r in views.contact_list(appts, doctors, mail, 5).collect()}
    assert got == {1: ("Ann", "Heart", True, "new", "02:30 PM"), 2: ("Unknown Doctor", "General Medicine", False, "No messages yet", "Start chat")}


def test_appointments_of_unknown_doctors(spark):
    day = datetime(2024, 1, 2, 9)
    appts = spark.createDataFrame([(1, 7, day, "confirmed"), (2, 8, day, None), (3, None, None, "")], "id long, doctor_id long, created_at timestamp, status string")
    doctors = spark.createDataFrame([(7, "Ann", None), (7, "Zoe", "Heart")], "id long, name string, specialty string")
    got = {r["id"]: tuple(r)[1:] for r in views.formatted_appointments(appts, doctors).collect()}
    assert got[1] == ("Dr. Ann", "Specialist", "1/2/2024, 9:00:00 AM", "12:00 PM", "confirmed")
    assert got[2] == ("Unknown Doctor", "Specialist", "1/2/2024, 9:00:00 AM", "12:00 PM", "pending")
    assert got[3] == ("Unknown Doctor", "Specialist", None, "12:00 PM", "pending")


def test_first_details_row_of_a_doctor(spark):
    doctors = spark.createDataFrame([(1, "Ann")], "id long, name string")
    details = spark.createDataFrame([(9, 1, "Late", 1, None, float("nan"), None, None), (4, 1, "First", 2, None, None, None, None), (5, None, "None", 1, None, None, None, None)], DETAILS)
    rows = views.doctor_search(doctors, details)
    assert [(r["specialty"], r["rating"]) for r in rows.collect()] == [("First", "4.5")]
    assert "CollectList" not in rows._jdf.queryExecution().toString() and "collect_list" not in rows._jdf.queryExecution().toString()
    nan = details.where("id = 9")
    assert [r["rating"] for r in views.doctor_search(doctors, nan, rating="4.6").collect()] == []
    assert [r["rating"] for r in views.doctor_search(doctors, nan, rating="4.5").collect()] == ["4.5"]


def test_schedule_and_counts(spark):
    day = datetime(2024, 1, 2, 9)
    appts = spark.createDataFrame([(1, 5, 7, "confirmed", day, None, None), (2, 6, 7, None, day, "Check", "10:00"), (3, None, 7, "pending", None, None, None)], "id long, user_id long, doctor_id long, status string, appointment_date timestamp_ntz, appointment_type string, appointment_time string")
    rows = {r["id"]: (r["type"], r["time"], r["status"], r["colour"]) for r in views.todays_schedule(appts, 7, "2024-01-02").collect()}
    assert rows == {1: ("Consultation", "9:00 AM", "confirmed", "green"), 2: ("Check", "10:00", "Pending", "red")}
    one = views.doctor_counts(appts, 7, "2024-01-02", F.expr("timestamp_ntz'2024-02-01 00:00:00'")).first()
    assert (one["patients"], one["today"], one["confirmed"], one["pending"]) == (2, 2, 1, 1)


def test_stream_has_each_message_once(spark, tmp_path):
    shape = "id long, sender_id long, receiver_id long, message string, timestamp timestamp"
    t = datetime(2024, 1, 1)
    users = spark.createDataFrame([(1, "Ann")], "id long, name string")

    def drop(rows):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(f"{tmp_path}/in")
        S.follow(S.with_names(S.live_messages(spark, f"{tmp_path}/in", 1, 2, schema=shape), users), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    drop([(1, 1, 2, "a", t), (2, 1, 3, "other", t)])
    drop([(1, 1, 2, "a", t), (3, 2, 1, "b", t)])
    got = sorted((r["id"], r["sender_name"], r["receiver_name"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "Ann", None), (3, None, "Ann")]


SHAPE = "id long, sender_id long, receiver_id long, message string, timestamp timestamp"


def ids_in(spark, path):
    return sorted(r["id"] for r in spark.read.schema(SHAPE).parquet(path).collect())


def test_late_messages_are_kept_and_repeats_are_not(spark, tmp_path):
    def drop(rows, **how):
        spark.createDataFrame(rows, SHAPE).write.mode("append").parquet(f"{tmp_path}/in")
        S.follow(S.live_messages(spark, f"{tmp_path}/in", 1, 2, schema=SHAPE, **how), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    drop([(1, 1, 2, "now", datetime(2024, 1, 20))])
    drop([(2, 2, 1, "a week late", datetime(2024, 1, 13)), (1, 1, 2, "now", datetime(2024, 1, 20))])
    drop([(3, 2, 1, "years late", datetime(2020, 1, 1)), (2, 2, 1, "a week late", datetime(2024, 1, 13)), (4, 2, 1, "no time", None)])
    assert ids_in(spark, f"{tmp_path}/out") == [1, 2, 3, 4]


def test_a_live_query_delivers_batches_until_stopped(spark, tmp_path):
    seen = []

    def put(*rows):
        spark.createDataFrame(list(rows), SHAPE).write.mode("append").parquet(f"{tmp_path}/in")

    put((1, 1, 2, "a", datetime(2024, 1, 1)))
    stream = S.live_messages(spark, f"{tmp_path}/in", 1, 2, schema=SHAPE)
    live = S.deliver(stream, lambda batch, k: seen.extend(r["id"] for r in batch.collect()), f"{tmp_path}/state", "50 milliseconds")
    live.processAllAvailable()
    assert (seen, live.isActive) == ([1], True)
    put((2, 2, 1, "b", datetime(2024, 1, 2)), (3, 1, 3, "other", datetime(2024, 1, 2)))
    live.processAllAvailable()
    assert sorted(seen) == [1, 2]
    live.stop()
    assert not live.isActive


def test_a_subscription_changes_and_comes_back(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame([(i, a, b, "x", datetime(2024, 1, 1)) for i, a, b in rows], SHAPE).write.mode("append").parquet(f"{tmp_path}/in")

    put((1, 1, 2), (2, 1, 3))
    one = S.Subscription(spark, f"{tmp_path}/in", str(tmp_path), "50 milliseconds", SHAPE)
    first = one.to(1, 2)
    first.processAllAvailable()
    second = one.to(3, 1)
    assert not first.isActive and second.isActive
    put((3, 2, 1), (4, 3, 1))
    second.processAllAvailable()
    one.to(2, 1).processAllAvailable()
    one.stop()
    assert one.query is None
    assert ids_in(spark, one.path(1, 2)) == [1, 3]
    assert ids_in(spark, one.path(3, 1)) == [2, 4]
