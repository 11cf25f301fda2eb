"""What the screens show, as plans: directory, dashboards, contacts, history, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelane.functions.text import joined_name
from carelane.functions.times import clock, date_part, date_time
from carelane.functions.values import case, fixed, is_even, null_default, or_default, share_floor
from carelane.operators.predicates import active, all_of, available, between_two, least_rating, on_day, online, optional_contains, overdue, search
from carelane.operators.relations import concatenated, first_by, is_member, labelled_counts, last_messages, pair_key


def doctor_search(doctors: DataFrame, details: DataFrame, term: str = "", specialty: str | None = None, rating: str | None = None, availability: str | None = None, seed: int | None = None) -> DataFrame:
    """Doctors (id, name) with their details (user_id, ...) that pass all filters given, with shown texts."""
    columns = ["id", "specialization", "experience", "availability", "rating", "reviews", "location"]
    # Only the first details row of a doctor is shown: it is picked before the join, none is gathered.
    first = first_by(details.select("user_id", F.struct(*columns).alias("__one")), ["user_id"], [F.col("__one")])
    rows = doctors.join(first, F.col("id") == F.col("user_id"), "left").drop("user_id")
    one = F.col("__one")
    rows = rows.where(all_of(search(term, F.col("name"), one["specialization"]), optional_contains(one["specialization"], specialty), least_rating(one["rating"], rating), available(F.col("id"), availability, seed)))
    return rows.select(
        "id",
        F.concat(F.lit("Dr. "), "name").alias("title"),
        or_default(one["specialization"], "Specialist").alias("specialty"),
        null_default(one["experience"], F.concat(one["experience"].cast("string"), F.lit(" years")), "Experience not specified").alias("experience"),
        fixed(or_default(one["rating"], 4.5, 0.0), 1).alias("rating"),
        or_default(one["reviews"], "No reviews yet").alias("reviews"),
        or_default(one["location"], "Remote Available").alias("location"),
        or_default(one["availability"], "Available today").alias("availability"),
        is_even(F.col("id")).alias("even"),
    )


def doctor_counts(appointments: DataFrame, doctor: int, today: str, now: Column, confirmed: str = "confirmed") -> DataFrame:
    """One row of a doctor's counts in one pass: patients, today, pending reviews, confirmed."""
    mine = appointments.where(F.col("doctor_id") == doctor)
    return mine.agg(
        F.count_distinct("user_id").alias("patients"),
        F.count_if(on_day(F.col("appointment_date"), today)).alias("today"),
        F.count_if(F.col("status") == confirmed).alias("confirmed"),
        F.count_if(overdue(F.col("status"), F.col("appointment_date"), now, confirmed)).alias("pending"),
    )


def doctor_dashboard(appointments: DataFrame, messages: DataFrame, doctor: int, today: str, now: Column, confirmed: str = "confirmed") -> DataFrame:
    """A doctor's counts as rows (label, value); unread messages come from one more aggregation."""
    counts = doctor_counts(appointments, doctor, today, now, confirmed)
    unread = messages.where((F.col("receiver_id") == doctor) & (F.col("is_read") == F.lit(False))).agg(F.count("*").alias("unread"))
    labels = labelled_counts(counts, {"patients": "Total Patients", "today": "Today's Appointments", "pending": "Pending Reviews"})
    return labels.unionByName(labelled_counts(unread, {"unread": "New Messages"}))


def todays_schedule(appointments: DataFrame, doctor: int, today: str) -> DataFrame:
    """A doctor's appointments of a day with their defaults."""
    mine = appointments.where((F.col("doctor_id") == doctor) & on_day(F.col("appointment_date"), today))
    status = F.col("status")
    return mine.select("id", "user_id", or_default(F.col("appointment_type"), "Consultation").alias("type"), or_default(F.col("appointment_time"), "9:00 AM").alias("time"), or_default(status, "Pending").alias("status"), case(status, {"confirmed": "green", "pending": "orange"}, "red").alias("colour"))


def patient_directory(appointments: DataFrame, people: DataFrame, doctor: int, order: list[str], term: str = "") -> DataFrame:
    """A doctor's distinct patients (id, name, ...) that match a search, with visits and the last of them."""
    mine = appointments.where(F.col("doctor_id") == doctor)
    visits = mine.groupBy("user_id").agg(F.count("*").alias("visits"), F.max_by("appointment_date", F.struct("appointment_date", *order)).alias("last_visit"))
    text = [F.col(c) for c in ("name", "email") if c in people.columns]
    return people.where(search(term, *text)).join(visits, F.col("id") == F.col("user_id")).drop("user_id")


def contact_list(appointments: DataFrame, doctors: DataFrame, messages: DataFrame, user: int, seed: int | None = None) -> DataFrame:
    """A patient's doctors, each once, with specialty, simulated presence and the latest message of the pair.

    One pass instead of a request for each appointment; ids are compared as unordered pairs.
    """
    ids = appointments.where((F.col("user_id") == user) & F.col("doctor_id").isNotNull()).select("doctor_id").distinct()
    mine = messages.where((F.col("sender_id") == user) | (F.col("receiver_id") == user))
    last = last_messages(mine)
    pairs = ids.join(doctors, F.col("doctor_id") == F.col("id")).drop("id").select("*", *pair_key(F.lit(user).cast("long"), F.col("doctor_id")))
    joined = pairs.join(last.select("a", "b", "message", "ts"), ["a", "b"], "left")
    return joined.select("doctor_id", or_default(F.col("name"), "Unknown Doctor").alias("name"), or_default(F.col("specialization"), "General Medicine").alias("specialty"), online(F.col("doctor_id"), seed).alias("online"), or_default(F.col("message"), "No messages yet").alias("last_message"), F.coalesce(clock(F.col("ts")), F.lit("Start chat")).alias("time"))


def history(messages: DataFrame, a: int, b: int) -> DataFrame:
    """Messages between two people, oldest first, with whether the first of them sent it."""
    mine = messages.where(between_two(F.col("sender_id"), F.col("receiver_id"), a, b))
    return mine.select("id", (F.col("sender_id") == a).alias("is_own"), "message", "ts").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("id"))


def formatted_appointments(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Appointments with their doctor's name (first match), specialty, date text, fixed time and type."""
    one = first_by(doctors, ["id"], [F.col("name")]).select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("specialty").alias("__specialty"))
    rows = appointments.join(one, F.col("doctor_id") == F.col("__id"), "left")
    return rows.select("id", F.coalesce(F.concat(F.lit("Dr. "), "__name"), F.lit("Unknown Doctor")).alias("doctor"), or_default(F.col("__specialty"), "Specialist").alias("specialty"), date_time(F.col("created_at")).alias("date"), F.lit("12:00 PM").alias("time"), or_default(F.col("status"), "pending").alias("type"))


def admin_users(doctors: DataFrame, patients: DataFrame, k: int = 4) -> DataFrame:
    """The first k of doctors then patients: name, role by membership among doctors, status, join date."""
    head = concatenated(doctors, patients).orderBy("src", "id").limit(k)
    rows = is_member(head, "id", doctors, "id", "is_doctor")
    return rows.select("id", joined_name(F.col("name")).alias("name"), F.when(F.col("is_doctor"), "Doctor").otherwise("Patient").alias("role"), F.when(active(F.col("is_active")), "Active").otherwise("Pending").alias("status"), F.coalesce(date_part(F.col("created_at")), F.lit("N/A")).alias("join_date"))


def admin_counts(users: DataFrame, doctors: DataFrame) -> DataFrame:
    """Users, doctors, the share of sessions that counts as active, and the fixed score, as rows (label, value)."""
    n = users.agg(F.count("*").alias("users"))
    counts = n.select(F.explode(F.array(F.struct(F.lit("Total Users").alias("label"), F.col("users").cast("string").alias("value")), F.struct(F.lit("Active Sessions").alias("label"), share_floor(F.col("users"), 70).cast("string").alias("value")), F.struct(F.lit("Security Score").alias("label"), F.lit("98%").alias("value")))).alias("x")).select("x.*")
    d = doctors.agg(F.count("*").cast("string").alias("value")).select(F.lit("Doctors").alias("label"), "value")
    return counts.unionByName(d)


def patient_counts(appointments: DataFrame, messages: DataFrame, user: int, pending: str = "pending") -> DataFrame:
    """A patient's appointments, pending ones and messages, as rows (label, value)."""
    mine = appointments.where(F.col("user_id") == user).agg(F.count("*").alias("n"), F.count_if(F.col("status") == pending).alias("p"))
    sent = messages.where(F.col("sender_id") == user).agg(F.count("*").alias("m"))
    return labelled_counts(mine, {"n": "Appointments", "p": "Pending"}).unionByName(labelled_counts(sent, {"m": "Messages"}))
