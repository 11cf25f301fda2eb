"""Declared tables, with the nullable columns that the screens read beside them."""

from __future__ import annotations

from pyspark.sql.types import StructType

#: The declared tables, then (after the bar) columns that only the screens know.
DDL = {
    "users": "id bigint, name string, email string, password string, role string, created_at timestamp, is_active boolean",
    "appointments": "id bigint, user_id bigint, doctor_id bigint, status string, created_at timestamp, appointment_date timestamp, appointment_type string, appointment_time string",
    "messages": "id bigint, sender_id bigint, receiver_id bigint, message string, timestamp timestamp, is_read boolean",
    "doctor_details": "id bigint, user_id bigint, specialization string, qualification string, experience int, availability string, rating double, reviews string, location string, image_url string",
    "admin_logs": "id bigint, admin_id bigint, timestamp timestamp",
    "doctor_logs": "id bigint, doctor_id bigint, timestamp timestamp",
}
#: Values that a person's role takes.
ROLES = ("user", "doctor", "admin")


def schema_of(name: str) -> StructType:
    """Explicit schema of a declared table; nothing is inferred from files."""
    return StructType.fromDDL(DDL[name])
