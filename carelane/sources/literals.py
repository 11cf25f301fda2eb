"""Literal sources."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

# All tables down to SEED_USERS, in their natural order.
TIME_SLOTS = ["09:00", "09:30", "10:00", "10:30", "11:00", "11:30", "14:00", "14:30", "15:00", "15:30", "16:00", "16:30", "17:00", "17:30"]
APPOINTMENT_TYPES = ["General Consultation", "Follow-up Visit", "Emergency Consultation", "Routine Check-up", "Specialist Consultation"]
SPECIALTY_FILTERS = ["cardiology", "dermatology", "neurology", "orthopedics", "pediatrics", "psychiatry", "general"]
LANDING = {"user": "/dashboard", "doctor": "/doctor-dashboard", "admin": "/admin-dashboard"}

DOCTORS = [
    (1, "Dr. Sarah Johnson", "Cardiologist", "15 years", 4.9, "https://images.unsplash.com/photo-1559839734-2b71ea197ec2?w=300&h=300&fit=crop&crop=face", "Available", "$150", "Harvard Medical School", ["English", "Spanish"]),
    (2, "Dr. Michael Chen", "Neurologist", "12 years", 4.8, "https://images.unsplash.com/photo-1612349317150-e413f6a5b16d?w=300&h=300&fit=crop&crop=face", "Available", "$180", "Johns Hopkins University", ["English", "Mandarin"]),
    (3, "Dr. Emily Rodriguez", "Pediatrician", "10 years", 4.9, "https://images.unsplash.com/photo-1594824388748-d7115d0d8ce1?w=300&h=300&fit=crop&crop=face", "Busy", "$120", "Stanford Medical School", ["English", "Spanish", "French"]),
    (4, "Dr. James Wilson", "Orthopedic Surgeon", "18 years", 4.7, "https://images.unsplash.com/photo-1582750433449-648ed127bb54?w=300&h=300&fit=crop&crop=face", "Available", "$200", "Mayo Clinic Medical School", ["English"]),
    (5, "Dr. Lisa Thompson", "Dermatologist", "8 years", 4.8, "https://images.unsplash.com/photo-1543228806-8b0c8dd31bdb?w=300&h=300&fit=crop&crop=face", "Available", "$130", "UCLA Medical Center", ["English", "German"]),
    (6, "Dr. Robert Kumar", "Psychiatrist", "14 years", 4.9, "https://images.unsplash.com/photo-1507003211169-0a1dd7228f2d?w=300&h=300&fit=crop&crop=face", "Available", "$160", "Columbia University", ["English", "Hindi", "Gujarati"]),
]
PATIENTS = [
    (1, "John Smith", 45, "Male", "+1 (555) 123-4567", "john.smith@email.com", "2024-01-15", "Hypertension", "Active"),
    (2, "Maria Garcia", 32, "Female", "+1 (555) 234-5678", "maria.garcia@email.com", "2024-01-18", "Diabetes Type 2", "Active"),
    (3, "David Johnson", 28, "Male", "+1 (555) 345-6789", "david.johnson@email.com", "2024-01-20", "Anxiety", "Follow-up"),
    (4, "Sarah Williams", 55, "Female", "+1 (555) 456-7890", "sarah.williams@email.com", "2024-01-12", "Arthritis", "Active"),
]
USERS = [
    (1, "Alice Cooper", "alice.cooper@email.com", "Patient", "2023-06-15", "Active"),
    (2, "Bob Wilson", "bob.wilson@email.com", "Patient", "2023-08-22", "Active"),
    (3, "Carol Davis", "carol.davis@email.com", "Patient", "2023-09-10", "Inactive"),
    (4, "Daniel Brown", "daniel.brown@email.com", "Patient", "2023-11-05", "Active"),
]
APPOINTMENTS = [
    (1, "John Smith", "Dr. Sarah Johnson", "2024-01-25", "10:00 AM", "Consultation", "Confirmed"),
    (2, "Maria Garcia", "Dr. Michael Chen", "2024-01-26", "2:30 PM", "Follow-up", "Pending"),
    (3, "David Johnson", "Dr. Robert Kumar", "2024-01-27", "11:15 AM", "Therapy Session", "Confirmed"),
]
MESSAGES = [
    (1, "Dr. Sarah Johnson", "Hello! How are you feeling today?", "2024-01-23T10:30:00", True),
    (2, "You", "Hi Doctor, I'm feeling much better after taking the medication.", "2024-01-23T10:32:00", False),
    (3, "Dr. Sarah Johnson", "That's wonderful to hear! Please continue with the current dosage and let me know if you experience any side effects.", "2024-01-23T10:35:00", True),
    (4, "You", "Sure, I will. When should I schedule my next appointment?", "2024-01-23T10:37:00", False),
    (5, "Dr. Sarah Johnson", "Let's schedule it for next week. I'll have my assistant coordinate with you for the best time.", "2024-01-23T10:40:00", True),
]
SEED_USERS = [
    ("Dr. Rakesh Kumar", "rakesh.k@gmail.com", "doctor"),
    ("Dr. Sarah Johnson", "sarah.johnson@gmail.com", "doctor"),
    ("John Smith", "john.smith@gmail.com", "user"),
    ("Admin User", "admin@gmail.com", "admin"),
]

#: Rows and types of each table.
SHAPES = {
    "doctors": (DOCTORS, "id int, name string, specialization string, experience string, rating double, image string, availability string, fee string, education string, languages array<string>"),
    "patients": (PATIENTS, "id int, name string, age int, gender string, phone string, email string, last_visit date, condition string, status string"),
    "users": (USERS, "id int, name string, email string, role string, join_date date, status string"),
    "appointments": (APPOINTMENTS, "id int, patient_name string, doctor_name string, date date, time string, type string, status string"),
    "messages": (MESSAGES, "id int, sender string, message string, timestamp timestamp, is_doctor boolean"),
    "seed_users": (SEED_USERS, "name string, email string, role string"),
    "time_slots": ([(k, s) for k, s in enumerate(TIME_SLOTS)], "position int, slot string"),
    "appointment_types": ([(k, s) for k, s in enumerate(APPOINTMENT_TYPES)], "position int, type string"),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    """A literal table with its explicit types: dates and timestamps parsed once, here."""
    rows, ddl = SHAPES[name]
    kinds = [c.split()[1] for c in ddl.split(", ")]
    parse = {"date": date.fromisoformat, "timestamp": datetime.fromisoformat}
    return spark.createDataFrame([tuple(parse.get(k, lambda v: v)(v) for k, v in zip(kinds, r, strict=True)) for r in rows], ddl)
