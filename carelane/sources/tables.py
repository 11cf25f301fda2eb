"""Logical tables: declared tables in a folder, and their stand-ins in the synthetic star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import DDL, schema_of

#: Pairs of people in the stand-in for messages are (user, event modulo this).
RECEIVERS = 150


def declared(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A declared table as Parquet under a folder, with its explicit schema."""
    return spark.read.schema(schema_of(name)).parquet(f"{folder}/{name}")


def people(users: DataFrame, role: str) -> DataFrame:
    """The people of a role: doctors are role 'doctor', patients role 'user'."""
    return users.where(F.col("role") == role)


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(DDL)) -> None:
    """Temporary views for SQL: declared tables under a folder, and the role views ``doctors`` and ``patients``."""
    for name in names:
        declared(spark, folder, name).createOrReplaceTempView(name)
    if "users" in names:
        for view, role in (("doctors", "doctor"), ("patients", "user")):
            people(spark.table("users"), role).createOrReplaceTempView(view)


def database(spark: SparkSession, name: str, folder: str) -> str:
    """A catalog database whose tables lie under a folder; its name."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{folder}'")
    return name


#: Rows of one bucket: a task sorts, joins and groups them.
BUCKET_ROWS = 1_000_000


def buckets_for(*tables: DataFrame, least: int = 4) -> int:
    """Buckets for tables that are joined with each other, by the rows of the largest: more rows make more buckets and
    not larger ones. What is counted may be a stored table that has at least as many rows."""
    return max(least, -(-max(rows.count() for rows in tables) // BUCKET_ROWS))


def save_bucketed(rows: DataFrame, database: str, name: str, keys: list[str], buckets: int) -> None:
    """A table of a database, bucketed and sorted by keys: joins and groupings by all of them need no exchange.

    Tables that are to be joined need equally many buckets. Messages are bucketed by the unordered pair, as two
    columns (``relations.pair_key``).
    """
    # Dealt by the same keys first, so that there is a file a bucket and not one for each task.
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"`{database}`.`{name}`")


#: The keys that the tables of a database are bucketed by: people and what is theirs by the person, messages by the pair.
LAYOUT = {"users": ["id"], "appointments": ["user_id"], "messages": ["a", "b"], "doctor_details": ["user_id"], "admin_logs": ["admin_id"], "doctor_logs": ["doctor_id"]}


def publish(spark: SparkSession, name: str, folder: str, snapshots: dict[str, DataFrame], buckets: int | None = None) -> str:
    """Declared tables, as they are now, as bucketed tables of a catalog database, with the role views ``doctors`` and
    ``patients`` where there are users; the database's name. A table that is there already is replaced. Without a
    number of buckets it follows from the rows of the largest."""
    database(spark, name, folder)
    buckets = buckets or buckets_for(*snapshots.values())
    for table, rows in snapshots.items():
        if table == "messages":
            rows = rows.select("*", F.least("sender_id", "receiver_id").alias("a"), F.greatest("sender_id", "receiver_id").alias("b"))
        spark.sql(f"DROP TABLE IF EXISTS `{name}`.`{table}`")
        save_bucketed(rows, name, table, LAYOUT[table], buckets)
    if "users" in snapshots:
        for view, role in (("doctors", "doctor"), ("patients", "user")):
            spark.sql(f"CREATE OR REPLACE VIEW `{name}`.`{view}` AS SELECT * FROM `{name}`.users WHERE role = '{role}'")
    return name


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients: id, name, segment, balance."""
    return star(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def doctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as doctors: id, name, detail_id."""
    return star(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("detail_id"), F.col("s_acctbal").alias("balance"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as doctors' details: detail_id, specialization."""
    return star(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("detail_id"), F.col("n_name").alias("specialization"))


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as appointments of a patient (orderer) with a doctor (supplier)."""
    lines = star(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("doctor_id"), F.col("l_shipdate").alias("appointment_date"))
    orders = star(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages from their user to one of the first ``RECEIVERS`` numbers."""
    return star(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("sender_id"), (F.col("event_id") % RECEIVERS).alias("receiver_id"), F.col("event_type").alias("message"), "ts")
