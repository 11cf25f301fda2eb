"""Queries over the stand-in tables by name, each with DuckDB SQL that states its result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelane.functions import text as X
from carelane.functions import times as T
from carelane.functions import values as V
from carelane.operators import predicates as P
from carelane.operators import relations as R
from carelane.operators import writes
from carelane.operators.cardinality import at_most_one_row, exactly_one_row, head, is_empty, maybe_single, single, top
from carelane.operators.commits import CommittedTable, lookup_layout
from carelane.operators.text_index import TextIndex
from carelane.plans import views
from carelane.sources import literals, tables
from carelane.sources.person import session_rows, signed_in_rows
from carelane.sources.schema import schema_of
from carelane.streaming import messages as S
from carelane.streaming import sinks
from carelane.streaming.folders import work_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_APPT = """appt as (select l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey user_id, l.l_suppkey doctor_id, o.o_orderstatus status,
 o.o_orderdate created_at, l.l_shipdate appointment_date from lineitem l join orders o on l.l_orderkey = o.o_orderkey)"""
_MSG = "msg as (select event_id id, user_id sender_id, event_id % 150 receiver_id, event_type message, ts from events)"
_LAST = """lm as (select least(sender_id, receiver_id) a, greatest(sender_id, receiver_id) b, id, message, ts, row_number() over (
 partition by least(sender_id, receiver_id), greatest(sender_id, receiver_id) order by ts desc, id desc) rn from msg)"""


def _now():
    return F.expr("timestamp_ntz'1998-06-01 00:00:00'")


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _line_order(*columns: str) -> list[str]:
    return ["l_orderkey", "l_linenumber", "l_partkey", *columns]


# Scans, filters and projections


@query("select c_custkey as id, c_name as name from customer where c_mktsegment = 'BUILDING'")
def eq_filter(spark, d):
    return tables.patients(spark, d).where(F.col("segment") == "BUILDING").select("id", "name")


@query("select c_custkey as id, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer where c_custkey = 42")
def point_lookup(spark, d):
    return tables.patients(spark, d).where(F.col("id") == 42)


@query("select p_partkey as id, p_name as name from part where contains(lower(p_name), lower('RED')) or contains(lower(coalesce(nullif(p_brand, 'Brand#2'), '')), lower('RED')) or contains(lower(p_type), lower('RED'))")
def text_search(spark, d):
    """Some of three columns has the term: names (a red one), brands with nulls among them, types."""
    part = tables.star(spark, d, "part")
    brand = F.nullif(F.col("p_brand"), F.lit("Brand#2"))
    return part.where(P.search("RED", F.col("p_name"), brand, F.col("p_type"))).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("select c_custkey as id, c_name as name from customer where contains(lower(c_name), lower('BuIlD')) or contains(lower(c_mktsegment), lower('BuIlD'))")
def search_second_column(spark, d):
    """A term that only the second column has."""
    return tables.patients(spark, d).where(P.search("BuIlD", F.col("name"), F.col("segment"))).select("id", "name")


@query("select c_custkey as id from customer where c_acctbal >= try_cast('4.5' as double)")
def min_rating(spark, d):
    # A missing or zero rating counts as the default, here the limit's other side.
    return tables.patients(spark, d).where(P.least_rating(F.col("balance"), "4.5", 0.0)).select("id")


@query("select p_partkey as id, p_size from part where p_size >= 1 and contains(lower(p_type), 'promo') and coalesce(nullif(p_size / 10.0, 0.0), 4.5) >= 4.0 and p_partkey % 10 >= 3")
def optional_filters(spark, d):
    part = tables.star(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_type")
    keep = P.all_of(P.optional_contains(F.col("p_type"), "Promo"), P.optional_contains(F.col("p_type"), ""), P.least_rating(F.col("p_size") / F.lit(10.0), "4.0"), P.available(F.col("id"), "today"))
    return part.where(keep).select("id", "p_size")


@query(f"with {_MSG} select id, sender_id, receiver_id from msg where (sender_id = 17 and receiver_id = 139) or (sender_id = 139 and receiver_id = 17)")
def pair_filter(spark, d):
    return tables.messages(spark, d).where(P.between_two(F.col("sender_id"), F.col("receiver_id"), 17, 139)).select("id", "sender_id", "receiver_id")


@query("select conv_id, turn, role from conversations where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0")
def not_blank(spark, d):
    return tables.star(spark, d, "conversations").where(P.not_blank(F.col("text"))).select("conv_id", "turn", "role")


@query("select c_custkey as id from customer where c_name is not null and c_name <> '' and c_mktsegment is not null and c_mktsegment <> ''")
def required_fields(spark, d):
    return tables.patients(spark, d).where(P.all_given(F.col("name"), F.col("segment"))).select("id")


# Joins


@query("select n_nationkey as detail_id, count(s_suppkey) as n, min(s_suppkey) as first_id from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey")
def embed_many(spark, d):
    rows = R.embed_many(tables.details(spark, d), tables.doctors(spark, d).withColumnRenamed("detail_id", "owner"), "detail_id", "owner", "doctors", ["id"])
    return rows.select("detail_id", F.size("doctors").cast("long").alias("n"), V.element(F.col("doctors"), 0)["id"].alias("first_id"))


@query("""select n_nationkey as detail_id, coalesce(string_agg(s_suppkey, ',' order by s_suppkey), '') as first_ids from nation
 left join (select *, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier) on s_nationkey = n_nationkey and k <= 3 group by n_nationkey""")
def embed_first(spark, d):
    """Of many rows only the first three are embedded."""
    rows = R.embed_many(tables.details(spark, d), tables.doctors(spark, d).withColumnRenamed("detail_id", "owner"), "detail_id", "owner", "doctors", ["id"], 3)
    return rows.select("detail_id", F.array_join(F.transform("doctors", lambda x: x["id"].cast("string")), ",").alias("first_ids"))


@query(f"with {_APPT} select a.l_orderkey, a.l_linenumber, a.l_partkey, c.c_name as patient_name from appt a left join customer c on a.user_id = c.c_custkey where a.doctor_id = 7")
def embed_one(spark, d):
    mine = tables.appointments(spark, d).where(F.col("doctor_id") == 7)
    rows = R.embed_one(mine, tables.patients(spark, d), "user_id", "id", "patient", ["id", "name"])
    return rows.select(*_line_order(), F.col("patient.name").alias("patient_name"))


@query(f"with {_MSG} select m.id, s.c_name as sender_name, r.c_name as receiver_name from msg m left join customer s on m.sender_id = s.c_custkey left join customer r on m.receiver_id = r.c_custkey")
def embed_two(spark, d):
    people = tables.patients(spark, d)
    rows = R.embed_one(tables.messages(spark, d), people, "sender_id", "id", "sender", ["name"])
    rows = R.embed_one(rows, people, "receiver_id", "id", "receiver", ["name"])
    return rows.select("id", F.col("sender.name").alias("sender_name"), F.col("receiver.name").alias("receiver_name"))


@query(f"""with {_APPT} select a.l_orderkey, a.l_linenumber, a.l_partkey, s.s_name as doctor_name, n.n_name as specialization
 from appt a left join supplier s on a.doctor_id = s.s_suppkey left join nation n on s.s_nationkey = n.n_nationkey where a.user_id = 10""")
def embed_nested(spark, d):
    doctors = R.embed_many(tables.doctors(spark, d), tables.details(spark, d).withColumnRenamed("detail_id", "owner"), "detail_id", "owner", "doctor_details", ["specialization"])
    mine = tables.appointments(spark, d).where(F.col("user_id") == 10)
    rows = R.embed_one(mine, doctors, "doctor_id", "id", "doctor", ["name", "doctor_details"])
    return rows.select(*_line_order(), F.col("doctor.name").alias("doctor_name"), V.element(F.col("doctor.doctor_details"), 0)["specialization"].alias("specialization"))


@query("""with u as (select s_suppkey id, s_name as name from supplier union all select c_custkey, c_name from customer)
 select u.id, u.name, case when d.did is not null then 'Doctor' else 'Patient' end as role from u left join (select distinct s_suppkey did from supplier) d on u.id = d.did""")
def role_flag(spark, d):
    doctors = tables.doctors(spark, d).select("id", "name")
    rows = R.is_member(R.concatenated(doctors, tables.patients(spark, d).select("id", "name")), "id", doctors, "id", "is_doctor")
    return rows.select("id", "name", F.when(F.col("is_doctor"), "Doctor").otherwise("Patient").alias("role"))


@query("select c_custkey as id from customer c where not exists (select 1 from supplier s where s.s_suppkey = c.c_custkey)")
def anti_insert(spark, d):
    return R.insert_absent(tables.doctors(spark, d).select("id"), tables.patients(spark, d).select("id"), "id")


# Groups and windows


@query(f"with {_APPT} select distinct c.c_custkey as id, c.c_name as name from appt a join customer c on a.user_id = c.c_custkey where a.doctor_id = 7")
def distinct_patients(spark, d):
    ids = tables.appointments(spark, d).where(F.col("doctor_id") == 7).select("user_id").distinct()
    return tables.patients(spark, d).join(ids, F.col("id") == F.col("user_id"), "left_semi").select("id", "name")


@query(f"with {_MSG} select least(sender_id, receiver_id) as a, greatest(sender_id, receiver_id) as b, count(*) as n from msg group by 1, 2")
def pair_counts(spark, d):
    return tables.messages(spark, d).select(*R.pair_key(F.col("sender_id"), F.col("receiver_id"))).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"with {_MSG}, {_LAST} select a, b, id, message from lm where rn = 1")
def last_message(spark, d):
    return R.last_messages(tables.messages(spark, d)).select("a", "b", "id", "message")


@query(f"""with {_APPT} select user_id as id, any_value(c_name) as name, count(*) as visits, max(appointment_date) as last_visit
 from appt join customer on user_id = c_custkey where doctor_id = 7 group by user_id""")
def patient_directory(spark, d):
    people = tables.patients(spark, d).select("id", "name")
    return views.patient_directory(tables.appointments(spark, d), people, 7, _line_order())


@query(f"""with {_APPT}, r as (select user_id, appointment_date, l_orderkey, l_linenumber, row_number() over (partition by user_id order by appointment_date desc,
 l_orderkey desc, l_linenumber desc, l_partkey desc) rn from appt where doctor_id = 7) select user_id, cast(appointment_date as date) as day, l_orderkey from r where rn = 1""")
def last_visit(spark, d):
    mine = tables.appointments(spark, d).where(F.col("doctor_id") == 7)
    rows = R.first_by(mine, ["user_id"], [F.desc(c) for c in ("appointment_date", *_line_order())])
    return rows.select("user_id", F.col("appointment_date").cast("date").alias("day"), "l_orderkey")


@query(f"""with {_APPT}, r as (select doctor_id, l_orderkey, row_number() over (partition by doctor_id order by l_orderkey, l_linenumber, l_partkey) rn
 from appt where user_id = 10) select doctor_id, l_orderkey from r where rn = 1""")
def first_contact(spark, d):
    mine = tables.appointments(spark, d).where(F.col("user_id") == 10)
    return R.first_by(mine, ["doctor_id"], [F.asc(c) for c in _line_order()]).select("doctor_id", "l_orderkey")


@query(f"with {_APPT} select count(*) as n from appt where doctor_id = 7 and cast(appointment_date as date) = date '1996-10-13'")
def today_count(spark, d):
    mine = tables.appointments(spark, d).where((F.col("doctor_id") == 7) & P.on_day(F.col("appointment_date"), "1996-10-13"))
    return mine.agg(F.count("*").alias("n"))


@query(f"with {_APPT} select count(*) as n from appt where doctor_id = 7 and year(created_at) = 1998 and month(created_at) = 3")
def month_count(spark, d):
    mine = tables.appointments(spark, d).where((F.col("doctor_id") == 7) & T.same_month(F.col("created_at"), F.lit("1998-03-15").cast("date")))
    return mine.agg(F.count("*").alias("n"))


@query(f"with {_APPT} select count(*) as n from appt where doctor_id = 7 and status = 'F' and appointment_date < timestamp '1998-06-01 00:00:00'")
def pending_reviews(spark, d):
    mine = tables.appointments(spark, d).where((F.col("doctor_id") == 7) & P.overdue(F.col("status"), F.col("appointment_date"), _now(), "F"))
    return mine.agg(F.count("*").alias("n"))


@query(f"with {_APPT} select user_id, count(*) as n, count(*) filter (where status = 'P') as pending from appt group by user_id")
def cond_counts(spark, d):
    return tables.appointments(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "P").alias("pending"))


@query("select cast(floor(count(*) * 7 / 10) as bigint) as n from customer")
def floor_metric(spark, d):
    return tables.patients(spark, d).agg(F.count("*").alias("k")).select(V.share_floor(F.col("k"), 70).alias("n"))


@query(f"""with {_APPT}, k as (select count(distinct user_id) patients, count(*) filter (where cast(appointment_date as date) = date '1996-10-13') today,
 count(*) filter (where status = 'F') confirmed, count(*) filter (where status = 'F' and appointment_date < timestamp '1998-06-01 00:00:00') pending from appt where doctor_id = 7)
 select 'patients' as label, patients as value from k union all select 'today', today from k union all select 'confirmed', confirmed from k union all select 'pending', pending from k""")
def kpi_row(spark, d):
    counts = views.doctor_counts(tables.appointments(spark, d), 7, "1996-10-13", _now(), "F")
    return R.labelled_counts(counts, {c: c for c in ("patients", "today", "confirmed", "pending")})


@query(f"with {_MSG} select count(*) as unread from msg where receiver_id = 7 and id % 3 = 0")
def unread_count(spark, d):
    rows = tables.messages(spark, d).withColumn("is_read", F.col("id") % 3 != 0)
    return rows.where((F.col("receiver_id") == 7) & P.unread(F.col("is_read"))).agg(F.count("*").alias("unread"))


# Order, limits and sets


@query("select c_custkey as id, c_acctbal as balance from customer order by c_acctbal desc, c_custkey limit 4")
def topk(spark, d):
    return top(tables.patients(spark, d).select("id", "balance"), 4, "balance", "id")


@query("select s_suppkey as id, s_name as name from supplier order by s_suppkey limit 3")
def head_k(spark, d):
    return head(tables.doctors(spark, d).select("id", "name"), 3, F.asc_nulls_last("id"))


@query("select id, name, src from (select s_suppkey id, s_name as name, 0 src from supplier union all select c_custkey, c_name, 1 from customer) order by src, id limit 4")
def union_head(spark, d):
    both = R.concatenated(tables.doctors(spark, d).select("id", "name"), tables.patients(spark, d).select("id", "name"))
    return head(both, 4, F.col("src"), F.col("id"))


@query(f"with {_MSG} select id, sender_id = 17 as is_own, message, ts from msg where (sender_id = 17 and receiver_id = 139) or (sender_id = 139 and receiver_id = 17) order by ts, id")
def history_sorted(spark, d):
    return views.history(tables.messages(spark, d), 17, 139)


# Scalar functions


@query("select c_custkey as id, concat(upper(substring(lower(c_mktsegment), 1, 1)), substring(lower(c_mktsegment), 2)) as label from customer")
def capitalise(spark, d):
    return tables.patients(spark, d).select("id", X.capitalised(F.lower("segment")).alias("label"))


@query("select s_suppkey as id, array_to_string(list_transform(string_split(s_name, '#'), lambda x: x[1:1]), '') as initials from supplier")
def initials(spark, d):
    return tables.doctors(spark, d).select("id", X.initials(F.col("name"), "#").alias("initials"))


@query("select c_custkey as id, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Specialist') as specialty from customer")
def default_chain(spark, d):
    return tables.patients(spark, d).select("id", V.or_default(F.col("segment"), "Specialist", "BUILDING").alias("specialty"))


@query("select event_id as id, strftime(ts, '%I:%M %p') as clock, strftime(ts, '%Y-%m-%d') as day from events")
def time_label(spark, d):
    return tables.messages(spark, d).select("id", T.clock(F.col("ts")).alias("clock"), T.date_part(F.col("ts")).alias("day"))


@query("""select o_orderkey as id, strftime(o_orderdate, '%B ') || day(o_orderdate) || case when day(o_orderdate) in (1, 21, 31) then 'st' when day(o_orderdate) in (2, 22) then 'nd'
 when day(o_orderdate) in (3, 23) then 'rd' else 'th' end || strftime(o_orderdate, ', %Y') as label,
 strftime(o_orderdate, '%-m/%-d/%Y, %-I:%M:%S %p') as stamp from orders""")
def date_labels(spark, d):
    orders = tables.star(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), T.long_date(F.col("o_orderdate")).alias("label"), T.date_time(F.col("o_orderdate")).alias("stamp"))


@query("select p_partkey as id, array_to_string(list_transform(range(0, 5), lambda i: case when i < floor(p_size / 10.0) then '*' else '-' end), '') as stars from part")
def star_array(spark, d):
    filled = V.stars(F.col("p_size") / 10.0)
    return tables.star(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(filled, lambda x: F.when(x, "*").otherwise("-")), "").alias("stars"))


@query("""select c_custkey as id, case when c_custkey % 2 = 0 then 'even' else 'odd' end as parity, cast(c_custkey as varchar) as shown,
 case c_mktsegment when 'BUILDING' then '/dashboard' when 'MACHINERY' then '/doctor-dashboard' end as landing,
 case when c_custkey % 3 <> 1 then 's' else '' end as plural from customer""")
def small_functions(spark, d):
    landing = {"BUILDING": literals.LANDING["user"], "MACHINERY": literals.LANDING["doctor"]}
    return tables.patients(spark, d).select("id", F.when(V.is_even(F.col("id")), "even").otherwise("odd").alias("parity"), F.col("id").cast("string").alias("shown"), V.lookup(F.col("segment"), landing).alias("landing"), X.plural(F.col("id") % 3).alias("plural"))


@query("select event_id as id, try_cast(regexp_extract(props, '[0-9]+') as bigint) as number from events")
def parsed_number(spark, d):
    digits = F.regexp_replace("props", "^[^0-9]*", "")
    return tables.star(spark, d, "events").select(F.col("event_id").alias("id"), V.parse_int(digits).alias("number"))


@query("select c_custkey as id, try_cast(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1), '') as bigint) as number from (select c_custkey, case c_custkey % 4 when 0 then c_custkey || ' of ' || c_mktsegment when 1 then '  -' || c_custkey || 'px' when 2 then c_mktsegment || c_custkey else '' end v from customer)")
def leading_number(spark, d):
    """Whole numbers at the beginning of texts: with a rest, with spaces and a sign, with none, empty."""
    n = F.col("id").cast("string")
    kind = F.pmod("id", F.lit(4))
    text = F.when(kind == 0, F.concat(n, F.lit(" of "), "segment")).when(kind == 1, F.concat(F.lit("  -"), n, F.lit("px"))).when(kind == 2, F.concat("segment", n)).otherwise("")
    return tables.patients(spark, d).select("id", V.parse_int(text).alias("number"))


@query("select p_partkey as id, case when p_size / 20.0 - floor(p_size / 20.0) in (0.25, 0.75) then printf('%.1f', p_size / 20.0 + 0.01) else printf('%.1f', p_size / 20.0) end as shown from part")
def one_decimal(spark, d):
    """Twentieths with one decimal: 2.35 is below its tie in binary, 2.45 above, 2.25 is one and goes up."""
    return tables.star(spark, d, "part").select(F.col("p_partkey").alias("id"), V.fixed(F.col("p_size") / 20.0, 1).alias("shown"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 or c_acctbal = 0 then 4.5 else c_acctbal end as rating from customer")
def falsy_number(spark, d):
    """Null, zero and NaN take the default."""
    odd = F.when(F.col("id") % 6 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("balance"))
    return tables.patients(spark, d).select("id", V.or_default(odd, 4.5, 0.0).alias("rating"))


@query("select o_orderkey as id, case when o_orderkey % 2 = 0 then o_orderdate end as at from orders")
def parsed_time(spark, d):
    """Texts that are times, and texts that are none."""
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("string")).otherwise(F.concat("o_orderpriority", F.lit(" no time")))
    return tables.star(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.wall(T.parsed(text)).alias("at"))


@query("""select o_orderkey as id, case o_orderkey % 4 when 0 then date_trunc('day', o_orderdate) + interval 9 hour when 1 then o_orderdate
 when 2 then o_orderdate + interval 14 hour end as at from orders""")
def parsed_in_zone(spark, d):
    """A date alone is midnight in UTC, a reading is one of the person's zone, one with an offset has its own; shown in Tokyo."""
    at = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, at.cast("date").cast("string")).when(F.col("o_orderkey") % 4 == 1, at.cast("string")).when(F.col("o_orderkey") % 4 == 2, F.concat(at.cast("string"), F.lit("-05:00"))).otherwise(F.lit("soon"))
    return tables.star(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.wall(T.parsed(text, "Asia/Tokyo"), "Asia/Tokyo").alias("at"))


@query("""select user_id as id, count(*) filter (where cast(ts + interval 9 hour as date) = date '2024-01-12') as today,
 count(*) filter (where year(ts + interval 9 hour) = 2024 and month(ts + interval 9 hour) = 1) as this_month,
 min(strftime(ts + interval 9 hour, '%I:%M %p')) as least_clock from events group by user_id""")
def zoned_counts(spark, d):
    """Days, months and clocks of a zone, from stored readings of UTC."""
    rows, zone = tables.star(spark, d, "events"), "Asia/Tokyo"
    ts = F.col("ts")
    return rows.groupBy(F.col("user_id").alias("id")).agg(
        F.count_if(P.on_day(ts, "2024-01-12", zone)).alias("today"),
        F.count_if(T.same_month(ts, F.lit("2024-01-05").cast("date"), zone)).alias("this_month"),
        F.min(T.clock(T.wall(ts, zone, "timestamp_ntz"))).alias("least_clock"),
    )


@query("select o_orderkey as id, case o_orderstatus when 'F' then 'green' when 'P' then 'orange' else 'red' end as colour from orders")
def case_chain(spark, d):
    return tables.star(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.case(F.col("o_orderstatus"), {"F": "green", "P": "orange"}, "red").alias("colour"))


@query("select o_orderkey as id from orders where o_orderdate >= timestamp '1998-06-01 00:00:00'")
def bookable_days(spark, d):
    return tables.star(spark, d, "orders").where(P.bookable(F.col("o_orderdate"), _now())).select(F.col("o_orderkey").alias("id"))


@query("select c_custkey as id, c_custkey % 2 = 1 as online from customer")
def presence(spark, d):
    return tables.patients(spark, d).select("id", P.online(F.col("id")).alias("online"))


@query("select row_number() over (order by s_suppkey) - 1 as \"index\", s_suppkey as id, (row_number() over (order by s_suppkey) - 1) % 2 = 0 as even from (select s_suppkey from supplier order by s_suppkey limit 6)")
def row_index(spark, d):
    """A shown list with each row's place and whether it is even."""
    shown = head(tables.doctors(spark, d).select("id"), 6, F.asc("id"))
    return R.indexed(shown, [F.asc("id")]).select("index", "id", V.is_even(F.col("index")).alias("even"))


@query(f"with {_APPT} select user_id, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by user_id order by l_orderkey, l_linenumber, l_partkey) - 1 as place from appt where doctor_id = 7")
def index_in_group(spark, d):
    mine = tables.appointments(spark, d).where(F.col("doctor_id") == 7)
    return R.indexed(mine, [F.asc(c) for c in _line_order()], ["user_id"], "place").select("user_id", *_line_order(), "place")


# Rows that are asked for one by one


@query("select c_custkey as id, c_name as name from customer where c_custkey = 42")
def exactly_one(spark, d):
    rows = tables.patients(spark, d).where(F.col("id") == 42).select("id", "name")
    return spark.createDataFrame([single(rows)], rows.schema)


@query("select c_custkey as id, c_name as name from customer where c_custkey in (-1, 7)")
def at_most_one(spark, d):
    """One lookup that finds nobody and one that finds a row."""
    rows = tables.patients(spark, d).select("id", "name")
    found = [maybe_single(rows.where(F.col("id") == k)) for k in (-1, 7)]
    return spark.createDataFrame([r for r in found if r is not None], rows.schema)


@query("select c_custkey as id, c_name as name from customer where c_custkey in (42, 7)")
def one_in_plan(spark, d):
    """Exactly one and at most one as parts of a plan: nothing runs before the whole does."""
    rows = tables.patients(spark, d).select("id", "name")
    return exactly_one_row(rows.where("id = 42")).unionByName(at_most_one_row(rows.where("id = 7"))).unionByName(at_most_one_row(rows.where("id = -1")))


@query("select 'customers' as list, (select count(*) from customer) = 0 as empty union all select 'nobody', (select count(*) from customer where c_custkey < 0) = 0")
def empty_lists(spark, d):
    people = tables.patients(spark, d)
    return spark.createDataFrame([("customers", is_empty(people)), ("nobody", is_empty(people.where("id < 0")))], "list string, empty boolean")


# Declared tables, written and read back


_PEOPLE = """people as (select s_suppkey id, s_name as name, 'd' || s_suppkey || '@example.com' email, 'doctor' as role from supplier
 union all select c_custkey + 1000000, c_name, 'p' || c_custkey || '@example.com', 'user' from customer)"""


def _database_name(folder: str) -> str:
    """A name of its own for a work folder's database."""
    return f"carelane_{folder.rsplit('-', 1)[-1]}"


def _declared_people(spark, d):
    """Suppliers and customers as the declared table of users, under a folder of its own."""
    folder = work_folder(spark)
    doctors = tables.doctors(spark, d).select("id", "name", F.concat(F.lit("d"), "id", F.lit("@example.com")).alias("email"), F.lit("doctor").alias("role"))
    patients = tables.patients(spark, d).select((F.col("id") + 1000000).alias("id"), "name", F.concat(F.lit("p"), "id", F.lit("@example.com")).alias("email"), F.lit("user").alias("role"))
    writes.as_declared(doctors.unionByName(patients), "users").write.parquet(f"{folder}/users")
    return folder


@query(f"with {_PEOPLE} select id, name, email, role from people")
def declared_users(spark, d):
    return tables.declared(spark, _declared_people(spark, d), "users").select("id", "name", "email", "role")


@query(f"with {_PEOPLE} select id, name, email from people where role = 'doctor'")
def role_doctors(spark, d):
    return tables.people(tables.declared(spark, _declared_people(spark, d), "users"), "doctor").select("id", "name", "email")


@query(f"with {_PEOPLE} select id, name, email from people where role = 'user'")
def role_patients(spark, d):
    return tables.people(tables.declared(spark, _declared_people(spark, d), "users"), "user").select("id", "name", "email")


@query(f"with {_PEOPLE} select role, count(*) as n, min(name) as first_name from people group by role")
def catalog_views(spark, d):
    """SQL over a catalog database: declared tables, and views of roles."""
    folder = _declared_people(spark, d)
    db = tables.publish(spark, _database_name(folder), f"{folder}/db", {"users": tables.declared(spark, folder, "users")}, 4)
    return spark.sql(f"select role, count(*) as n, min(name) as first_name from (select * from {db}.doctors union all select * from {db}.patients) group by role")


@query(f"with {_PEOPLE} select role, count(*) as n, min(name) as first_name from people group by role")
def session_views(spark, d):
    """SQL over registered views of declared tables and of roles."""
    tables.register(spark, _declared_people(spark, d), ("users",))
    return spark.sql("select role, count(*) as n, min(name) as first_name from (select * from doctors union all select * from patients) group by role")


@query(f"with {_MSG} select least(sender_id, receiver_id) as a, greatest(sender_id, receiver_id) as b, count(*) as n, max(id) as last_id from msg group by 1, 2")
def catalog_pairs(spark, d):
    """Messages of a catalog database, counted by the unordered pair that they are bucketed by."""
    folder = work_folder(spark)
    mail = writes.as_declared(_mail(spark, d), "messages")
    db = tables.publish(spark, _database_name(folder), folder, {"messages": mail}, 4)
    return spark.sql(f"select a, b, count(*) as n, max(id) as last_id from {db}.messages group by a, b")


@query(f"with {_PEOPLE} select id, name, email, role from people")
def stored_sessions(spark, d):
    """People sign in: what their sessions store is read back as the same people."""
    users = tables.declared(spark, _declared_people(spark, d), "users")
    return signed_in_rows(session_rows(users)).select(F.col("id").cast("long").alias("id"), "name", "email", "role")


@query(f"with {_PEOPLE} select email, count(*) as n, count(*) as n_ids from (select email from people union all select 'new' || x || '@example.com' from range(3) t(x)) group by email")
def inserted_people(spark, d):
    """Existing people and three new ones are inserted, twice: each email stays one row, each with an id of its own."""
    folder = _declared_people(spark, d)
    users = writes.committed(spark, f"{folder}/new", "users")
    users.append(tables.declared(spark, folder, "users"))
    old = users.read().where("role = 'doctor'").select("name", "email", "role")
    new = spark.range(3).select(F.concat(F.lit("New "), "id").alias("name"), F.concat(F.lit("new"), "id", F.lit("@example.com")).alias("email"), F.lit("user").alias("role"))
    for _ in range(2):
        writes.insert_people(users, old.unionByName(new).unionByName(new))
    ids = users.read().groupBy("id").agg(F.count("*").alias("times"), F.max("email").alias("email"))
    return ids.where("times = 1 and id is not null").groupBy("email").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def _mail(spark, d):
    """Events as messages without an id, some of them blank."""
    text = F.when(F.col("id") % 7 == 0, " \t\u00a0\ufeff").otherwise(F.col("message"))
    return tables.messages(spark, d).select("id", "sender_id", "receiver_id", text.alias("message"), F.col("ts").cast("timestamp").alias("timestamp"))


@query(f"with {_MSG} select sender_id, receiver_id, message, false as is_read, count(*) as n from msg where id % 7 <> 0 and sender_id < 50 group by 1, 2, 3")
def sent_messages(spark, d):
    """Messages that are appended in several sendings, blank ones not; then read again from the table."""
    sent = writes.committed(spark, work_folder(spark), "messages")
    for part in range(2):
        writes.append_messages(sent, _mail(spark, d).where((F.col("sender_id") < 50) & (F.col("id") % 2 == part)).drop("id"))
    return sent.read().groupBy("sender_id", "receiver_id", "message", "is_read").agg(F.count("*").alias("n"))


@query(f"with {_MSG}, kept as (select * from msg where id % 7 <> 0) select sender_id, count(*) as n, count(*) as n_ids, 1::bigint as low, (select count(*) from kept) as high from kept group by sender_id")
def stored_ids(spark, d):
    """Ids that the store makes in three appends: none missing, none twice, without gaps."""
    sent = writes.committed(spark, work_folder(spark), "messages")
    for part in range(3):
        writes.append_messages(sent, _mail(spark, d).where(F.col("id") % 3 == part).drop("id"))
    rows = sent.read()
    span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return rows.groupBy("sender_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")).crossJoin(F.broadcast(span))


@query("select p_partkey as id, p_name as name from part where contains(lower(p_name), lower('RED')) or contains(lower(coalesce(nullif(p_brand, 'Brand#2'), '')), lower('RED')) or contains(lower(p_type), lower('RED'))")
def search_by_index(spark, d):
    """The search over three columns, by trigrams; the table came in two parts."""
    index = TextIndex(spark, work_folder(spark), "id bigint, name string, brand string, type string", "id", ["name", "brand", "type"])
    part = tables.star(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.nullif(F.col("p_brand"), F.lit("Brand#2")).alias("brand"), F.col("p_type").alias("type"))
    for half in (0, 1, 1):  # the second part comes twice
        index.add(part.where(F.col("id") % 2 == half), ("parts", half))
    return index.search("RED").select("id", "name")


@query(f"with {_PEOPLE} select id, name, email from people where email in ('p42@example.com', 'd7@example.com') or id = 1000003")
def indexed_lookup(spark, d):
    """People by email and by id from a table that is laid out for lookups."""
    path = f"{work_folder(spark)}/users"
    lookup_layout(tables.declared(spark, _declared_people(spark, d), "users"), path, ["id"], ("email",))
    users = spark.read.schema(schema_of("users")).parquet(path).select("id", "name", "email")
    found = [users.where(F.col("email") == e) for e in ("p42@example.com", "d7@example.com")]
    return found[0].unionByName(found[1]).unionByName(users.where(F.col("id") == 1000003))


@query(f"with {_APPT} select c_custkey as id, c_name as name, count(*) as visits, count(distinct doctor_id) as doctors from customer join appt on user_id = c_custkey group by 1, 2")
def bucketed_join(spark, d):
    """People and appointments as tables of a database, bucketed by the person: joined and counted where they lie."""
    folder = work_folder(spark)
    db = tables.database(spark, _database_name(folder), folder)
    patients, appointments = tables.patients(spark, d).select("id", "name"), tables.appointments(spark, d).select("user_id", "doctor_id")
    buckets = tables.buckets_for(patients, tables.star(spark, d, "lineitem"))  # an appointment is an order line
    tables.save_bucketed(patients, db, "patients", ["id"], buckets)
    tables.save_bucketed(appointments, db, "appointments", ["user_id"], buckets)
    return spark.sql(f"select p.id, p.name, count(*) as visits, count(distinct doctor_id) as doctors from {db}.patients p join {db}.appointments a on a.user_id = p.id group by p.id, p.name")


@query("select c_custkey + 5 as id, c_name as name, c_custkey || '@example.com' as email, case when c_custkey % 2 = 0 then 'doctor' else 'user' end as role from customer where c_custkey % 5 not in (0, 1, 2)")
def session_people(spark, d):
    """Stored sessions: some are signed out, some lack a key, some have an unknown role or no number."""
    n = F.col("id")
    kind = F.pmod(n, F.lit(5))
    sessions = tables.patients(spark, d).select(
        F.when(kind == 0, "false").otherwise("true").alias("isLoggedIn"),
        F.when(kind == 1, "guest").when(n % 2 == 0, "doctor").otherwise("user").alias("userRole"),
        F.concat(F.when(kind == 2, "x").otherwise(" +"), (n + 5).cast("string"), F.lit(".5")).alias("userId"),
        F.col("name").alias("userName"),
        F.concat(n.cast("string"), F.lit("@example.com")).alias("userEmail"),
    )
    nameless = sessions.withColumn("userName", F.lit(""))
    return signed_in_rows(sessions.unionByName(nameless))


# Literal sources


def _values(name: str) -> str:
    """A literal table as SQL values, typed as its shape says."""
    rows, ddl = literals.SHAPES[name]
    columns = [c.split() for c in ddl.split(", ")]
    kinds = {"string": "varchar", "long": "bigint", "array<string>": "varchar[]"}

    def shown(value) -> str:
        if isinstance(value, list):
            return "[" + ", ".join(map(shown, value)) + "]"
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    casts = ", ".join(f'cast("{c}" as {kinds.get(k, k)}) as "{c}"' for c, k in columns)
    names = ", ".join(f'"{c}"' for c, _ in columns)
    return f"select {casts} from (values " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") t({names})"


#: For each literal table: the column that stored rows are counted by, those rows (SQL: k), and the same in Spark.
_STORED = {
    "doctors": ("id", "select l_suppkey k from lineitem", lambda spark, d: tables.star(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"))),
    "patients": ("id", "select o_custkey k from orders", lambda spark, d: tables.star(spark, d, "orders").select(F.col("o_custkey").alias("k"))),
    "users": ("id", "select user_id k from events", lambda spark, d: tables.star(spark, d, "events").select(F.col("user_id").alias("k"))),
    "appointments": ("id", "select l_orderkey k from lineitem", lambda spark, d: tables.star(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))),
    "messages": ("id", "select event_id % 9 k from events", lambda spark, d: tables.star(spark, d, "events").select((F.col("event_id") % 9).alias("k"))),
    "seed_users": ("role", "select 'doctor' k from supplier union all select 'user' from customer", lambda spark, d: tables.star(spark, d, "supplier").select(F.lit("doctor").alias("k")).unionAll(tables.star(spark, d, "customer").select(F.lit("user").alias("k")))),
    "time_slots": ("slot", "select strftime(ts, '%H:') || case when minute(ts) < 30 then '00' else '30' end k from events", lambda spark, d: tables.star(spark, d, "events").select(T.half_hour(F.col("ts")).alias("k"))),
    "appointment_types": ("position", "select l_linenumber % 5 k from lineitem", lambda spark, d: tables.star(spark, d, "lineitem").select((F.col("l_linenumber") % 5).alias("k"))),
}


def _literal_query(name: str):
    """A literal table with how many stored rows each of its rows stands for."""
    key, sql, stored = _STORED[name]

    def rows(spark, d):
        counts = stored(spark, d).groupBy(F.col("k").alias("__k")).agg(F.count("*").alias("n"))
        own = literals.literal(spark, name)
        return own.join(counts, F.col(key) == F.col("__k"), "left").select(*own.columns, F.coalesce("n", F.lit(0)).cast("long").alias("stored"))

    rows.__name__ = name if name == "time_slots" else f"literal_{name}"
    query(f'select l.*, coalesce(n, 0)::bigint as stored from ({_values(name)}) l left join (select k, count(*) n from ({sql}) group by k) s on s.k = l."{key}"')(rows)


for _name in literals.SHAPES:
    _literal_query(_name)


@query(f"""select l.id, l.name, c_name as stored_name from ({_values('patients')}) l left join customer on c_custkey = l.id
 where contains(lower(name), 'smith') or contains(lower(email), 'smith') or contains(lower(email), 'garcia@')""")
def fixture_search(spark, d):
    """The search by name or e-mail on the literal patients, with two terms, beside the stored people of their ids."""
    rows = literals.literal(spark, "patients")
    found = rows.where(P.search("Smith", F.col("name"), F.col("email")) | P.search("GARCIA@", F.col("name"), F.col("email"))).select("id", "name")
    return R.embed_one(found, tables.patients(spark, d).select(F.col("id").alias("own"), F.col("name").alias("stored_name")), "id", "own", "p", ["stored_name"]).select("id", "name", "p.stored_name")


# Screens


@query("""select s_suppkey as id, 'Dr. ' || s_name as title, n_name as specialty, s_nationkey || ' years' as experience, '4.5' as rating, 'No reviews yet' as reviews,
 'Remote Available' as location, 'Available today' as availability, s_suppkey % 2 = 0 as even from supplier join nation on n_nationkey = s_nationkey
 where contains(lower(s_name), 'supp') or contains(lower(n_name), 'supp')""")
def doctor_directory(spark, d):
    doctors = tables.doctors(spark, d)
    rows = doctors.join(tables.details(spark, d), "detail_id")
    empty = {"availability": "string", "rating": "double", "reviews": "string", "location": "string"}
    details = rows.select("id", F.col("id").alias("user_id"), "specialization", F.col("detail_id").cast("int").alias("experience"), *[F.lit(None).cast(k).alias(c) for c, k in empty.items()])
    return views.doctor_search(doctors.select("id", "name"), details, "supp", rating="4.5", availability="month")


@query(f"""with {_APPT}, {_MSG} select 'Total Patients' as label, count(distinct user_id) as value from appt where doctor_id = 7
 union all select 'Today''s Appointments', count(*) from appt where doctor_id = 7 and cast(appointment_date as date) = date '1996-10-13'
 union all select 'Pending Reviews', count(*) from appt where doctor_id = 7 and status = 'F' and appointment_date < timestamp '1998-06-01'
 union all select 'New Messages', count(*) from msg where receiver_id = 7 and id % 3 = 0""")
def doctor_dashboard(spark, d):
    mail = tables.messages(spark, d).withColumn("is_read", F.col("id") % 3 != 0)
    return views.doctor_dashboard(tables.appointments(spark, d), mail, 7, "1996-10-13", _now(), "F")


@query(f"""with {_APPT}, {_MSG}, {_LAST}, ids as (select distinct doctor_id from appt where user_id = 10)
 select i.doctor_id, s.s_name as name, coalesce(n.n_name, 'General Medicine') as specialty, coalesce(p.message, 'No messages yet') as last_message,
 coalesce(strftime(p.ts, '%I:%M %p'), 'Start chat') as time, i.doctor_id % 2 = 1 as online from ids i join supplier s on s.s_suppkey = i.doctor_id left join nation n on n.n_nationkey = s.s_nationkey
 left join lm p on p.rn = 1 and p.a = least(10, i.doctor_id) and p.b = greatest(10, i.doctor_id)""")
def contact_list(spark, d):
    doctors = tables.doctors(spark, d).join(tables.details(spark, d), "detail_id", "left").select("id", "name", "specialization")
    return views.contact_list(tables.appointments(spark, d), doctors, tables.messages(spark, d), 10)


@query(f"""with {_APPT} select l_orderkey * 100 + l_linenumber as id, coalesce('Dr. ' || s_name, 'Unknown Doctor') as doctor, coalesce(n_name, 'Specialist') as specialty,
 strftime(created_at, '%-m/%-d/%Y, %-I:%M:%S %p') as date, '12:00 PM' as time, coalesce(nullif(status, ''), 'pending') as type
 from appt left join supplier on s_suppkey = doctor_id left join nation on n_nationkey = s_nationkey where user_id = 10""")
def formatted_appointments(spark, d):
    known = tables.doctors(spark, d).join(tables.details(spark, d), "detail_id", "left").select("id", "name", F.col("specialization").alias("specialty"))
    mine = tables.appointments(spark, d).where(F.col("user_id") == 10).withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return views.formatted_appointments(mine, known)


@query("""with u as (select s_suppkey id, s_name as name, 0 src, null as flag from supplier union all select c_custkey, c_name, 1, c_custkey % 2 = 0 from customer)
 select u.id, u.name, case when u.id in (select s_suppkey from supplier) then 'Doctor' else 'Patient' end as role,
 case when flag is distinct from false then 'Active' else 'Pending' end as status, 'N/A' as join_date from u order by src, u.id limit 104""")
def admin_users(spark, d):
    none = F.lit(None).cast("timestamp").alias("created_at")
    doctors = tables.doctors(spark, d).select("id", "name", none)
    patients = tables.patients(spark, d).select("id", "name", (F.col("id") % 2 == 0).alias("is_active"), none)
    return views.admin_users(doctors, patients, 104)


@query("""select 'Total Users' as label, cast(count(*) as varchar) as value from customer union all select 'Active Sessions', cast(cast(floor(count(*) * 7 / 10) as bigint) as varchar) from customer
 union all select 'Security Score', '98%' union all select 'Doctors', cast(count(*) as varchar) from supplier""")
def admin_counts(spark, d):
    return views.admin_counts(tables.patients(spark, d), tables.doctors(spark, d))


@query(f"""with {_APPT}, {_MSG} select 'Appointments' as label, count(*) as value from appt where user_id = 10 union all
 select 'Pending', count(*) from appt where user_id = 10 and status = 'P' union all select 'Messages', count(*) from msg where sender_id = 10""")
def patient_dashboard(spark, d):
    return views.patient_counts(tables.appointments(spark, d), tables.messages(spark, d), 10, "P")


# Streams


_SHAPE = "id long, sender_id long, receiver_id long, message string, timestamp timestamp"


def _as_files(spark, d):
    rows = tables.messages(spark, d)
    return rows.select("id", "sender_id", "receiver_id", "message", F.col("ts").cast("timestamp").alias("timestamp"))


def _of_pair(a: int, b: int):
    return P.between_two(F.col("sender_id"), F.col("receiver_id"), a, b)


@query(f"with {_MSG} select id, sender_id, receiver_id, message from msg where (sender_id = 17 and receiver_id = 139) or (sender_id = 139 and receiver_id = 17)")
def stream_pair(spark: SparkSession, d: str) -> DataFrame:
    """The pair's messages through the stream: events as message files in two drops, the pair's own in both of them."""
    base = work_folder(spark)
    for half in (0, 1):
        _as_files(spark, d).where((F.col("id") % 2 == half) | _of_pair(17, 139)).write.mode("append").parquet(f"{base}/in")
        S.follow(S.live_messages(spark, f"{base}/in", 17, 139, schema=_SHAPE), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(_SHAPE).parquet(f"{base}/out").select("id", "sender_id", "receiver_id", "message")


@query(f"with {_MSG} select m.id, m.message, s.c_name as sender_name from msg m left join customer s on s.c_custkey = m.sender_id where (sender_id = 17 and receiver_id = 139) or (sender_id = 139 and receiver_id = 17)")
def stream_live(spark: SparkSession, d: str) -> DataFrame:
    """The same conversation by a query that goes on: the snapshot, then what comes, handed over batch by batch with names."""
    base = work_folder(spark)
    late = F.col("id") % 2 == 0
    rows = _as_files(spark, d)
    rows.where(~late).write.parquet(f"{base}/in")
    stream = S.with_names(S.live_messages(spark, f"{base}/in", 17, 139, schema=_SHAPE), tables.patients(spark, d))
    keep = lambda batch, k: batch.select("id", "message", "sender_name").write.mode("overwrite").parquet(f"{base}/out/batch={k}")
    live = S.deliver(stream, keep, f"{base}/state", "100 milliseconds")
    live.processAllAvailable()
    rows.where(late).write.mode("append").parquet(f"{base}/in")
    live.processAllAvailable()
    live.stop()
    return spark.read.schema("id long, message string, sender_name string").parquet(f"{base}/out").select("id", "message", "sender_name")


@query(f"""with {_MSG} select id, case when least(sender_id, receiver_id) = 17 then 'first' else 'second' end as conversation from msg
 where (sender_id = 17 and receiver_id = 139) or (sender_id = 139 and receiver_id = 17) or (sender_id = 21 and receiver_id = 40) or (sender_id = 40 and receiver_id = 21)""")
def stream_resubscribed(spark: SparkSession, d: str) -> DataFrame:
    """A subscription that changes to another pair and comes back, while messages of both go on to come."""
    base = work_folder(spark)
    one = S.Subscription(spark, f"{base}/in", base, "100 milliseconds", _SHAPE)
    for part, pair in enumerate([(17, 139), (40, 21), (139, 17), (21, 40)]):
        _as_files(spark, d).where(F.col("id") % 4 == part).write.mode("append").parquet(f"{base}/in")
        one.to(*pair).processAllAvailable()
    one.to(17, 139).processAllAvailable()
    one.stop()
    found = [spark.read.schema(_SHAPE).parquet(one.path(*pair)).select("id", F.lit(name).alias("conversation")) for pair, name in (((17, 139), "first"), ((21, 40), "second"))]
    return found[0].unionByName(found[1])


@query(f"with {_MSG}, {_LAST} select a, b, id, message from lm where rn = 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest message of each pair, kept up to date by a stream: three drops, in the last one the oldest messages."""
    base = work_folder(spark)
    table = CommittedTable(spark, f"{base}/latest", sinks.LATEST, id_column=None)
    rows = _as_files(spark, d)
    early = F.col("timestamp") < F.lit("2024-01-08 00:00:00 UTC").cast("timestamp")
    for part in (~early & (F.col("id") % 2 == 0), ~early & (F.col("id") % 2 == 1), early):
        rows.where(part).write.mode("append").parquet(f"{base}/in")
        live = S.all_messages(spark, f"{base}/in", None, _SHAPE)
        sinks.keep_latest(live, table, "latest", f"{base}/state", compact_every=2).awaitTermination()
    return sinks.newest(table.read()).select("a", "b", "id", "message")


@query(f"""with {_MSG}, pr as (select distinct 's' || sender_id % 3 as subscriber, receiver_id r, least(sender_id, receiver_id) a, greatest(sender_id, receiver_id) b from msg)
 select distinct subscriber, id from msg join pr on a = least(sender_id, receiver_id) and b = greatest(sender_id, receiver_id) where id % 2 = 1 or r % 2 = 0""")
def stream_routed(spark: SparkSession, d: str) -> DataFrame:
    """One stream for all open conversations. The first drop finds those with even receivers open, the second all of them."""
    base = work_folder(spark)
    table = CommittedTable(spark, f"{base}/routed", sinks.ROUTED, id_column=None)
    rows = _as_files(spark, d)
    pairs = rows.select(F.concat(F.lit("s"), F.col("sender_id") % 3).alias("subscriber"), F.col("receiver_id").alias("a"), F.col("sender_id").alias("b")).distinct()
    for part in (0, 1):
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        open_now = pairs if part else pairs.where(F.col("a") % 2 == 0)
        handle = sinks.routed(lambda open_now=open_now: open_now, table, "chat")
        S.deliver(S.all_messages(spark, f"{base}/in", None, _SHAPE), handle, f"{base}/state").awaitTermination()
    return table.read().select("subscriber", "id").distinct()


@query(f"with {_MSG} select id, count(*) as n from msg where sender_id < 50 group by id")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Batches that come again, as after a failure that loses the stream's own state, add nothing."""
    base = work_folder(spark)
    table = CommittedTable(spark, f"{base}/out", _SHAPE.replace(" long", " bigint"))
    rows = _as_files(spark, d).where(F.col("sender_id") < 50)
    for part in (0, 1):
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        S.deliver(S.all_messages(spark, f"{base}/in", None, _SHAPE), sinks.once(table, "mail", 2), f"{base}/state").awaitTermination()
    S.deliver(S.all_messages(spark, f"{base}/in", None, _SHAPE), sinks.once(table, "mail"), f"{base}/other").awaitTermination()
    return table.read().groupBy("id").agg(F.count("*").alias("n"))


@query(f"with {_MSG} select id, sender_id, receiver_id, message from msg where (sender_id = 17 and receiver_id = 139) or (sender_id = 139 and receiver_id = 17)")
def stream_inserts(spark: SparkSession, d: str) -> DataFrame:
    """A conversation from the inserts into the messages table: those before it was opened, then each as it is committed,
    with a compaction between them."""
    base = work_folder(spark)
    mail, seen = writes.committed(spark, base, "messages"), CommittedTable(spark, f"{base}/seen", _SHAPE.replace(" long", " bigint"))
    rows = tables.messages(spark, d).select("id", "sender_id", "receiver_id", "message", F.col("ts").cast("timestamp").alias("timestamp"))
    mail.append(rows.where("id % 3 = 0"))
    live = sinks.inserts(mail, lambda new, k: sinks.once(seen, "chat")(new.where(_of_pair(17, 139)), k), f"{base}/state", "100 milliseconds")
    live.processAllAvailable()
    mail.append(rows.where("id % 3 = 1"))
    mail.compact()
    live.processAllAvailable()
    mail.append(rows.where("id % 3 = 2"))
    live.processAllAvailable()
    live.stop()
    return seen.read().select("id", "sender_id", "receiver_id", "message")
