import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carelane.functions import text as X
from carelane.functions import times as T
from carelane.functions import values as V


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_defaults(spark):
    rows = [(0.0,), (None,), (4.7,)]
    assert values(spark, rows, "x double", V.or_default(F.col("x"), 4.5, 0.0)) == [4.5, 4.5, 4.7]
    assert values(spark, [(float("nan"),)], "x double", V.or_default(F.col("x"), 4.5, 0.0)) == [4.5]
    assert values(spark, [("",), ("x",)], "x string", V.or_default(F.col("x"), "none")) == ["none", "x"]
    rows = [(0,), (None,)]
    made = V.null_default(F.col("x"), F.concat(F.col("x").cast("string"), F.lit(" years")), "Experience not specified")
    assert values(spark, rows, "x int", made) == ["0 years", "Experience not specified"]


def test_numbers(spark):
    rows = [("12abc",), ("  -3",), ("x",), (None,), ("",)]
    assert values(spark, rows, "x string", V.parse_int(F.col("x"))) == [12, -3, None, None, None]
    rows = [("4.5",), ("4.5 stars",), (".5",), ("1e3",), ("no",)]
    assert values(spark, rows, "x string", V.parse_number(F.col("x"))) == [4.5, 4.5, 0.5, 1000.0, None]
    assert values(spark, [(7,), (10,), (0,)], "x long", V.share_floor(F.col("x"), 70)) == [4, 7, 0]
    assert values(spark, [(4.26,)], "x double", V.fixed(F.col("x"), 1)) == ["4.3"]


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_rounds_the_exact_value(spark, digits):
    rng = random.Random(digits)
    some = [4.35, 4.25, 4.45, 0.05, 0.15, 0.25, -4.25, -4.35, 0.0, 9.95, 9.949999, 99.99, 1e-7, 0.049999999999999996, 1.005, 2.5, 123456789.25, 4503599627370495.5]
    some += [rng.choice([-1, 1]) * rng.randrange(2000) / rng.choice([20, 40, 200, 1000]) for _ in range(300)] + [rng.random() * 10**rng.randrange(-3, 9) for _ in range(100)]
    want = [str(abs(Decimal(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in some]
    want = [f"-{w}" if x < 0 else w for x, w in zip(some, want, strict=True)]
    assert values(spark, [(x,) for x in some], "x double", V.fixed(F.col("x"), digits)) == want
    assert values(spark, [(None,)], "x double", V.fixed(F.col("x"), digits)) == [None]


def test_arrays_and_lookups(spark):
    assert values(spark, [([1],), ([],), (None,)], "x array<int>", V.element(F.col("x"), 0)) == [1, None, None]
    assert values(spark, [(3.7,)], "x double", V.stars(F.col("x"))) == [[True, True, True, False, False]]
    assert values(spark, [("doctor",), ("other",)], "x string", V.lookup(F.col("x"), {"doctor": "/d"})) == ["/d", None]
    assert values(spark, [("a",), ("z",)], "x string", V.case(F.col("x"), {"a": "1", "b": "2"}, "3")) == ["1", "3"]


def test_text(spark):
    assert values(spark, [("\t a b \n",), (None,)], "x string", X.trimmed(F.col("x"))) == ["a b", None]
    assert values(spark, [("Ann  Lee",), ("",)], "x string", X.initials(F.col("x"))) == ["AL", ""]
    assert values(spark, [("mcDONALD",), ("",)], "x string", X.capitalised(F.col("x"))) == ["McDONALD", ""]
    assert values(spark, [(0,), (1,), (2,)], "x int", X.plural(F.col("x"))) == ["s", "", "s"]
    assert values(spark, [("Ann",), (None,)], "x string", X.contains_folded(F.col("x"), "")) == [True, True]
    assert values(spark, [("a", None), ("a", "b")], "x string, y string", X.joined_name(F.col("x"), F.col("y"))) == ["a", "a b"]


def test_times(spark):
    rows = [(datetime(2024, 1, 22, 14, 5, 9),)]
    get = lambda c: values(spark, rows, "x timestamp_ntz", c)[0]
    assert get(T.clock(F.col("x"))) == "02:05 PM"
    assert get(T.date_part(F.col("x"))) == "2024-01-22"
    assert get(T.date_time(F.col("x"))) == "1/22/2024, 2:05:09 PM"
    assert get(T.same_month(F.col("x"), F.lit(date(2024, 1, 1))))
    days = [(date(2024, 1, d),) for d in (1, 2, 3, 4, 11, 12, 13, 21, 22, 23)]
    assert [s.split()[1] for s in values(spark, days, "x date", T.long_date(F.col("x")))] == ["1st,", "2nd,", "3rd,", "4th,", "11th,", "12th,", "13th,", "21st,", "22nd,", "23rd,"]
    assert values(spark, [("nonsense",), ("2024-01-22 14:05:09",)], "x string", T.parsed(F.col("x"))) == [None, rows[0][0]]
    ends = [(datetime(2024, 1, 31, 23, 59, 59, 999999),), (datetime(2024, 2, 1),), (datetime(2023, 12, 31, 23, 59),), (None,)]
    assert values(spark, ends, "x timestamp_ntz", T.same_month(F.col("x"), F.lit(date(2024, 1, 5)))) == [True, False, False, None]
    assert values(spark, [(date(2024, 1, 31),), (date(2024, 2, 1),)], "x date", T.same_month(F.col("x"), F.lit(date(2024, 1, 5)))) == [True, False]


def test_white_space_is_the_same_on_the_driver(spark):
    odd = ["\u00a0a\ufeff", "\x1ca\x1f", "\x85", " \u3000\u2028 ", "\u200b", "\v\f"]
    assert values(spark, [(x,) for x in odd], "x string", X.trimmed(F.col("x"))) == [x.strip(X.WHITE) for x in odd]


@pytest.mark.parametrize("n", [0])
@settings(max_examples=15, deadline=None)
@given(names=st.lists(st.text(alphabet="ab AB", max_size=6), min_size=1, max_size=5), term=st.text(alphabet="abAB", max_size=3))
def test_contains_matches_python(spark, n, names, term):
    got = values(spark, [(x,) for x in names], "x string", X.contains_folded(F.col("x"), term))
    assert got == [term.lower() in x.lower() for x in names]


ZONES = ["UTC", "America/New_York", "Asia/Tokyo"]


@pytest.fixture(params=ZONES)
def session_zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_texts_are_instants_whatever_the_session(spark, session_zone):
    """A date alone is UTC, a reading is the person's, an offset is its own."""
    micros = lambda text, *zone: values(spark, [(text,)], "x string", F.unix_seconds(T.parsed(F.col("x"), *zone)))[0]
    assert micros("2024-01-25") == micros("2024-01-25", "America/New_York") == micros(" 2024-01-25 ", "Asia/Tokyo") == 1706140800
    assert micros("2024-01-25T10:00:00", "America/New_York") == 1706194800
    assert micros("2024-01-25 10:00", "Asia/Tokyo") == 1706144400
    assert micros("2024-01-25T10:00:00.5") == 1706176800
    assert micros("2024-01-25T10:00:00Z", "Asia/Tokyo") == micros("2024-01-25T05:00:00-05:00", "Asia/Tokyo") == 1706176800
    for none in ("soon", "", "2024-13-01", "2024-01-25T99:00:00", None):
        assert micros(none) is None


def test_days_months_and_clocks_of_a_zone(spark, session_zone):
    from carelane.operators.predicates import on_day

    # Nine in the evening of the 31st in New York is the first of the next month in UTC and in Tokyo.
    rows = spark.sql("select timestamp'2024-01-31T21:00:00-05:00' as t, timestamp_ntz'2024-02-01 02:00:00' as u")
    get = lambda c: rows.select(c).first()[0]
    day = F.lit("2024-01-15").cast("date")
    for zone, date_, clock, january in (("UTC", "2024-02-01", "02:00 AM", False), ("America/New_York", "2024-01-31", "09:00 PM", True), ("Asia/Tokyo", "2024-02-01", "11:00 AM", False)):
        for column, kind in (("t", "timestamp"), ("u", "timestamp_ntz")):
            seen = T.wall(F.col(column), zone, kind)
            assert (get(T.date_part(seen)), get(T.clock(seen))) == (date_, clock)
            assert get(on_day(F.col(column), date_, zone, kind)) and not get(on_day(F.col(column), "2024-01-30", zone, kind))
            assert get(T.same_month(F.col(column), day, zone, kind)) == january
    assert get(T.date_time(T.wall(F.col("t"), "America/New_York"))) == "1/31/2024, 9:00:00 PM"
    assert get(T.half_hour(F.col("u"))) == "02:00"


def test_a_reading_that_a_session_skips_stays(spark, session_zone):
    """Half past two does not exist in New York on this day."""
    rows = spark.sql("select timestamp_ntz'2024-03-10 02:30:00' as u")
    assert rows.select(T.clock(F.col("u"))).first()[0] == "02:30 AM"


def test_zone_filters_are_pushed_down(spark, tmp_path):
    spark.sql("select timestamp'2024-01-31T21:00:00-05:00' as t, timestamp_ntz'2024-02-01 02:00:00' as u").write.parquet(f"{tmp_path}/t")
    from carelane.operators.predicates import on_day

    for column, kind in (("t", "timestamp"), ("u", "timestamp_ntz")):
        found = spark.read.parquet(f"{tmp_path}/t").where(on_day(F.col(column), "2024-01-31", "America/New_York", kind))
        assert f"GreaterThanOrEqual({column}" in found._jdf.queryExecution().toString() and found.count() == 1
