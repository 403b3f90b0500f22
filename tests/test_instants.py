"""Time strings: each written form, the awkward hours of a zone, and what names no instant."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidewell.functions.instants import canonical_micros, with_instant
from tidewell.operators.instants import grow_dictionary, normalise_instants
from tidewell.sources.scratch import fresh_path

UTC = dt.timezone.utc


def us(*a, micro=0):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 1_000_000 + micro


NY, BERLIN, SYDNEY, LONDON, KOLKATA = "America/New_York", "Europe/Berlin", "Australia/Sydney", "Europe/London", "Asia/Kolkata"
CASES = [
    ("2024-01-05T12:00:00Z", "UTC", "YMD", us(2024, 1, 5, 12)),
    ("  2024-01-05t12:00:00z\n", "UTC", "YMD", us(2024, 1, 5, 12)),
    ("2024-01-05T12:00:00.123456789Z", "UTC", "YMD", us(2024, 1, 5, 12, micro=123456)),
    ("2024-01-05T12:00:00+05:30", "UTC", "YMD", us(2024, 1, 5, 6, 30)),
    ("2024-01-05T12:00:00-0500", "UTC", "YMD", us(2024, 1, 5, 17)),
    ("2024-01-05T12:00:00+01:00[Europe/Berlin]", "UTC", "YMD", us(2024, 1, 5, 11)),
    ("2024-07-05 12:00:00", NY, "MDY", us(2024, 7, 5, 16)),
    ("2024-01-05T12:00", BERLIN, "DMY", us(2024, 1, 5, 11)),
    ("2024-01-05", BERLIN, "DMY", us(2024, 1, 4, 23)),
    ("05.01.2024 12:00:00", BERLIN, "DMY", us(2024, 1, 5, 11)),
    ("01/05/2024 5:15 PM", NY, "MDY", us(2024, 1, 5, 22, 15)),
    ("1.5.2024, 12:15 am", NY, "MDY", us(2024, 1, 5, 5, 15)),
    ("2024/01/05 12:00:00", NY, "MDY", us(2024, 1, 5, 17)),
    ("Fri, 05 Jan 2024 12:00:00 GMT", NY, "MDY", us(2024, 1, 5, 12)),
    ("Fri, 05 Jan 2024 12:00:00 EST", NY, "MDY", us(2024, 1, 5, 17)),
    ("Fri, 05 Jul 2024 12:00:00 EST", NY, "MDY", us(2024, 7, 5, 17)),
    ("5 Jan 24 12:00:00 CET", BERLIN, "DMY", us(2024, 1, 5, 11)),
    ("5 Jan 24 12:00:00 IST", KOLKATA, "DMY", us(2024, 1, 5, 6, 30)),
    ("5 Jan 24 12:00:00 CST", "Asia/Shanghai", "YMD", us(2024, 1, 5, 4)),
    ("5 Jan 24 12:00:00 CST", "America/Chicago", "MDY", us(2024, 1, 5, 18)),
    ("5 January 2024, 12:00", LONDON, "DMY", us(2024, 1, 5, 12)),
    ("January 5, 2024 3:00 pm", NY, "MDY", us(2024, 1, 5, 20)),
    ("Jan 5 2024 12:00:00", "UTC", "YMD", us(2024, 1, 5, 12)),
    ("Fri Jan 5 12:00:00 2024", "UTC", "YMD", us(2024, 1, 5, 12)),
    ("2024-01-05 12:00:00 UTC+5", "UTC", "YMD", us(2024, 1, 5, 7)),
    ("2024-01-05 12:00:00 GMT-05:30", "UTC", "YMD", us(2024, 1, 5, 17, 30)),
    ("20240105120000", NY, "MDY", us(2024, 1, 5, 17)),
    ("20240105T120000Z", NY, "MDY", us(2024, 1, 5, 12)),
    ("1704456000", NY, "MDY", us(2024, 1, 5, 12)),
    ("1704456000123", NY, "MDY", us(2024, 1, 5, 12, micro=123000)),
    ("1704456000123456", NY, "MDY", us(2024, 1, 5, 12, micro=123456)),
    ("1704456000123456789", NY, "MDY", us(2024, 1, 5, 12, micro=123456)),
    ("2024-11-03 01:30:00", NY, "MDY", us(2024, 11, 3, 5, 30)),  # twice: the earlier
    ("2024-03-10 02:30:00", NY, "MDY", None),  # skipped
    ("2024-10-06 02:30:00", SYDNEY, "DMY", None),
    ("2024-02-30 12:00:00", NY, "MDY", None),
    ("0000-00-00 00:00:00", NY, "MDY", None),
    ("2024-13-05T10:00:00Z", NY, "MDY", None),
    ("20241305100000", NY, "MDY", None),
    ("2024-01-05 24:00:00", NY, "MDY", None),
    ("01/05/2024 13:15 PM", NY, "MDY", None),
    ("2 hours ago", NY, "MDY", None),
    ("yesterday", NY, "MDY", None),
    ("", NY, "MDY", None),
    ("-", NY, "MDY", None),
    (None, NY, "MDY", None),
    ("2024-01-05 12:00:00", None, None, None),
    ("x" * 100_000, NY, "MDY", None),
]


def test_forms(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string, tz string, ord string, want bigint")
    got = {r.i: r.got for r in with_instant(df, "raw", "tz", "ord", "got").collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[3]]
    assert not wrong


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame([("a", "a.example", NY, "MDY"), ("b", "b.example", "UTC", "YMD")], "feed_name string, source_domain string, home_tz string, date_order string")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2200, 1, 1)), min_size=20, max_size=60))
def test_round_trip(spark, times):
    rows = [(t.strftime("%Y-%m-%dT%H:%M:%SZ"), us(t.year, t.month, t.day, t.hour, t.minute, t.second)) for t in times]
    df = spark.createDataFrame(rows, "raw string, want bigint")
    assert df.where(canonical_micros(F.col("raw")) != F.col("want")).count() == 0
    spaced = df.withColumn("raw", F.concat(F.lit(" "), "raw")).withColumn("tz", F.lit("UTC")).withColumn("ord", F.lit("YMD"))
    assert with_instant(spaced, "raw", "tz", "ord", "got").where("got is null or got <> want").count() == 0


def test_rows_survive_nulls_repeats_hot_values_and_clashing_names(spark, feeds):
    rows = [(i, "01/05/2024 5:15 PM", "a.example", "r") for i in range(200)] + [(200, None, "a.example", "r"), (201, "2024-01-05 12:00:00", None, None), (202, "2024-01-05T12:00:00Z", None, "r")]
    df = spark.createDataFrame(rows, "n int, src string, raw string, instant_us string")  # names the operator uses inside
    out = normalise_instants(df, "src", "raw", feeds, "t").collect()
    assert len(out) == len(rows)
    got = {r.n: r.t for r in out}
    assert got[0] == us(2024, 1, 5, 22, 15) and got[200] is None and got[201] is None and got[202] == us(2024, 1, 5, 12)


def test_empty(spark, feeds):
    df = spark.createDataFrame([], "id int, raw string, src string")
    assert normalise_instants(df, "raw", "src", feeds).count() == 0


def test_dictionary_grows(spark, feeds):
    path = fresh_path(spark, "dictionary")
    v1 = spark.createDataFrame([("5 Jan 24 12:00:00", "a.example", 1)], "raw string, src string, n bigint")
    v2 = spark.createDataFrame([("5 Jan 24 12:00:00", "a.example", 9), ("6 Jan 24 12:00:00", "a.example", 1)], "raw string, src string, n bigint")
    assert grow_dictionary(v1, feeds, path).count() == 1
    again = grow_dictionary(v2, feeds, path)
    # The known value was not parsed again, so it stands in the dictionary once.
    assert sorted((r.raw, r.instant_us) for r in again.collect()) == [("5 Jan 24 12:00:00", us(2024, 1, 5, 17)), ("6 Jan 24 12:00:00", us(2024, 1, 6, 17))]


def test_values_that_turn_hot_later(spark, feeds):
    """Hot values are counted on the rows at hand; the dictionary persists over calls."""
    path = fresh_path(spark, "dictionary")
    one = lambda raws: spark.createDataFrame([(i, r, "b.example") for i, r in enumerate(raws)], "id int, raw string, src string")
    first = normalise_instants(one([f"2024-01-05 12:00:{k:02d}" for k in range(60)]), "raw", "src", feeds, "t", path).collect()
    assert all(r.t == us(2024, 1, 5, 12, 0, r.id) for r in first)
    later = normalise_instants(one(["2024-01-05 12:00:07"] * 500 + ["2024-02-01 00:00"]), "raw", "src", feeds, "t", path).collect()
    assert len(later) == 501 and {r.t for r in later} == {us(2024, 1, 5, 12, 0, 7), us(2024, 2, 1)}
    assert spark.read.parquet(f"{path}/*").count() == 61


def test_versions_of_a_dictionary_in_one_plan(spark, feeds):
    """Rows normalised by an older and by a newer version meet in one plan."""
    path = fresh_path(spark, "dictionary")
    one = lambda raw: spark.createDataFrame([(1, raw, "b.example")], "id int, raw string, src string")
    parts = [normalise_instants(one(f"2024-01-0{d} 12:00:00"), "raw", "src", feeds, "t", path) for d in (1, 2, 3)]
    assert sorted(r.t for r in parts[0].unionByName(parts[1]).unionByName(parts[2]).collect()) == [us(2024, 1, d, 12) for d in (1, 2, 3)]
