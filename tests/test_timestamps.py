import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions.timestamps import with_instant
from weftline.operators.instants import DateField, normalise_instants

UTC = dt.timezone.utc


def us(*a, micro=0, tz=UTC):
    return int((dt.datetime(*a, tzinfo=tz) - dt.datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000 + micro


def off(minutes):
    return dt.timezone(dt.timedelta(minutes=minutes))


CASES = [
    ("Fri, 15 Nov 2024 06:04:28 +0000", None, None, us(2024, 11, 15, 6, 4, 28)),
    ("Sun, 03 Sep 2023 04:07:54 +0530", None, None, us(2023, 9, 3, 4, 7, 54, tz=off(330))),
    ("Tue, 09 Jul 2024 22:45:15 PDT", "Asia/Tokyo", None, us(2024, 7, 9, 22, 45, 15, tz=off(-420))),
    ("Wednesday, 21-Jun-23 02:00:53 GMT", None, None, us(2023, 6, 21, 2, 0, 53)),
    ("Tue May 30 23:53:12 2023", "Europe/Paris", None, us(2023, 5, 30, 21, 53, 12)),
    ("Thu May  8 16:19:44 2025", None, None, us(2025, 5, 8, 16, 19, 44)),
    ("2023-12-07T03:35:38", "Asia/Kolkata", None, us(2023, 12, 7, 3, 35, 38, tz=off(330))),
    ("2023-04-26T15:27:07.748806999", None, None, us(2023, 4, 26, 15, 27, 7, micro=748806)),
    ("2023-06-10T23:19:21,3Z", None, None, us(2023, 6, 10, 23, 19, 21, micro=300000)),
    ("20240622T182908Z", None, None, us(2024, 6, 22, 18, 29, 8)),
    ("2025-06-21T17:38:05.564-00:00", "Asia/Tokyo", None, us(2025, 6, 21, 17, 38, 5, micro=564000)),
    ("2025-09-25T19:11:06+09", None, None, us(2025, 9, 25, 10, 11, 6)),
    ("2025-01-21T04:57-03:30", None, None, us(2025, 1, 21, 4, 57, tz=off(-210))),
    ("2023-11-05T01:39:32-07:00[America/Los_Angeles]", None, None, us(2023, 11, 5, 8, 39, 32)),
    ("2023-08-19T12:00:00[Europe/Berlin]", "Asia/Tokyo", None, us(2023, 8, 19, 10)),
    ("2023-09-02T22:15:46 america/los_angeles", None, None, us(2023, 9, 3, 5, 15, 46)),
    ("2024-03-17", "Europe/Paris", None, us(2024, 3, 16, 23)),
    ("2024-03-17T24:00:00", None, None, us(2024, 3, 18)),
    ("24/04/2025 10:25", None, True, us(2025, 4, 24, 10, 25)),
    ("04/24/2025 10:25 pm", None, None, us(2025, 4, 24, 22, 25)),
    ("02.04.2023 - 00:50", None, False, us(2023, 4, 2, 0, 50)),
    ("09.07.2025 09:44 Uhr", "Europe/Berlin", None, us(2025, 7, 9, 7, 44)),
    ("Posted on April 26, 2024 at 2:38 a.m.", None, None, us(2024, 4, 26, 2, 38)),
    ("Updated: Mar 13, 2023 12:14 AM", None, None, us(2023, 3, 13, 0, 14)),
    ("July 5, 2023 2:10 p.m. EDT", None, None, us(2023, 7, 5, 18, 10)),
    ("Publié le 13 février 2025 à 18:26", None, None, us(2025, 2, 13, 18, 26)),
    ("Publicado el 20 de abril de 2023, 04:51", None, None, us(2023, 4, 20, 4, 51)),
    ("Aktualisiert: 25. März 2025, 02:40 Uhr", None, None, us(2025, 3, 25, 2, 40)),
    ("Tuesday, 18 February 2025 04:51 UTC-04:00", None, None, us(2025, 2, 18, 8, 51)),
    ("1699320778", "Asia/Tokyo", None, 1699320778 * 10**6),
    ("1708952549.25", None, None, 1708952549250000),
    ("1755704914116", None, None, 1755704914116000),
    ("1733265587131390", None, None, 1733265587131390),
    ("  2025-08-16T16:51:55\n", None, None, us(2025, 8, 16, 16, 51, 55)),
    # repeated local time: the first; skipped: the offset before the change
    ("2024-10-27 02:30:00", "Europe/Paris", None, us(2024, 10, 27, 0, 30)),
    ("2024-03-31 02:30:00", "Europe/Paris", None, us(2024, 3, 31, 1, 30)),
    ("2023-11-05 01:30:00", "America/Chicago", None, us(2023, 11, 5, 6, 30)),
    *[(x, None, True, None) for x in ("", " ", None, "yesterday", "TBA", "2 hours ago", "31/31/2024", "2024-02-30", "2023-02-29", "0000-00-00 00:00:00", "2023-13-05T10:00:00Z", "Thu, 32 Jan 2024 10:00:00 GMT", "2024-06-31T08:00:00+02:00", "2024-06-30T25:00:00", "2024-06-30T24:00:01", "2024-06-30T10:60", "{{pubDate}}", "x" * 20000, "\x1f2024")],
]


def test_formats(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, v string, z string, f boolean")
    got = {r.i: r.utc_micros for r in with_instant(df, "v", "z", "f").collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[3]) for c in CASES]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.datetimes(dt.datetime(1971, 1, 1), dt.datetime(2099, 1, 1)), st.sampled_from(["Europe/Paris", "America/Sao_Paulo", "Asia/Kolkata", "Australia/Sydney"])), min_size=60, max_size=60))
def test_local_times_follow_the_zone(spark, xs):
    df = spark.createDataFrame([(i, d.isoformat(), z) for i, (d, z) in enumerate(xs)], "i int, v string, z string")
    got = {r.i: r.utc_micros for r in with_instant(df, "v", "z").collect()}
    for i, (d, z) in enumerate(xs):
        want = (d.replace(tzinfo=ZoneInfo(z)) - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)
        assert got[i] == want, (d, z)


def test_operator_takes_repeats_nulls_clashes_and_empty_tables(spark):
    a = spark.createDataFrame([(1, "2024-01-01", "s", "x"), (1, "2024-01-01", "s", "x"), (2, None, "s", "x"), (None, "2024-01-01", None, "x"), (3, "2024-01-01", None, "x"), (4, "2024-01-01", "bad", "x"), (5, "x" * 100000, "s", None)], "k long, v string, source_name string, field_name string")
    z = spark.createDataFrame([("s", "Asia/Tokyo", True), ("s", "Asia/Tokyo", None), ("bad", "Mars/Base", None), (None, "Asia/Tokyo", True)], "source_name string, time_zone string, day_first boolean")
    got = sorted(map(tuple, normalise_instants([DateField(a, "k", "v", "source_name", True), DateField(a.limit(0), "k", "v", None)], z).collect()))
    assert got == [("v", "1", us(2023, 12, 31, 15)), ("v", "3", us(2024, 1, 1)), ("v", "4", us(2024, 1, 1))]
    assert normalise_instants([DateField(a.limit(0), "k", "v")], z.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["2000-02-29", "1900-03-01", "0001-01-01", "9999-12-31"])
def test_day_arithmetic(spark, text):
    want = (dt.date.fromisoformat(text) - dt.date(1970, 1, 1)).days * 86400 * 10**6
    assert with_instant(spark.createDataFrame([(text,)], "v string"), "v").first().utc_micros == want
