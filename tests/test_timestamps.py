"""Capture lines against a plain datetime and zoneinfo version."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from ledgerloom.operators.timestamps import capture_instants, epoch_day

UTC = dt.timezone.utc


def us(y, mo, d, h=0, mi=0, s=0, frac=0, zone="UTC", minutes=None):
    wall = dt.datetime(y, mo, d, h, mi, s, frac)
    if minutes is not None:
        t = wall.replace(tzinfo=UTC) - dt.timedelta(minutes=minutes)
    else:
        z = ZoneInfo(zone)
        t = wall.replace(tzinfo=z, fold=0)  # twice: the first; skipped: fold 0 moves on by the gap
        t = t.astimezone(UTC)
    return (t - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)


CASES = [
    ("Captured: Fri, 19 Sep 2025 17:05:44 -04:00", False, None, us(2025, 9, 19, 17, 5, 44, minutes=-240)),
    ("Erfasst am: 25/8/2025  5:30 PM", False, "Europe/Berlin", us(2025, 8, 25, 17, 30, zone="Europe/Berlin")),
    ("Scanned on: 03/04/2025 08:00", True, "UTC", us(2025, 4, 3, 8)),
    ("Scanned on: 03/04/2025 08:00", None, None, us(2025, 3, 4, 8)),
    ("Captured: 14-03-26 12:00:01.5", False, None, us(2026, 3, 14, 12, 0, 1, 500000)),
    ("Reçu le: 11 août 2026 à 15h19", False, "Europe/Paris", us(2026, 8, 11, 15, 19, zone="Europe/Paris")),
    ("Zeitstempel: 29. März 2026, 02:30:00 Uhr", False, "Europe/Berlin", us(2026, 3, 29, 2, 30, zone="Europe/Berlin")),
    ("Time stamp: 2025-10-26T02:30:00", False, "Europe/Berlin", us(2025, 10, 26, 2, 30, zone="Europe/Berlin")),
    ("Time stamp: 2024-10-27T03:50:24+03:00[Europe/Helsinki]", False, "UTC", us(2024, 10, 27, 3, 50, 24, minutes=180)),
    ("TIME STAMP: 2024-03-10T02:02:43[AMERICA/NEW_YORK]", False, "UTC", us(2024, 3, 10, 2, 2, 43, zone="America/New_York")),
    ("captured -> 17 de junio de 2025, 13:13:37", False, None, us(2025, 6, 17, 13, 13, 37)),
    ("Captured.... 20250113T041944", False, None, us(2025, 1, 13, 4, 19, 44)),
    ("Captured: 07-Jan-2026 03:31 BST", False, "Asia/Tokyo", us(2026, 1, 7, 3, 31, minutes=60)),
    ("Captured: Mar 4, 2025 at 12:10:48 a.m.", False, None, us(2025, 3, 4, 0, 10, 48)),
    ("Captured: 1784031609", False, None, 1784031609000000),
    ("Captured: 1779552124.555", False, None, 1779552124555000),
    ("Captured: 1743914431647", False, None, 1743914431647000),
    ("Captured: 1783664212203186", False, None, 1783664212203186),
    ("Note: x | Eingegangen:: 2025-10-15 03:19:56 | Total: 3", False, None, us(2025, 10, 15, 3, 19, 56)),
    ("\tCaptured: 19　april　2026　06:00", False, None, us(2026, 4, 19, 6)),
    ("Captured: 30 February 2025 01:23", False, None, None), ("Captured: 2025-13-01T00:00Z", False, None, None),
    ("Captured: 2025-05-24 27:53", False, None, None), ("Captured: 2025-05-24", False, None, None), ("Captured: --", False, None, None),
    ("Captured: 13:05 PM 2025-05-24", False, None, None), ("Captured: 2025-05-24 13:05 PM", False, None, None),
    ("Captured: 2025-05-24 10:00", False, "Nowhere/City", None), ("", False, None, None), (None, False, None, None), ("Total: 2025-05-24 10:00", False, None, None),
    ("x" * 300_000 + "\nCaptured: 2025-05-24 10:00", False, None, us(2025, 5, 24, 10)),
]


def test_capture_lines(spark):
    docs = spark.createDataFrame([(i, i, t, "extra", i) for i, (t, *_x) in enumerate(CASES)], "doc_key long, request_id long, text string, dayfirst string, zone int")
    reqs = spark.createDataFrame([(i, df, tz, dt.datetime(2026, 1, 1), 7) for i, (_t, df, tz, _u) in enumerate(CASES)],
                                 "request_id long, dayfirst boolean, site_tz string, received_at timestamp, doc_key int")
    reqs = reqs.union(reqs)  # delivered again
    got = {r.doc_key: r.utc_us for r in capture_instants(docs, reqs).collect()}
    want = {i: c[3] for i, c in enumerate(CASES) if c[3] is not None}
    assert {i: CASES[i][0] for i in want if got.get(i) != want[i]} == {}
    assert set(got) == set(want)


def test_no_rows_and_missing_requests(spark):
    docs = spark.createDataFrame([(1, None, "Captured: 2025-05-24 10:00"), (2, 99, "Captured: 2025-05-24 10:00")], "doc_key long, request_id long, text string")
    reqs = spark.createDataFrame([], "request_id long, dayfirst boolean, site_tz string, received_at timestamp")
    assert {r.doc_key: r.utc_us for r in capture_instants(docs, reqs).collect()} == {1: us(2025, 5, 24, 10), 2: us(2025, 5, 24, 10)}
    assert capture_instants(docs.limit(0), reqs).count() == 0


@pytest.mark.parametrize("day", ["1970-01-01", "2000-02-29", "1900-03-01", "2100-12-31", "0001-01-01"])
def test_epoch_day(spark, day):
    from pyspark.sql import functions as F

    y, m, d = map(int, day.split("-"))
    got = spark.range(1).select(epoch_day(F.lit(y), F.lit(m), F.lit(d)).alias("x")).first().x
    assert got == (dt.date(y, m, d) - dt.date(1970, 1, 1)).days
