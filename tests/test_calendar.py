from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelcast.functions import calendar as C
from panelcast.sources.landed import localize


def one(spark, ts, expr):
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "hour, zone, expected",
    [(12, None, 12), (23, None, 1), (1, None, 23), (10, "Europe/Berlin", 13)],
)
def test_hours_until_midnight(spark, hour, zone, expected):
    # 10:00 UTC is 11:00 in Berlin in winter
    assert one(spark, datetime(2024, 1, 1, hour), C.hours_until_midnight("ts", zone)) == expected


def test_next_wednesday_keeps_the_time_of_day(spark):
    f = C.next_wednesday("ts")
    assert one(spark, datetime(2024, 10, 24, 10, 20), f) == datetime(2024, 10, 30, 10)
    assert one(spark, datetime(2024, 10, 23, 10, 20), f) == datetime(2024, 10, 23, 10)


def test_forecast_dates_of_a_wednesday(spark):
    got = one(spark, datetime(2024, 10, 23, 9), C.forecast_hours("ts"))
    assert got == [datetime(2024, 10, d, h) for d in (25, 26) for h in (12, 16, 20)]
    days = one(spark, datetime(2024, 10, 23), C.following_days("ts"))
    assert days == [datetime(2024, 10, 23 + i) for i in range(1, 7)]


@pytest.mark.parametrize(
    "year, easter",
    [
        (2021, date(2021, 4, 4)),
        (2022, date(2022, 4, 17)),
        (2023, date(2023, 4, 9)),
        (2024, date(2024, 3, 31)),
        (2025, date(2025, 4, 20)),
        (2026, date(2026, 4, 5)),
    ],
)
def test_easter(spark, year, easter):
    assert one(spark, datetime(year, 6, 1), C.easter_sunday(F.year("ts"))) == easter


def test_holiday_table(spark):
    days = {r.day for r in C.holiday_table(spark, 2017, 2017).collect()}
    assert len(days) == 13  # with 31 October
    assert date(2017, 10, 31) in days and date(2017, 6, 15) in days


def test_positions_and_grid(spark):
    ts = datetime(1969, 12, 31, 23)
    assert one(spark, ts, C.HOURLY.pos("ts")) == -1
    assert one(spark, ts, C.HOURLY.at(C.HOURLY.pos("ts"))) == ts
    assert one(spark, datetime(2024, 1, 1, 0, 30), C.HOURLY.on_grid("ts")) is False
    with pytest.raises(ValueError):
        C.Freq("W")


def test_seasonal_names_match_columns(spark):
    for cyclical in (True, False):
        cols = C.seasonal_columns("ts", C.HOURLY, cyclical)
        assert list(cols) == C.seasonal_names(C.HOURLY, cyclical)


def test_localize_across_clock_changes(spark):
    rows = [
        ("s", 1, datetime(2024, 10, 27, 1)),
        ("s", 2, datetime(2024, 10, 27, 2)),
        ("s", 3, datetime(2024, 10, 27, 2)),
        ("s", 4, datetime(2024, 10, 27, 3)),
        ("s", 5, datetime(2024, 3, 31, 2)),  # does not exist
    ]
    df = spark.createDataFrame(rows, "series_id string, seq int, ts timestamp_ntz")
    got = [(r.seq, r.ts_utc) for r in localize(df, "seq").orderBy("seq").collect()]
    assert got == [
        (1, datetime(2024, 10, 26, 23)),
        (2, datetime(2024, 10, 27, 0)),
        (3, datetime(2024, 10, 27, 1)),
        (4, datetime(2024, 10, 27, 2)),
    ]


def test_session_time_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            ts = datetime(2024, 3, 10, 2, 30)  # skipped in New York
            assert one(spark, ts, C.HOURLY.floor("ts")) == datetime(2024, 3, 10, 2)
            assert one(spark, ts, C.to_local("ts")) == datetime(2024, 3, 10, 3, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
