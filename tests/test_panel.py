from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from panel_rows import column, series
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.operators import panel as P
from panelcast.operators.blocks import row_numbers
from panelcast.operators.joins import join_covariates, stitch, upsert

HOUR = timedelta(hours=1)


def test_interpolation_vector(spark):
    rows = series(spark, [None, 1.0, None, None, 4.0, 5.0, None, None])
    grid = P.regularize(rows, DAILY, ["y"])
    assert column(P.interpolate(grid, ["y"])) == [None, 1, 2, 3, 4, 5, 5, 5]


def test_prefix_interpolation_leaves_the_future(spark):
    rows = series(spark, [None, 1.0, None, 3.0, None, None]).withColumn(
        "x", F.when(F.dayofmonth("ts") != 2, F.dayofmonth("ts").cast("double"))
    )
    grid = P.regularize(rows, DAILY, ["y", "x"])
    out = P.interpolate_prefix(grid, ["y", "x"])
    assert column(out) == [None, 1, 2, 3, None, None]
    assert column(out, "x") == [1, 2, 3, 4, 5, 6]


def test_backfill_keeps_source_nulls(spark):
    start = datetime(2024, 1, 1)
    rows = [("s", start, 1.0), ("s", start + 2 * HOUR, None), ("s", start + 5 * HOUR, 3.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    assert column(P.upsample_backfill(df, HOURLY, "y")) == [1, None, None, 3, 3, 3]


def test_small_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    y = [float(v) if keep else None for v, keep in zip(rng.normal(size=300), rng.random(300) < 0.2)]
    grid = P.regularize(series(spark, y), DAILY, ["y"]).persist()
    want = pd.Series([np.nan if v is None else v for v in y]).interpolate().to_list()
    for rows in (7, 64, 4096):
        got = column(P.interpolate(grid, ["y"], rows=rows))
        assert np.allclose([np.nan if v is None else v for v in got], want, equal_nan=True)
    numbered = row_numbers(grid.filter("y is not null"), ["series_id"], "pos", rows=5)
    assert column(numbered, "rn") == list(range(1, sum(v is not None for v in y) + 1))


def test_grid_drops_off_grid_rows_and_refuses_duplicates(spark):
    base = datetime(2024, 1, 1)
    rows = [("s", base, 1.0), ("s", base + timedelta(hours=5), 9.0), ("s", base + 2 * 24 * HOUR, 3.0)]
    schema = "series_id string, ts timestamp_ntz, y double"
    grid = P.regularize(spark.createDataFrame(rows, schema), DAILY, ["y"], with_bounds=True)
    assert column(grid) == [1, None, 3]
    assert column(grid, "idx") == [0, 1, 2]
    twice = spark.createDataFrame([*rows, ("s", base, 2.0)], schema)
    for read in (lambda g: g.collect(), lambda g: g.count(), lambda g: g.select("ts").collect()):
        with pytest.raises(Exception, match="duplicate timestamps"):
            read(P.regularize(twice, DAILY, ["y"]))


def test_infer_frequency(spark):
    daily = series(spark, [1.0] * 5, "d")
    gap = daily.filter(F.dayofmonth("ts") != 3).withColumn("series_id", F.lit("gap"))
    hourly = series(spark, [1.0] * 5, "h", step=HOUR)
    short = series(spark, [1.0] * 2, "short")
    twice = daily.union(daily.limit(1)).withColumn("series_id", F.lit("twice"))
    late = series(spark, [1.0] * 4, "late", start=datetime(2024, 1, 1, 6))
    got = P.infer_frequency(daily.union(gap).union(hourly).union(short).union(twice).union(late))
    want = {"d": "D", "gap": None, "h": "h", "short": None, "twice": None, "late": "D"}
    assert {r.series_id: r.freq for r in got.collect()} == want


def test_join_is_one_to_one(spark):
    y = series(spark, [1.0, 2.0])
    x = series(spark, [5.0, 6.0, 7.0], col="x")
    assert column(join_covariates(y, x)) == [1, 2, None]
    with pytest.raises(Exception, match="not unique"):
        join_covariates(y.union(y), x).collect()


def test_stitch_and_upsert(spark):
    history = series(spark, [1.0, 2.0, 3.0, 4.0])
    forecast = series(spark, [30.0, 40.0], start=datetime(2024, 1, 3))
    assert column(stitch(history, forecast, DAILY)) == [1, 2, 30, 40]
    values = forecast.withColumnRenamed("y", "value")
    out = upsert(history.filter("y < 4"), values, ["series_id", "ts"])
    assert column(out) == [1, 2, 30, 40]


def test_keep_first_of_a_hot_key(spark):
    df = spark.range(0, 5000).select(
        F.lit("hot").alias("k"), (5000 - F.col("id")).alias("seq"), F.col("id").alias("v")
    )
    assert P.keep_first(df, ["k"], "seq").collect() == [("hot", 1, 4999)]


def test_rolling_mean_waits_for_a_full_window(spark):
    grid = P.regularize(series(spark, [1.0, 2.0, 3.0, 4.0]), DAILY, ["y"])
    assert column(P.rolling_mean(grid, "y", 3, "m"), "m") == [None, None, 2, 3]
