from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from panel_rows import column, series
from pyspark.sql import functions as F

from panelcast.config import QCOLS
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.operators.blocks import drop_halo, with_halo
from panelcast.operators.features import (
    FeatureSpec,
    build_features,
    offsets,
    seasonal_rolling_quantiles,
    training_frame,
)
from panelcast.operators.panel import regularize

HOUR = timedelta(hours=1)
START = datetime(2021, 1, 1)


@pytest.fixture
def fixture(spark):
    """14 hourly rows: rain and load."""
    rain = [3, 2, 1, 0, -1, -2, -3, -4, -5, -6, -7, -8, -9, -10]
    load = [float(v) for v in range(-100, 40, 10)]
    x = series(spark, [float(v) for v in rain], start=START, step=HOUR, col="rain")
    y = series(spark, load, start=START, step=HOUR, col="load")
    return regularize(y.join(x, ["series_id", "ts"]), HOURLY, ["load", "rain"])


def test_lag_names_and_values(fixture):
    spec = FeatureSpec(HOURLY, (1, 2), ("rain",), seasonal=False, target="load")
    assert spec.names == ["rain", "rain_lag_1", "rain_lag_2", "load_lag_1", "load_lag_2"]
    frame = training_frame(build_features(fixture, spec), spec)
    assert frame.count() == 12
    rows = frame.orderBy("ts").collect()
    assert (rows[0].rain_lag_1, rows[0].rain_lag_2) == (2, 3)
    assert (rows[0].load, rows[0].load_lag_1, rows[0].load_lag_2) == (-80, -90, -100)


def test_lag_columns_can_be_switched_off(fixture):
    spec = FeatureSpec(HOURLY, (1,), ("rain",), lag_cols=(), target="load")
    assert "rain_lag_1" not in spec.names and "hour_sin" in spec.names
    hot = FeatureSpec(HOURLY, (1,), cyclical=False, one_hot=True, lag_cols=())
    assert "dayofweek_1" in hot.names and "dayofweek_0" not in hot.names


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(0)
    grid = regularize(series(spark, [float(v) for v in rng.normal(size=120)]), DAILY, ["y"])
    spec = FeatureSpec(DAILY, (1, 7), rolling=True)
    cut = datetime(2024, 1, 1) + timedelta(days=100)
    full = build_features(grid, spec).filter(F.col("ts") <= cut)
    short = build_features(grid.filter(F.col("ts") <= cut), spec)
    names = ["ts", *spec.names]
    assert full.select(names).orderBy("ts").collect() == short.select(names).orderBy("ts").collect()


def test_rolling_quantiles_equal_pandas(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=260)
    grid = regularize(series(spark, [float(v) for v in y]), DAILY, ["y"])
    halo = with_halo(grid, "pos", back=90, rows=64)
    cols = dict(zip(QCOLS, seasonal_rolling_quantiles(halo, DAILY).values()))
    got = drop_halo(halo.withColumns(cols)).orderBy("ts").toPandas()
    s = pd.Series(y, index=pd.date_range("2024-01-01", periods=len(y)))
    roll = s.groupby(s.index.weekday).rolling("90D", closed="left")
    for q, c in ((0.025, "q025"), (0.5, "q50"), (0.975, "q975")):
        want = roll.quantile(q).reset_index(level=0, drop=True).sort_index()
        assert np.allclose(got[c], want, equal_nan=True)


def test_offsets_look_both_ways(spark):
    grid = regularize(series(spark, [1.0, 2.0, 3.0]), DAILY, ["y"])
    out = offsets(grid, ["y"], [-1, 0, 1])
    assert column(out, "y_lag_1") == [None, 1, 2]
    assert column(out, "y_now") == [1, 2, 3]
    assert column(out, "y_lead_1") == [2, 3, None]


def test_bad_lags_are_refused():
    with pytest.raises(ValueError):
        FeatureSpec(DAILY, (0, 1))
