from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from panel_rows import series
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAILY
from panelcast.plans.prepare import Target, prepare_target, read_weather
from panelcast.sources import artifacts, landing


def test_a_panel_has_a_bounded_number_of_folders(spark, tmp_path):
    rows = [(f"s{i % 300}", datetime(2020, 1, 1) + timedelta(days=i // 3), float(i)) for i in range(900)]
    panel = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    path = artifacts.write_panel(panel, str(tmp_path))
    folders = [p for p in Path(path).iterdir() if p.is_dir()]
    assert 1 < len(folders) <= artifacts.BUCKETS
    back = artifacts.read_panel(spark, str(tmp_path))
    assert back.columns == panel.columns
    assert sorted(back.collect()) == sorted(panel.collect())
    one = artifacts.read_panel(spark, str(tmp_path), "s7", "2020-02-01", "2020-09-30")
    want = [r for r in rows if r[0] == "s7" and datetime(2020, 2, 1) <= r[1] < datetime(2020, 10, 1)]
    assert sorted(tuple(r) for r in one.collect()) == want
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    files = one.inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} <= {p.name.split("=")[1] for p in folders}


def test_metrics_are_lines_not_folders(spark, tmp_path):
    rows = [(f'k"{i}', m, i / 3, None if m == "b" else 1.5) for i in range(200) for m in ("a", "b")]
    metrics = spark.createDataFrame(rows, "series_id string, metric string, mean double, std double")
    path = str(tmp_path / "metrics")
    artifacts.write_metrics(metrics, ["series_id"], path)
    assert not any(p.is_dir() for p in Path(path).iterdir())
    parsed = F.from_json("value", "map<string, struct<mean: double, std: double>>")
    back = artifacts.read_metrics(spark, path, ["series_id"])
    back = back.select("series_id", F.explode(parsed).alias("metric", "v")).select("series_id", "metric", "v.*")
    assert sorted(back.collect(), key=repr) == sorted(metrics.collect(), key=repr)


def test_preparation_checks_what_it_is_given(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown kind"):
        Target("table", DAILY)
    path = str(tmp_path / "pairs")
    landing.land_pairs(series(spark, [5.0, 20000.0, None, 8.0, 9.0]), path)
    weather = series(spark, [float(i) for i in range(8)], col="rain")
    with pytest.raises(ValueError, match="no such weather"):
        prepare_target(spark, Target("pairs", DAILY, weather=("sun",)), path, str(tmp_path / "a"), weather=weather, past_days=2)
    with pytest.raises(ValueError, match="s: max_lag"):
        prepare_target(spark, Target("pairs", DAILY, max_lag=40), path, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="s: past_days"):
        prepare_target(spark, Target("pairs", DAILY), path, str(tmp_path / "c"), weather=weather)
    target = Target("pairs", DAILY, most=10000.0, scale=2.0)
    out = prepare_target(spark, target, path, str(tmp_path / "d"), weather=weather, past_days=2)
    rows = out.orderBy("ts").collect()
    # 20000 is cut and filled, as is the missing day; after the last target there is none
    assert [r["y"] for r in rows[:5]] == pytest.approx([2.5, 3.0, 3.5, 4.0, 4.5])
    assert [r["y"] for r in rows[5:]] == [None] * 3 and [r["rain"] for r in rows] == list(map(float, range(8)))
    assert dict(out.dtypes)["y"] == "float" and rows[0]["is_holiday"]


def test_weather_is_stitched_within_its_days(spark):
    start = datetime(2024, 1, 1)
    history = series(spark, [0.0] * 40, col="rain")
    ahead = series(spark, [1.0] * 30, start=start + timedelta(days=25), col="rain")
    now = F.lit("2024-02-05").cast("timestamp_ntz")
    rows = read_weather(history, ahead, DAILY, now, past_days=5, forecast_days=7).orderBy("ts").collect()
    # the feed counts from 31 January to 12 February; history ends the day before
    assert [r["ts"] for r in rows] == [start + timedelta(days=i) for i in range(43)]
    assert [r["rain"] for r in rows] == [0.0] * 30 + [1.0] * 13
