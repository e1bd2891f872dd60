from __future__ import annotations

import json
from datetime import timedelta

import numpy as np
import pytest
from panel_rows import series
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelcast.config import QCOLS
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.models import estimator
from panelcast.models.estimator import PanelForecaster, PanelForecasterModel, register
from panelcast.models.linear import LinearQuantile
from panelcast.models.ml import (
    LinearQuantileRegression,
    MultipleQuantileModel,
    MultipleQuantileRegressor,
)
from panelcast.models.registry import Baseline, Setup, get_model
from panelcast.operators.baseline import baseline_forecast
from panelcast.operators.features import FeatureSpec
from panelcast.operators.folds import WINDOW, WindowParams, evaluation_grid, fold_table
from panelcast.operators.panel import SERIES, extended, regularize, since
from panelcast.plans.evaluate import Period, evaluate_period
from panelcast.plans.train import require_length, train_and_save
from panelcast.sources import artifacts


@pytest.fixture(scope="module")
def grid(spark):
    """Two series with a covariate that is known ten days longer than the target."""
    rng = np.random.default_rng(3)
    parts = []
    for name in "ab":
        x = rng.random(210)
        y = 10 + 5 * x + np.arange(210) % 7 + rng.normal(size=210)
        target = [float(v) if i < 200 else None for i, v in enumerate(y)]
        xs = series(spark, [float(v) for v in x], name, col="x")
        parts.append(series(spark, target, name).join(xs, [SERIES, "ts"]))
    return regularize(parts[0].union(parts[1]), DAILY, ["y", "x"], with_bounds=True).persist()


def collected(rows):
    return [tuple(r) for r in rows.select(SERIES, "h", "ts", *QCOLS).orderBy(SERIES, "h").collect()]


@pytest.mark.parametrize(
    ("name", "options"),
    [
        ("benchmark", {"n_weeks": 4}),
        ("quantreg", {"lags": [7], "l1": 0.0}),
        ("lgbm", {"rounds": 2, "lags": [7, 14], "lag_cols": []}),
        ("qrf", {"trees": 2, "depth": 2}),
    ],
)
def test_a_model_that_is_read_forecasts_the_same(spark, grid, tmp_path, name, options):
    x = () if name == "benchmark" else ("x",)
    estimate = PanelForecaster(modelName=name, xCols=x, options=json.dumps(options), steps=7)
    model = estimate.fit(grid)
    model.save(str(tmp_path / name))
    again = PanelForecasterModel.load(str(tmp_path / name))
    rows = collected(model.transform(grid))
    assert rows == collected(again.transform(grid))
    assert [r[:2] for r in rows] == [(s, h) for s in "ab" for h in range(1, 8)]
    assert all(list(r[3:]) == sorted(r[3:]) for r in rows)
    assert again.uid == model.uid and again.getOrDefault(again.steps) == 7


def test_the_baseline_equals_its_operator(spark, grid):
    model = PanelForecaster(options='{"n_weeks": 4}', steps=7).fit(grid)
    known = grid.filter(F.col("y").isNotNull())
    ends = known.groupBy(SERIES).agg(F.max("pos").alias("hi"))
    history = known.drop("hi").join(ends, SERIES)
    dates = ends.select(SERIES, F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + 7)).alias("pos"))
    want = baseline_forecast(history, dates, DAILY, 4).select(SERIES, "pos", *QCOLS)
    got = model.transform(grid).select(SERIES, DAILY.pos("ts").alias("pos"), *QCOLS)
    assert sorted(want.collect()) == sorted(got.collect())


def test_a_model_of_ones_own(spark, grid, tmp_path, monkeypatch):
    monkeypatch.setattr(estimator, "_OWN", {})
    spec = FeatureSpec(DAILY, (7,), lag_cols=(), seasonal=False)

    def factory(freq, x_cols, l1=0.0):
        return Setup("mine", LinearQuantile(tuple(spec.names), l1=l1), spec)

    with pytest.raises(ValueError):
        register("lgbm", factory)
    register("mine", factory)
    stages = Pipeline(stages=[PanelForecaster(modelName="mine", options='{"l1": 0.1}', steps=3)])
    stages.write().save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(grid)
    fitted.write().save(str(tmp_path / "pipeline"))
    again = PipelineModel.load(str(tmp_path / "pipeline"))
    assert collected(fitted.transform(grid)) == collected(again.transform(grid))


def test_multiple_quantile_model_is_written_as_a_whole(spark, tmp_path):
    rows = [(float(i), float(i % 9), float(2 * i + i % 5)) for i in range(60)]
    frame = spark.createDataFrame(rows, "a double, b double, label double")
    frame = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(frame)
    model = MultipleQuantileRegressor([0.1, 0.5, 0.9], LinearQuantileRegression(l1=0.0)).fit(frame)
    model.save(str(tmp_path / "m"))
    again = MultipleQuantileModel.load(str(tmp_path / "m"))
    assert list(again.regressors) == [0.1, 0.5, 0.9]
    a, b = ([r.predictions for r in m.transform(frame).orderBy("a").collect()] for m in (model, again))
    assert a == b


def test_windows_from_dates(spark):
    parts = [series(spark, [1.0] * n, name, start=start) for name, n, start in (
        ("long", 60, T0), ("late", 60, T0 + timedelta(days=20)), ("after", 30, T0 + timedelta(days=45)),
    )]
    panel = regularize(parts[0].union(parts[1]).union(parts[2]), DAILY, ["y"], with_bounds=True)
    dated = evaluation_grid(panel, DAILY, "2024-01-11", "2024-02-09", "2024-02-25")
    rows = {r[SERIES]: r for r in dated.select(SERIES, "lo", "hi", WINDOW, "n_rows").distinct().collect()}
    assert {n: (r[WINDOW], r["n_rows"]) for n, r in rows.items()} == {
        "long": (30, 46), "late": (20, 36), "after": (0, 11),
    }
    split = Period("2024-02-09", step_days=7, forecast_days=7).splitter(DAILY)
    folds = fold_table(dated.select(SERIES, "lo", "hi", WINDOW).distinct(), DAILY, split)
    found = {(r[SERIES], r["fold"]): (r["cutoff"], r["len_train_window"]) for r in folds.collect()}
    first, second = (T0 + timedelta(days=d) for d in (39, 46))
    assert found == {
        ("long", 0): (first, 30), ("long", 1): (second, 30),
        ("late", 0): (first, 20), ("late", 1): (second, 20),
    }
    assert WindowParams("window", 7, 7).columns == ["window"]


T0 = series.__defaults__[1]


@pytest.mark.parametrize("kind", ["sliding", "expanding"])
def test_evaluation_by_dates(spark, grid, tmp_path, kind):
    period = Period("2024-05-01", "2024-06-30", "2024-01-08", kind=kind)
    spec = FeatureSpec(DAILY, (7,), ("x",), lag_cols=(), seasonal=False)
    for setup in (Setup("benchmark", Baseline(6)), Setup("l", LinearQuantile(tuple(spec.names)), spec)):
        root = str(tmp_path / setup.name)
        results, metrics = evaluate_period(grid, DAILY, setup, period, root)
        rows = results.collect()
        assert {(r[SERIES], r["fold"]) for r in rows} == {(s, f) for s in "ab" for f in range(8)}
        assert {r["len_train_window"] for r in rows if r["fold"] == 0} == {115}
        assert ("fit_time" in results.columns) == (setup.spec is not None)
        back = artifacts.read_csv(spark, f"{root}/eval_results", results.schema)
        assert back.count() == 16
        assert metrics.count() == 2 * 5


def test_training_from_a_day_on(spark, grid, tmp_path):
    setup = get_model("quantreg", DAILY, ("x",), l1=0.0, lags=(7,), seasonal=False)
    path = train_and_save(grid, setup, str(tmp_path / "m"), "2024-03-01")
    late = spark.read.parquet(path).collect()
    again = since(grid, DAILY, "2024-03-01")
    assert again.agg(F.min("ts"), F.min("idx"), F.min("n_rows")).first()[:] == (T0 + timedelta(days=60), 0, 150)
    # rows are counted as the whole panel counts them
    assert {(r["first"], r["last"]) for r in late} == {(67, 199)}
    with pytest.raises(ValueError, match="too short"):
        train_and_save(grid, setup, str(tmp_path / "n"), "2024-07-15")
    with pytest.raises(ValueError, match="past_days"):
        require_length(grid.select(SERIES, "ts"), DAILY, 7, past_days=400)


def test_grids_go_on_to_a_day(spark):
    for freq, step, rows in ((DAILY, timedelta(days=1), 6), (HOURLY, timedelta(hours=1), 6 * 24)):
        grid = regularize(series(spark, [1.0, 2.0], step=step), freq, ["y"], with_bounds=True)
        longer = extended(grid, freq, "2024-01-06")
        got = longer.orderBy("pos").collect()
        assert [r["idx"] for r in got] == list(range(rows)) and {r["n_rows"] for r in got} == {rows}
        assert [r["y"] for r in got[:3]] == [1.0, 2.0, None]
        assert sorted(extended(grid, freq, "2023-12-01").collect()) == sorted(grid.collect())
