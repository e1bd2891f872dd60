from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from panel_rows import series
from pyspark.sql import functions as F

from panelcast.config import QCOLS, TREE_GRID
from panelcast.functions.calendar import DAILY
from panelcast.models import passes
from panelcast.models.forecast import backtest, backtest_settings
from panelcast.models.linear import LinearQuantile
from panelcast.models.passes import fit_here
from panelcast.models.registry import Baseline, Setup, get_model
from panelcast.models.trees import BoostedQuantile
from panelcast.operators.features import FeatureSpec, build_features, build_many
from panelcast.operators.folds import Splitter, WindowParams
from panelcast.operators.panel import SERIES, regularize
from panelcast.plans.train import feature_settings, sweep, tree_settings

SPLIT = Splitter(WindowParams(300, 60, 20), "sliding")


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(3)
    parts = []
    for name in "ab":
        x = rng.random(380)
        y = 10 + 5 * x + np.sin(np.arange(380)) + rng.normal(size=380)
        xs = series(spark, [float(v) for v in x], name, col="x")
        parts.append(series(spark, [float(v) for v in y], name).join(xs, [SERIES, "ts"]))
    return regularize(parts[0].union(parts[1]), DAILY, ["y", "x"], with_bounds=True).persist()


def linear(spec):
    return spec, LinearQuantile(tuple(spec.names), l1=0.0)


def boosted(spec, **how):
    return spec, BoostedQuantile(tuple(spec.names), depth=2, bins=20, **how)


LAGGED = FeatureSpec(DAILY, (1, 7), ("x",), lag_cols=(), seasonal=False)
FULL = FeatureSpec(DAILY, (2,), ("x",), lag_cols=None, cyclical=True, rolling=True)
SETTINGS = {
    "linear": linear(LAGGED),
    "short": boosted(LAGGED, rounds=2),
    "long": boosted(LAGGED, rounds=5),
    "stopping": boosted(LAGGED, rounds=5, patience=1, holdout=40),
    "full": linear(FULL),
}


@pytest.mark.parametrize("in_passes", [False, True])
def test_settings_equal_separate_backtests(grid, in_passes, monkeypatch):
    settings = SETTINGS
    if in_passes:
        monkeypatch.setattr(passes, "LOCAL_VALUES", 500)
        settings = {"short": boosted(LAGGED, rounds=1), "long": boosted(LAGGED, rounds=2)}
    run = backtest_settings(grid, settings, SPLIT)
    together = run.predictions.persist()
    for name, (spec, model) in settings.items():
        cols = [SERIES, "fold", "h", "y", *QCOLS]
        alone = backtest(grid, spec, model, SPLIT).predictions.select(cols).orderBy(*cols[:3]).collect()
        here = together.filter(F.col("setting") == name).select(cols).orderBy(*cols[:3]).collect()
        assert len(alone) == len(here) == 2 * 2 * 20
        assert np.allclose(*[[[r[c] for c in cols[3:]] for r in rows] for rows in (alone, here)])
    assert run.times.count() == len(settings) * 4
    assert run.times.filter("fit_time <= 0 OR pred_quantiles_time <= 0").isEmpty()


def test_features_of_many_specs_equal_those_of_each(grid):
    union = build_many(grid, [LAGGED, FULL]).orderBy(SERIES, "idx").toPandas()
    for spec in (LAGGED, FULL):
        own = build_features(grid, spec).orderBy(SERIES, "idx").toPandas()
        for n in spec.names:
            assert np.allclose(own[n].astype(float), union[n].astype(float), equal_nan=True), n


def test_a_short_fit_is_the_beginning_of_a_long_one():
    rng = np.random.default_rng(0)
    x = rng.random((200, 2))
    y = x[:, 0] + rng.normal(size=200)
    to_end = np.arange(200)[::-1]
    for growth in ("leaf", "symmetric"):
        long = BoostedQuantile(("a", "b"), rounds=6, depth=3, growth=growth, subsample=0.8, bins=20)
        short = replace(long, rounds=2)
        params = fit_here(long, x, y, to_end)
        assert np.array_equal(short.shortened(params), fit_here(short, x, y, to_end))
        assert np.array_equal(long.shortened(params), params)


def test_grids():
    found = tree_settings(get_model("lgbm", DAILY, ("x",)), TREE_GRID)
    assert len(found) == 45
    assert {s.model.max_leaves for s in found.values()} == {6, 15, 31, 62, 90}
    capped = tree_settings(get_model("lgbm", DAILY), TREE_GRID | {"max_depth": (3,)})
    assert {(s.model.max_leaves, s.model.depth) for s in capped.values()} == {(6, 3), (8, 3)}
    features = feature_settings("quantreg", DAILY, ("x",))
    assert len(features) == 12 and len({s.spec for s in features.values()}) == 12
    widths = {len(s.spec.names) for s in features.values()}
    assert min(widths) == 3 and max(widths) > 25


def test_sweep_has_every_metric_of_every_setting(grid):
    settings = {"benchmark": Setup("benchmark", Baseline(5))} | {
        n: Setup(n, model, spec) for n, (spec, model) in SETTINGS.items() if n != "full"
    }
    rows = sweep(grid, DAILY, settings, SPLIT).collect()
    by_setting = {n: {r["metric"]: r["mean"] for r in rows if r["setting"] == n} for n in settings}
    scores = {"pinball_loss", "interval_score_50", "interval_score_95", "coverage_50", "coverage_95"}
    for name, metrics in by_setting.items():
        wanted = scores | {"avg_pred_time"} | ({"avg_fit_time"} if name != "benchmark" else set())
        assert set(metrics) == wanted and all(v >= 0 for v in metrics.values())

