from datetime import timedelta

import numpy as np
import pytest
from panel_rows import series
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.models import passes, trees
from panelcast.models.forecast import (
    backtest,
    check_horizon,
    forecast,
    horizon_steps,
    importances,
    roll_forward,
    train,
)
from panelcast.models.forest import QuantileForest
from panelcast.models.linear import LinearQuantile
from panelcast.models.ml import LinearQuantileRegression, MultipleQuantileRegressor
from panelcast.models.passes import fit_here
from panelcast.models.registry import NAMES, Baseline, direct_linear, get_model
from panelcast.models.trees import BoostedQuantile
from panelcast.operators.baseline import baseline_backtest
from panelcast.operators.features import FeatureSpec
from panelcast.operators.folds import Splitter, WindowParams, fold_table, window_params
from panelcast.operators.panel import SERIES, regularize
from panelcast.operators.scoring import fold_scores, pinball

SPEC = FeatureSpec(DAILY, (1, 2), ("x",), lag_cols=(), seasonal=False)


@pytest.fixture(scope="module")
def noisy(spark):
    """Two series whose spread grows with a known covariate."""
    rng = np.random.default_rng(0)
    parts = []
    for name, scale in (("a", 1.0), ("b", 10.0)):
        x = rng.random(700)
        y = scale * (5 + 3 * x + (0.2 + 2 * x) * rng.normal(size=700))
        xs = series(spark, [float(v) for v in x], name, col="x")
        parts.append(series(spark, [float(v) for v in y], name).join(xs, [SERIES, "ts"]))
    return regularize(parts[0].union(parts[1]), DAILY, ["y", "x"], with_bounds=True).persist()


SPLIT = Splitter(WindowParams(500, 100, 50), "sliding")


def total_loss(rows):
    taus = dict(zip(QCOLS, LEVELS, strict=True))
    cells = [F.avg(pinball(F.col("y"), F.col(c), t)) for c, t in taus.items()]
    return sum(rows.agg(*cells).first())


@pytest.mark.parametrize(
    "model",
    [
        BoostedQuantile(tuple(SPEC.names), rounds=3, depth=2, learning_rate=0.7, growth="leaf",
                        max_leaves=4, subsample=0.9, colsample=0.9),
        BoostedQuantile(tuple(SPEC.names), rounds=3, depth=2, growth="symmetric",
                        learning_rate=0.7, patience=3, holdout=50),
        QuantileForest(tuple(SPEC.names), trees=15, depth=3),
    ],
    ids=lambda m: f"{m.kind}-{getattr(m, 'growth', '')}",
)
def test_models_beat_constant_quantiles(noisy, model):
    run = backtest(noisy, SPEC, model, SPLIT)
    rows = run.predictions
    assert rows.count() == 2 * 2 * 50
    constant = noisy.groupBy(SERIES).agg(
        F.percentile("y", F.array(*[F.lit(q) for q in LEVELS])).alias("q")
    )
    flat = rows.select(SERIES, "y").join(constant, SERIES).select(
        "y", *[F.col("q")[i].alias(c) for i, c in enumerate(QCOLS)]
    )
    assert total_loss(rows) < 0.93 * total_loss(flat)
    for r in rows.select(*QCOLS).collect():
        assert list(r) == sorted(r)
    spent = run.times.collect()
    assert len(spent) == 4 and all(r.fit_time > 0 and r.pred_quantiles_time > 0 for r in spent)


@pytest.mark.parametrize(
    "model",
    [
        BoostedQuantile(tuple(SPEC.names), rounds=2, depth=2, learning_rate=0.5),
        QuantileForest(tuple(SPEC.names), trees=4, depth=2),
    ],
    ids=lambda m: m.kind,
)
def test_later_rows_change_no_earlier_fold(noisy, model):
    """Fold 0 trains on rows 0-499 and forecasts 500-549."""
    later = noisy.withColumns(
        {c: F.when(F.col("idx") >= 550, F.col(c) * 7 + 3).otherwise(F.col(c)) for c in ("y", "x")}
    )
    cols = [SERIES, "h", *QCOLS]
    a, b = (
        backtest(g, SPEC, model, SPLIT).predictions.filter("fold = 0").select(*cols).orderBy(*cols)
        for g in (noisy, later)
    )
    assert a.collect() == b.collect()


def test_early_stopping_can_use_the_last_tree(noisy):
    model = BoostedQuantile(tuple(SPEC.names), rounds=2, depth=1, learning_rate=0.1,
                            patience=5, holdout=50)
    fitted = train(noisy, SPEC, model).collect()
    assert all(r["params"][0] == 2 for r in fitted)  # rounds used


def test_too_short_a_series_raises(spark):
    grid = regularize(series(spark, [1.0, 2.0, 3.0]), DAILY, ["y"], with_bounds=True)
    spec = FeatureSpec(DAILY, (7,), lag_cols=(), seasonal=False)
    for model in (LinearQuantile(tuple(spec.names)), QuantileForest(tuple(spec.names), trees=2, depth=1)):
        with pytest.raises(ValueError, match="too few rows"):
            train(grid, spec, model)


def test_short_horizon_raises(noisy):
    model = LinearQuantile(tuple(SPEC.names), max_iter=2)
    models = train(noisy.filter("idx < 690"), SPEC, model)
    assert forecast(noisy, models, SPEC, model, 10).count() == 20
    with pytest.raises(Exception, match="enough data for the forecast horizon"):
        forecast(noisy, models, SPEC, model, 20).count()


def check_loss(x, y, tau, coefficients, l1):
    r = y - coefficients[0] - x @ coefficients[1:]
    penalty = l1 * (x.std(axis=0) * np.abs(coefficients[1:])).sum()
    return np.maximum(tau * r, (tau - 1) * r).mean() + penalty


def best_through_points(x, y, tau):
    """The least check loss of a line: it passes through two of the points."""
    n, best = len(y), np.inf
    for i in range(n):
        for j in range(i):
            if x[i] != x[j]:
                slope = (y[i] - y[j]) / (x[i] - x[j])
                line = np.array([y[i] - slope * x[i], slope])
                best = min(best, check_loss(x[:, None], y, tau, line, 0.0))
    return best


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_linear_loss_is_the_least(seed):
    rng = np.random.default_rng(seed)
    x = rng.random(60)
    y = 3 * x + (0.3 + x) * rng.standard_t(3, size=60)
    model = LinearQuantile(("x",), l1=0.0)
    params = fit_here(model, x[:, None], y, np.arange(60)[::-1])
    assert model.converged(params)
    for tau, line in zip(model.levels, model.coefficients(params), strict=True):
        assert check_loss(x[:, None], y, tau, line, 0.0) < (1 + 1e-7) * best_through_points(x, y, tau)


SHAPES = {
    "light": lambda r, n, p: r.normal(size=(n, p)),
    "scaled": lambda r, n, p: r.normal(size=(n, p)) * 10.0 ** np.arange(-3, p - 3),
    "dummies": lambda r, n, p: np.eye(p)[r.integers(0, p, n)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("l1", [0.0, 1.0])
def test_linear_fits_end_soon(shape, l1):
    rng = np.random.default_rng(3)
    x = SHAPES[shape](rng, 900, 9)
    y = x @ (rng.normal(size=9) / (x.std(axis=0) + 0.01)) + rng.gamma(1.0, 2.0, 900)
    model = LinearQuantile(tuple("abcdefghi"), l1=l1)
    params = fit_here(model, x, y, np.arange(900)[::-1])
    assert model.converged(params) and model.passes(params) <= 30
    below = (y[:, None] <= model.predict(x, params, None) + 1e-9).mean(axis=0)
    if not l1:
        assert np.all(np.abs(below - model.levels) <= 15 / 900)
    for tau, b in zip(model.levels, model.coefficients(params), strict=True):
        own = check_loss(x, y, tau, b, l1)
        for _ in range(60):  # no way down from there
            step = rng.normal(size=10) * np.append(1.0, 1 / (x.std(axis=0) + 0.01))
            for size in (1e-3, 1e-2, 0.1, 1.0):
                assert own < (1 + 1e-9) * check_loss(x, y, tau, b + size * step, l1)


@pytest.fixture
def in_passes(monkeypatch):
    """Windows are too long for a task; rows are written again after each round."""
    monkeypatch.setattr(passes, "LOCAL_VALUES", 30)
    monkeypatch.setattr(passes, "KEEP_ROUNDS", 1)


def exact(spec, model):
    """Constants from all rows, in place of sketches."""

    def constants(frame, models, names, bins, target):
        pdf = frame.dropna(subset=[*names, target]).toPandas().sort_values("idx")
        rows = []
        for m in models.collect():
            own = pdf[(pdf[SERIES] == m[SERIES]) & pdf["idx"].between(m["first"], m["last"])]
            aux = model.constants(own[list(names)].to_numpy(), own[target].to_numpy())
            rows.append((m[SERIES], m["fold"], aux.tolist()))
        return models.sparkSession.createDataFrame(rows, "series_id string, fold long, aux array<double>")

    return constants


@pytest.mark.parametrize(
    "model",
    [
        BoostedQuantile(tuple(SPEC.names), levels=(0.1, 0.5), rounds=3, depth=5, growth="leaf", max_leaves=4,
                        subsample=0.8, colsample=0.7, bins=16),
        BoostedQuantile(tuple(SPEC.names), levels=(0.1, 0.5), rounds=4, depth=2, growth="symmetric", bins=9,
                        patience=2, holdout=40, colsample=0.7, column_draw="depth"),
    ],
    ids=lambda m: f"{m.kind}-{getattr(m, 'growth', '')}",
)
def test_passes_and_tasks_agree(noisy, model, monkeypatch, request):
    split = Splitter(WindowParams(600, 90, 10), "sliding")

    def params():
        run = backtest(noisy, SPEC, model, split)
        return {(r[SERIES], r["fold"]): np.asarray(r["params"]) for r in run.models.collect()}

    here = params()
    request.getfixturevalue("in_passes")
    monkeypatch.setattr(trees, "sketched_constants", exact(SPEC, model))
    there = params()
    assert here.keys() == there.keys() and len(here) == 4
    for key, one in here.items():
        assert np.allclose(one, there[key], rtol=1e-7, atol=1e-7)


def test_linear_passes_come_close_to_the_exact_minimum(noisy, request):
    model = LinearQuantile(tuple(SPEC.names), levels=(0.1, 0.5), l1=0.0)
    split = Splitter(WindowParams(600, 90, 10), "sliding")
    exactly = backtest(noisy, SPEC, model, split).models
    request.getfixturevalue("in_passes")
    near = backtest(noisy, SPEC, model, split).models
    both = exactly.join(near.select(SERIES, "fold", F.col("params").alias("other")), [SERIES, "fold"])
    rows = both.collect()
    assert len(rows) == 4
    for r in rows:  # losses by level follow the coefficients
        least, loss = (np.asarray(r[c])[-4:-2] for c in ("params", "other"))
        assert np.all(least <= loss * (1 + 1e-9)) and np.all(loss <= 1.003 * least)


def test_sketched_bins_are_close_to_exact_ones(spark):
    rng = np.random.default_rng(1)
    n = 6000
    cols = [(float(v), float(w)) for v, w in zip(rng.normal(size=n), rng.gamma(2, 3, n), strict=True)]
    frame = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate(cols)], "series_id string, idx long, x double, y double")
    folds = [("a", 0, 0, n - 1), ("a", 1, 700, 5100), ("a", 2, 3, 400)]
    models = spark.createDataFrame(folds, "series_id string, fold long, first long, last long")
    model = BoostedQuantile(("x",), bins=20)
    x, y = np.array(cols).T
    got = {r["fold"]: np.asarray(r["aux"]) for r in trees.sketched_constants(frame, models, ("x",), 20).collect()}
    for _, fold, first, last in folds:
        own = slice(first, last + 1)
        edges, grid = trees.split_aux(got[fold], 1)
        want, labels = trees.split_aux(model.constants(x[own, None], y[own]), 1)
        for found, true, values in ((edges[0], want[0], x[own]), (grid, labels, y[own])):
            rank = np.searchsorted(np.sort(values), found) - np.searchsorted(np.sort(values), true)
            assert np.abs(rank).max() <= max(2, 0.01 * len(values))


def node_depths(model, params):
    _, roots, nodes = model._tables(params)
    depth = np.zeros(len(nodes), int)
    for i, (feature, _, left, _) in enumerate(nodes):  # children come after their parent
        if feature >= 0:
            depth[[int(left), int(left) + 1]] = depth[i] + 1
    return [depth[a:b] for a, b in zip(roots, [*roots[1:], len(nodes)], strict=True)]


def test_best_first_growth_goes_where_the_gain_is():
    """Runs of two labels, each half as long as the one before: every cut leaves one pure
    side, so leaves lie below one another, deeper than as many grown level by level."""
    x = np.arange(400.0)[:, None]
    y = np.repeat([0.0, 1.0, 0.0, 1.0, 0.0], [200, 100, 50, 25, 25])
    to_end = np.arange(400)[::-1]
    sizes = {}
    for leaves in (3, 5, 64):
        model = BoostedQuantile(("x",), levels=(0.5,), rounds=1, depth=9, growth="leaf",
                                max_leaves=leaves, min_child=5, bins=80)
        [depth] = node_depths(model, fit_here(model, x, y, to_end))
        sizes[leaves] = (len(depth), depth.max())
    assert sizes == {3: (5, 2), 5: (9, 4), 64: (9, 4)}
    capped = BoostedQuantile(("x",), levels=(0.5,), rounds=1, depth=2, growth="leaf",
                             max_leaves=64, min_child=1, bins=80)
    [depth] = node_depths(capped, fit_here(capped, x, y, to_end))
    assert depth.max() == 2


def test_first_cut_is_the_best_of_all():
    """One round of stumps against every cut tried by hand."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = x[:, 1] * 2 + rng.normal(size=300)
    model = BoostedQuantile(tuple("abc"), rounds=1, depth=1, min_child=10, penalty=1.0, learning_rate=1.0)
    params = fit_here(model, x, y, np.arange(300)[::-1])
    base, roots, nodes = model._tables(params)
    for t, tau in enumerate(model.levels):
        gradient = np.where(y > base[t], tau, tau - 1)
        best = (-np.inf, 0, 0.0)
        for j in range(3):
            for cut in np.unique(x[:, j]):
                left = x[:, j] <= cut
                n, m = left.sum(), (~left).sum()
                if min(n, m) >= 10:
                    gain = gradient[left].sum() ** 2 / (n + 1) + gradient[~left].sum() ** 2 / (m + 1)
                    best = max(best, (gain, -j, -cut))
        feature, cut = nodes[roots[t], :2]
        left = x[:, int(feature)] <= cut
        gain = gradient[left].sum() ** 2 / (left.sum() + 1) + gradient[~left].sum() ** 2 / ((~left).sum() + 1)
        assert np.isclose(gain, best[0])
        for side, leaf in ((left, int(nodes[roots[t], 2])), (~left, int(nodes[roots[t], 2]) + 1)):
            r = y[side] - base[t]
            assert np.quantile(r, max(0, tau - 0.03)) - 0.1 <= nodes[leaf, 3] <= np.quantile(r, min(1, tau + 0.03)) + 0.1


def brute_tree(x, y, w, min_child, depth=None, at=0):
    """Nested (column, value, left, right); a leaf is (labels, weights)."""
    x, y, w = x[w > 0], y[w > 0], w[w > 0]

    def spread(k):
        return (w[k] * (y[k] - np.average(y[k], weights=w[k])) ** 2).sum()

    best = (1e-9, None)
    for j in range(x.shape[1]):
        for value in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= value
            if min(w[left].sum(), w[~left].sum()) >= min_child:
                gain = spread(w > 0) - spread(left) - spread(~left)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, value))
    if best[1] is None or at == depth:
        return y, w
    j, value = best[1]
    left = x[:, j] <= value
    middle = (value + x[~left, j].min()) / 2
    children = [brute_tree(x[k], y[k], w[k], min_child, depth, at + 1) for k in (left, ~left)]
    return (j, middle, *children)


@pytest.mark.parametrize(("min_child", "depth"), [(1, None), (3, None), (1, 2)])
def test_forest_equals_brute_force(min_child, depth):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 8, size=(60, 3)).astype(float)
    y = x[:, 0] * 2 + rng.normal(size=60)
    to_end = np.arange(60)[::-1]
    model = QuantileForest(tuple("abc"), trees=5, min_child=min_child, depth=depth)
    got = model.predict(x, fit_here(model, x, y, to_end), None)
    grown = [brute_tree(x, y, model.weights(to_end, k), min_child, depth) for k in range(5)]
    for row, quantiles in zip(x, got, strict=True):
        held = []
        for tree in grown:
            while len(tree) == 4:
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            held += [(label, weight / tree[1].sum() / 5) for label, weight in zip(*tree, strict=True)]
        held.sort()
        cdf = np.cumsum([weight for _, weight in held])
        want = [held[min(int(np.searchsorted(cdf, q - 1e-12)), len(held) - 1)][0] for q in model.levels]
        assert np.allclose(want, quantiles)


def test_forest_windows_have_a_limit(noisy):
    model = QuantileForest(tuple(SPEC.names), trees=2, local_values=300)
    with pytest.raises(ValueError, match="beyond its limit"):
        train(noisy, SPEC, model)


def test_registered_settings_are_the_workloads():
    leafwise, hourly = (get_model("lgbm", f, ("x",)).model for f in (DAILY, HOURLY))
    assert (leafwise.max_leaves, leafwise.depth, leafwise.rounds, leafwise.bins) == (15, 9, 250, 255)
    assert (hourly.max_leaves, hourly.depth, hourly.min_child) == (20, 12, 200)
    forest = get_model("qrf", DAILY, ("x",)).model
    assert (forest.trees, forest.depth, forest.min_child) == (100, None, 1)


def test_linear_fit_splits_the_data_at_its_level(noisy):
    spec = FeatureSpec(DAILY, (1,), ("x",), lag_cols=(), seasonal=False)
    model = LinearQuantile(tuple(spec.names), levels=(0.1, 0.5, 0.9), l1=0.0)
    rows = {r[SERIES]: np.asarray(r["params"]) for r in train(noisy, spec, model).collect()}
    pdf = noisy.orderBy(SERIES, "idx").toPandas()
    for name, params in rows.items():
        own = pdf[pdf[SERIES] == name]
        x = np.column_stack([own["x"].to_numpy()[1:], own["y"].to_numpy()[:-1]])
        assert model.converged(params)
        q = model.predict(x, params, np.array([]))
        below = (own["y"].to_numpy()[1:, None] <= q).mean(axis=0)
        # a quantile fit leaves its share below, up to one row per coefficient
        assert np.all(np.abs(below - model.levels) < 6 / len(own))


def test_penalty_shrinks_the_coefficients(noisy):
    sizes = []
    for l1 in (0.0, 1.0):
        model = LinearQuantile(tuple(SPEC.names), levels=(0.5,), l1=l1)
        params = np.asarray(train(noisy, SPEC, model).filter("series_id = 'a'").first()["params"])
        sizes.append(np.abs(params[1:4]).sum())
    assert sizes[1] < 0.2 * sizes[0]


def test_multiple_quantile_regressor(spark):
    frame = spark.createDataFrame([(float(v), float(v)) for v in (1, 2, 3)], "x double, label double")
    frame = VectorAssembler(inputCols=["x"], outputCol="features").transform(frame)
    model = MultipleQuantileRegressor([0.1, 0.9], LinearQuantileRegression(), n_jobs=2).fit(frame)
    assert len(model.regressors) == 2
    for q, one in model.regressors.items():
        assert one.getOrDefault(one.quantile) == q
    later = spark.createDataFrame([(4.0,), (5.0,), (6.0,)], "x double")
    later = VectorAssembler(inputCols=["x"], outputCol="features").transform(later)
    rows = [r.predictions for r in model.transform(later).collect()]
    assert len(rows) == 3 and all(len(p) == 2 and p[0] <= p[1] for p in rows)
    with pytest.raises(ValueError):
        MultipleQuantileRegressor([0.5], LinearRegression()).fit(frame)


class Echo:
    """A model whose forecasts are a fixed mix of its features."""

    levels = (0.1, 0.5, 0.9)

    def predict(self, x, params, aux):
        centre = x @ params
        return np.column_stack([centre + 1, centre, centre - 1])  # crossed on purpose


@pytest.mark.parametrize("rolling", [False, True])
def test_blocks_equal_single_steps(rolling):
    spec = FeatureSpec(DAILY, (2, 3), lag_cols=(), seasonal=False, rolling=rolling)
    rng = np.random.default_rng(4)
    tail, static = rng.normal(size=spec.reach), np.empty((11, 0))
    params = rng.normal(size=len(spec.names)) / 4
    got = roll_forward(Echo(), spec, tail, static, params, np.array([]))
    y = list(tail)
    for _ in range(11):
        x = [y[-2], y[-3]]
        if rolling:
            phase = [y[i] for i in range(len(y) - 7, len(y) - 91, -7)]
            x += list(np.quantile(phase, LEVELS))
        y.append(float(np.dot(x, params)))
    want = np.array(y[spec.reach :])
    assert np.allclose(got[:, 1], want)
    assert np.allclose(got[:, 0], want - 1)  # sorted back


def test_three_folds_with_and_without_covariates(spark):
    rng = np.random.default_rng(7)
    hours = np.arange(1368)
    load = 50 + 10 * np.sin(2 * np.pi * hours / 24) + rng.normal(size=1368)
    panel = series(spark, [float(v) for v in load], step=timedelta(hours=1))
    panel = panel.withColumn("hour_of_day", F.hour("ts").cast("double"))
    grid = regularize(panel, HOURLY, ["y", "hour_of_day"], with_bounds=True).persist()
    split = Splitter(WindowParams(1008, 168, 24), "sliding")
    limits = grid.groupBy(SERIES).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    assert fold_table(limits, HOURLY, split).count() == 3
    for x_cols, seasonal in (((), True), (("hour_of_day",), False)):
        setup = get_model("xgb-custom", HOURLY, x_cols, lags=(24, 168), seasonal=seasonal,
                          cyclical=False, rounds=1, depth=2, learning_rate=0.5)
        run = backtest(grid, setup.spec, setup.model, split)
        scores = fold_scores(run.predictions).collect()
        assert len(scores) == 3 and all(r.n == 24 for r in scores)


def test_contract(noisy):
    model = LinearQuantile(tuple(SPEC.names), l1=0.0, max_iter=2)
    models = train(noisy.filter("idx < 650"), SPEC, model)
    inside = noisy.filter("idx between 640 and 645").select(SERIES, "ts")
    with pytest.raises(NotImplementedError):
        horizon_steps(noisy, models, inside)
    with pytest.raises(NotImplementedError):
        check_horizon(noisy, models, 0)
    with pytest.raises(ValueError):
        check_horizon(noisy, models, 51)
    check_horizon(noisy, models, 50)
    ahead = noisy.filter("idx between 655 and 660").select(SERIES, "ts")
    assert horizon_steps(noisy, models, ahead) == 11
    with pytest.raises(ValueError):
        forecast(noisy, models, SPEC, LinearQuantile(tuple(SPEC.names), levels=(0.1, 0.9)), 5)
    with pytest.raises(ValueError):
        train(noisy, SPEC, LinearQuantile(("other",)))


def test_importance_counts_splits(noisy):
    model = BoostedQuantile(tuple(SPEC.names), rounds=2, depth=2)
    table = importances(train(noisy, SPEC, model), model)
    top = table.groupBy("feature").agg(F.sum("importance").alias("n")).orderBy(F.desc("n")).first()
    assert top["feature"] == "x"
    assert table.count() == 2 * len(LEVELS) * len(SPEC.names)


def test_registry(spark):
    for freq in (DAILY, HOURLY):
        for name in NAMES:
            setup = get_model(name, freq, ("x",))
            assert isinstance(setup.model, Baseline) or setup.model.names == tuple(setup.spec.names)
    # direct models feed nothing back: every lag is at least the chunk
    assert min(get_model("xgboost", DAILY, chunk=7).spec.lags) == 7
    assert min(direct_linear(HOURLY, (), chunk=24).spec.lags) >= 24
    with pytest.raises(ValueError):
        get_model("prophet", DAILY)


def test_window_params_and_splitters():
    assert window_params(2.5, 7, 14, "D") == WindowParams(912, 7, 14)
    assert window_params(0.5, 7, 7, "h") == WindowParams(4380, 168, 168)
    with pytest.raises(ValueError):
        window_params(1, 7, 7, "W")
    with pytest.raises(ValueError):
        Splitter(WindowParams(1, 1, 1), "rolling")


@pytest.mark.parametrize("kind", ["sliding", "expanding"])
def test_baseline_equals_looking_history_up(spark, kind):
    """Multi-week horizon and clipped history against a plain loop."""
    rng = np.random.default_rng(9)
    y = [float(v) if rng.random() > 0.1 else None for v in rng.normal(size=200)]
    grid = regularize(series(spark, y), DAILY, ["y"], with_bounds=True)
    n = grid.count()
    first = 200 - n if y[0] is None else 0
    y = y[first : first + n]
    split, weeks = Splitter(WindowParams(60, 13, 20), kind), 6
    got = {(r.fold, r.idx): r for r in baseline_backtest(grid, DAILY, split, weeks).collect()}
    seen = 0
    for fold in range((n - 80) // 13 + 1):
        cut = 59 + 13 * fold
        start = cut - 59 if kind == "sliding" else 0
        for i in range(cut + 1, cut + 21):
            past = [j for j in range(start, cut + 1) if (i - j) % 7 == 0][-weeks:]
            values = [y[j] for j in past if y[j] is not None]
            row = got[(fold, i)]
            if values:
                want = np.quantile(values, LEVELS)
                assert [row[c] for c in QCOLS] == pytest.approx(list(want))
            else:
                assert row["q50"] is None
            seen += 1
    assert seen == len(got)
