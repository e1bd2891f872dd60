"""Queries of the fitted models.

SQL cannot fit them; it states what holds for any fit: which rows are forecast, their
actual values, that quantiles do not cross, and how many rows lie below a fitted level.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.config import DIRECT_COVARIATE_OFFSETS, MODEL_GRID, QCOLS, TREE_GRID
from panelcast.functions.calendar import DAILY, is_holiday
from panelcast.models.estimator import PanelForecaster, PanelForecasterModel
from panelcast.models.forecast import (
    backtest,
    check_horizon,
    fitted_shares,
    forecast,
    importances,
    train,
)
from panelcast.models.ml import LinearQuantileRegression, MultipleQuantileRegressor
from panelcast.models.registry import (
    direct_grid,
    direct_linear,
    direct_linear_steps,
    direct_parts,
    get_model,
)
from panelcast.operators.experiments import mean_importance, top_features
from panelcast.operators.folds import Splitter, WindowParams
from panelcast.operators.panel import SERIES, interpolate, interpolate_prefix
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import query, r, with_ctes
from panelcast.plans.train import (
    feature_settings,
    load_and_forecast,
    sweep,
    train_and_save,
    tree_settings,
)
from panelcast.session import scratch_dir, stage

X = ("quantity", "discount", "is_holiday")
# Three folds a year apart, a week ahead.
SPLIT = Splitter(WindowParams(1400, 350, 7), "sliding")


def _panel(spark, sf_dir):
    return stage(T.covariate_panel(spark, sf_dir), "panel")


def _with_future(spark, sf_dir):
    """Covariates three months past the last target; targets filled up to their end."""
    cols = ["y", "quantity", "discount"]
    known = interpolate_prefix(T.joined(spark, sf_dir), cols)
    ahead = interpolate(known, ["quantity", "discount"])
    return stage(ahead.withColumn("is_holiday", is_holiday("ts").cast("double")), "panel")


def _ordered(columns):
    """Whether a row has all quantiles, none below the one before it."""
    values = F.array(*columns)
    whole = ~F.exists(values, lambda v: v.isNull())
    return (whole & (F.array_sort(values) == values)).alias("is_ordered")


def _checked(rows):
    """What SQL can state of forecasts: their keys, actual values and order."""
    return rows.select(SERIES, "fold", "h", "ts", r("y"), _ordered(QCOLS))


# The rows that the folds of SPLIT forecast, and those after the last target.
_FOLD_ROWS = with_ctes(
    """SELECT g.series_id, f.fold, g.idx - (1399 + 350 * f.fold) AS h, g.ts,
         round(g.y, 6) AS y, true AS is_ordered
       FROM mfill g JOIN (
         SELECT series_id, unnest(range(0, (n_rows - 1407) // 350 + 1)) AS fold
         FROM (SELECT DISTINCT series_id, n_rows FROM mfill) WHERE n_rows >= 1407) f USING (series_id)
       WHERE g.idx BETWEEN 1400 + 350 * f.fold AND 1406 + 350 * f.fold""",
    "mfill",
)


def _ahead_sql(steps: int) -> str:
    return with_ctes(
        f"""SELECT series_id, 0 AS fold, h, last + to_days(h::INT) AS ts,
              NULL::DOUBLE AS y, true AS is_ordered
            FROM (SELECT series_id, max(ts) AS last FROM jgrid WHERE y IS NOT NULL GROUP BY 1),
              (SELECT unnest(range(1, {steps + 1})) AS h)""",
        "jgrid",
    )


@query("m2_multiple_quantile_regressor")
def m2(spark, sf_dir):
    """Two levels of shipped value by quantity and discount, on all order lines."""
    frame = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        T.table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_extendedprice") / 1000)
    )
    regressor = LinearQuantileRegression(l1=0.0)
    model = MultipleQuantileRegressor([0.1, 0.9], regressor, "quantile", n_jobs=2).fit(frame)
    out = model.transform(frame)
    return out.select(
        "l_orderkey",
        "l_linenumber",
        F.col("predictions")[0].alias("q10"),
        F.col("predictions")[1].alias("q90"),
    )


@query(
    "m2_quantile_shares",
    """SELECT v.level, count(*) AS n, true AS is_fitted
       FROM lineitem, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(level) GROUP BY 1""",
)
def m2_shares(spark, sf_dir):
    """Of all order lines, as many lie on or below each fitted level as it says, up to one
    per coefficient (and rows that tie with it)."""
    frame = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(
        T.table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_extendedprice") / 1000)
    )
    levels = [0.1, 0.5, 0.9]
    model = MultipleQuantileRegressor(levels, LinearQuantileRegression(l1=0.0), "quantile").fit(frame)
    cells = [
        F.struct(F.lit(q).alias("level"), (F.col("label") - F.col("predictions")[i]).alias("r"))
        for i, q in enumerate(levels)
    ]
    rows = model.transform(frame).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    shares = rows.groupBy("level").agg(
        F.count("*").alias("n"), F.count_if(F.col("r") < -1e-6).alias("below"),
        F.count_if(F.col("r") <= 1e-6).alias("upto"),
    )
    slack = 0.002 * F.col("n") + 3
    wanted = F.col("level") * F.col("n")
    fitted = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return shares.select("level", "n", fitted.alias("is_fitted"))


def _backtest_query(name):
    def run(spark, sf_dir):
        setup = get_model(name, DAILY, X)
        return _checked(backtest(_panel(spark, sf_dir), setup.spec, setup.model, SPLIT).predictions)

    return run


query("m3_linear_quantile", _FOLD_ROWS)(_backtest_query("quantreg"))
query("m4_boosted_leafwise", _FOLD_ROWS)(_backtest_query("lgbm"))
query("m6_boosted_symmetric", _FOLD_ROWS)(_backtest_query("catboost"))
query("m7_quantile_forest", _FOLD_ROWS)(_backtest_query("qrf"))


@query(
    "m3_quantile_shares",
    with_ctes(
        """SELECT g.series_id, v.level, count(*) AS n, true AS is_fitted
           FROM mfill g, (VALUES (0.025::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE),
             (0.975::DOUBLE)) v(level) WHERE g.idx >= 14 GROUP BY ALL""",
        "mfill",
    ),
)
def m3_shares(spark, sf_dir):
    """An exact fit without penalty has at most its share of rows strictly below each level,
    and at least that many on or below it."""
    setup = get_model("quantreg", DAILY, X, l1=0.0)
    grid = _panel(spark, sf_dir)
    models = train(grid, setup.spec, setup.model)
    shares = fitted_shares(grid, setup.spec, setup.model, models)
    wanted = F.col("level") * F.col("n")
    fitted = (F.col("below") <= wanted) & (F.col("upto") >= wanted)
    return shares.select(SERIES, "level", "n", fitted.alias("is_fitted"))


@query("m5_boosted_early_stopping", _FOLD_ROWS)
def m5(spark, sf_dir):
    """Depth-wise trees that stop when the held-out month no longer improves."""
    setup = get_model("xgb-custom", DAILY, X, patience=10)
    return _checked(backtest(_panel(spark, sf_dir), setup.spec, setup.model, SPLIT).predictions)


@query("m8_direct_boosting", _ahead_sql(7))
def m8(spark, sf_dir):
    """A week in one chunk from covariate lags and leads; nothing is fed back."""
    setup = get_model("xgboost", DAILY, X, chunk=7)
    parts, steps = direct_parts(DAILY), DIRECT_COVARIATE_OFFSETS["D"]
    grid = stage(direct_grid(_with_future(spark, sf_dir), X, parts, steps), "direct")
    models = train(grid, setup.spec, setup.model)
    return _checked(forecast(grid, models, setup.spec, setup.model, 7))


@query("m9_direct_linear", _ahead_sql(7))
def m9(spark, sf_dir):
    setup = direct_linear(DAILY, X, chunk=7, l1=0.0)
    parts = direct_parts(DAILY, quarter=False)
    grid = _with_future(spark, sf_dir)
    grid = stage(direct_grid(grid, X, parts, direct_linear_steps(DAILY)), "direct")
    models = train(grid, setup.spec, setup.model)
    return _checked(forecast(grid, models, setup.spec, setup.model, 7))


@query("m10_recursive_forecast", _ahead_sql(28))
def m10(spark, sf_dir):
    """Four weeks past the last target from a model with lag 1: the median is fed back."""
    grid = _with_future(spark, sf_dir)
    setup = get_model("quantreg", DAILY, X, lags=(1, 7))
    models = train(grid, setup.spec, setup.model)
    check_horizon(grid, models, 28)
    return _checked(forecast(grid, models, setup.spec, setup.model, 28))


# Few rounds and trees: the registered settings are fitted by m3 to m8.
_SMALL = {"rounds": 12, "trees": 12}
_FITTED = {
    "benchmark": (),
    "quantreg": (),
    "quantile-regressor": (),
    "xgboost": ("rounds",),
    "xgb-custom": ("rounds",),
    "lgbm": ("rounds",),
    "catboost": ("rounds",),
    "qrf": ("trees",),
}


@query(
    "m15_model_registry",
    with_ctes(
        f"""SELECT m.model, series_id, h, last + to_days(h::INT) AS ts, true AS is_same, true AS is_ordered
            FROM (SELECT series_id, max(ts) AS last FROM jgrid WHERE y IS NOT NULL GROUP BY 1),
              (SELECT unnest(range(1, 8)) AS h), (SELECT unnest({list(_FITTED)}) AS model) m""",
        "jgrid",
    ),
)
def m15(spark, sf_dir):
    """Every model of the registry, fitted, written and read: it forecasts the same."""
    grid = _with_future(spark, sf_dir)
    keys, parts = [SERIES, "h", "ts"], []
    for name, small in _FITTED.items():
        options = json.dumps({k: _SMALL[k] for k in small})
        x = () if name == "benchmark" else X
        model = PanelForecaster(modelName=name, xCols=x, options=options, steps=7).fit(grid)
        path = scratch_dir(spark, "forecaster")
        model.save(path)
        again = PanelForecasterModel.load(path).transform(grid)
        both = model.transform(grid).join(
            again.select(*keys, *[F.col(c).alias(f"_{c}") for c in QCOLS]), keys
        )
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in QCOLS))
        parts.append(both.select(F.lit(name).alias("model"), *keys, same.alias("is_same"), _ordered(QCOLS)))
    return reduce(DataFrame.unionByName, parts)


@query("a13_importance_of_trees")
def a13_trees(spark, sf_dir):
    """Top features of a boosted model, averaged over its levels."""
    grid = _panel(spark, sf_dir)
    setup = get_model("lgbm", DAILY, X)
    models = train(grid, setup.spec, setup.model)
    return top_features(mean_importance(importances(models, setup.model), [SERIES]), 55)


# Folds of a week, as the workload has them.
WEEKLY = Splitter(WindowParams(1400, 7, 7), "sliding")


@query("b7_refit_backtest", _FOLD_ROWS.replace("350", "7"))
def b7(spark, sf_dir):
    """A linear model refitted every week, in every fold of every series."""
    setup = get_model("quantreg", DAILY, X)
    return _checked(backtest(_panel(spark, sf_dir), setup.spec, setup.model, WEEKLY).predictions)


# One fold per series, its horizon the week after the window.
SWEEP_SPLIT = Splitter(WindowParams(1400, 1000, 7), "sliding")


@query("b9_model_sweep")
def b9_models(spark, sf_dir):
    """The models of the workload's comparison over the same folds, in one table."""
    settings = {n: get_model(n, DAILY, () if n == "benchmark" else X) for n in MODEL_GRID}
    return sweep(_panel(spark, sf_dir), DAILY, settings, SWEEP_SPLIT)


@query("b9_tree_sweep")
def b9_tree_sweep(spark, sf_dir):
    """Leaf-wise trees of 18 settings, each scored by a backtest."""
    grid = TREE_GRID | {"num_leaves": (6, 15, 31), "min_child_samples": (25, 50)}
    settings = tree_settings(get_model("lgbm", DAILY, X), grid)
    return sweep(_panel(spark, sf_dir), DAILY, settings, SWEEP_SPLIT)


@query("b9_feature_sweep")
def b9_feature_sweep(spark, sf_dir):
    """The linear model on all 12 feature settings, each scored by a backtest."""
    return sweep(_panel(spark, sf_dir), DAILY, feature_settings("quantreg", DAILY, X), SPLIT)


@query(
    "b8_times",
    with_ctes(
        """SELECT series_id, unnest(range(0, (n_rows - 1407) // 350 + 1)) AS fold,
             true AS fit_time_is_positive, true AS pred_time_is_positive
           FROM (SELECT DISTINCT series_id, n_rows FROM mfill) WHERE n_rows >= 1407""",
        "mfill",
    ),
)
def b8_times(spark, sf_dir):
    """Seconds spent on each fold's own fit and forecast, whether they are positive."""
    setup = get_model("quantreg", DAILY, X)
    run = backtest(_panel(spark, sf_dir), setup.spec, setup.model, SPLIT)
    return run.times.select(
        SERIES, "fold", (F.col("fit_time") > 0).alias("fit_time_is_positive"),
        (F.col("pred_quantiles_time") > 0).alias("pred_time_is_positive"),
    )


@query("v13_train_save_load", _ahead_sql(7))
def v13(spark, sf_dir):
    """Fit on the years from 1996 on, write the model table, read it back, forecast a week
    past the last target."""
    grid = _with_future(spark, sf_dir)
    setup = get_model("quantreg", DAILY, X)
    root = scratch_dir(spark, "trained")
    train_and_save(grid, setup, root, "1996-01-01")
    return _checked(load_and_forecast(spark, grid, setup, root, 7))
