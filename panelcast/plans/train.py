"""Training, forecasting and model sweeps end to end."""

from __future__ import annotations

import time
from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import config as C
from panelcast.functions.calendar import Freq
from panelcast.models.forecast import backtest_settings, forecast, train
from panelcast.models.registry import Baseline, Setup, get_model
from panelcast.operators.baseline import baseline_backtest
from panelcast.operators.folds import Splitter
from panelcast.operators.panel import SERIES, length_violations, since
from panelcast.operators.scoring import fold_scores, metrics_table
from panelcast.session import stage
from panelcast.sources import artifacts


def require_length(rows: DataFrame, freq: Freq, max_lag: int, past_days: int = 0) -> None:
    """Raise where a series is too short for the lags, or for the covariates' history."""
    short = length_violations(rows, freq, max_lag, past_days).limit(5).collect()
    if short:
        which = ", ".join(f"{r[SERIES]} ({r['rule']}: {r['n']} rows, {r['needed']})" for r in short)
        raise ValueError(f"series too short: {which}")


def train_and_save(grid: DataFrame, setup: Setup, root: str, cutoff: str | None = None) -> str:
    """Fit one model per series and write the model table.

    Rows before the day ``cutoff`` are left out, as are those without a target; a series
    with fewer rows than the longest look-back raises.
    """
    whole = grid
    if cutoff is not None:
        grid = stage(since(grid, setup.spec.freq, cutoff), "training")
    observed = grid.filter(F.col(setup.spec.target).isNotNull())
    require_length(observed.select(SERIES, "ts"), setup.spec.freq, setup.spec.reach)
    models = train(grid, setup.spec, setup.model)
    if cutoff is not None:
        # a model counts rows as the panel does that it will forecast on
        start = F.min(F.col("pos") - F.col("idx"))
        starts = grid.groupBy(SERIES).agg(start.alias("_a"))
        starts = starts.join(whole.groupBy(SERIES).agg(start.alias("_b")), SERIES)
        shift = F.col("_a") - F.col("_b")
        moved = models.join(starts, SERIES).withColumns({c: F.col(c) + shift for c in ("first", "last")})
        models = moved.select(models.columns)
    return artifacts.write_model(models, root)


def load_and_forecast(
    spark: SparkSession, grid: DataFrame, setup: Setup, root: str, steps: int
) -> DataFrame:
    models = artifacts.read_model(spark, root)
    return forecast(grid, models, setup.spec, setup.model, steps)


def _with_times(metrics: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """Mean seconds per fit and forecast as two more metrics."""
    names = {"avg_fit_time": "fit_time", "avg_pred_time": "pred_quantiles_time"}
    spent = times.groupBy(*keys).agg(*(F.avg(c).alias(m) for m, c in names.items()))
    none = F.lit(None).cast("double").alias("std")
    parts = [spent.select(*keys, F.lit(m).alias("metric"), F.col(m).alias("mean"), none) for m in names]
    return reduce(DataFrame.unionByName, parts, metrics)


def score_baseline(grid: DataFrame, freq: Freq, n_weeks: int, splitter: Splitter) -> DataFrame:
    """``(metric, mean, std)`` of the baseline, which looks history up and fits nothing."""
    start = time.monotonic()
    rows = stage(baseline_backtest(grid, freq, splitter, n_weeks), "baseline")
    took = time.monotonic() - start
    folds = rows.select(SERIES, "fold").distinct().count()
    seconds = [("avg_pred_time", took / max(folds, 1), None)]
    spent = grid.sparkSession.createDataFrame(seconds, "metric string, mean double, std double")
    return metrics_table(fold_scores(rows), []).unionByName(spent)


def tree_settings(base: Setup, grid: dict[str, tuple]) -> dict[str, Setup]:
    """A leaf-wise model for every combination of the lists in ``grid``, named by its values.

    A depth of -1 is no limit; a limit caps the leaves.
    """
    found = {}
    for values in product(*grid.values()):
        one = dict(zip(grid, values, strict=True))
        leaves, depth = one["num_leaves"], one["max_depth"]
        leaves = leaves if depth == -1 else min(2**depth, leaves)
        model = replace(
            base.model,
            max_leaves=leaves,
            depth=leaves if depth == -1 else depth,
            min_child=one["min_child_samples"],
            rounds=one["n_estimators"],
            learning_rate=one["learning_rate"],
            colsample=one["colsample_bytree"],
            penalty=one["reg_lambda"],
        )
        found[" ".join(f"{k}={v}" for k, v in one.items())] = Setup(base.name, model, base.spec)
    return found


def feature_settings(name: str, freq: Freq, x_cols: tuple[str, ...]) -> dict[str, Setup]:
    """The named model on every sensible combination of feature switches: cyclical
    encodings need the seasonal columns."""
    found = {}
    for values in product(*C.FEATURE_GRID.values()):
        one = dict(zip(C.FEATURE_GRID, values, strict=True))
        if one["cyclical_encodings"] and not one["include_seasonal_dummies"]:
            continue
        setup = get_model(
            name,
            freq,
            x_cols,
            seasonal=one["include_seasonal_dummies"],
            cyclical=one["cyclical_encodings"],
            one_hot=name == "quantreg" and not one["cyclical_encodings"],
            lag_cols=None if one["lag_covariates"] else (),
            rolling=one["include_rolling_stats"],
        )
        found[" ".join(f"{k}={v}" for k, v in one.items())] = setup
    return found


def sweep(
    grid: DataFrame, freq: Freq, settings: dict[str, Setup], splitter: Splitter
) -> DataFrame:
    """``(setting, metric, mean, std)`` over all series and folds, from a backtest of each
    setting; fitted models share one job."""
    fitted = {n: (s.spec, s.model) for n, s in settings.items() if not isinstance(s.model, Baseline)}
    parts = []
    for name, setup in settings.items():
        if name not in fitted:
            scores = score_baseline(grid, freq, setup.model.n_weeks, splitter)
            parts.append(scores.select(F.lit(name).alias("setting"), "metric", "mean", "std"))
    if fitted:
        run = backtest_settings(grid, fitted, splitter)
        metrics = metrics_table(fold_scores(run.predictions, [SERIES, "setting", "fold"]), ["setting"])
        parts.append(_with_times(metrics, run.times, ["setting"]))
    return stage(reduce(DataFrame.unionByName, parts), "sweep")
