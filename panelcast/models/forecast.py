"""Fit, forecast and backtest feature-based models on a panel."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS, ROLLING_DAYS
from panelcast.models.forest import QuantileForest
from panelcast.models.linear import LinearQuantile
from panelcast.models.passes import (
    SETTING,
    final_models,
    fit_settings,
    fold_models,
    on_blocks,
    pack,
    require_fitted,
)
from panelcast.models.trees import BoostedQuantile
from panelcast.operators.blocks import BLOCK
from panelcast.operators.features import FeatureSpec, build_features, build_many
from panelcast.operators.folds import Splitter
from panelcast.operators.panel import SERIES
from panelcast.session import stage

Model = LinearQuantile | BoostedQuantile | QuantileForest


def fit_models(grid: DataFrame, spec: FeatureSpec, model: Model, empty: DataFrame) -> DataFrame:
    """Fit one model per row of ``empty`` on the features of ``grid``.

    Features only look back, so they are computed once for all folds; bins are those of a
    fold's own rows.  A series or fold without rows to train on raises.
    """
    if tuple(spec.names) != model.names:
        raise ValueError("the model was built for other features")
    features = build_features(grid, spec)
    chunks = stage(pack(features, spec.names, spec.target), "chunks")
    models = model.fit(chunks, empty, features, spec.target)
    require_fitted(models)
    return models


def check_horizon(grid: DataFrame, models: DataFrame, steps: int) -> None:
    """Covariates must reach the end of every horizon."""
    if steps < 1:
        raise NotImplementedError("in-sample predictions are not supported")
    ends = grid.groupBy(SERIES).agg(F.max("idx").alias("_end"))
    short = models.join(ends, SERIES, "left").filter(
        F.col("_end").isNull() | (F.col("_end") < F.col("last") + steps)
    )
    if not short.isEmpty():
        raise ValueError("X does not contain enough data for the forecast horizon")


def horizon_steps(grid: DataFrame, models: DataFrame, horizon: DataFrame) -> int:
    """Steps from the cutoff to the last of ``horizon(series_id, ts)``; in-sample raises."""
    span = (
        horizon.join(grid.select(SERIES, "ts", "idx"), [SERIES, "ts"], "left")
        .join(models.select(SERIES, "fold", "last"), SERIES)
        .agg(
            F.min(F.col("idx") - F.col("last")).alias("first"),
            F.max(F.col("idx") - F.col("last")).alias("last"),
            F.count_if(F.col("idx").isNull()).alias("outside"),
        )
        .first()
    )
    if span["outside"]:
        raise ValueError("X does not contain enough data for the forecast horizon")
    if span["first"] is None or span["first"] < 1:
        raise NotImplementedError("in-sample predictions are not supported")
    return int(span["last"])


def _inputs(grid: DataFrame, models: DataFrame, spec: FeatureSpec, steps: int) -> DataFrame:
    """One row per model: the target's tail, and the horizon's features that do not
    depend on the target.  Looked up by an equi-join on row numbers; ``reach + steps``
    rows per model.  History that no model looks back at is cut off first."""
    wanted = models.groupBy(SERIES).agg(
        (F.min("last") - 2 * spec.reach).alias("_lo"), (F.max("last") + steps).alias("_hi")
    )
    recent = grid.join(wanted, SERIES).filter(F.col("idx").between(F.col("_lo"), F.col("_hi")))
    static = build_features(recent.drop("_lo", "_hi"), spec, target_features=False)
    x = F.array(*[F.col(n).cast("double") for n in spec.static_names])
    x = x if spec.static_names else F.array().cast("array<double>")
    rows = static.select(SERIES, "idx", "pos", F.col(spec.target).cast("double").alias("y"), x.alias("x"))
    need = models.select(
        SERIES,
        "fold",
        "last",
        F.explode(F.sequence(F.col("last") - spec.reach + 1, F.col("last") + steps)).alias("idx"),
    )
    ahead = F.col("idx") > F.col("last")
    one = F.struct("idx", "pos", "y", F.when(ahead, F.col("x")).alias("x"))
    return (
        need.join(rows, [SERIES, "idx"])
        .groupBy(SERIES, "fold")
        .agg(F.sort_array(F.collect_list(one)).alias("r"))
        .select(
            SERIES,
            "fold",
            F.col("r.idx").alias("idx"),
            F.col("r.pos").alias("pos"),
            F.col("r.y").alias("y"),
            F.flatten(F.filter(F.col("r.x"), lambda v: v.isNotNull())).alias("x"),
        )
    )


def roll_forward(
    model: Model,
    spec: FeatureSpec,
    tail: np.ndarray,
    static: np.ndarray,
    params: np.ndarray,
    aux: np.ndarray,
) -> np.ndarray:
    """Forecast block by block, feeding the median back as history.

    A block is as long as the smallest lag, so nothing in it depends on a
    prediction in it; that equals going step by step.
    """
    steps, back = len(static), len(tail)
    middle = model.levels.index(0.5)
    y = np.concatenate([tail, np.full(steps, np.nan)])
    block = min(spec.lags)
    if spec.rolling:
        block = min(block, spec.freq.period)
    out = np.empty((steps, len(model.levels)))
    window = ROLLING_DAYS * spec.freq.per_day
    for start in range(0, steps, block):
        rows = np.arange(start, min(start + block, steps))
        parts = [static[rows]] + [y[back + rows - k][:, None] for k in spec.lags]
        if spec.rolling:
            parts.append(
                np.stack([_phase_quantiles(y, back + i, window, spec.freq.period) for i in rows])
            )
        out[rows] = model.predict(np.hstack(parts), params, aux)
        y[back + rows] = out[rows, middle]
    return np.sort(out, axis=1)


def _phase_quantiles(y: np.ndarray, at: int, window: int, period: int) -> np.ndarray:
    past = y[np.arange(at - period, max(at - window, 0) - 1, -period)]
    return np.nanquantile(past, LEVELS)


def forecast(
    grid: DataFrame,
    models: DataFrame,
    spec: FeatureSpec,
    model: Model | dict[str, Model],
    steps: int,
    seconds: bool = False,
) -> DataFrame:
    """Forecasts ``h = 1 .. steps`` of every model, in one job over (series, fold).

    ``grid`` carries the covariates of the horizon; ``y`` there is the actual, if known.
    ``seconds`` adds the time that a model's forecast took.  A dict names the models of the
    settings in a column ``setting`` of ``models``, which then is in the result as well.
    """
    by_setting = model if isinstance(model, dict) else {"": model}
    levels = next(iter(by_setting.values())).levels
    if any(m.levels != levels for m in by_setting.values()):
        raise ValueError("settings must share their levels")
    if 0.5 not in levels:
        raise ValueError("the median must be among the levels")
    if steps < 1:
        raise NotImplementedError("in-sample predictions are not supported")
    reach = spec.reach

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                start = time.perf_counter()
                idx, y = np.asarray(row.idx), np.asarray(row.y, dtype=float)
                ahead = idx > row.last
                k = int(ahead.sum())
                if len(row.params) == 0:
                    raise ValueError(f"the model of {getattr(row, SERIES)} is not fitted")
                if k < steps:
                    raise ValueError("X does not contain enough data for the forecast horizon")
                static = np.asarray(row.x, dtype=float).reshape(k, -1)
                # a start of history shorter than the look-back counts as missing
                tail = y[~ahead][-reach:]
                tail = np.concatenate([np.full(reach - len(tail), np.nan), tail])
                q = roll_forward(
                    by_setting[row.setting], spec, tail, static, np.asarray(row.params), np.asarray(row.aux)
                )
                out.append(
                    pd.DataFrame(
                        {
                            SERIES: getattr(row, SERIES),
                            "setting": row.setting,
                            "fold": row.fold,
                            "h": idx[ahead] - row.last,
                            "pos": np.asarray(row.pos)[ahead],
                            "y": y[ahead],
                            "q": list(q),
                            "seconds": time.perf_counter() - start,
                        }
                    )
                )
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = (
        f"{SERIES} string, setting string, fold long, h long, pos long, y double, "
        "q array<double>, seconds double"
    )
    named = isinstance(model, dict)
    setting = F.col(SETTING) if named else F.lit("")
    fitted = models.select(SERIES, "fold", "last", "params", "aux", setting.alias("setting"))
    # settings share the inputs of their fold
    ends = fitted.select(SERIES, "fold", "last").distinct()
    inputs = _inputs(grid, ends, spec, steps).join(fitted, [SERIES, "fold"])
    rows = inputs.mapInPandas(run, schema)
    return rows.select(
        SERIES,
        *([SETTING] if named else []),
        "fold",
        "h",
        "pos",
        spec.freq.at("pos").alias("ts"),
        F.when(~F.isnan("y"), F.col("y")).alias("y"),
        *quantile_columns(levels),
        *(["seconds"] if seconds else []),
    )


def quantile_columns(levels: tuple[float, ...]) -> list[Column]:
    """The array ``q`` as named columns."""
    if levels == LEVELS:
        return [_value(i).alias(c) for i, c in enumerate(QCOLS)]
    return [_value(i).alias("q" + str(v).replace("0.", "")) for i, v in enumerate(levels)]


def _value(i: int) -> Column:
    cell = F.col("q")[i]
    return F.when(~F.isnan(cell), cell)


@dataclass
class BacktestRun:
    """Predictions, the fitted models, and ``(series_id, fold, fit_time,
    pred_quantiles_time)`` with the seconds spent on each fold's own model."""

    predictions: DataFrame
    models: DataFrame
    times: DataFrame


def backtest(grid: DataFrame, spec: FeatureSpec, model: Model, splitter: Splitter) -> BacktestRun:
    """Refit in every fold, forecast its horizon.  All folds of all series advance in
    the same Spark jobs; times are taken where a fold's model is fitted and applied."""
    empty = stage(fold_models(grid, splitter, spec.reach), "folds")
    models = fit_models(grid, spec, model, empty)
    steps = splitter.params.forecast_steps
    rows = stage(forecast(grid, models, spec, model, steps, seconds=True), "predictions")
    spent = rows.groupBy(SERIES, "fold").agg(F.max("seconds").alias("pred_quantiles_time"))
    fitted = models.select(SERIES, "fold", F.col("seconds").alias("fit_time"))
    return BacktestRun(rows.drop("seconds"), models, fitted.join(spent, [SERIES, "fold"]))


def backtest_settings(
    grid: DataFrame, settings: dict[str, tuple[FeatureSpec, Model]], splitter: Splitter
) -> BacktestRun:
    """As :func:`backtest`, for many settings of features and models over the same folds.

    The setting is part of a model's key, in all three tables of the run: features are
    made once for all settings, one job fits every (series, fold, setting), and one job
    per feature set forecasts.
    """
    specs = list(dict.fromkeys(spec for spec, _ in settings.values()))
    for spec, model in settings.values():
        if tuple(spec.names) != model.names:
            raise ValueError("a model was built for other features")
    features = build_many(grid, specs)
    names = tuple(dict.fromkeys(n for s in specs for n in s.names))
    target = specs[0].target
    chunks = stage(pack(features, list(names), target, incomplete=True), "chunks")
    folds = [
        fold_models(grid, splitter, spec.reach).withColumn(SETTING, F.lit(name))
        for name, (spec, _) in settings.items()
    ]
    empty = stage(reduce(DataFrame.unionByName, folds), "folds")
    learners = {name: model for name, (_, model) in settings.items()}
    models = fit_settings(chunks, empty, learners, names, features, target, "settings")
    require_fitted(models)
    steps, parts = splitter.params.forecast_steps, []
    for spec in specs:
        own = {name: model for name, (s, model) in settings.items() if s == spec}
        chosen = models.filter(F.col(SETTING).isin(*own))
        parts.append(stage(forecast(grid, chosen, spec, own, steps, seconds=True), "predictions"))
    rows = reduce(DataFrame.unionByName, parts)
    keys = [SERIES, SETTING, "fold"]
    spent = rows.groupBy(*keys).agg(F.max("seconds").alias("pred_quantiles_time"))
    times = models.select(*keys, F.col("seconds").alias("fit_time")).join(spent, keys)
    return BacktestRun(rows.drop("seconds"), models, times)


def train(grid: DataFrame, spec: FeatureSpec, model: Model) -> DataFrame:
    """One model per series on all rows up to its last target."""
    return fit_models(grid, spec, model, stage(final_models(grid, spec.reach), "final"))


def fitted_shares(grid: DataFrame, spec: FeatureSpec, model: Model, models: DataFrame) -> DataFrame:
    """``series_id, fold, level, n, below, upto``: how many of the rows that a model was
    trained on lie below, and on or below, each of its levels.

    A residual within 1e-7 of a block's mean label counts as on the level.
    """
    chunks = pack(build_features(grid, spec), spec.names, spec.target)
    pairs = chunks.join(on_blocks(models, "first", "last", "params"), [SERIES, BLOCK])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                idx, y = np.asarray(row.idx), np.asarray(row.y)
                a, b = np.searchsorted(idx, (row.first, row.last + 1))
                x = np.asarray(row.x, dtype=float).reshape(len(y), -1)[a:b]
                r = y[a:b, None] - model.predict(x, np.asarray(row.params), None)
                near = 1e-7 * np.abs(y).mean()
                for q, one in zip(model.levels, r.T, strict=True):
                    counts = len(one), int((one < -near).sum()), int((one <= near).sum())
                    out.append((getattr(row, SERIES), row.fold, q, *counts))
            yield pd.DataFrame(out, columns=[SERIES, "fold", "level", "n", "below", "upto"])

    schema = f"{SERIES} string, fold long, level double, n long, below long, upto long"
    parts = pairs.mapInPandas(run, schema)
    return parts.groupBy(SERIES, "fold", "level").agg(*(F.sum(c).alias(c) for c in ("n", "below", "upto")))


def importances(models: DataFrame, model: BoostedQuantile) -> DataFrame:
    """Splits per (series, fold, level, feature)."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if len(row.params) == 0:
                    continue
                table = model.importance(np.asarray(row.params))
                cells = [
                    (getattr(row, SERIES), row.fold, q, n, float(table[i, j]))
                    for i, q in enumerate(model.levels)
                    for j, n in enumerate(model.names)
                ]
                out += cells
            yield pd.DataFrame(out, columns=[SERIES, "fold", "level", "feature", "importance"])

    schema = f"{SERIES} string, fold long, level double, feature string, importance double"
    return models.select(SERIES, "fold", "params").mapInPandas(run, schema)


__all__ = [
    "BacktestRun",
    "backtest",
    "backtest_settings",
    "check_horizon",
    "fit_models",
    "fitted_shares",
    "forecast",
    "horizon_steps",
    "importances",
    "roll_forward",
    "train",
]
