"""Backtests from panel to metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.functions.calendar import DAILY, HOURLY, Freq
from panelcast.operators.baseline import baseline_backtest
from panelcast.models.forecast import backtest
from panelcast.models.registry import Baseline, Setup
from panelcast.operators.folds import WINDOW, Splitter, WindowParams, evaluation_grid, fold_table
from panelcast.operators.panel import SERIES
from panelcast.operators.scoring import fold_scores, metrics_table
from panelcast.plans import tables as T
from panelcast.session import stage
from panelcast.sources import artifacts

# Rows in the window, step, horizon; weeks of history.
DAILY_SPLIT = Splitter(WindowParams(1000, 7, 7), "sliding")
DAILY_WEEKS = 100
HOURLY_SPLIT = Splitter(WindowParams(336, 24, 48), "sliding")
HOURLY_WEEKS = 3
LONG_SPLIT = Splitter(WindowParams(1400, 70, 21), "expanding")
LONG_WEEKS = 50


def daily_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline_backtest(T.daily_grid(spark, sf_dir), DAILY, DAILY_SPLIT, DAILY_WEEKS)


def hourly_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizon and window where the history is clipped by the training window."""
    return baseline_backtest(T.hourly_grid(spark, sf_dir), HOURLY, HOURLY_SPLIT, HOURLY_WEEKS)


def long_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three weeks ahead from all history."""
    return baseline_backtest(T.daily_grid(spark, sf_dir), DAILY, LONG_SPLIT, LONG_WEEKS)


def daily_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_scores(daily_backtest(spark, sf_dir))


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_table(daily_folds(spark, sf_dir))


@dataclass(frozen=True)
class Period:
    """When to evaluate, in whole days: training data from ``cutoff`` on, folds whose first
    cutoff is ``first``, nothing after ``last``."""

    first: str
    last: str | None = None
    cutoff: str | None = None
    step_days: int = 7
    forecast_days: int = 7
    kind: str = "sliding"

    def splitter(self, freq: Freq) -> Splitter:
        per_day = freq.per_day
        sizes = WindowParams(WINDOW, per_day * self.step_days, per_day * self.forecast_days)
        return Splitter(sizes, self.kind)


def evaluate_period(
    grid: DataFrame, freq: Freq, setup: Setup, period: Period, root: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(results, metrics)`` of a model over the folds that the dates give each series.

    ``results`` has a row per fold: cutoff, window, loss by level and times, where a model
    is fitted.  With ``root`` both are written there, results as CSV, metrics as JSON.
    """
    splitter = period.splitter(freq)
    dated = evaluation_grid(grid, freq, period.cutoff, period.first, period.last)
    dated = stage(dated, "evaluation")
    times = None
    if isinstance(setup.model, Baseline):
        rows = baseline_backtest(dated, freq, splitter, setup.model.n_weeks)
    else:
        run = backtest(dated, setup.spec, setup.model, splitter)
        rows, times = run.predictions, run.times
    scores = stage(fold_scores(rows), "fold-scores")
    bounds = dated.select(SERIES, "lo", "hi", WINDOW).distinct()
    folds = fold_table(bounds, freq, splitter).select(SERIES, "fold", "cutoff", "len_train_window")
    results = folds.join(scores, [SERIES, "fold"]).select(
        SERIES,
        "fold",
        "cutoff",
        "len_train_window",
        *[F.col(f"loss_{c}").alias(str(q)) for c, q in zip(QCOLS, LEVELS, strict=True)],
        F.col("pinball_loss").alias("test_PinballLoss"),
    )
    if times is not None:
        results = results.join(times, [SERIES, "fold"])
    metrics = metrics_table(scores)
    if root is not None:
        artifacts.write_csv(results, f"{root}/eval_results")
        artifacts.write_metrics(metrics, [SERIES], f"{root}/metrics")
    return results, metrics
