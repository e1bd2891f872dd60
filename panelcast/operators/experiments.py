"""Sweeps and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.config import DISPLAY_NAMES, FEATURE_GRID, TREE_GRID
from panelcast.functions.calendar import Freq
from panelcast.operators.baseline import baseline_backtest
from panelcast.operators.folds import Splitter
from panelcast.operators.panel import SERIES, keep_first
from panelcast.operators.scoring import fold_scores, metrics_table


def parameter_grid(runs: DataFrame, grid: dict[str, tuple]) -> DataFrame:
    """Every combination of the parameter lists for every run (literal lists, no join)."""
    for name, values in grid.items():
        runs = runs.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return runs


def tree_grid(runs: DataFrame) -> DataFrame:
    """45 tree settings; a depth limit caps the leaves."""
    capped = F.when(F.col("max_depth") == -1, F.col("num_leaves")).otherwise(
        F.least(F.pow(F.lit(2.0), F.col("max_depth")).cast("int"), F.col("num_leaves"))
    )
    return parameter_grid(runs, TREE_GRID).withColumn("num_leaves", capped)


def feature_grid(runs: DataFrame) -> DataFrame:
    """12 feature settings: cyclical encodings need the seasonal columns."""
    return parameter_grid(runs, FEATURE_GRID).filter(
        F.col("include_seasonal_dummies") | ~F.col("cyclical_encodings")
    )


def weeks_sweep(grid: DataFrame, freq: Freq, splitter: Splitter, spans: list[int]) -> DataFrame:
    """Metrics of the baseline for many history lengths, all in one plan."""
    rows = baseline_backtest(grid, freq, splitter, max(spans), spans=spans)
    folds = fold_scores(rows, [SERIES, "n_weeks", "fold"])
    return metrics_table(folds, [SERIES, "n_weeks"])


def mean_std_text(mean: str, std: str) -> Column:
    """``m (± s)`` with two decimals, half rounded to even."""
    return F.format_string("%.2f (± %.2f)", F.bround(mean, 2), F.bround(std, 2))


LOSSES = ("pinball_loss", "interval_score_50", "interval_score_95")
COVERAGES = (("coverage_50", 0.5), ("coverage_95", 0.95))


def result_table(metrics: DataFrame, keys: list[str], model: str, order: str) -> DataFrame:
    """One row per model: formatted mean and deviation, and who is best.

    ``metrics(keys..., model, order, metric, mean, std)``: rows with nulls drop, the
    first run of a model stays, losses are best at their minimum, coverage closest to
    its nominal level.
    """
    clean = metrics.dropna("any", subset=["mean", "std", model])
    cells = []
    for m in (*LOSSES, *[c for c, _ in COVERAGES]):
        here = F.col("metric") == m
        cells += [
            F.max(F.when(here, F.col("mean"))).alias(f"{m}_mean"),
            F.max(F.when(here, F.col("std"))).alias(f"{m}_std"),
        ]
    runs = clean.groupBy(*keys, model, order).agg(*cells).dropna("any")
    runs = keep_first(runs, [*keys, model], order)
    # values equal to nine digits are ties and go to the first name
    ranks = {m: F.round(f"{m}_mean", 9) for m in LOSSES}
    ranks |= {m: F.round(F.abs(F.col(f"{m}_mean") - goal), 9) for m, goal in COVERAGES}
    best = runs.groupBy(*keys).agg(
        *[
            F.min_by(model, F.struct(rank, F.col(model))).alias(f"_best_{m}")
            for m, rank in ranks.items()
        ]
    )
    names = F.create_map(*[F.lit(v) for pair in DISPLAY_NAMES.items() for v in pair])
    every = [*LOSSES, *[c for c, _ in COVERAGES]]
    return runs.join(best, keys).select(
        *keys,
        F.coalesce(names[F.col(model).cast("string")], F.col(model).cast("string")).alias("model"),
        F.col("pinball_loss_mean").alias("pinball_loss_value"),
        *[mean_std_text(f"{m}_mean", f"{m}_std").alias(m) for m in every],
        *[(F.col(model) == F.col(f"_best_{m}")).alias(f"{m}_is_best") for m in every],
    )


def mean_importance(importances: DataFrame, keys: list[str]) -> DataFrame:
    """Average over the models of all levels."""
    return importances.groupBy(*keys, "feature").agg(F.avg("importance").alias("importance"))


def top_features(importances: DataFrame, n: int) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
