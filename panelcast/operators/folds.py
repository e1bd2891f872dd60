"""Backtest folds as arithmetic on row indices."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Freq
from panelcast.operators.panel import SERIES, with_ends


@dataclass(frozen=True)
class WindowParams:
    """Sizes in rows.  The initial window is one number, or the name of a grid column that
    holds one per series (see :func:`evaluation_grid`)."""

    initial_window: int | str
    step_length: int
    forecast_steps: int

    @property
    def window(self) -> Column:
        w = self.initial_window
        return F.col(w) if isinstance(w, str) else F.lit(w)

    @property
    def columns(self) -> list[str]:
        """Grid columns that the sizes come from."""
        return [self.initial_window] if isinstance(self.initial_window, str) else []


@dataclass(frozen=True)
class Splitter:
    """Sliding windows train on the last ``initial_window`` rows, expanding ones on all."""

    params: WindowParams
    kind: str = "sliding"

    def __post_init__(self) -> None:
        if self.kind not in ("sliding", "expanding"):
            raise ValueError(f"unknown splitter type: {self.kind}")


def window_params(
    years: float, step_length_days: int, forecast_steps_days: int, freq: str
) -> WindowParams:
    """Window sizes in rows from years and days."""
    per_day = Freq(freq).per_day
    return WindowParams(
        math.floor(per_day * 365 * years),
        per_day * step_length_days,
        per_day * forecast_steps_days,
    )


def n_folds(n_rows: Column, p: WindowParams) -> Column:
    free = n_rows - p.window - p.forecast_steps
    return F.when((free < 0) | (p.window < 1), 0).otherwise(F.floor(free / p.step_length) + 1)


def fold_table(series: DataFrame, freq: Freq, splitter: Splitter) -> DataFrame:
    """One row per series and fold, from ``(series_id, lo, hi)`` and the window's column."""
    p = splitter.params
    n = F.col("hi") - F.col("lo") + 1
    folds = (
        series.withColumn("_k", n_folds(n, p))
        .filter(F.col("_k") > 0)
        .withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    )
    cutoff = (p.window - 1) + F.col("fold") * p.step_length
    start = cutoff - p.window + 1 if splitter.kind == "sliding" else F.lit(0)
    folds = folds.withColumn("cutoff_idx", cutoff).withColumn("train_start_idx", start)
    folds = folds.withColumn(
        "len_train_window", F.col("cutoff_idx") - F.col("train_start_idx") + 1
    )
    return folds.select(
        SERIES,
        "fold",
        "cutoff_idx",
        "train_start_idx",
        "len_train_window",
        freq.at(F.col("lo") + F.col("cutoff_idx")).alias("cutoff"),
        freq.at(F.col("lo") + F.col("train_start_idx")).alias("train_start"),
        freq.at(F.col("lo") + F.col("cutoff_idx") + 1).alias("test_start"),
        freq.at(F.col("lo") + F.col("cutoff_idx") + p.forecast_steps).alias("test_end"),
    )


def _explode_folds(df: DataFrame, first: Column, last: Column, p: WindowParams) -> DataFrame:
    top = n_folds(F.col("n_rows"), p) - 1
    first = F.greatest(first, F.lit(0))
    last = F.least(last, top)
    folds = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))
    return df.withColumn("fold", F.explode(folds))


def test_rows(grid: DataFrame, p: WindowParams) -> DataFrame:
    """Every (fold, row) with the row in the fold's horizon; ``h`` is the step ahead.

    The folds of a row follow from its index, so no range join is needed.
    """
    i, w, s, h = F.col("idx"), p.window, p.step_length, p.forecast_steps
    first = F.ceil((i - w - h + 1) / s)
    last = F.floor((i - w) / s)
    out = _explode_folds(grid, first, last, p)
    return out.withColumn("h", i - (w - 1 + F.col("fold") * s))


def train_rows(grid: DataFrame, splitter: Splitter) -> DataFrame:
    """Every (fold, row) with the row in the fold's training window."""
    p = splitter.params
    i, w, s = F.col("idx"), p.window, p.step_length
    first = F.ceil((i - w + 1) / s)
    last = F.floor(i / s) if splitter.kind == "sliding" else n_folds(F.col("n_rows"), p) - 1
    return _explode_folds(grid, first, last, p)


def initial_window(grid: DataFrame, freq: Freq, day: str) -> DataFrame:
    """Rows up to and including a whole day, per series."""
    inside = F.to_date("ts") <= F.lit(day).cast("date")
    return grid.groupBy(SERIES).agg(F.count_if(inside).alias("initial_window"))


WINDOW = "window"


def evaluation_grid(
    grid: DataFrame, freq: Freq, start: str | None, first: str, last: str | None
) -> DataFrame:
    """The part of an indexed grid that a dated evaluation sees, and its windows.

    Rows from the day ``start`` through the day ``last``; the column ``window`` counts a
    series' rows up to and including the day ``first``, so ``WindowParams("window", ...)``
    gives each series folds from that day on.  A series without rows up to then has no folds.
    """

    def position(day: str) -> Column:
        return freq.pos(F.lit(day).cast("timestamp_ntz"))

    grid = with_ends(grid)
    lo, hi = F.col("lo"), F.col("hi")
    if start is not None:
        lo = F.greatest(lo, position(start))
    if last is not None:
        hi = F.least(hi, position(last) + freq.per_day - 1)
    inside = grid.filter(F.col("pos").between(lo, hi)).withColumns({"lo": lo, "hi": hi})
    seen = position(first) + freq.per_day - F.col("lo")
    rows = F.col("hi") - F.col("lo") + 1
    window = F.least(F.greatest(seen, F.lit(0)), rows).cast("int")
    return inside.withColumns({"idx": F.col("pos") - F.col("lo"), "n_rows": rows, WINDOW: window})
