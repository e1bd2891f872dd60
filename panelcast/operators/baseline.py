"""Seasonal baseline: quantiles of the last weeks of the same phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.functions.calendar import Freq
from panelcast.operators.blocks import BLOCK, drop_halo, with_halo
from panelcast.operators.folds import Splitter, test_rows
from panelcast.operators.panel import SERIES
from panelcast.operators.quantiles import sorted_quantile


def _weeks_ahead(h: Column, freq: Freq) -> Column:
    return F.floor((h - 1) / freq.period)


def _phase_window(freq: Freq, first: int, last: int):
    return (
        Window.partitionBy(SERIES, BLOCK, freq.phase("pos"))
        .orderBy("pos")
        .rangeBetween(first * freq.period, last * freq.period)
    )


def baseline_backtest(
    grid: DataFrame, freq: Freq, splitter: Splitter, n_weeks: int, spans: list[int] | None = None
) -> DataFrame:
    """Quantile forecasts of every fold in one pass over the panel.

    The history of a row at step ``h`` is the same phase ``k+1 .. k+n`` weeks
    before it, ``k`` full weeks ahead of the cutoff, and never before the start of
    the training window.  A week without an observation keeps its place.  With
    ``spans`` the result has one row per history length (``n_weeks`` column).
    """
    p = splitter.params
    weeks = max(spans) if spans else n_weeks
    far = (p.forecast_steps - 1) // freq.period  # full weeks ahead at the last step
    reach = (weeks + far) * freq.period
    known = isinstance(p.initial_window, int)
    clipped = splitter.kind == "sliding" and not (known and p.initial_window >= reach)
    simple = far == 0 and not clipped and spans is None

    halo = with_halo(grid, "pos", back=reach)
    if simple:
        w = _phase_window(freq, -n_weeks, -1)
        levels = F.array(*[F.lit(q) for q in LEVELS])
        scored = drop_halo(halo.withColumn("_q", F.percentile("y", levels).over(w)))
        rows = test_rows(scored, p)
        return rows.withColumns({c: F.col("_q")[i] for i, c in enumerate(QCOLS)}).drop("_q")

    w = _phase_window(freq, -(weeks + far), -1)
    seen = F.when(F.col("y").isNotNull(), F.struct("pos", "y"))
    rows = test_rows(drop_halo(halo.withColumn("_past", F.collect_list(seen).over(w))), p)
    if spans:
        rows = rows.withColumn("n_weeks", F.explode(F.array(*[F.lit(s) for s in spans])))
        span: Column = F.col("n_weeks")
    else:
        span = F.lit(n_weeks)
    cutoff = F.col("pos") - F.col("h")
    newest = F.col("pos") - (_weeks_ahead(F.col("h"), freq) + 1) * freq.period
    oldest = newest - (span - 1) * freq.period
    if splitter.kind == "sliding":
        oldest = F.greatest(oldest, cutoff - p.window + 1)
    rows = rows.withColumns({"_old": oldest, "_new": newest})
    used = F.filter("_past", lambda x: x["pos"].between(F.col("_old"), F.col("_new")))
    rows = rows.withColumn("_s", F.array_sort(F.transform(used, lambda x: x["y"])))
    return rows.withColumns(
        {c: sorted_quantile(F.col("_s"), q) for c, q in zip(QCOLS, LEVELS, strict=True)}
    ).drop("_past", "_s", "_old", "_new")


def baseline_table(history: DataFrame, freq: Freq, n_weeks: int, y: str = "y") -> DataFrame:
    """``series_id, phase, _q``: quantiles of the last ``n_weeks`` of every phase, from a
    history grid with ``hi`` per row."""
    recent = history.filter(F.col("pos") > F.col("hi") - n_weeks * freq.period)
    levels = F.array(*[F.lit(q) for q in LEVELS])
    return recent.groupBy(SERIES, freq.phase("pos").alias("phase")).agg(
        F.percentile(y, levels).alias("_q")
    )


def baseline_lookup(horizon: DataFrame, table: DataFrame, freq: Freq) -> DataFrame:
    """``horizon(series_id, pos)`` with the quantiles of its phase."""
    out = horizon.withColumn("phase", freq.phase("pos")).join(table, [SERIES, "phase"], "left")
    return out.withColumns({c: F.col("_q")[i] for i, c in enumerate(QCOLS)}).drop("_q", "phase")


def baseline_forecast(
    history: DataFrame, horizon: DataFrame, freq: Freq, n_weeks: int, y: str = "y"
) -> DataFrame:
    """Forecast ``horizon(series_id, pos)`` from a history grid with ``hi`` per row.

    The last ``n_weeks`` of every phase are averaged into quantiles once per
    (series, phase); the horizon looks its phase up.
    """
    return baseline_lookup(horizon, baseline_table(history, freq, n_weeks, y), freq)
