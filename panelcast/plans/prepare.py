"""Preparation: landed payloads of a target and of its weather to a clean panel on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import Freq, is_holiday
from panelcast.operators.joins import join_covariates, stitch
from panelcast.operators.panel import (
    SERIES,
    interpolate_prefix,
    keep_first,
    length_violations,
    regularize,
)
from panelcast.session import stage
from panelcast.sources import artifacts, landed

KINDS = ("pairs", "feed", "text")


@dataclass(frozen=True)
class Target:
    """How a target lands and what its panel holds.

    ``kind``: JSON ``pairs`` of days, a weekly JSON ``feed`` of epoch milliseconds, which become
    local wall time, or delimited ``text`` of hours labelled by their end.  Values above ``most``
    drop, the others are divided by ``scale`` and kept as 32-bit floats.  ``weather`` names the
    columns of the stitched weather that stay (None: all).
    """

    kind: str
    freq: Freq
    most: float | None = None
    scale: float = 1.0
    skip_years: int = 0
    weather: tuple[str, ...] | None = None
    max_lag: int = 0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of target: {self.kind}")


def read_target(spark: SparkSession, target: Target, path: str, index: str | None = None) -> DataFrame:
    """``series_id, ts, y`` with naive local timestamps, one row each: of rows that repeat one
    (the hour that autumn repeats among them) the first of the source stays."""
    if target.kind == "pairs":
        rows = landed.parse_pairs(landed.read_json_lines(spark, path))
        rows = rows.select(F.col(SERIES).cast("string").alias(SERIES), "ts", "y", F.col("i").alias("_order"))
        rows = rows.filter(F.col("ts").isNotNull())
    elif target.kind == "feed":
        feed = landed.read_feed(spark, path, index, target.skip_years)
        local = landed.epoch_ms_to_local(F.col("epoch_ms"))
        rows = feed.filter(F.col("y").isNotNull()).select(
            SERIES, local.alias("ts"), "y", F.col("epoch_ms").alias("_order")
        )
    else:
        rows = landed.read_measurements(spark, path).withColumn("_order", F.lit(0))
    if target.most is not None:
        rows = rows.filter(F.col("y").isNull() | (F.col("y") <= target.most))
    rows = rows.withColumn("y", F.col("y") / target.scale)
    return keep_first(rows, [SERIES, "ts"], "_order").drop("_order")


def read_weather(
    history: DataFrame, ahead: DataFrame, freq: Freq, now: Column, past_days: int, forecast_days: int
) -> DataFrame:
    """History before the first row of the forecast feed, then the feed.

    Of the feed the days from ``past_days`` before ``now`` to ``forecast_days`` after it count,
    as its service would answer; both frames have the frequency of the target.
    """
    day = F.expr("interval 1 day")
    near = F.col("ts").between(now - day * past_days, now + day * forecast_days)
    return stitch(history, ahead.filter(near), freq)


def prepare_target(
    spark: SparkSession,
    target: Target,
    path: str,
    root: str,
    index: str | None = None,
    weather: DataFrame | None = None,
    past_days: int = 60,
) -> DataFrame:
    """One target from its payloads to its panel.

    Read, cut, de-duplicate; join with the weather, which says which timestamps there are;
    grid; interpolate up to the last target; holidays; Parquet.  A series with fewer rows than
    the longest lag, or than the weather's ``past_days``, raises.
    """
    rows = stage(read_target(spark, target, path, index), "target")
    # days of weather before now must lie within a series
    short = length_violations(
        rows.select(SERIES, "ts"), target.freq, target.max_lag, past_days if weather is not None else 0
    ).limit(5).collect()
    if short:
        which = ", ".join(f"{r[SERIES]}: {r['rule']}" for r in short)
        raise ValueError(f"series too short: {which}")
    names = []
    if weather is not None:
        names = [c for c in weather.columns if c not in (SERIES, "ts")]
        names = names if target.weather is None else [c for c in names if c in target.weather]
        if target.weather is not None and set(names) != set(target.weather):
            raise ValueError(f"no such weather: {sorted(set(target.weather) - set(names))}")
        rows = stage(join_covariates(rows, weather.select(SERIES, "ts", *names)), "joined")
    return _to_panel(spark, rows, target.freq, ["y", *names], root, "float")


def _to_panel(
    spark: SparkSession, rows: DataFrame, freq: Freq, names: list[str], root: str, kind: str = "double"
) -> DataFrame:
    grid = regularize(rows, freq, names, with_bounds=True)
    filled = interpolate_prefix(grid, names).withColumn("y", F.col("y").cast(kind))
    panel = filled.select(SERIES, "ts", *names, is_holiday("ts").alias("is_holiday"))
    artifacts.write_panel(panel, root)
    return artifacts.read_panel(spark, root)


def prepare(
    spark: SparkSession, pairs_path: str, covariates: DataFrame, freq: Freq, root: str
) -> DataFrame:
    """JSON pairs, right join with covariates, de-duplicate, grid, interpolate up to the
    last target, holidays, Parquet."""
    target = landed.parse_pairs(landed.read_json_lines(spark, pairs_path))
    target = keep_first(
        target.select(target[SERIES].cast("string").alias(SERIES), "ts", "y", "i"),
        [SERIES, "ts"],
        "i",
    ).drop("i")
    joined = stage(join_covariates(target, covariates), "joined")
    names = [c for c in joined.columns if c not in (SERIES, "ts")]
    return _to_panel(spark, joined, freq, names, root)
