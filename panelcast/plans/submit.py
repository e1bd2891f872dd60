"""From history to a checked submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import QCOLS, SUBMISSION_QCOLS
from panelcast.functions.calendar import (
    DAILY,
    HOURLY,
    following_days,
    forecast_hours,
    next_wednesday,
)
from panelcast.models.forecast import forecast
from panelcast.models.registry import Setup
from panelcast.operators.baseline import baseline_forecast
from panelcast.operators.panel import SERIES, aggregate_panel, extended, interpolate, regularize
from panelcast.operators.submission import ROW_ID, build_submission, horizon_label
from panelcast.plans import tables as T
from panelcast.plans.tables import RATE
from panelcast.plans.train import train_and_save
from panelcast.session import stage
from panelcast.sources import artifacts

# Which event types stand for the two targets.
BIKES, ENERGY = "click", "view"
WEEKS = 4


def target_grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily counts of one event type; hourly value of another."""
    events = T.table(spark, sf_dir, "events")
    counts = aggregate_panel(
        events.filter(F.col("event_type") == BIKES),
        F.col("event_type"),
        F.col("ts"),
        DAILY,
        y=F.count("*").cast("double"),
    )
    load = aggregate_panel(
        events.filter(F.col("event_type") == ENERGY),
        F.col("event_type"),
        F.col("ts"),
        HOURLY,
        y=F.round(F.sum("value"), 2) / (RATE * 10),
    )
    return (
        regularize(stage(counts, "counts"), DAILY, ["y"], with_bounds=True),
        regularize(stage(load, "load"), HOURLY, ["y"], with_bounds=True),
    )


def as_of_date(*grids: DataFrame):
    """The day of the last row of all grids: one date for all targets of a submission."""
    last = [g.agg(F.max("ts")).first()[0] for g in grids]
    return max(x.date() for x in last if x is not None)


def horizon_dates(grid: DataFrame, freq, as_of) -> DataFrame:
    """Forecast timestamps of the week after the day ``as_of``, with their Wednesday."""
    day = F.lit(as_of.isoformat()).cast("timestamp_ntz")
    series = grid.select(SERIES).distinct().withColumn("last", day)
    start = series.select(SERIES, next_wednesday("last").alias("start"))
    dates = following_days("start") if freq is DAILY else forecast_hours("start")
    return start.select(
        SERIES, DAILY.floor("start").alias("wednesday"), F.explode(dates).alias("ts")
    ).withColumn("pos", freq.pos("ts"))


def target_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(target, horizon, wednesday, q025...)`` of both targets."""
    parts = []
    grids = target_grids(spark, sf_dir)
    as_of = as_of_date(*grids)
    for grid, freq, target in zip(grids, (DAILY, HOURLY), ("bikes", "energy"), strict=True):
        rows = baseline_forecast(grid, horizon_dates(grid, freq, as_of), freq, WEEKS)
        label = horizon_label("ts", "wednesday", daily=freq is DAILY)
        parts.append(
            rows.select(
                F.lit(target).alias("target"), label.alias("horizon"), "wednesday", *QCOLS
            )
        )
    return parts[0].unionByName(parts[1])


def fitted_forecasts(spark: SparkSession, sf_dir: str, setups: dict[str, Setup], root: str) -> DataFrame:
    """As :func:`target_forecasts`, from a model per target that is fitted, written under
    ``root`` and read back."""
    parts = []
    grids = target_grids(spark, sf_dir)
    as_of = as_of_date(*grids)
    for grid, freq, target in zip(grids, (DAILY, HOURLY), ("bikes", "energy"), strict=True):
        setup, place = setups[target], f"{root}/{target}"
        filled = interpolate(grid, ["y"])
        train_and_save(filled, setup, place)
        dates = stage(horizon_dates(grid, freq, as_of), "horizon")
        end = dates.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
        ahead = stage(extended(filled, freq, end), "ahead")
        models = artifacts.read_model(spark, place)
        steps = ahead.join(models, SERIES).agg(F.max("hi") - F.min(F.col("lo") + F.col("last"))).first()[0]
        rows = forecast(ahead, models, setup.spec, setup.model, int(steps))
        rows = rows.join(dates.select(SERIES, "wednesday", "pos"), [SERIES, "pos"])
        label = horizon_label("ts", "wednesday", daily=freq is DAILY)
        parts.append(
            rows.select(F.lit(target).alias("target"), label.alias("horizon"), "wednesday", *QCOLS)
        )
    return parts[0].unionByName(parts[1])


def submission(spark: SparkSession, sf_dir: str, forecasts: DataFrame | None = None) -> DataFrame:
    """The 18 submission rows; ``forecast_date`` is the Wednesday the horizon starts from."""
    forecasts = target_forecasts(spark, sf_dir) if forecasts is None else forecasts
    forecasts = stage(forecasts, "forecasts")  # 12 rows
    wednesday = forecasts.agg(F.date_format(F.max("wednesday"), "yyyy-MM-dd")).first()[0]
    return build_submission(forecasts, F.lit(wednesday))


def write_submission(sub: DataFrame, path: str) -> DataFrame:
    """The contract's eight columns as one file in row order, as it is read back.

    The file has 18 rows, so one task writes it; its rows are numbered in file order.
    """
    rows = sub.orderBy(ROW_ID).coalesce(1).drop(ROW_ID)
    artifacts.write_csv(rows, path)
    schema = "forecast_date string, target string, horizon string, " + ", ".join(
        f"`{s}` double" for s in SUBMISSION_QCOLS
    )
    back = artifacts.read_csv(sub.sparkSession, path, schema)
    place = F.monotonically_increasing_id().cast("int").alias(ROW_ID)
    return back.select(place, "*")
