"""Panels derived from the fact tables: daily orders, hourly events, shipment covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAILY, HOURLY, is_holiday
from panelcast.operators.joins import join_covariates
from panelcast.operators.panel import SERIES, aggregate_panel, interpolate, regularize
from panelcast.session import stage
from panelcast.sources.artifacts import time_slice

# Marks per euro: prices in thousand euro, event values in euro.
RATE = 1.95583


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(
    spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Order value per priority and day; days without orders are missing.

    ``start`` and ``end`` (whole days, inclusive) cut the orders at the scan.
    """
    y = F.round(F.sum("o_totalprice"), 2) / (RATE * 1000)
    orders = time_slice(table(spark, sf_dir, "orders"), start, end, "o_orderdate")
    return aggregate_panel(orders, F.col("o_orderpriority"), F.col("o_orderdate"), DAILY, y=y)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value per type and hour."""
    y = F.round(F.sum("value"), 2) / RATE
    events = table(spark, sf_dir, "events")
    return aggregate_panel(events, F.col("event_type"), F.col("ts"), HOURLY, y=y)


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped quantity and discount per priority and day, three months past the orders."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    return aggregate_panel(
        lines,
        F.col("o_orderpriority"),
        F.col("l_shipdate"),
        DAILY,
        quantity=F.sum("l_quantity"),
        discount=F.round(F.sum("l_discount"), 2) / RATE,
    )


# A grid reads its rows twice, for the limits of each series and for the values, so the
# rolled-up facts are staged: the facts are scanned once.


def daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularize(stage(daily(spark, sf_dir), "daily"), DAILY, ["y"], with_bounds=True)


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regularize(stage(hourly(spark, sf_dir), "hourly"), HOURLY, ["y"], with_bounds=True)


def daily_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate(daily_grid(spark, sf_dir), ["y"])


def hourly_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate(hourly_grid(spark, sf_dir), ["y"])


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target right-joined to covariates, on the grid: future rows have no target."""
    both = stage(join_covariates(daily(spark, sf_dir), covariates(spark, sf_dir)), "joined")
    return regularize(both, DAILY, ["y", "quantity", "discount"], with_bounds=True)


def covariate_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free daily panel with covariates and holiday flag, for models."""
    both = stage(daily(spark, sf_dir).join(covariates(spark, sf_dir), [SERIES, "ts"]), "panel")
    grid = regularize(both, DAILY, ["y", "quantity", "discount"], with_bounds=True)
    return interpolate(grid, ["y", "quantity", "discount"]).withColumn(
        "is_holiday", is_holiday("ts").cast("double")
    )

