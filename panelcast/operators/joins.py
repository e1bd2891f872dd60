"""Joins of targets and covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Freq
from panelcast.operators.blocks import BLOCK, block_of
from panelcast.operators.panel import SERIES


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Fold rows per key; a repeated key raises when the plan runs."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in rest]
    )
    check = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what}: keys are not unique")))
    return one.withColumn("_n", check).filter(F.col("_n").isNull()).drop("_n").select(*df.columns)


def join_covariates(target: DataFrame, covariates: DataFrame) -> DataFrame:
    """Right outer, one to one: covariates say which timestamps there are."""
    keys = [SERIES, "ts"]
    left = require_unique(target, keys, "target")
    right = require_unique(covariates, keys, "covariates")
    return left.join(right, keys, "right")


def align(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Index-aligned columns of two frames."""
    return a.join(b, keys, "full")


def stitch(history: DataFrame, forecast: DataFrame, freq: Freq) -> DataFrame:
    """History strictly before the first forecast row of its series, then the forecast.

    The cut is repeated per block of history, so that no series meets it in one task.
    """
    cut = forecast.groupBy(SERIES).agg(F.min(freq.pos("ts")).alias("_cut"))
    span = history.groupBy(SERIES, block_of(freq.pos("ts")).alias(BLOCK)).agg(F.lit(1).alias("_1"))
    cuts = span.join(cut, SERIES, "left").drop("_1")
    old = (
        history.withColumn(BLOCK, block_of(freq.pos("ts")))
        .join(cuts, [SERIES, BLOCK])
        .filter(F.col("_cut").isNull() | (freq.pos("ts") < F.col("_cut")))
        .drop(BLOCK, "_cut")
    )
    return old.unionByName(forecast)


def upsert(series: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Replace ``y`` where ``values(keys, value)`` has one, and append new keys."""
    return series.join(values, keys, "full").withColumn(
        "y", F.coalesce(F.col("value"), F.col("y"))
    ).drop("value")
