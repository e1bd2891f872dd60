"""Writers that encode a panel as the payload files the readers expect.

Used to land fixtures; every body is bounded (a day, a quarter, a week).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import epoch_days, epoch_hours
from panelcast.operators.panel import SERIES


def land_delimited(hourly: DataFrame, path: str) -> None:
    """Hours labelled by their end, ``'01:00'`` to ``'24:00'``; null as ``-``; a footer."""
    rows = hourly.select(
        SERIES,
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.format_string("'%02d:00'", F.hour("ts") + 1).alias("Time"),
        F.coalesce(F.col("y").cast("string"), F.lit("-")).alias("Measure value"),
    )
    footer = hourly.sparkSession.createDataFrame(
        [("-", "source", "-", "-")], rows.schema
    )
    rows.union(footer).write.option("sep", ";").option("header", True).csv(path)


def land_pairs(daily: DataFrame, path: str) -> None:
    """One line per series and quarter: ``[["1995-01-01", "12.5"], ...]``."""
    pair = F.array(F.date_format("ts", "yyyy-MM-dd"), F.col("y").cast("string"))
    bodies = daily.groupBy(SERIES, F.date_trunc("quarter", "ts").alias("_q")).agg(
        F.to_json(F.sort_array(F.collect_list(pair))).alias("value")
    )
    bodies.select("value", SERIES).write.partitionBy(SERIES).text(path)


def land_feed(panel: DataFrame, path: str, index_path: str) -> None:
    """One body per series and week under ``week_stamp=<epoch ms>``, and the index."""
    week = (F.floor((epoch_days("ts") + 3) / 7) * 7 - 3) * 86400000  # Monday
    ms = (epoch_hours("ts") * 3600000).cast("double")
    bodies = panel.groupBy(SERIES, week.alias("week_stamp")).agg(
        F.sort_array(F.collect_list(F.array(ms, F.col("y")))).alias("series")
    )
    (
        bodies.select(F.to_json(F.struct(SERIES, "series")).alias("value"), "week_stamp")
        .repartition("week_stamp")
        .write.partitionBy("week_stamp")
        .text(path)
    )
    stamps = panel.select(week.alias("s")).distinct()
    stamps.agg(F.sort_array(F.collect_list("s")).alias("timestamps")).select(
        F.to_json(F.struct("timestamps")).alias("value")
    ).coalesce(1).write.text(index_path)


def land_packed(daily: DataFrame, variables: list[str], path: str) -> None:
    """Arrays per series and quarter of contiguous days, with start, end and interval."""
    day = epoch_days("ts")
    cells = F.sort_array(F.collect_list(F.struct(day.alias("d"), *variables)))
    packed = daily.groupBy(SERIES, F.date_trunc("quarter", "ts").alias("_q")).agg(
        (F.min(day) * 86400).alias("start"),
        ((F.max(day) + 1) * 86400).alias("end"),
        cells.alias("c"),
    )
    packed.select(
        SERIES,
        "start",
        "end",
        F.lit(86400).alias("interval_seconds"),
        *[F.col("c")[v].alias(v) for v in variables],
    ).write.json(path)
