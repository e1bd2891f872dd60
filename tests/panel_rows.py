"""Small frames of one series, and their columns, for the panel tests."""

from __future__ import annotations

from datetime import datetime, timedelta


def series(spark, values, name="s", start=datetime(2024, 1, 1), step=timedelta(days=1), col="y"):
    """Rows of one series; a null value is a row without a value."""
    rows = [(name, start + i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id string, ts timestamp_ntz, {col} double")


def column(df, name="y", order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]
