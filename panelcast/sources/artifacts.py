"""Stage outputs: panels, results, metrics and models as partitioned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.panel import SERIES


# Folders of a panel, whatever the number of series.
BUCKETS = 64
BUCKET = "bucket"


def _bucket(series) -> Column:
    return F.pmod(F.xxhash64(series), F.lit(BUCKETS)).cast("int")


def data_path(root: str) -> str:
    """Panel location: a folder per bucket of series in it."""
    return f"{root}/panel"


def model_path(root: str) -> str:
    return f"{root}/model"


def write_panel(df: DataFrame, root: str) -> str:
    """Parquet, one folder per bucket of series, in order of series and time within a file.

    Rows are spread by bucket and year first, so a long series is written by several tasks.
    """
    path = data_path(root)
    (
        df.withColumn(BUCKET, _bucket(F.col(SERIES).cast("string")))
        .repartition(F.col(BUCKET), F.year("ts"))
        .sortWithinPartitions(BUCKET, SERIES, "ts")
        .write.mode("overwrite")
        .partitionBy(BUCKET)
        .parquet(path)
    )
    return path


def read_panel(
    spark: SparkSession,
    root: str,
    target: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Panel rows; target and dates (whole days, inclusive) are pruned at the scan: a target
    by its bucket's folder, and by the order of series within it."""
    df = spark.read.parquet(data_path(root))
    if target is not None:
        df = df.filter((F.col(BUCKET) == _bucket(F.lit(target))) & (F.col(SERIES) == target))
    return time_slice(df.drop(BUCKET), start, end)


def time_slice(
    df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Inclusive slice; a date as end covers its whole day.  Written as ranges on the
    bare column, so that they reach the scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return df


def year_slice(df: DataFrame, year: int, ts: str = "ts") -> DataFrame:
    return time_slice(df, f"{year}-01-01", f"{year}-12-31", ts)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per task that made rows."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def nested_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(metric, mean, std)`` to one JSON text per key: ``{metric: {mean, std}}``."""
    entries = F.sort_array(F.collect_list(F.struct("metric", F.struct("mean", "std").alias("v"))))
    return metrics.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_metrics(metrics: DataFrame, keys: list[str], path: str) -> None:
    """One JSON line per key, ``{keys..., "metrics": {metric: {mean, std}}}``, in files of
    whole tasks: no folder per key."""
    nested = nested_metrics(metrics, keys)
    head = F.to_json(F.struct(*keys))
    # the metrics are JSON already: they go behind the keys as they are
    open_end = head.substr(F.lit(1), F.length(head) - 1)
    line = F.concat(open_end, F.lit(',"metrics":'), F.col("value"), F.lit("}"))
    nested.select(line.alias("value")).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``keys..., value``: the metrics of each key as JSON text."""
    lines = spark.read.text(path)
    cells = [F.get_json_object("value", f"$.{k}").alias(k) for k in keys]
    return lines.select(*cells, F.get_json_object("value", "$.metrics").alias("value"))


def write_model(model: DataFrame, root: str) -> str:
    path = model_path(root)
    model.write.mode("overwrite").parquet(path)
    return path


def read_model(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(model_path(root))
