"""Weekly feeds as a Python data source: ``spark.read.format("weekly_feed")``.

The index names the shards; a partition reads one shard, and bounds on ``epoch_ms`` leave out
the shards whose week they do not touch, before any of their files is opened.  The bounds are
options: what a Python reader learns from pushed filters stays with the frame, so a second
query on the same frame could miss shards that only the first did not need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WEEK_MS = 7 * 86_400_000
SCHEMA = "series_id string, epoch_ms long, y double, week_stamp long, file string, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema(
    [(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]])
     for c in SCHEMA.split(", ")]
)


class FeedError(ValueError):
    """A body that is no feed: the message names its file and line."""


class Shard(InputPartition):
    def __init__(self, stamp: int):
        self.stamp = stamp


class WeeklyFeed(DataSource):
    """Options: ``path`` with a folder ``week_stamp=<epoch ms>`` per shard, ``index`` with the
    list of stamps, ``skipYears`` to leave out that many times 52 first shards, ``from`` and
    ``until`` as bounds on ``epoch_ms`` (the second exclusive), and ``onError``: ``raise``
    (default), or ``report`` for a row with ``file`` and ``error``."""

    @classmethod
    def name(cls) -> str:
        return "weekly_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options):
        # option names come in any case
        given = {k.lower(): v for k, v in dict(options).items()}
        self.path, self.index = given["path"], given["index"]
        self.skip = 52 * int(given.get("skipyears", 0))
        self.on_error = given.get("onerror", "raise")
        if self.on_error not in ("raise", "report"):
            raise ValueError(f"unknown onError: {self.on_error}")
        self.low, self.high = (int(given[k]) if k in given else None for k in ("from", "until"))

    def partitions(self) -> list[InputPartition]:
        stamps = sorted({s for _, line, _ in _lines(self.index) for s in json.loads(line)["timestamps"]})
        wanted = [
            s
            for s in stamps[self.skip :]
            if (self.low is None or s + WEEK_MS > self.low) and (self.high is None or s < self.high)
        ]
        return [Shard(s) for s in wanted]

    def _inside(self, ms: int) -> bool:
        return (self.low is None or ms >= self.low) and (self.high is None or ms < self.high)

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is wanted
            return
        for file, line, number in _lines(f"{self.path}/week_stamp={partition.stamp}"):
            try:
                body = json.loads(line)
                pairs = [(int(ms), None if y is None else float(y)) for ms, y in body["series"]]
                pairs = [p for p in pairs if self._inside(p[0])]
                name = str(body["series_id"])
            except (ValueError, KeyError, TypeError) as e:
                text = f"{file}, line {number}: {type(e).__name__}: {e}"
                if self.on_error == "raise":
                    raise FeedError(text) from e
                row = [None, None, None, partition.stamp, file, text]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ARROW, strict=True)], schema=ARROW)
                continue
            n = len(pairs)
            columns = [
                [name] * n, [p[0] for p in pairs], [p[1] for p in pairs],
                [partition.stamp] * n, [file] * n, [None] * n,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _lines(uri: str) -> Iterator[tuple[str, str, int]]:
    """``file, line, number`` of the text files in a folder; none where it is missing."""
    store, folder = fs.FileSystem.from_uri(uri)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    for info in sorted(found, key=lambda i: i.path):
        if not info.is_file or info.base_name.startswith(("_", ".")):
            continue
        with store.open_input_stream(info.path) as stream:
            text = stream.read().decode("utf-8")  # a shard holds one week
        for number, line in enumerate(text.splitlines(), 1):
            if line.strip():
                yield info.path, line, number


def read_weekly_feed(
    spark: SparkSession,
    path: str,
    index: str,
    skip_years: int = 0,
    on_error: str = "raise",
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """The feed from ``start_ms`` up to, not including, ``end_ms``."""
    spark.dataSource.register(WeeklyFeed)
    reader = spark.read.format("weekly_feed").option("path", qualified(spark, path))
    reader = reader.option("index", qualified(spark, index)).option("skipYears", skip_years)
    for key, value in (("from", start_ms), ("until", end_ms)):
        reader = reader if value is None else reader.option(key, value)
    return reader.option("onError", on_error).load()


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI: a bare path belongs to the cluster's default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and "://" not in uri else uri
