"""Readers of landed payload files (delimited text, JSON pairs, packed arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import LOCAL_ZONE
from panelcast.functions.calendar import HOURLY, from_seconds, to_local, to_utc
from panelcast.operators.panel import SERIES, keep_first, upsample_backfill

PLACE = "_place"
DELIMITED_SCHEMA = "series_id string, `Date` string, `Time` string, `Measure value` string"


def nan_to_null(x: Column) -> Column:
    """NaN is a missing value everywhere in this package."""
    return F.when(~F.isnan(x), x)


def parse_date(text: Column) -> Column:
    """ISO date, or null when the text is not one."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


# --- semicolon-separated measurements ------------------------------------------


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows: ``;`` separated, ``-`` means null.  A footer record may follow the data.

    ``_place`` orders rows as the source has them: file, start of the split, row in it.
    """
    raw = (
        spark.read.schema(DELIMITED_SCHEMA)
        .option("sep", ";")
        .option("header", True)
        .option("nullValue", "-")
        .csv(path)
    )
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.withColumn(PLACE, place)


def drop_footer(raw: DataFrame) -> DataFrame:
    """A footer is a record whose date is not a date; files have no row order in Spark."""
    return raw.filter(parse_date(F.col("Date")).isNotNull())


def wrapped_hour(time: Column) -> Column:
    """Hour of a quoted ``'HH:MM'`` text, 24 becoming 0."""
    return F.substring(time, 2, 2).cast("int") % 24


def assemble_timestamp(date: Column, hour: Column, roll_midnight: Column | None = None) -> Column:
    """Date plus hour.  ``24:00`` stays on its own date unless ``roll_midnight`` says
    to move it to the next."""
    day = F.unix_date(parse_date(date)).cast("long")
    if roll_midnight is not None:
        day = day + roll_midnight.cast("long")
    return HOURLY.at(day * 24 + hour)


def parse_delimited(raw: DataFrame, roll_midnight: bool = False) -> DataFrame:
    """Typed rows ``(series_id, ts, y)`` plus their order in the source where ``raw`` has
    it (see :func:`read_delimited`), else the raw ``Date``/``Time``."""
    time = F.col("Time")
    rolled = (F.substring(time, 2, 2) == "24") if roll_midnight else None
    return drop_footer(raw).select(
        SERIES,
        assemble_timestamp(F.col("Date"), wrapped_hour(time), rolled).alias("ts"),
        nan_to_null(F.col("Measure value").try_cast("double")).alias("y"),
        (F.col(PLACE) if PLACE in raw.columns else F.concat_ws(" ", "Date", "Time")).alias("_order"),
    )


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Hourly measurements: parse, keep the first row per hour, back-fill the grid."""
    rows = parse_delimited(read_delimited(spark, path))
    first = keep_first(rows, [SERIES, "ts"], "_order").drop("_order")
    return upsample_backfill(first, HOURLY, "y").select(SERIES, "ts", "y")


# --- JSON payloads ------------------------------------------------------------------


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One response body per line, with the partition columns of the folder layout."""
    return spark.read.text(path)


def parse_pairs(bodies: DataFrame, body: str = "value") -> DataFrame:
    """``[[date, value], ...]`` bodies to typed rows."""
    pairs = F.from_json(F.col(body), "array<array<string>>")
    others = [c for c in bodies.columns if c != body]
    return bodies.select(*others, F.posexplode(pairs).alias("i", "p")).select(
        *others,
        "i",
        F.try_to_timestamp(F.get("p", F.lit(0)), F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("ts"),
        nan_to_null(F.get("p", F.lit(1)).try_cast("double")).alias("y"),
    )


def parse_feed(bodies: DataFrame, body: str = "value") -> DataFrame:
    """``{"series_id": ..., "series": [[epoch_ms, value], ...]}`` bodies to rows."""
    pairs = F.from_json(F.get_json_object(F.col(body), "$.series"), "array<array<double>>")
    name = F.get_json_object(F.col(body), "$.series_id").alias(SERIES)
    others = [c for c in bodies.columns if c != body]
    return bodies.select(*others, name, F.posexplode(pairs).alias("i", "p")).select(
        *others,
        SERIES,
        "i",
        F.get("p", F.lit(0)).cast("long").alias("epoch_ms"),
        nan_to_null(F.get("p", F.lit(1))).alias("y"),
    )


def epoch_ms_to_local(ms: Column, zone: str = LOCAL_ZONE) -> Column:
    """Epoch milliseconds, cut to whole seconds, as local wall time of ``zone``."""
    return to_local(from_seconds(F.floor(ms / 1000)), zone)


def shard_stamps(spark: SparkSession, index_path: str, skip_years: int) -> list[int]:
    """Stamps of the shards to read: the index without its first ``52 * skip_years``.

    The index is a list of weeks, a few thousand entries at most.
    """
    index = spark.read.text(index_path)
    stamps = index.select(
        F.explode(F.from_json(F.get_json_object("value", "$.timestamps"), "array<long>")).alias("s")
    )
    return [r.s for r in stamps.distinct().orderBy("s").offset(52 * skip_years).collect()]


def read_feed(spark: SparkSession, path: str, index_path: str, skip_years: int = 0) -> DataFrame:
    """The weekly shards named by the index; skipped weeks are pruned as partitions."""
    bodies = read_json_lines(spark, path)
    stamps = shard_stamps(spark, index_path, skip_years)
    return parse_feed(bodies.filter(F.col("week_stamp").isin(stamps)))


def unpack_arrays(packed: DataFrame, variables: list[str]) -> DataFrame:
    """Packed arrays with ``start``, ``end`` and ``interval_seconds`` (epoch seconds) to
    rows on a left-closed axis.  Variables are bound by name, never by position."""
    others = [
        c for c in packed.columns if c not in (*variables, "start", "end", "interval_seconds")
    ]
    size = F.floor((F.col("end") - F.col("start")) / F.col("interval_seconds")).cast("int")
    zipped = F.slice(F.arrays_zip(*variables), F.lit(1), size)
    rows = packed.select(*others, "start", "interval_seconds", F.posexplode(zipped).alias("i", "z"))
    return rows.select(
        *others,
        from_seconds(F.col("start") + F.col("i") * F.col("interval_seconds")).alias("ts"),
        *[F.col("z")[v].alias(v) for v in variables],
    )


# --- time zones ---------------------------------------------------------------------


def localize(df: DataFrame, seq: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Naive local ``ts`` to ``ts_utc`` per series.

    Of two rows in the repeated autumn hour the second by ``seq`` is the later
    instant.  Rows in the skipped spring hour do not exist and drop.
    """
    hour = F.expr("interval 1 hour")
    utc = to_utc("ts", zone)
    df = df.withColumn("ts_utc", utc).filter(to_local("ts_utc", zone) == F.col("ts"))
    df = df.withColumn("_twice", to_local(F.col("ts_utc") + hour, zone) == F.col("ts"))
    # One hour a year and series is joined; the other rows stay where they are.
    twice = df.filter("_twice")
    firsts = twice.groupBy(SERIES, "ts").agg(F.min(seq).alias("_first"))
    later = F.col(seq) > F.col("_first")
    told = (
        twice.join(firsts, [SERIES, "ts"])
        .withColumn("ts_utc", F.when(later, F.col("ts_utc") + hour).otherwise(F.col("ts_utc")))
        .drop("_first")
    )
    once = df.filter(~F.coalesce("_twice", F.lit(False)))
    return once.unionByName(told).drop("_twice")
