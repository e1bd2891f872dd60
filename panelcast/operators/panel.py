"""The panel ``(series_id, ts, y, x...)`` on a regular calendar grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Freq, epoch_micros
from panelcast.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    block_of,
    block_window,
    drop_halo,
    nearest_observed,
    row_numbers,
    with_halo,
)

SERIES = "series_id"


def aggregate_panel(
    df: DataFrame, series: Column, ts: Column, freq: Freq, **values: Column
) -> DataFrame:
    """Roll raw facts up to one row per series and grid step (map-side combined)."""
    return (
        df.groupBy(series.alias(SERIES), freq.pos(ts).alias("pos"))
        .agg(*[v.alias(k) for k, v in values.items()])
        .select(SERIES, freq.at("pos").alias("ts"), *values)
    )


def bounds(df: DataFrame, freq: Freq, *extra: Column) -> DataFrame:
    """First and last grid position of each series."""
    return df.groupBy(SERIES).agg(
        F.min(freq.pos("ts")).alias("lo"), F.max(freq.pos("ts")).alias("hi"), *extra
    )


def spine(limits: DataFrame, freq: Freq, rows: int = BLOCK_ROWS) -> DataFrame:
    """Every grid position from ``lo`` to ``hi``.

    Exploded block by block, so no array outgrows a block and the second step
    can be spread over the cluster.  Other columns of ``limits`` come along.
    """
    blocks = limits.withColumn(
        BLOCK, F.explode(F.sequence(block_of("lo", rows), block_of("hi", rows)))
    )
    start = F.greatest(F.col("lo"), F.col(BLOCK) * rows)
    stop = F.least(F.col("hi"), F.col(BLOCK) * rows + rows - 1)
    return (
        blocks.withColumn("pos", F.explode(F.sequence(start, stop)))
        .withColumn("ts", freq.at("pos"))
        .drop(BLOCK)
    )


def regularize(
    df: DataFrame, freq: Freq, cols: list[str] | None = None, with_bounds: bool = False
) -> DataFrame:
    """Complete the grid from first to last timestamp; off-grid rows drop.

    A repeated (series, timestamp) raises, as a grid cannot hold both.  Adds
    ``pos``; with ``with_bounds`` also ``idx`` (0-based row in the series),
    ``n_rows`` and ``lo``/``hi``.
    """
    cols = cols or [c for c in df.columns if c not in (SERIES, "ts", "pos")]
    on_grid = df.filter(freq.on_grid("ts")).withColumn("pos", freq.pos("ts"))
    cells = on_grid.groupBy(SERIES, "pos").agg(
        F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in cols]
    )
    # The limits are needed whatever is selected, so the check is part of them.
    message = F.lit("cannot put duplicate timestamps on a grid")
    at = F.when(F.col("_n") > 1, F.raise_error(message).cast("long")).otherwise(F.col("pos"))
    limits = cells.groupBy(SERIES).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    cells = cells.drop("_n")
    grid = spine(limits, freq).join(cells, [SERIES, "pos"], "left")
    keep = [SERIES, "ts", "pos", *cols]
    if with_bounds:
        grid = with_index(grid)
        keep += ["idx", "n_rows", "lo", "hi"]
    return grid.select(*keep)


def with_index(grid: DataFrame) -> DataFrame:
    """Row index and series length, by arithmetic on ``lo``/``hi``."""
    return grid.withColumn("idx", F.col("pos") - F.col("lo")).withColumn(
        "n_rows", F.col("hi") - F.col("lo") + 1
    )


def with_ends(grid: DataFrame) -> DataFrame:
    """``lo`` and ``hi`` of an indexed grid."""
    lo = F.col("pos") - F.col("idx")
    return grid.withColumns({"lo": lo, "hi": lo + F.col("n_rows") - 1})


def since(grid: DataFrame, freq: Freq, day: str) -> DataFrame:
    """The part of an indexed grid from the start of a day on, numbered anew."""
    first = F.greatest("lo", freq.pos(F.lit(day).cast("timestamp_ntz")))
    return with_index(with_ends(grid).filter(F.col("pos") >= first).withColumn("lo", first))


def extended(grid: DataFrame, freq: Freq, last: str) -> DataFrame:
    """An indexed grid with rows up to the end of a day; new rows have no values."""
    grid = with_ends(grid)
    end = freq.pos(F.lit(last).cast("timestamp_ntz")) + freq.per_day - 1
    hi = F.greatest("hi", end)
    series = grid.groupBy(SERIES).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    more = series.filter(F.col("hi") < end).select(
        SERIES, "lo", F.explode(F.sequence(F.col("hi") + 1, end)).alias("pos"), end.alias("hi")
    )
    longer = grid.withColumn("hi", hi).unionByName(
        more.withColumn("ts", freq.at("pos")), allowMissingColumns=True
    )
    return with_index(longer)


def attach_series(df: DataFrame, stats: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Join per-series values (with ``lo``/``hi``) to rows, block by block.

    The stats are repeated once per block, so a long series is spread over
    many join partitions instead of one.
    """
    by_block = stats.withColumn(
        BLOCK, F.explode(F.sequence(block_of("lo", rows), block_of("hi", rows)))
    )
    clash = [c for c in stats.columns if c != SERIES and c in df.columns]
    left = df.drop(*clash).withColumn(BLOCK, block_of("pos", rows))
    return left.join(by_block, [SERIES, BLOCK]).drop(BLOCK)


def _between(c: str, pos: Column) -> Column:
    p0, v0, p1, v1 = (F.col(f"_{s}_{c}") for s in ("pp", "pv", "np", "nv"))
    line = F.when(p0 == p1, v0).otherwise(v0 + (v1 - v0) * (pos - p0) / (p1 - p0))
    return F.coalesce(line, v0)


def _helpers(cols: list[str]) -> list[str]:
    return [f"_{s}_{c}" for c in cols for s in ("pp", "pv", "np", "nv")]


def interpolate(grid: DataFrame, cols: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation by position; leading nulls stay, the tail holds its
    last value."""
    near = nearest_observed(grid, [SERIES], "pos", cols, rows=rows)
    filled = {c: _between(c, F.col("pos")).alias(c) for c in cols}
    return near.withColumns(filled).drop(*_helpers(cols))


def interpolate_prefix(
    grid: DataFrame, cols: list[str], target: str = "y", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Interpolate only up to the last observed target; later rows are untouched."""
    stats = grid.groupBy(SERIES).agg(
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
        F.max(F.when(F.col(target).isNotNull(), F.col("pos"))).alias("_end"),
    )
    df = attach_series(grid, stats, rows).drop("lo", "hi")
    inside = F.col("pos") <= F.col("_end")
    seen = {c: F.col(c).isNotNull() & inside for c in cols}
    near = nearest_observed(df, [SERIES], "pos", cols, observed=seen, rows=rows)
    filled = {
        c: F.when(inside, _between(c, F.col("pos"))).otherwise(F.col(c)).alias(c) for c in cols
    }
    return near.withColumns(filled).drop("_end", *_helpers(cols))


def upsample_backfill(df: DataFrame, freq: Freq, col: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Complete the grid; a new row takes the next source row's value, null included."""
    source = df.withColumn("_real", F.lit(True)).select(SERIES, "ts", "_real", col)
    grid = regularize(source, freq, ["_real", col])
    near = nearest_observed(
        grid, [SERIES], "pos", [col], observed={col: F.col("_real").isNotNull()}, rows=rows
    )
    return near.withColumn(col, F.col(f"_nv_{col}")).drop("_real", *_helpers([col]))


def fill_nearest(grid: DataFrame, col: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward and backward fill of a column as ``ffill`` and ``bfill``."""
    near = nearest_observed(grid, [SERIES], "pos", [col], rows=rows)
    return near.withColumn("ffill", F.col(f"_pv_{col}")).withColumn(
        "bfill", F.col(f"_nv_{col}")
    ).drop(*_helpers([col]))


def infer_frequency(df: DataFrame) -> DataFrame:
    """``D``, ``h`` or null per series.

    Spacing is uniform when timestamps are distinct, agree modulo the step and
    fill the span; that is an aggregate, so no series is sorted in one task.
    """
    us = epoch_micros("ts")
    distinct = df.groupBy(SERIES, us.alias("us")).agg(F.count("*").alias("dup"))
    day, hour = 86400 * 1000000, 3600 * 1000000
    stats = distinct.groupBy(SERIES).agg(
        F.count("*").alias("n"),
        F.max("dup").alias("dup"),
        (F.max("us") - F.min("us")).alias("span"),
        (F.max(F.pmod("us", F.lit(day))) == F.min(F.pmod("us", F.lit(day)))).alias("day_ok"),
        (F.max(F.pmod("us", F.lit(hour))) == F.min(F.pmod("us", F.lit(hour)))).alias("hour_ok"),
    )
    enough = (F.col("n") >= 3) & (F.col("dup") == 1)
    filled = {s: F.col("span") == (F.col("n") - 1) * F.lit(s) for s in (day, hour)}
    return stats.select(
        SERIES,
        F.when(enough & F.col("day_ok") & filled[day], "D")
        .when(enough & F.col("hour_ok") & filled[hour], "h")
        .alias("freq"),
    )


def length_violations(df: DataFrame, freq: Freq, max_lag: int, past_days: int) -> DataFrame:
    """Series too short for the lags, or for the covariate history, one row per rule."""
    stats = bounds(df, freq, F.count("*").alias("n"))
    rules = F.array(
        F.when(
            F.col("n") < max_lag,
            F.struct(F.lit("max_lag").alias("rule"), F.lit(max_lag).alias("needed")),
        ),
        F.when(
            F.col("lo") >= F.col("hi") - past_days * freq.per_day,
            F.struct(F.lit("past_days").alias("rule"), F.lit(past_days).alias("needed")),
        ),
    )
    return (
        stats.select(SERIES, "n", F.explode(F.array_compact(rules)).alias("r"))
        .select(SERIES, "r.rule", "n", "r.needed")
    )


def keep_first(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """One row per key: the one with the smallest ``order``.

    An aggregate with map-side combining, so a key that holds most rows does not
    end in one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def tail_of_history(df: DataFrame, freq: Freq, days: int = 14) -> DataFrame:
    """Rows within ``days`` of the last observed target of their series."""
    stats = df.groupBy(SERIES).agg(
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
        F.max(F.when(F.col("y").isNotNull(), F.col("pos"))).alias("_end"),
    )
    out = attach_series(df, stats)
    near = F.col("pos").between(F.col("_end") - days * freq.per_day, F.col("_end"))
    return out.filter(near).drop("lo", "hi", "_end")


def positional_index(df: DataFrame, freq: Freq, rows: int = BLOCK_ROWS) -> DataFrame:
    """Replace the timestamps of each series by consecutive grid steps from its first."""
    numbered = row_numbers(df.withColumn("pos", freq.pos("ts")), [SERIES], "pos", "rn", rows)
    stats = bounds(df, freq)
    joined = attach_series(numbered, stats, rows)
    return joined.withColumn("ts", freq.at(F.col("lo") + F.col("rn") - 1)).drop(
        "lo", "hi", "rn", "pos"
    )


def rolling_mean(grid: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """Mean of the last ``n`` rows; null until ``n`` values are there."""
    halo = with_halo(grid, "pos", back=n - 1)
    w = block_window([SERIES], "pos").rowsBetween(-(n - 1), 0)
    full = F.count(col).over(w) == n
    return drop_halo(halo.withColumn(name, F.when(full, F.avg(col).over(w))))


def last_rows_per_phase(grid: DataFrame, freq: Freq, n: int) -> DataFrame:
    """The last ``n`` grid weeks of every phase (weekday, or weekday and hour).

    On a regular grid that is a range of positions, not a ranking.
    """
    stats = grid.groupBy(SERIES).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    out = attach_series(grid, stats)
    near = F.col("pos") > F.col("hi") - n * freq.period
    return out.filter(near).withColumn("phase", freq.phase("pos")).drop("lo", "hi")
