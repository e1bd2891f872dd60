"""Splitting long series over many tasks.

A window over ``partitionBy(series)`` puts a whole series into one task.  Here a
series is cut into blocks of grid positions instead; rows near a border are also
sent to the neighbour that looks back (or ahead) at them, so a bounded window
gives the same result as over the whole series, whatever one series holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK_ROWS = 4096
BLOCK, HOME = "_block", "_home"


def block_rows(back: int, ahead: int = 0, minimum: int = BLOCK_ROWS) -> int:
    """Block length that keeps the repeated rows below the block's own rows."""
    return max(minimum, back + ahead, 1)


def block_of(pos: str | Column, rows: int = BLOCK_ROWS) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(rows))


def with_halo(
    df: DataFrame, pos: str, back: int = 0, ahead: int = 0, rows: int | None = None
) -> DataFrame:
    """Send every row to its own block and to the blocks whose windows reach it.

    ``back`` and ``ahead`` are how far a window looks, in grid positions.
    """
    rows = rows or block_rows(back, ahead)
    p = F.col(pos)
    first, last = block_of(p - ahead, rows), block_of(p + back, rows)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
        HOME, F.col(BLOCK) == block_of(p, rows)
    )


def block_window(keys: list[str], pos: str, *extra: str | Column) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK, *extra).orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col(HOME)).drop(BLOCK, HOME)


def nearest_observed(
    df: DataFrame,
    keys: list[str],
    pos: str,
    cols: list[str],
    observed: dict[str, Column] | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Nearest observed value at or before, and at or after, every row.

    Adds ``_pp_c, _pv_c, _np_c, _nv_c`` (position and value) for each column
    ``c``.  ``observed[c]`` says which rows count (default: not null).  Unbounded
    reach is carried over block borders by one summary row per block.
    """
    observed = observed or {}
    df = df.withColumn(BLOCK, block_of(pos, rows))
    seen = {c: observed.get(c, F.col(c).isNotNull()) for c in cols}
    at = {c: F.when(seen[c], F.col(pos)) for c in cols}

    aggs: list[Column] = []
    for c in cols:
        aggs += [
            F.max(at[c]).alias(f"_lp_{c}"),
            F.max_by(F.col(c), at[c]).alias(f"_lv_{c}"),
            F.min(at[c]).alias(f"_fp_{c}"),
            F.min_by(F.col(c), at[c]).alias(f"_fv_{c}"),
        ]
    summary = df.groupBy(*keys, BLOCK).agg(*aggs)

    def carried(stem: str, c: str, order: Column) -> Column:
        w = (
            Window.partitionBy(*keys)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        here = F.col(f"_{stem}p_{c}").isNotNull()
        pair = F.when(here, F.struct(f"_{stem}p_{c}", f"_{stem}v_{c}"))
        return F.last(pair, ignorenulls=True).over(w)

    carry = summary.select(
        *keys,
        BLOCK,
        *[carried("l", c, F.col(BLOCK).asc()).alias(f"_cl_{c}") for c in cols],
        *[carried("f", c, F.col(BLOCK).desc()).alias(f"_cf_{c}") for c in cols],
    )

    def local(c: str, order: Column) -> Column:
        w = (
            Window.partitionBy(*keys, BLOCK)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return F.last(F.when(seen[c], F.struct(pos, c)), ignorenulls=True).over(w)

    out = df.join(carry, [*keys, BLOCK])
    out = out.withColumns({f"_bl_{c}": local(c, F.col(pos).asc()) for c in cols})
    out = out.withColumns({f"_bf_{c}": local(c, F.col(pos).desc()) for c in cols})
    result: dict[str, Column] = {}
    for c in cols:
        for short, block_side, carry_side, stem in (
            ("p", f"_bl_{c}", f"_cl_{c}", "l"),
            ("n", f"_bf_{c}", f"_cf_{c}", "f"),
        ):
            here = F.col(block_side).isNotNull()
            result[f"_{short}p_{c}"] = F.when(here, F.col(block_side)[pos]).otherwise(
                F.col(carry_side)[f"_{stem}p_{c}"]
            )
            result[f"_{short}v_{c}"] = F.when(here, F.col(block_side)[c]).otherwise(
                F.col(carry_side)[f"_{stem}v_{c}"]
            )
    helpers = [f"_{s}_{c}" for c in cols for s in ("bl", "bf", "cl", "cf")]
    return out.withColumns(result).drop(BLOCK, *helpers)


def row_numbers(
    df: DataFrame, keys: list[str], pos: str, name: str = "rn", rows: int = BLOCK_ROWS
) -> DataFrame:
    """``row_number`` in order of a unique position, counted block by block."""
    df = df.withColumn(BLOCK, block_of(pos, rows))
    before = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*keys, BLOCK)
        .agg(F.count("*").alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        df.join(offsets, [*keys, BLOCK])
        .withColumn(name, F.row_number().over(block_window(keys, pos)) + F.col("_offset"))
        .drop(BLOCK, "_offset")
    )
