"""Exact interpolated quantiles.

``sorted_quantile`` works on a short sorted array.  ``Ranked`` is for groups of any size: its
values are laid out in order over all partitions, so no task holds a whole group and no
join is keyed by the group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import stage

PART = "_part"  # number of a value's partition


def sorted_quantile(values: Column, level: float) -> Column:
    """Linear interpolation in a sorted array without nulls; null when it is empty."""
    n = F.size(values)
    rank = (n - 1) * F.lit(float(level))
    low = F.floor(rank).cast("int")
    high = F.ceil(rank).cast("int")
    a, b = F.get(values, low), F.get(values, high)
    return F.when(n > 0, F.when(low == high, a).otherwise((high - rank) * a + (rank - low) * b))


class Ranked:
    """The values of each group in order, by range partitions and counts of them.

    ``values (keys, _v, _n, _part)``: distinct values, how often each occurs, and the range
    partition that holds it; written out, as both its tables read it.  ``parts (keys, _part,
    _in, _before, _total)``: the rows of a group in a partition, before it and in all; a group
    has as many of these as there are partitions that hold it.
    """

    def __init__(self, df: DataFrame, keys: list[str], value: str, partitions: int | None = None):
        self.keys = keys
        spark = df.sparkSession
        counts = (
            df.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # staged first: choosing the borders reads it once more
        ordered = stage(counts, "value-counts").repartitionByRange(wanted, *keys, "_v")
        self.values = stage(ordered.withColumn(PART, F.spark_partition_id()), "ranked")
        inside = self.values.groupBy(*keys, PART).agg(F.sum("_n").alias("_in"))
        group = Window.partitionBy(*keys)
        before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        self.parts = inside.withColumns(
            {"_before": F.coalesce(F.sum("_in").over(before), F.lit(0)), "_total": F.sum("_in").over(group)}
        )

    def quantiles(self, levels: list[float], names: list[str]) -> DataFrame:
        """Interpolated quantiles, one row per group; the partitions that hold a wanted rank
        are the only ones whose values are counted up."""
        ranks = [
            F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(float(q))).alias("rank"))
            for i, q in enumerate(levels)
        ]
        both = F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))
        here = (F.col("_need") >= F.col("_before")) & (F.col("_need") < F.col("_before") + F.col("_in"))
        wanted = (
            self.parts.withColumn("_r", F.explode(F.array(*ranks)))
            .select(*self.keys, PART, "_in", "_before", "_r.i", "_r.rank")
            .withColumn("_need", F.explode(both))
            .filter(here)
        )
        place = [*self.keys, PART]
        hit = wanted.select(*place, "_before").distinct()
        up_to = Window.partitionBy(*place).orderBy("_v")
        counted = (
            self.values.join(hit, place)
            .withColumn("_stop", F.sum("_n").over(up_to) + F.col("_before"))
            .withColumn("_start", F.col("_stop") - F.col("_n"))
            .select(*place, "_v", "_start", "_stop")
        )
        inside = (F.col("_need") >= F.col("_start")) & (F.col("_need") < F.col("_stop"))
        found = wanted.join(counted, place).filter(inside)
        return found.groupBy(*self.keys).agg(*(self._at(i, n) for i, n in enumerate(names)))

    @staticmethod
    def _at(i: int, name: str) -> Column:
        here = F.col("i") == i
        low = F.min(F.when(here & (F.col("_need") == F.floor("rank")), F.col("_v")))
        high = F.max(F.when(here & (F.col("_need") == F.ceil("rank")), F.col("_v")))
        rank = F.max(F.when(here, F.col("rank")))
        # same order of operations as the built-in percentile
        between = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
        return F.when(rank == F.floor(rank), low).otherwise(between).alias(name)

    def beside(self, groups: DataFrame) -> DataFrame:
        """``values`` with the columns of one row per group, joined by group and partition."""
        return self.values.join(
            self.parts.select(*self.keys, PART).join(groups, self.keys), [*self.keys, PART]
        )


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    levels: list[float],
    names: list[str],
    partitions: int | None = None,
) -> DataFrame:
    """Exact quantiles per group of any size, or of all rows without ``keys``."""
    if not keys:
        whole = df.withColumn("_all", F.lit(0))
        return grouped_quantiles(whole, ["_all"], value, levels, names, partitions).drop("_all")
    return Ranked(df, keys, value, partitions).quantiles(levels, names)
