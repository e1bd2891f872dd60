"""Forecast submission tables: build and validate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.config import HORIZONS, PLAUSIBLE, QCOLS, SUBMISSION_QCOLS
from panelcast.functions.calendar import epoch_days, epoch_hours

CONTRACT = ("forecast_date", "target", "horizon", *SUBMISSION_QCOLS)
ROW_ID = "row_id"


def horizon_label(ts: str | Column, wednesday: str | Column, daily: bool) -> Column:
    """``"k day"`` after the Wednesday, or ``"k hour"`` after the midnight that ends it."""
    if daily:
        return F.concat((epoch_days(ts) - epoch_days(wednesday)).cast("string"), F.lit(" day"))
    base = (epoch_days(wednesday) + 1) * 24
    return F.concat((epoch_hours(ts) - base).cast("string"), F.lit(" hour"))


def clip_negative(col: Column) -> Column:
    return F.when(col < 0, F.lit(0.0)).otherwise(col)


def skeleton(spark: SparkSession) -> DataFrame:
    """The 18 expected (target, horizon) rows in order."""
    rows = [(t, h) for t, hs in HORIZONS.items() for h in hs]
    return spark.createDataFrame(
        [(i, t, h) for i, (t, h) in enumerate(rows)], f"{ROW_ID} int, target string, horizon string"
    )


def build_submission(forecasts: DataFrame, forecast_date: Column) -> DataFrame:
    """Expected rows with clipped forecasts; a target without forecasts is all null.

    ``forecasts(target, horizon, q025...)``.  A target with some but not all of its
    rows has the wrong shape and raises, and so does a label that is not expected.
    """
    sk = skeleton(forecasts.sparkSession)
    wide = forecasts.select("target", "horizon", *QCOLS, F.lit(1).alias("_hit"))
    joined = sk.join(wide, ["target", "horizon"], "full")
    per_target = joined.groupBy(F.col("target").alias("_target")).agg(
        F.count("*").alias("_rows"), F.count("_hit").alias("_hits")
    )
    bad = (F.col("_hits") != 0) & ((F.col("_hits") != F.col("_rows")) | (F.col("_rows") != 6))
    shape = F.raise_error(F.lit("invalid shape for predictions")).cast("boolean")
    label = F.raise_error(F.lit("unknown target or horizon")).cast("boolean")
    unknown = F.col(ROW_ID).isNull()
    return (
        joined.join(per_target, F.col("target").eqNullSafe(F.col("_target")))
        .filter(F.when(unknown, label).when(bad, shape).otherwise(F.lit(True)))
        .select(
            F.col(ROW_ID).cast("int").alias(ROW_ID),
            forecast_date.alias("forecast_date"),
            "target",
            "horizon",
            *[
                clip_negative(F.col(c)).alias(s)
                for c, s in zip(QCOLS, SUBMISSION_QCOLS, strict=True)
            ],
        )
    )


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def check_submission(df: DataFrame, today: str) -> DataFrame:
    """One row per rule: ``rule_no, rule, severity, violations``.

    ``df`` has the contract columns and ``row_id``, the row order.  When the columns
    are wrong only the column rules are reported, as the rest cannot be checked.
    """
    cols = [c for c in df.columns if c != ROW_ID]
    shape = [
        (1, "column_count", "fail", int(len(cols) != len(CONTRACT))),
        (2, "column_names", "fail", len(set(cols) ^ set(CONTRACT))),
        (3, "column_order", "fail", sum(a != b for a, b in zip(cols, CONTRACT))),
        (
            4,
            "text_columns",
            "fail",
            sum(t != "string" for c, t in df.dtypes if c in ("target", "horizon")),
        ),
    ]
    if any(r[3] for r in shape[:3]):
        return _listed(df.agg(F.count("*").alias("rows")), [(*r[1:3], F.lit(r[3])) for r in shape])

    date = F.try_to_timestamp(F.col("forecast_date").cast("string"), F.lit("yyyy-MM-dd")).cast(
        "date"
    )
    numbers = {s: _q(s).try_cast("double") for s in SUBMISSION_QCOLS}
    has_null = _any([F.col(c).isNull() for c in ("forecast_date", "target", "horizon")]) | _any(
        [n.isNull() for n in numbers.values()]
    )
    values = list(numbers.values())
    decreasing = _any([b < a for a, b in zip(values, values[1:])])
    no_value = _any([n.isNull() for n in values])

    aggs = [
        F.count_if(date.isNull()).alias("bad_date"),
        F.count_distinct(date).alias("dates"),
        F.min_by(date, ROW_ID).alias("first_date"),
        F.count_if(~F.col("target").isin(*HORIZONS)).alias("unknown"),
        F.count_if(has_null).alias("null_rows"),
        F.min_by("target", F.when(has_null, F.col(ROW_ID))).alias("null_target"),
        *[F.count_if(n.isNull()).alias(f"non_numeric_{i}") for i, n in enumerate(values)],
    ]
    for t, horizons in HORIZONS.items():
        mine = F.col("target") == t
        low, high = PLAUSIBLE[t]
        aggs += [
            F.count_if(mine).alias(f"rows_{t}"),
            F.count_if(mine & ~F.col("horizon").isin(*horizons)).alias(f"strange_{t}"),
            F.array(
                *[F.min(F.when(mine & (F.col("horizon") == h), F.col(ROW_ID))) for h in horizons]
            ).alias(f"order_{t}"),
            F.count_if(mine & _any([(n < low) | (n > high) for n in values])).alias(f"odd_{t}"),
            F.count_if(mine & (no_value | decreasing)).alias(f"crossed_{t}"),
        ]
    one = df.agg(*aggs)

    def per_target(make) -> Column:
        return reduce(lambda a, b: a + b, [make(t) for t in HORIZONS])

    def disorder(t: str) -> Column:
        order = F.col(f"order_{t}")
        missing = F.exists(order, lambda x: x.isNull())
        wrong = missing | (order != F.array_sort(order)) | (F.col(f"strange_{t}") > 0)
        return wrong.cast("long")

    rules = [
        ("date_format", "fail", F.col("bad_date")),
        *[
            (f"numeric_{s}", "warn", F.col(f"non_numeric_{i}"))
            for i, s in enumerate(SUBMISSION_QCOLS)
        ],
        ("single_date", "fail", F.greatest(F.col("dates") - 1, F.lit(0))),
        ("date_not_past", "warn", (F.col("first_date") < F.lit(today).cast("date")).cast("long")),
        ("date_is_wednesday", "warn", (F.weekday("first_date") != 2).cast("long")),
        ("known_targets", "fail", F.col("unknown")),
        (
            "rows_per_target",
            "fail",
            per_target(lambda t: F.abs(F.col(f"rows_{t}") - len(HORIZONS[t]))),
        ),
        ("horizon_order", "fail", per_target(disorder)),
        ("plausible_range", "warn", per_target(lambda t: F.col(f"odd_{t}"))),
        ("one_null_target", "fail", F.greatest(F.col("null_rows") - 6, F.lit(0))),
        (
            "quantile_order",
            "fail",
            per_target(
                lambda t: F.when(F.col("null_target").eqNullSafe(t), 0).otherwise(
                    F.col(f"crossed_{t}")
                )
            ),
        ),
    ]
    return _listed(one, [(*r[1:3], F.lit(r[3])) for r in shape] + rules)


def _listed(one: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row of counts to one row per rule."""
    cells = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(name).alias("rule"),
            F.lit(severity).alias("severity"),
            F.coalesce(count.cast("long"), F.lit(0)).alias("violations"),
        )
        for i, (name, severity, count) in enumerate(rules, start=1)
    ]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def verdict(rules: DataFrame) -> DataFrame:
    """Whether every failing rule passes, and the first that does not."""
    failed = (F.col("severity") == "fail") & (F.col("violations") > 0)
    return rules.agg(
        F.coalesce(~F.bool_or(failed), F.lit(True)).alias("ok"),
        F.min_by("rule", F.when(failed, F.col("rule_no"))).alias("first_failure"),
        F.count_if((F.col("severity") == "warn") & (F.col("violations") > 0)).alias("warnings"),
    )
