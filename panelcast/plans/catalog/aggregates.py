"""Aggregations and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.functions.calendar import HOURLY
from panelcast.operators import eda, scoring
from panelcast.operators.experiments import mean_importance
from panelcast.operators.panel import SERIES
from panelcast.operators.quantiles import grouped_quantiles
from panelcast.plans import evaluate
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import LEVELS_SQL, q_columns, query, r, with_ctes


@query(
    "a1_quantiles",
    f"""SELECT o_orderpriority AS series_id, o_orderstatus AS status, {q_columns()} FROM (
        SELECT o_orderpriority, o_orderstatus,
               quantile_cont(o_totalprice / 1955.83::DOUBLE, {LEVELS_SQL}) AS q
        FROM orders GROUP BY ALL)""",
)
def a1(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias(SERIES),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice") / 1955.83).alias("v"),
    )
    out = grouped_quantiles(orders, [SERIES, "status"], "v", list(LEVELS), list(QCOLS))
    return out.select(SERIES, "status", *[r(c) for c in QCOLS])


@query(
    "a2_fold_mean_std",
    with_ctes(
        """SELECT series_id, metric, round(mean, 6) AS mean, round(std, 6) AS std
           FROM dmetrics WHERE metric NOT LIKE 'coverage%'""",
        "dmetrics",
    ),
)
def a2(spark, sf_dir):
    metrics = evaluate.evaluate(spark, sf_dir)
    return metrics.filter(~F.col("metric").startswith("coverage")).select(
        SERIES, "metric", r("mean"), r("std")
    )


@query(
    "a3_fold_population",
    with_ctes(
        """SELECT series_id, metric, round(mean, 8) AS mean, round(std, 8) AS std
           FROM dmetrics WHERE metric LIKE 'coverage%'""",
        "dmetrics",
    ),
)
def a3(spark, sf_dir):
    metrics = evaluate.evaluate(spark, sf_dir)
    return metrics.filter(F.col("metric").startswith("coverage")).select(
        SERIES, "metric", r("mean", 8), r("std", 8)
    )


@query(
    "a4_scaled_variance",
    with_ctes(
        "SELECT series_id, "
        + ", ".join(f"round(sqrt(var_pop(hit_{c}) * count(*) / sum(n)), 8) AS std_{c}" for c in QCOLS)
        + " FROM dfold GROUP BY series_id",
        "dfold",
    ),
)
def a4(spark, sf_dir):
    curve = scoring.calibration(evaluate.daily_folds(spark, sf_dir), divisor="samples")
    return curve.groupBy(SERIES).agg(
        *[
            F.round(F.max(F.when(F.col("level") == q, F.col("std"))), 8).alias(f"std_{c}")
            for q, c in zip(LEVELS, QCOLS, strict=True)
        ]
    )


@query(
    "a5_row_sum",
    with_ctes(
        "SELECT series_id, fold, round(pinball_loss, 6) AS pinball_loss FROM dfold", "dfold"
    ),
)
def a5(spark, sf_dir):
    long = scoring.losses_long(evaluate.daily_folds(spark, sf_dir))
    return long.groupBy(SERIES, "fold").agg(F.round(F.sum("loss"), 6).alias("pinball_loss"))


@query(
    "a6_hit_rate",
    with_ctes(
        "SELECT series_id, "
        + ", ".join(f"round(avg(({c} >= y)::INT), 8) AS {c}" for c in QCOLS)
        + " FROM dscored GROUP BY series_id",
        "dscored",
    ),
)
def a6(spark, sf_dir):
    rows = scoring.scored(evaluate.daily_backtest(spark, sf_dir))
    hits = [
        F.round(F.avg((F.col("y") <= F.col(c)).cast("double")), 8).alias(c)
        for c in QCOLS
    ]
    return rows.groupBy(SERIES).agg(*hits)


@query(
    "a7_counts",
    with_ctes(
        """SELECT series_id, count(*) AS n, count(y) AS n_observed,
             count(*) FILTER (WHERE y > 200) AS n_high FROM dgrid GROUP BY series_id
           UNION ALL
           SELECT 'all', count(*), count(y), count(*) FILTER (WHERE y > 200) FROM dgrid""",
        "dgrid",
    ),
)
def a7(spark, sf_dir):
    per_series = (
        T.daily_grid(spark, sf_dir)
        .groupBy(SERIES)
        .agg(
            F.count("*").alias("n"),
            F.count("y").alias("n_observed"),
            F.count_if(F.col("y") > 200).alias("n_high"),
        )
    )
    sums = [F.sum(c).alias(c) for c in ("n", "n_observed", "n_high")]
    return per_series.union(per_series.agg(F.lit("all").alias(SERIES), *sums))


@query(
    "a8_distinct",
    """SELECT event_type AS series_id, count(DISTINCT user_id) AS users,
       count(DISTINCT date_trunc('hour', ts)) AS hours, count(DISTINCT user_id) > 1 AS many
       FROM events GROUP BY 1""",
)
def a8(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias(SERIES)).agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct(HOURLY.pos("ts")).alias("hours"),
        (F.count_distinct("user_id") > 1).alias("many"),
    )


@query(
    "a9_any_all",
    with_ctes(
        """SELECT series_id, bool_or(y > 800) AS any_high, bool_and(y >= 0) AS all_positive,
             bool_or(y IS NULL) AS any_null FROM dgrid GROUP BY series_id""",
        "dgrid",
    ),
)
def a9(spark, sf_dir):
    return (
        T.daily_grid(spark, sf_dir)
        .groupBy(SERIES)
        .agg(
            F.bool_or(F.col("y") > 800).alias("any_high"),
            F.bool_and(F.col("y") >= 0).alias("all_positive"),
            F.bool_or(F.col("y").isNull()).alias("any_null"),
        )
    )


@query(
    "a10_describe",
    with_ctes(
        """SELECT series_id, count(y) AS count, round(avg(y), 6) AS mean,
             round(stddev_samp(y), 6) AS std, round(min(y), 6) AS min,
             round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.5), 6) AS q50,
             round(quantile_cont(y, 0.75), 6) AS q75, round(max(y), 6) AS max
           FROM dgrid GROUP BY series_id""",
        "dgrid",
    ),
)
def a10(spark, sf_dir):
    out = eda.describe(T.daily_grid(spark, sf_dir), [SERIES])
    return out.select(
        SERIES, "count", *[r(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


def _box_sql(keys: str, source: str, value: str) -> str:
    return f"""SELECT {keys}, round(q[1], 6) AS q25, round(q[2], 6) AS q50,
          round(q[3], 6) AS q75, count(*) AS n,
          round(min({value}) FILTER (WHERE {value} >= q[1] - 1.5::DOUBLE * (q[3] - q[1])), 6)
            AS whisker_low,
          round(max({value}) FILTER (WHERE {value} <= q[3] + 1.5::DOUBLE * (q[3] - q[1])), 6)
            AS whisker_high,
          count(*) FILTER (WHERE {value} < q[1] - 1.5::DOUBLE * (q[3] - q[1])
                           OR {value} > q[3] + 1.5::DOUBLE * (q[3] - q[1])) AS outliers
        FROM {source} JOIN (SELECT {keys}, quantile_cont({value}, [0.25, 0.5, 0.75]) AS q
                            FROM {source} GROUP BY ALL) USING ({keys})
        WHERE {value} IS NOT NULL GROUP BY {keys}, q"""


def _box(df, keys):
    out = eda.five_numbers(df, keys)
    cols = [r(c) for c in ("q25", "q50", "q75", "whisker_low", "whisker_high")]
    return out.select(*keys, *cols, "n", "outliers")


@query(
    "a11_boxplot_by_month",
    with_ctes(
        _box_sql("series_id, month", "c", "y"),
        "daily",
        c="SELECT series_id, month(ts)::INT AS month, y FROM daily",
    ),
)
def a11_month(spark, sf_dir):
    panel = T.daily(spark, sf_dir).withColumn("month", F.month("ts"))
    return _box(panel, [SERIES, "month"])


@query(
    "a11_boxplot_by_hour",
    """WITH c AS (SELECT hour(ts)::INT AS hour, value / 1.95583::DOUBLE AS y FROM events) """
    + _box_sql("hour", "c", "y"),
)
def a11_hour(spark, sf_dir):
    """Over raw events: groups grow with the data."""
    events = T.table(spark, sf_dir, "events").select(
        F.hour("ts").alias("hour"), (F.col("value") / 1.95583).alias("y")
    )
    return _box(events, ["hour"])


@query(
    "a11_boxplot_two_keys",
    with_ctes(
        _box_sql("weekday, in_range", "c", "y"),
        "daily",
        c="""SELECT (isodow(ts) - 1)::INT AS weekday, ts BETWEEN TIMESTAMP '1998-03-15'
             AND TIMESTAMP '1999-05-15' AS in_range, y FROM daily""",
    ),
)
def a11_two(spark, sf_dir):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1998-03-15", "1999-05-15"))
    panel = T.daily(spark, sf_dir).withColumns(
        {"weekday": F.weekday("ts"), "in_range": F.col("ts").between(low, high)}
    )
    return _box(panel, ["weekday", "in_range"])


@query(
    "a12_arg_extremes",
    with_ctes(
        """SELECT series_id, arg_min(fold, [pinball_loss, fold]) AS argmin,
             arg_min(fold, [abs(interval_score_50 - 300), fold]) AS closest
           FROM dfold GROUP BY series_id""",
        "dfold",
    ),
)
def a12(spark, sf_dir):
    folds = evaluate.daily_folds(spark, sf_dir)
    low = eda.extremes(folds, [SERIES], "fold", "pinball_loss", 0.0).select(SERIES, "argmin")
    near = eda.extremes(folds, [SERIES], "fold", "interval_score_50", 300.0)
    return low.join(near.select(SERIES, "closest"), SERIES)


@query(
    "a13_mean_importance",
    with_ctes(
        "SELECT series_id, feature, round(avg(importance), 6) AS importance FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, (isodow(ts) - 1)::VARCHAR AS feature, avg(abs(y - {c})) AS importance "
            "FROM dscored GROUP BY ALL"
            for c in QCOLS
        )
        + ") GROUP BY series_id, feature",
        "dscored",
    ),
)
def a13(spark, sf_dir):
    """Mean absolute error by weekday and level, averaged over levels."""
    rows = scoring.scored(evaluate.daily_backtest(spark, sf_dir))
    wide = rows.groupBy(SERIES, F.weekday("ts").cast("string").alias("feature")).agg(
        *[F.avg(F.abs(F.col("y") - F.col(c))).alias(c) for c in QCOLS]
    )
    long = wide.unpivot([SERIES, "feature"], list(QCOLS), "quantile", "importance")
    return mean_importance(long, [SERIES]).select(SERIES, "feature", r("importance"))


