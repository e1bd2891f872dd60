"""Scans, sources and sinks: land the tables as payload files, read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.functions.calendar import DAILY
from panelcast.operators.panel import SERIES, regularize
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import LEVELS_SQL, q_columns, query, r, with_ctes
from panelcast.session import scratch_dir
from panelcast.sources import artifacts, landed, landing
from panelcast.sources.feed_source import read_weekly_feed


@query(
    "s1_delimited_scan",
    with_ctes(
        """SELECT series_id, strftime(ts, '%Y-%m-%d') AS date,
           '''' || lpad((hour(ts) + 1)::VARCHAR, 2, '0') || ':00''' AS time, round(y, 6) AS value
           FROM hgrid""",
        "hgrid",
    ),
)
def s1(spark, sf_dir):
    path = scratch_dir(spark, "delimited")
    landing.land_delimited(T.hourly_grid(spark, sf_dir), path)
    raw = landed.drop_footer(landed.read_delimited(spark, path))
    value = F.col("Measure value").try_cast("double")
    return raw.select(
        SERIES,
        F.col("Date").alias("date"),
        F.col("Time").alias("time"),
        F.round(value, 6).alias("value"),
    )


@query(
    "s2_footer_drop",
    with_ctes(
        """SELECT count(*) + 1 AS n_raw, count(*) AS n_kept, count(y) AS n_values FROM hgrid""",
        "hgrid",
    ),
)
def s2(spark, sf_dir):
    path = scratch_dir(spark, "delimited")
    landing.land_delimited(T.hourly_grid(spark, sf_dir), path)
    raw = landed.read_delimited(spark, path)
    kept = landed.parse_date(F.col("Date")).isNotNull()
    return raw.agg(
        F.count("*").alias("n_raw"),
        F.count_if(kept).alias("n_kept"),
        F.count(F.when(kept, F.col("Measure value"))).alias("n_values"),
    )


@query(
    "s3_json_pairs",
    with_ctes("SELECT series_id, ts, round(y, 6) AS y FROM daily", "daily"),
)
def s3(spark, sf_dir):
    path = scratch_dir(spark, "pairs")
    landing.land_pairs(T.daily(spark, sf_dir), path)
    return landed.parse_pairs(landed.read_json_lines(spark, path)).select(
        F.col(SERIES).cast("string").alias(SERIES), "ts", r("y")
    )


@query(
    "s4_json_feed",
    with_ctes(
        "SELECT series_id, epoch_ms(ts) AS epoch_ms, round(y, 6) AS y FROM hgrid", "hgrid"
    ),
)
def s4(spark, sf_dir):
    path, index = scratch_dir(spark, "feed"), scratch_dir(spark, "index")
    landing.land_feed(T.hourly_grid(spark, sf_dir), path, index)
    return landed.read_feed(spark, path, index).select(SERIES, "epoch_ms", r("y"))


@query(
    "s4_feed_source",
    with_ctes(
        """SELECT series_id, epoch_ms(ts) AS epoch_ms, round(y, 6) AS y FROM hgrid
           WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 06:00:00'""",
        "hgrid",
    ),
)
def s4_source(spark, sf_dir):
    """Ten days of the feed through the data source, which opens the weeks they touch."""
    path, index = scratch_dir(spark, "feed"), scratch_dir(spark, "index")
    landing.land_feed(T.hourly_grid(spark, sf_dir), path, index)
    rows = read_weekly_feed(spark, path, index, start_ms=1704844800000, end_ms=1705730400000)
    return rows.select(SERIES, "epoch_ms", r("y"))


@query(
    "s5_shard_skip",
    with_ctes(
        """SELECT series_id, ts, round(y, 6) AS y FROM daily
           WHERE date_trunc('week', ts) IN (
               SELECT wk FROM (SELECT DISTINCT date_trunc('week', ts) AS wk FROM daily)
               ORDER BY wk OFFSET 104)""",
        "daily",
    ),
)
def s5(spark, sf_dir):
    path, index = scratch_dir(spark, "feed"), scratch_dir(spark, "index")
    landing.land_feed(T.daily(spark, sf_dir), path, index)
    feed = landed.read_feed(spark, path, index, skip_years=2)
    return feed.select(SERIES, DAILY.at(F.col("epoch_ms") / 86400000).alias("ts"), r("y"))


@query(
    "s6_unpack_arrays",
    with_ctes(
        """SELECT g.series_id, g.ts, coalesce(c.quantity, 0) AS quantity,
           round(coalesce(c.discount, 0), 6) AS discount FROM (
               SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
               FROM cov GROUP BY series_id) g LEFT JOIN cov c USING (series_id, ts)""",
        "cov",
    ),
)
def s6(spark, sf_dir):
    path = scratch_dir(spark, "packed")
    grid = regularize(T.covariates(spark, sf_dir), DAILY, ["quantity", "discount"]).fillna(0.0)
    landing.land_packed(grid, ["quantity", "discount"], path)
    schema = (
        "series_id string, start long, end long, interval_seconds long, "
        "quantity array<double>, discount array<double>"
    )
    packed = spark.read.schema(schema).json(path)
    return landed.unpack_arrays(packed, ["quantity", "discount"]).select(
        SERIES, "ts", "quantity", r("discount")
    )


@query(
    "s7_parquet_scan",
    """SELECT o_orderkey, o_orderdate AS ts, o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'""",
)
def s7(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "ts")
    return artifacts.time_slice(orders, "1997-01-01", "1997-03-31").select(
        "o_orderkey", "ts", "o_totalprice"
    )


@query(
    "s8_parquet_sink",
    with_ctes("SELECT series_id, ts, round(y, 6) AS y FROM daily", "daily"),
)
def s8(spark, sf_dir):
    root = scratch_dir(spark, "stage")
    artifacts.write_panel(T.daily(spark, sf_dir), root)
    return artifacts.read_panel(spark, root).select(
        F.col(SERIES).cast("string").alias(SERIES), "ts", r("y")
    )


@query(
    "s9_csv_sink",
    with_ctes(
        """SELECT series_id, year(ts) AS year, count(*) AS n, round(sum(y), 4) AS total
           FROM daily GROUP BY ALL""",
        "daily",
    ),
)
def s9(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    yearly = (
        T.daily(spark, sf_dir)
        .groupBy(SERIES, F.year("ts").alias("year"))
        .agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))
    )
    artifacts.write_csv(yearly, path)
    return artifacts.read_csv(spark, path, "series_id string, year int, n long, total double")


@query(
    "s10_json_metrics",
    with_ctes(
        """SELECT series_id, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM (
           SELECT series_id, 'level' AS metric, avg(y) AS mean, stddev_samp(y) AS std
           FROM daily GROUP BY 1
           UNION ALL
           SELECT series_id, 'active_day' AS metric, avg((y IS NOT NULL)::INT::DOUBLE),
                  stddev_pop((y IS NOT NULL)::INT::DOUBLE) FROM dgrid GROUP BY 1)""",
        "dgrid",
    ),
)
def s10(spark, sf_dir):
    grid = T.daily_grid(spark, sf_dir)
    active = F.col("y").isNotNull().cast("double")
    wide = grid.groupBy(SERIES).agg(
        F.avg("y").alias("m1"),
        F.stddev_samp("y").alias("s1"),
        F.avg(active).alias("m2"),
        F.stddev_pop(active).alias("s2"),
    )
    metrics = wide.select(
        SERIES, F.expr("stack(2, 'level', m1, s1, 'active_day', m2, s2) as (metric, mean, std)")
    )
    path = scratch_dir(spark, "metrics")
    artifacts.write_metrics(metrics, [SERIES], path)
    parsed = F.from_json("value", "map<string, struct<mean: double, std: double>>")
    return (
        artifacts.read_metrics(spark, path, [SERIES])
        .select(SERIES, F.explode(parsed).alias("metric", "v"))
        .select(
            SERIES,
            "metric",
            F.round("v.mean", 6).alias("mean"),
            F.round("v.std", 6).alias("std"),
        )
    )


@query(
    "s11_model_save_load",
    with_ctes(
        f"""SELECT series_id, phase, {q_columns()} FROM (
            SELECT series_id, (pos % 7)::BIGINT AS phase, quantile_cont(y, {LEVELS_SQL}) AS q
            FROM (SELECT *, max(pos) OVER (PARTITION BY series_id) AS hi FROM dgrid)
            WHERE pos > hi - 700 GROUP BY ALL)""",
        "dgrid",
    ),
)
def s11(spark, sf_dir):
    root = scratch_dir(spark, "model")
    grid = T.daily_grid(spark, sf_dir)
    levels = F.array(*[F.lit(q) for q in LEVELS])
    model = (
        grid.filter(F.col("pos") > F.col("hi") - 700)
        .groupBy(SERIES, DAILY.phase("pos").alias("phase"))
        .agg(F.percentile("y", levels).alias("q"))
        .select(
            SERIES,
            "phase",
            *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(QCOLS)],
        )
    )
    artifacts.write_model(model, root)
    return artifacts.read_model(spark, root)


@query(
    "s12_partition_prune",
    with_ctes(
        """SELECT series_id, ts, round(y, 6) AS y FROM daily
           WHERE series_id = '5-LOW' AND ts >= TIMESTAMP '1999-01-01'""",
        "daily",
    ),
)
def s12(spark, sf_dir):
    root = scratch_dir(spark, "stage")
    artifacts.write_panel(T.daily(spark, sf_dir), root)
    return artifacts.read_panel(spark, root, target="5-LOW", start="1999-01-01").select(
        F.col(SERIES).cast("string").alias(SERIES), "ts", r("y")
    )

