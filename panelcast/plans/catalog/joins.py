"""Joins of targets, covariates, folds and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.calendar import DAILY, HOURLY, is_holiday
from panelcast.operators import joins as J
from panelcast.operators import panel as P
from panelcast.operators.experiments import feature_grid
from panelcast.operators.panel import SERIES
from panelcast.plans import evaluate
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import query, r, with_ctes
from panelcast.session import stage


@query(
    "j1_right_join",
    with_ctes(
        """SELECT c.series_id, c.ts, round(d.y, 6) AS y, c.quantity, round(c.discount, 6) AS discount
           FROM daily d RIGHT JOIN cov c ON d.series_id = c.series_id AND d.ts = c.ts""",
        "daily",
        "cov",
    ),
)
def j1(spark, sf_dir):
    both = J.join_covariates(T.daily(spark, sf_dir), T.covariates(spark, sf_dir))
    return both.select(SERIES, "ts", r("y"), "quantity", r("discount"))


@query(
    "j2_concat_columns",
    with_ctes(
        """SELECT coalesce(d.series_id, c.series_id) AS series_id, coalesce(d.ts, c.ts) AS ts,
           round(d.y, 6) AS y, c.quantity
           FROM daily d FULL JOIN cov c ON d.series_id = c.series_id AND d.ts = c.ts""",
        "daily",
        "cov",
    ),
)
def j2(spark, sf_dir):
    both = J.align(T.daily(spark, sf_dir), T.covariates(spark, sf_dir), [SERIES, "ts"])
    return both.select(SERIES, "ts", r("y"), "quantity")


# Easter Sundays of the data's years, written out so that the check does not repeat
# the computus.
_EASTER = {
    1995: "04-16",
    1996: "04-07",
    1997: "03-30",
    1998: "04-12",
    1999: "04-04",
    2000: "04-23",
    2001: "04-15",
    2024: "03-31",
}
_EASTER_SQL = ", ".join(f"(DATE '{y}-{md}')" for y, md in _EASTER.items())


@query(
    "j3_holiday",
    f"""WITH easter(d) AS (VALUES {_EASTER_SQL}),
        moving AS (SELECT (d + o)::DATE AS day FROM easter,
                   (VALUES (-2), (1), (39), (50), (60)) AS k(o))
        SELECT day, strftime(day, '%m-%d') IN
                 ('01-01','01-06','05-01','10-03','11-01','12-25','12-26')
               OR day IN (SELECT day FROM moving) AS is_holiday, n FROM (
          SELECT ts::DATE::TIMESTAMP AS day, count(*) AS n FROM (
            SELECT o_orderdate AS ts FROM orders UNION ALL SELECT ts FROM events) GROUP BY 1)""",
)
def j3(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"))
    events = T.table(spark, sf_dir, "events").select("ts")
    days = orders.union(events).groupBy(DAILY.pos("ts").alias("pos")).agg(F.count("*").alias("n"))
    return days.select(
        DAILY.at("pos").alias("day"), is_holiday(DAILY.at("pos")).alias("is_holiday"), "n"
    )


@query(
    "j4_stitch_feeds",
    """WITH f AS (SELECT l_linestatus AS series_id, l_returnflag, l_shipdate AS ts,
                  sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL),
       hist AS (SELECT series_id, ts, 'H' AS l_returnflag, sum(quantity) AS quantity
                FROM f WHERE l_returnflag <> 'N' GROUP BY 1, 2),
       fc AS (SELECT f.* FROM f JOIN (SELECT series_id, max(ts) AS hi FROM hist GROUP BY 1) h
              ON h.series_id = f.series_id AND f.ts >= hi - INTERVAL 90 DAY
              WHERE l_returnflag = 'N')
       SELECT series_id, ts, l_returnflag AS feed, quantity FROM hist h
       WHERE coalesce(ts < (SELECT min(ts) FROM fc WHERE fc.series_id = h.series_id), true)
       UNION ALL SELECT series_id, ts, l_returnflag, quantity FROM fc""",
)
def j4(spark, sf_dir):
    """Settled lines up to the first open line of the last 90 days, then the open ones."""
    open_line = F.when(F.col("l_returnflag") == "N", "N").otherwise("H")
    feeds = (
        T.table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_linestatus").alias(SERIES),
            F.col("l_shipdate").alias("ts"),
            open_line.alias("feed"),
        )
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    feeds = stage(feeds, "feeds")
    history = feeds.filter("feed = 'H'")
    late = history.groupBy(SERIES).agg(F.max("ts").alias("_hi"))
    forecast = (
        feeds.filter("feed = 'N'")
        .join(F.broadcast(late), SERIES)  # one row per line status
        .filter(F.col("ts") >= F.col("_hi") - F.expr("interval 90 days"))
        .drop("_hi")
    )
    return J.stitch(history, forecast, DAILY)


@query(
    "j5_positional_index",
    with_ctes(
        """SELECT series_id, min(ts) OVER (PARTITION BY series_id)
             + to_days((row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1)::INT) AS ts,
           round(y, 6) AS y FROM daily""",
        "daily",
    ),
)
def j5(spark, sf_dir):
    return P.positional_index(T.daily(spark, sf_dir), DAILY).select(SERIES, "ts", r("y"))


@query(
    "j6_phase_lookup",
    with_ctes(
        """SELECT series_id, cutoff, ts, round(y, 6) AS y FROM (
             SELECT d.series_id, c.cutoff, d.ts, d.y,
               row_number() OVER (PARTITION BY d.series_id, c.cutoff ORDER BY d.ts DESC) AS rn
             FROM dgrid d JOIN (SELECT series_id, ts AS cutoff FROM dgrid
                                WHERE ts = last_day(ts)) c
               ON c.series_id = d.series_id AND d.ts <= c.cutoff
              AND isodow(d.ts) = isodow(c.cutoff)) WHERE rn <= 5""",
        "dgrid",
    ),
)
def j6(spark, sf_dir):
    """The last five rows of the cutoff's weekday, at month ends: an equi-join on the
    positions a cutoff looks at."""
    grid = T.daily_grid(spark, sf_dir)
    month_end = F.to_date("ts") == F.last_day("ts")
    cutoffs = grid.filter(month_end).select(
        SERIES,
        F.col("ts").alias("cutoff"),
        F.explode(F.sequence(F.col("pos") - 28, F.col("pos"), F.lit(7).cast("long"))).alias("pos"),
    )
    return cutoffs.join(grid.select(SERIES, "pos", "ts", "y"), [SERIES, "pos"]).select(
        SERIES, "cutoff", "ts", r("y")
    )


@query(
    "j7_align_forecasts",
    with_ctes(
        """SELECT p.series_id, p.fold, p.ts, round(d.y, 6) AS y, round(p.q[3], 6) AS q50
           FROM dpred p JOIN daily d ON d.series_id = p.series_id AND d.ts = p.ts""",
        "dpred",
    ),
)
def j7(spark, sf_dir):
    forecasts = evaluate.daily_backtest(spark, sf_dir).select(SERIES, "fold", "ts", "q50")
    return forecasts.join(T.daily(spark, sf_dir), [SERIES, "ts"]).select(
        SERIES, "fold", "ts", r("y"), r("q50")
    )


@query(
    "j8_upsert",
    with_ctes(
        """SELECT coalesce(g.series_id, p.series_id) AS series_id, coalesce(g.ts, p.ts) AS ts,
             round(coalesce(p.v, g.y), 6) AS y
           FROM hgrid g FULL JOIN (
             SELECT series_id, ts + INTERVAL 1 DAY AS ts, y AS v FROM hourly) p ON g.series_id = p.series_id AND g.ts = p.ts""",
        "hgrid",
    ),
)
def j8(spark, sf_dir):
    grid = T.hourly_grid(spark, sf_dir).select(SERIES, "ts", "y")
    values = T.hourly(spark, sf_dir).select(
        SERIES, HOURLY.at(HOURLY.pos("ts") + 24).alias("ts"), F.col("y").alias("value")
    )
    return J.upsert(grid, values, [SERIES, "ts"]).select(SERIES, "ts", r("y"))


@query(
    "j9_parameter_grid",
    with_ctes(
        """SELECT series_id, rows, s.v AS include_seasonal_dummies, c.v AS cyclical_encodings,
             l.v AS lag_covariates, w.v AS include_rolling_stats
           FROM (SELECT series_id, count(*) AS rows FROM daily GROUP BY 1),
             (VALUES (true), (false)) s(v), (VALUES (true), (false)) c(v),
             (VALUES (true), (false)) l(v), (VALUES (true), (false)) w(v)
           WHERE s.v OR NOT c.v""",
        "daily",
    ),
)
def j9(spark, sf_dir):
    runs = T.daily(spark, sf_dir).groupBy(SERIES).agg(F.count("*").alias("rows"))
    return feature_grid(runs)
