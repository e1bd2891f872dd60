"""Projections, filters, cleaning and regularization."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import HORIZONS, QCOLS
from panelcast.functions.calendar import (
    DAILY,
    HOURLY,
    epoch_micros,
    from_seconds,
    part,
    to_local,
)
from panelcast.operators import panel as P
from panelcast.operators.panel import SERIES
from panelcast.operators.submission import clip_negative, skeleton
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import filled_sql, query, r, with_ctes
from panelcast.sources import artifacts, landed


@query(
    "p1_cast",
    """SELECT event_id, value::VARCHAR::DOUBLE AS as_double, value::FLOAT::DOUBLE AS as_float,
       TRY_CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, TRY_CAST(event_type AS INT) AS bad
       FROM events""",
)
def p1(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        F.col("value").cast("string").try_cast("double").alias("as_double"),
        F.col("value").cast("float").cast("double").alias("as_float"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.col("event_type").try_cast("int").alias("bad"),
    )


def _clock(ts="ts"):
    """A quoted hour label, ``'01:00'`` to ``'24:00'``."""
    return F.format_string("'%02d:00'", F.hour(ts) + 1)


@query("p2_wrap_hour", "SELECT event_id, ((hour(ts) + 1) % 24)::INT AS hour FROM events")
def p2(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select("event_id", landed.wrapped_hour(_clock()).alias("hour"))


@query(
    "p3_assemble_timestamp",
    """SELECT event_id,
       date_trunc('day', ts)::TIMESTAMP + to_hours(((hour(ts) + 1) % 24)::INT) AS stamp,
       date_trunc('day', ts)::TIMESTAMP + to_hours((hour(ts) + 1)::INT) AS rolled FROM events""",
)
def p3(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    date, time = F.date_format("ts", "yyyy-MM-dd"), _clock()
    hour = landed.wrapped_hour(time)
    return events.select(
        "event_id",
        landed.assemble_timestamp(date, hour).alias("stamp"),
        landed.assemble_timestamp(date, hour, F.substring(time, 2, 2) == "24").alias("rolled"),
    )


@query(
    "p4_epoch_ms",
    """SELECT event_id, (date_trunc('second', ts)::TIMESTAMP AT TIME ZONE 'UTC')
       AT TIME ZONE 'Europe/Berlin' AS local_ts FROM events""",
)
def p4(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    ms = F.floor(epoch_micros("ts") / 1000)
    return events.select("event_id", landed.epoch_ms_to_local(ms).alias("local_ts"))


@query(
    "p5_localize_dst",
    """WITH o AS (
         SELECT o_orderkey, o_orderpriority AS series_id,
                date_trunc('day', o_orderdate)::TIMESTAMP + to_hours((o_orderkey % 4)::INT) AS ts
         FROM orders),
       c AS (SELECT *,
         ((ts - INTERVAL 2 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' = ts AS summer,
         ((ts - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' = ts AS winter,
         row_number() OVER (PARTITION BY series_id, ts ORDER BY o_orderkey) AS rn FROM o)
       SELECT o_orderkey, series_id, ts,
         CASE WHEN summer AND winter AND rn > 1 THEN ts - INTERVAL 1 HOUR
              WHEN summer THEN ts - INTERVAL 2 HOUR ELSE ts - INTERVAL 1 HOUR END AS ts_utc
       FROM c WHERE summer OR winter""",
)
def p5(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    naive = orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias(SERIES),
        HOURLY.at(DAILY.pos("o_orderdate") * 24 + F.col("o_orderkey") % 4).alias("ts"),
    )
    return landed.localize(naive, "o_orderkey")


@query(
    "p6_convert_zone",
    """SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS local_ts
       FROM events""",
)
def p6(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select("event_id", to_local("ts").alias("local_ts"))


@query(
    "p7_strip_zone",
    """SELECT (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS naive,
       count(*) AS n FROM (SELECT o_orderdate + to_minutes((o_orderkey % 240)::INT) AS ts
                           FROM orders) GROUP BY 1""",
)
def p7(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    # an instant (timestamp with zone), then naive wall time of the zone
    instant = F.timestamp_micros(
        epoch_micros("o_orderdate") + (F.col("o_orderkey") % 240) * 60000000
    )
    utc = from_seconds(F.unix_micros(instant) / 1000000)
    return orders.groupBy(to_local(utc).alias("naive")).agg(F.count("*").alias("n"))


@query(
    "p8_keep_first",
    """SELECT series_id, ts, event_id, value FROM (
         SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, event_id, value,
           row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts)
                              ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
)
def p8(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select(
        F.col("event_type").alias(SERIES), HOURLY.floor("ts").alias("ts"), "event_id", "value"
    )
    return P.keep_first(events, [SERIES, "ts"], "event_id")


@query(
    "p9_outlier_cut",
    with_ctes("SELECT series_id, ts, round(y, 6) AS y FROM dgrid WHERE y <= 200", "dgrid"),
)
def p9(spark, sf_dir):
    return T.daily_grid(spark, sf_dir).filter(F.col("y") <= 200).select(SERIES, "ts", r("y"))


@query(
    "p10_drop_nulls",
    with_ctes(
        """SELECT series_id, ts, round(y, 6) AS y, quantity FROM jgrid
           WHERE y IS NOT NULL AND quantity IS NOT NULL""",
        "jgrid",
    ),
)
def p10(spark, sf_dir):
    return T.joined(spark, sf_dir).dropna("any").select(SERIES, "ts", r("y"), "quantity")


@query(
    "p11_convert_unit",
    with_ctes("SELECT series_id, ts, round(y / 1000, 9) AS y FROM hourly", "hourly"),
)
def p11(spark, sf_dir):
    return T.hourly(spark, sf_dir).withColumn("y", F.round(F.col("y") / 1000, 9))


@query(
    "p12_project_rename",
    "SELECT o_orderkey, o_totalprice AS total FROM orders",
)
def p12(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    kept = orders.drop("o_custkey", "o_orderdate").withColumnRenamed("o_totalprice", "total")
    return kept.select("o_orderkey", "total")


@query(
    "p13_time_slice",
    """SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'""",
)
def p13(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("event_id", "ts")
    return artifacts.time_slice(events, "2024-01-10", "2024-01-20")


@query(
    "p14_year_slice",
    with_ctes("SELECT series_id, ts, round(y, 6) AS y FROM daily WHERE year(ts) = 1998", "daily"),
)
def p14(spark, sf_dir):
    return T.daily(spark, sf_dir, "1998-01-01", "1998-12-31").select(SERIES, "ts", r("y"))


@query(
    "p15_regularize",
    with_ctes(
        """SELECT 'D ' || series_id AS series, ts, round(y, 6) AS y, idx, n_rows FROM dgrid
           UNION ALL
           SELECT 'h ' || series_id, ts, round(y, 6), idx, n_rows FROM hgrid""",
        "dgrid",
        "hgrid",
    ),
)
def p15(spark, sf_dir):
    parts = [("D ", T.daily_grid(spark, sf_dir)), ("h ", T.hourly_grid(spark, sf_dir))]
    named = [
        df.select(F.concat(F.lit(f), SERIES).alias("series"), "ts", r("y"), "idx", "n_rows")
        for f, df in parts
    ]
    return named[0].unionByName(named[1])


@query(
    "p16_interpolate",
    with_ctes(
        """SELECT 'D ' || series_id AS series, ts, round(y, 6) AS y FROM dfill
           UNION ALL SELECT 'h ' || series_id, ts, round(y, 6) FROM hfill""",
        "dfill",
        "hfill",
    ),
)
def p16(spark, sf_dir):
    parts = [("D ", T.daily_filled(spark, sf_dir)), ("h ", T.hourly_filled(spark, sf_dir))]
    named = [
        df.select(F.concat(F.lit(f), SERIES).alias("series"), "ts", r("y")) for f, df in parts
    ]
    return named[0].unionByName(named[1])


def _prefix_sql() -> str:
    masked = ", ".join(
        f"CASE WHEN pos <= t_last THEN {c} END AS {c}" for c in ("y", "quantity", "discount")
    )
    return with_ctes(
        """SELECT j.series_id, j.ts,
             round(CASE WHEN j.pos <= j.t_last THEN f.y ELSE j.y END, 6) AS y,
             round(CASE WHEN j.pos <= j.t_last THEN f.quantity ELSE j.quantity END, 6) AS quantity,
             round(CASE WHEN j.pos <= j.t_last THEN f.discount ELSE j.discount END, 6) AS discount
           FROM jlast j JOIN jfill f USING (series_id, pos)""",
        "jgrid",
        jlast="""SELECT *, max(CASE WHEN y IS NOT NULL THEN pos END)
                 OVER (PARTITION BY series_id) AS t_last FROM jgrid""",
        jmask=f"SELECT series_id, ts, pos, {masked} FROM jlast",
        jfill=filled_sql("jmask", ["y", "quantity", "discount"]),
    )


@query("p17_interpolate_prefix", _prefix_sql())
def p17(spark, sf_dir):
    cols = ["y", "quantity", "discount"]
    filled = P.interpolate_prefix(T.joined(spark, sf_dir), cols)
    return filled.select(SERIES, "ts", *[r(c) for c in cols])


@query(
    "p18_backfill",
    with_ctes(
        """SELECT series_id, ts, round(first_value(v IGNORE NULLS) OVER (
             PARTITION BY series_id ORDER BY ts
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING).y, 6) AS y FROM (
             SELECT g.series_id, g.ts,
               CASE WHEN s.ts IS NOT NULL
                    THEN struct_pack(y := CASE WHEN day(s.ts) % 5 = 0 THEN NULL ELSE s.y END) END AS v
             FROM hgrid g LEFT JOIN hourly s USING (series_id, ts))""",
        "hgrid",
    ),
)
def p18(spark, sf_dir):
    source = T.hourly(spark, sf_dir).withColumn(
        "y", F.when(F.dayofmonth("ts") % 5 != 0, F.col("y"))
    )
    return P.upsample_backfill(source, HOURLY, "y").select(SERIES, "ts", r("y"))


def _frequency_sql() -> str:
    return with_ctes(
        """SELECT series_id, CASE WHEN n >= 3 AND lo = hi THEN
             CASE WHEN lo = 86400000000 THEN 'D' WHEN lo = 3600000000 THEN 'h' END END AS freq
           FROM (SELECT series_id, count(*) AS n, min(d) AS lo, max(d) AS hi FROM (
             SELECT series_id, epoch_us(ts) - lag(epoch_us(ts))
               OVER (PARTITION BY series_id ORDER BY ts) AS d FROM mixed) GROUP BY series_id)""",
        "dgrid",
        "hgrid",
        mixed="""SELECT 'grid ' || series_id AS series_id, ts FROM dgrid
                 UNION ALL SELECT 'days ' || series_id, ts FROM daily
                 UNION ALL SELECT 'hours ' || series_id, ts FROM hgrid
                 UNION ALL SELECT 'events ' || event_type, ts FROM events
                 UNION ALL SELECT 'orders ' || o_orderpriority, o_orderdate FROM orders""",
    )


@query("p19_infer_frequency", _frequency_sql())
def p19(spark, sf_dir):
    def named(prefix, df, series=SERIES, ts="ts"):
        return df.select(F.concat(F.lit(prefix), series).alias(SERIES), F.col(ts).alias("ts"))

    events, orders = (T.table(spark, sf_dir, t) for t in ("events", "orders"))
    mixed = (
        named("grid ", T.daily_grid(spark, sf_dir))
        .union(named("days ", T.daily(spark, sf_dir)))
        .union(named("hours ", T.hourly_grid(spark, sf_dir)))
        .union(named("events ", events, "event_type"))
        .union(named("orders ", orders, "o_orderpriority", "o_orderdate"))
    )
    return P.infer_frequency(mixed)


@query(
    "p20_length_rules",
    with_ctes(
        """SELECT series_id, 'max_lag' AS rule, n, 1720 AS needed FROM l WHERE n < 1720
           UNION ALL
           SELECT series_id, 'past_days', n, 2400 FROM l WHERE lo >= hi - INTERVAL 2400 DAY""",
        "daily",
        l="SELECT series_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM daily GROUP BY 1",
    ),
)
def p20(spark, sf_dir):
    return P.length_violations(T.daily(spark, sf_dir), DAILY, max_lag=1720, past_days=2400)


@query(
    "p21_assign_columns",
    with_ctes(
        """SELECT series_id, ts, year(ts)::INT AS year, month(ts)::INT AS month,
           day(ts)::INT AS day, (isodow(ts) - 1)::INT AS weekday, quarter(ts)::INT AS quarter,
           (isodow(ts) - 1)::INT AS week FROM daily""",
        "daily",
    ),
)
def p21(spark, sf_dir):
    names = {"year": "year", "month": "month", "day": "day", "weekday": "weekday"}
    names |= {"quarter": "quarter", "week": "dayofweek"}
    made = {k: part("ts", v) for k, v in names.items()}
    return T.daily(spark, sf_dir).drop("y").withColumns(made)


@query(
    "p22_date_range_flag",
    """SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1998-03-15' AND TIMESTAMP '1999-05-15'
       AS in_range FROM orders""",
)
def p22(spark, sf_dir):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1998-03-15", "1999-05-15"))
    orders = T.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.col("o_orderdate").between(low, high).alias("in_range"))


@query(
    "p23_member_of_list",
    """SELECT event_id, ts FROM events
       WHERE hour(ts) IN (12, 16, 20) AND isodow(ts) - 1 IN (4, 5)""",
)
def p23(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("event_id", "ts")
    return events.filter(F.hour("ts").isin(12, 16, 20) & F.weekday("ts").isin(4, 5))


@query(
    "p24_clip_negative",
    """SELECT o_orderkey, round(CASE WHEN v < 0 THEN 0 ELSE v END, 6) AS clipped FROM (
       SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice - 250000 END AS v
       FROM orders)""",
)
def p24(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") - 250000)
    return orders.select("o_orderkey", F.round(clip_negative(v), 6).alias("clipped"))


_SKELETON_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{h}' AS horizon" for t, hs in HORIZONS.items() for h in hs
)


@query(
    "p25_null_block",
    f"""WITH sk AS ({_SKELETON_SQL}),
        v AS (SELECT CASE event_type WHEN 'click' THEN 'bikes' ELSE 'energy' END AS target,
                CASE event_type WHEN 'click' THEN isodow(ts)::VARCHAR || ' day'
                     ELSE (hour(ts) + 24)::VARCHAR || ' hour' END AS horizon,
                max(value) AS q50 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
        SELECT sk.target, sk.horizon, v.q50 FROM sk LEFT JOIN v USING (target, horizon)""",
)
def p25(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    click = F.col("event_type") == "click"
    day = F.concat((F.weekday("ts") + 1).cast("string"), F.lit(" day"))
    hour = F.concat((F.hour("ts") + 24).cast("string"), F.lit(" hour"))
    values = events.groupBy(
        F.when(click, "bikes").otherwise("energy").alias("target"),
        F.when(click, day).otherwise(hour).alias("horizon"),
    ).agg(F.max("value").alias(QCOLS[2]))
    return (
        skeleton(spark)
        .drop("row_id")
        .join(values, ["target", "horizon"], "left")
        .select("target", "horizon", "q50")
    )
