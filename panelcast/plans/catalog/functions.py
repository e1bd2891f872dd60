"""Scalar functions over the fact tables, and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import DISPLAY_NAMES, LEVELS, QCOLS
from panelcast.functions import calendar as C
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.operators import scoring
from panelcast.operators.experiments import mean_std_text
from panelcast.operators.features import one_hot
from panelcast.operators.panel import SERIES
from panelcast.plans import evaluate
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import query, r, with_ctes
from panelcast.sources.landed import parse_date


@query(
    "f1_calendar_parts",
    """SELECT event_id, (isodow(ts) - 1)::INT AS dayofweek, month(ts)::INT AS month,
       hour(ts)::INT AS hour FROM events""",
)
def f1(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select(
        "event_id", *[C.part("ts", p).alias(p) for p in ("dayofweek", "month", "hour")]
    )


@query(
    "f2_more_parts",
    """SELECT o_orderkey, year(o_orderdate)::INT AS year, day(o_orderdate)::INT AS day,
       quarter(o_orderdate)::INT AS quarter FROM orders""",
)
def f2(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", *[C.part("o_orderdate", p).alias(p) for p in ("year", "day", "quarter")]
    )


def _pair(expr: str, period: int, name: str) -> str:
    return (
        f"round(sin(2 * pi() * {expr} / {period}), 9) AS {name}_sin, "
        f"round(cos(2 * pi() * {expr} / {period}), 9) AS {name}_cos"
    )


@query(
    "f3_cyclical_encoding",
    with_ctes(
        f"""SELECT series_id, ts, {_pair('(isodow(ts) - 1)', 7, 'dayofweek')},
            {_pair('month(ts)', 12, 'month')}, {_pair('hour(ts)', 24, 'hour')},
            (isodow(ts) > 5)::INT AS is_weekend FROM hourly""",
        "hourly",
    ),
)
def f3(spark, sf_dir):
    cols = C.seasonal_columns("ts", HOURLY)
    out = T.hourly(spark, sf_dir).withColumns(cols)
    pairs = [r(c, 9) for c in cols if c != "is_weekend"]
    return out.select(SERIES, "ts", *pairs, "is_weekend")


_ONE_HOT = ", ".join(
    [f"(isodow(ts) = {d + 1})::INT AS dayofweek_{d}" for d in range(1, 7)]
    + [f"(month(ts) = {m})::INT AS month_{m}" for m in range(2, 13)]
)


@query(
    "f4_category_codes",
    with_ctes(
        f"""SELECT series_id, ts, (isodow(ts) - 1)::INT AS dayofweek, month(ts)::INT AS month,
            {_ONE_HOT} FROM daily""",
        "daily",
    ),
)
def f4(spark, sf_dir):
    codes = C.seasonal_columns("ts", DAILY, cyclical=False, weekend=False)
    out = T.daily(spark, sf_dir).drop("y").withColumns(codes)
    return out.withColumns(one_hot(DAILY))


@query(
    "f5_is_weekend",
    "SELECT event_id, (isodow(ts) - 1 > 4)::INT AS is_weekend FROM events",
)
def f5(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select("event_id", C.is_weekend("ts").alias("is_weekend"))


@query(
    "f6_cyclic_encoder",
    with_ctes(
        f"""SELECT series_id, ts, {_pair('day(ts)', 31, 'day')}, {_pair('month(ts)', 12, 'month')},
            {_pair('(isodow(ts) - 1)', 7, 'dayofweek')}, {_pair('quarter(ts)', 4, 'quarter')}
            FROM daily""",
        "daily",
    ),
)
def f6(spark, sf_dir):
    parts = [(p, C.PERIODS[p]) for p in ("day", "month", "dayofweek", "quarter")]
    cols = C.cyclic_encoder("ts", parts)
    return (
        T.daily(spark, sf_dir)
        .withColumns(cols)
        .select(SERIES, "ts", *[r(c, 9) for c in cols])
    )


@query(
    "f7_hours_until_midnight",
    """SELECT o_orderkey, floor(date_diff('second', ts, date_trunc('day', ts) + INTERVAL 1 DAY)
         / 3600)::INT AS naive,
       floor(date_diff('second', ts, ((l::DATE + 1)::TIMESTAMP AT TIME ZONE 'Europe/Berlin')
         AT TIME ZONE 'UTC') / 3600)::INT AS berlin
       FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS l FROM (
         SELECT o_orderkey, o_orderdate + to_minutes((o_orderkey % 1440)::INT) AS ts FROM orders))""",
)
def f7(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    stamp = C.from_seconds(
        C.epoch_seconds("o_orderdate") + (F.col("o_orderkey") % 1440) * 60
    )
    return orders.select("o_orderkey", stamp.alias("ts")).select(
        "o_orderkey",
        C.hours_until_midnight("ts").alias("naive"),
        C.hours_until_midnight("ts", "Europe/Berlin").alias("berlin"),
    )


@query(
    "f8_next_wednesday",
    """SELECT event_id, date_trunc('hour', ts)::TIMESTAMP
       + to_days(((9 - (isodow(ts) - 1)) % 7)::INT) AS wednesday FROM events""",
)
def f8(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select("event_id", C.next_wednesday("ts").alias("wednesday"))


@query(
    "f9_forecast_hours",
    """SELECT start, ts FROM (SELECT start, unnest(generate_series(start, start + INTERVAL 5 DAY,
         INTERVAL 1 HOUR)) AS ts FROM (
           SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS start FROM events))
       WHERE hour(ts) IN (12, 16, 20) AND isodow(ts) IN (5, 6)""",
)
def f9(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    starts = events.select(HOURLY.floor("ts").alias("start")).distinct()
    return starts.select("start", F.explode(C.forecast_hours("start")).alias("ts"))


@query(
    "f10_date_range",
    """SELECT start, unnest(generate_series(start + INTERVAL 1 DAY, start + INTERVAL 6 DAY,
         INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT o_orderdate AS start FROM orders)""",
)
def f10(spark, sf_dir):
    starts = T.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("start")).distinct()
    return starts.select("start", F.explode(C.following_days("start")).alias("ts"))


@query(
    "f11_floor_offset_format",
    """SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS hour_floor,
       ts - INTERVAL 60 DAY AS past, strftime(ts, '%Y-%m-%d') AS label FROM events""",
)
def f11(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        HOURLY.floor("ts").alias("hour_floor"),
        (F.col("ts") - F.expr("interval 60 days")).alias("past"),
        F.date_format("ts", "yyyy-MM-dd").alias("label"),
    )


_MODELS = tuple(DISPLAY_NAMES)


@query(
    "f12_text",
    """SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS code,
       split_part(o_orderpriority, '-', 2) AS name,
       (o_orderkey % 72)::VARCHAR || ' hour' AS label,
       CASE o_orderkey % 5 WHEN 0 THEN 'LightGBM' WHEN 1 THEN 'XGBoost' WHEN 2 THEN 'CatBoost'
         WHEN 3 THEN 'Quantile Regression' ELSE 'Benchmark' END AS model,
       'q' || CASE WHEN o_orderkey % 2 = 0 THEN '0.25' ELSE '0.75' END AS quantile FROM orders""",
)
def f12(spark, sf_dir):
    orders = T.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    short = F.array(*[F.lit(m) for m in _MODELS])[(key % 5).cast("int")]
    names = F.create_map(*[F.lit(v) for kv in DISPLAY_NAMES.items() for v in kv])
    level = F.when(key % 2 == 0, F.lit(0.25)).otherwise(F.lit(0.75))
    return orders.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).alias("code"),
        F.split("o_orderpriority", "-")[1].alias("name"),
        F.format_string("%d hour", key % 72).alias("label"),
        names[short].alias("model"),
        F.concat(F.lit("q"), level.cast("string")).alias("quantile"),
    )


@query(
    "f13_mean_std_text",
    with_ctes(
        """SELECT series_id, metric, printf('%.2f (± %.2f)', mean, std) AS text,
             mean = min(mean) OVER (PARTITION BY metric) AS is_best FROM dmetrics""",
        "dmetrics",
    ),
)
def f13(spark, sf_dir):
    metrics = evaluate.evaluate(spark, sf_dir)
    best = metrics.groupBy("metric").agg(F.min("mean").alias("_best"))
    text = mean_std_text("mean", "std").alias("text")
    # one row per metric, five in all
    return metrics.join(F.broadcast(best), "metric").select(
        SERIES, "metric", text, (F.col("mean") == F.col("_best")).alias("is_best")
    )


@query(
    "f14_parse_or_null",
    """SELECT series_id, count(*) AS n, count(TRY_CAST(txt AS DATE)) AS dates,
       count(TRY_CAST(num AS DOUBLE)) AS numbers, min(TRY_CAST(txt AS DATE))::TIMESTAMP AS first
       FROM (SELECT o_orderpriority AS series_id,
         CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' WHEN o_orderkey % 10 = 1 THEN '31.12.1999'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS txt,
         CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_totalprice::VARCHAR END AS num
         FROM orders) GROUP BY 1""",
)
def f14(spark, sf_dir):
    key = F.col("o_orderkey")
    dirty = T.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias(SERIES),
        F.when(key % 10 == 0, "n/a")
        .when(key % 10 == 1, "31.12.1999")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("txt"),
        F.when(key % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("num"),
    )
    date = parse_date(F.col("txt"))
    return dirty.groupBy(SERIES).agg(
        F.count("*").alias("n"),
        F.count(date).alias("dates"),
        F.count(F.col("num").try_cast("double")).alias("numbers"),
        F.min(date).cast("timestamp_ntz").alias("first"),
    )


@query(
    "f15_parse_json",
    """SELECT event_id, json_extract_string(props, '$.k')::INT AS k, i, v FROM (
         SELECT event_id, props, unnest([event_id, user_id]) AS v, unnest([0, 1]) AS i
         FROM events)""",
)
def f15(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.array("event_id", "user_id").alias("pair")))
    pairs = F.from_json(F.get_json_object(body, "$.pair"), "array<long>")
    k = F.from_json("props", "k int")["k"]
    return events.select("event_id", k.alias("k"), F.posexplode(pairs).alias("i", "v"))


# --- reshape -------------------------------------------------------------------------


@query(
    "r1_wide_to_long",
    with_ctes(
        "SELECT series_id, fold, c AS quantile, round(loss, 6) AS loss FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, fold, '{c}' AS c, loss_{c} AS loss FROM dfold" for c in QCOLS
        )
        + ")",
        "dfold",
    ),
)
def r1(spark, sf_dir):
    long = scoring.losses_long(evaluate.daily_folds(spark, sf_dir))
    return long.select(SERIES, "fold", "quantile", r("loss"))


@query(
    "r2_long_to_wide",
    with_ctes(
        "SELECT series_id, fold, "
        + ", ".join(f'round(loss_{c}, 6) AS "{q}"' for c, q in zip(QCOLS, LEVELS, strict=True))
        + " FROM dfold",
        "dfold",
    ),
)
def r2(spark, sf_dir):
    long = scoring.losses_long(evaluate.daily_folds(spark, sf_dir))
    wide = long.groupBy(SERIES, "fold").pivot("quantile", list(QCOLS)).agg(F.first("loss"))
    return wide.select(
        SERIES, "fold", *[r(c, alias=str(q)) for c, q in zip(QCOLS, LEVELS, strict=True)]
    )


@query(
    "r3_intervals",
    with_ctes(
        """SELECT series_id, fold, ts, 0.5::DOUBLE AS coverage, round(q[3], 6) AS median,
             round(q[2], 6) AS lower, round(q[4], 6) AS upper FROM dpred
           UNION ALL SELECT series_id, fold, ts, 0.95::DOUBLE, round(q[3], 6), round(q[1], 6),
             round(q[5], 6) FROM dpred""",
        "dpred",
    ),
)
def r3(spark, sf_dir):
    rows = scoring.intervals(evaluate.daily_backtest(spark, sf_dir), [SERIES, "fold", "ts"])
    return rows.select(
        SERIES, "fold", "ts", "coverage", r("median"), r("lower"), r("upper")
    )
