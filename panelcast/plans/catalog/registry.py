"""Query registry and the SQL building blocks of the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(name: str, digits: int = 6, alias: str | None = None) -> Column:
    """Rounded column, so that sums in another order compare equal."""
    return F.round(F.col(f"`{name}`"), digits).alias(alias or name)


LEVELS_SQL = "[0.025, 0.25, 0.5, 0.75, 0.975]"

# Common table expressions of the oracles, by name, with what they build on.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "daily": (
        (),
        """SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
           round(sum(o_totalprice), 2) / (1.95583::DOUBLE * 1000) AS y FROM orders GROUP BY 1, 2""",
    ),
    "hourly": (
        (),
        """SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts,
           round(sum(value), 2) / 1.95583::DOUBLE AS y FROM events GROUP BY 1, 2""",
    ),
    "cov": (
        (),
        """SELECT o_orderpriority AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
           sum(l_quantity) AS quantity, round(sum(l_discount), 2) / 1.95583::DOUBLE AS discount
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    ),
    "dgrid": (
        ("daily",),
        """SELECT g.series_id, g.ts, datediff('day', DATE '1970-01-01', g.ts::DATE) AS pos, d.y,
           row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS idx,
           count(*) OVER (PARTITION BY g.series_id) AS n_rows
           FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
                 FROM daily GROUP BY series_id) g LEFT JOIN daily d USING (series_id, ts)""",
    ),
    "hgrid": (
        ("hourly",),
        """SELECT g.series_id, g.ts,
           datediff('hour', TIMESTAMP '1970-01-01', g.ts) AS pos, d.y,
           row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS idx,
           count(*) OVER (PARTITION BY g.series_id) AS n_rows
           FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
                 FROM hourly GROUP BY series_id) g LEFT JOIN hourly d USING (series_id, ts)""",
    ),
    "jgrid": (
        ("daily", "cov"),
        """SELECT g.series_id, g.ts, datediff('day', DATE '1970-01-01', g.ts::DATE) AS pos,
           d.y, c.quantity, c.discount
           FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
                 FROM cov GROUP BY series_id) g
           LEFT JOIN cov c USING (series_id, ts)
           LEFT JOIN daily d ON d.series_id = g.series_id AND d.ts = g.ts AND c.ts IS NOT NULL""",
    ),
    "mgrid": (
        ("daily", "cov"),
        """SELECT g.series_id, g.ts, datediff('day', DATE '1970-01-01', g.ts::DATE) AS pos,
           b.y, b.quantity, b.discount,
           row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS idx,
           count(*) OVER (PARTITION BY g.series_id) AS n_rows
           FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
                 FROM daily JOIN cov USING (series_id, ts) GROUP BY series_id) g
           LEFT JOIN (SELECT series_id, ts, y, quantity, discount
                      FROM daily JOIN cov USING (series_id, ts)) b USING (series_id, ts)""",
    ),
}


def filled_sql(source: str, cols: list[str], extra: str = "") -> str:
    """Linear interpolation of ``cols`` along ``pos`` per series."""
    near, out = [], []
    for c in cols:
        at = f"CASE WHEN {c} IS NOT NULL THEN pos END"
        near.append(
            f"last_value({c} IGNORE NULLS) OVER b AS v0_{c}, "
            f"last_value({at} IGNORE NULLS) OVER b AS p0_{c}, "
            f"first_value({c} IGNORE NULLS) OVER f AS v1_{c}, "
            f"first_value({at} IGNORE NULLS) OVER f AS p1_{c}"
        )
        out.append(
            f"CASE WHEN p0_{c} = p1_{c} OR p1_{c} IS NULL THEN v0_{c} "
            f"ELSE v0_{c} + (v1_{c} - v0_{c}) * (pos - p0_{c}) / (p1_{c} - p0_{c}) END AS {c}"
        )
    return f"""SELECT series_id, ts, pos, {', '.join(out)}{extra} FROM (
        SELECT *, {', '.join(near)} FROM {source}
        WINDOW b AS (PARTITION BY series_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               f AS (PARTITION BY series_id ORDER BY pos
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


_CTES["dfill"] = (("dgrid",), filled_sql("dgrid", ["y"], ", idx, n_rows"))
_CTES["hfill"] = (("hgrid",), filled_sql("hgrid", ["y"], ", idx, n_rows"))
_CTES["mfill"] = (
    ("mgrid",),
    filled_sql("mgrid", ["y", "quantity", "discount"], ", idx, n_rows"),
)


def _baseline(grid: str, w: int, h: int, step: int, n: int, period: int, sliding: bool) -> str:
    """Brute-force backtest: every fold looks its own history up."""
    clip = f"AND p.idx > t.cut - {w}" if sliding else ""
    return f"""SELECT series_id, fold, ts, idx, h, y, quantile_cont(past, {LEVELS_SQL}) AS q FROM (
        SELECT t.*, p.y AS past, row_number() OVER (
            PARTITION BY t.series_id, t.fold, t.ts ORDER BY p.idx DESC) AS rn
        FROM (SELECT g.series_id, f.fold, g.ts, g.idx, g.y, {w - 1} + f.fold * {step} AS cut,
                     g.idx - ({w - 1} + f.fold * {step}) AS h
              FROM {grid} g JOIN (
                  SELECT series_id, unnest(range(0, (n_rows - {w + h}) // {step} + 1)) AS fold
                  FROM (SELECT DISTINCT series_id, n_rows FROM {grid})
                  WHERE n_rows >= {w + h}) f USING (series_id)
              WHERE g.idx BETWEEN {w} + f.fold * {step} AND {w - 1 + h} + f.fold * {step}) t
        JOIN {grid} p ON p.series_id = t.series_id AND p.idx <= t.cut
             AND (t.idx - p.idx) % {period} = 0 {clip})
        WHERE rn <= {n} GROUP BY ALL"""


def q_columns(prefix: str = "q", digits: int = 6) -> str:
    names = ("q025", "q25", "q50", "q75", "q975")
    return ", ".join(f"round({prefix}[{i}], {digits}) AS {n}" for i, n in enumerate(names, 1))


# Backtest settings shared by the queries: rows in the window, horizon, step, weeks.
DAILY_BT = {"w": 1000, "h": 7, "step": 7, "n": 100}
HOURLY_BT = {"w": 336, "h": 48, "step": 24, "n": 3}

_CTES["dpred"] = (("dgrid",), _baseline("dgrid", 1000, 7, 7, 100, 7, True))
_CTES["hpred"] = (("hgrid",), _baseline("hgrid", 336, 48, 24, 3, 168, True))
_CTES["dpred_long"] = (("dgrid",), _baseline("dgrid", 1400, 21, 70, 50, 7, False))
_CTES["dscored"] = (
    ("dpred",),
    "SELECT series_id, fold, ts, y, q[1] AS q025, q[2] AS q25, q[3] AS q50, q[4] AS q75, "
    "q[5] AS q975 FROM dpred WHERE y IS NOT NULL",
)
LOSSES_SQL = ", ".join(
    f"avg(greatest({t}::DOUBLE * (y - {c}), ({t}::DOUBLE - 1.0) * (y - {c}))) AS loss_{c}, "
    f"avg((y <= {c})::INT::DOUBLE) AS hit_{c}"
    for t, c in ((0.025, "q025"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.975, "q975"))
)
_CTES["dfold"] = (
    ("dscored",),
    f"""SELECT *, loss_q025 + loss_q25 + loss_q50 + loss_q75 + loss_q975 AS pinball_loss,
        (loss_q25 + loss_q75) / 0.5::DOUBLE AS interval_score_50,
        (loss_q025 + loss_q975) / 0.05::DOUBLE AS interval_score_95 FROM (
        SELECT series_id, fold, count(*) AS n, {LOSSES_SQL},
               avg((y >= q25 AND y <= q75)::INT::DOUBLE) AS coverage_50,
               avg((y >= q025 AND y <= q975)::INT::DOUBLE) AS coverage_95
        FROM dscored GROUP BY series_id, fold)""",
)
_CTES["dmetrics"] = (
    ("dfold",),
    " UNION ALL ".join(
        f"SELECT series_id, '{m}' AS metric, avg({m}) AS mean, {std}({m}) AS std "
        "FROM dfold GROUP BY series_id"
        for m, std in (
            ("pinball_loss", "stddev_samp"),
            ("interval_score_50", "stddev_samp"),
            ("interval_score_95", "stddev_samp"),
            ("coverage_50", "stddev_pop"),
            ("coverage_95", "stddev_pop"),
        )
    ),
)


def with_ctes(select: str, *names: str, **local: str) -> str:
    """``select`` with the named common table expressions and what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in _CTES[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS (\n{_CTES[n][1]}\n)" for n in order]
    parts += [f"{n} AS (\n{body}\n)" for n, body in local.items()]
    return f"WITH {', '.join(parts)}\n{select}" if parts else select
