"""Queries that stage rows, on a master other than local with a bare path in ``spark.checkpoint.dir``."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import oracle
import pytest

from panelcast.plans.catalog import ORACLES, QUERIES

START = datetime(1995, 1, 1)
DAYS = 2190  # two folds of the sweep: windows of 2,100 days, a step of 70, a week
SHORT = 1407  # one fold of the fitted models

STAGED = (
    "a11_boxplot_by_month", "a11_boxplot_by_hour", "a11_boxplot_two_keys", "a12_arg_extremes",
    "a13_mean_importance", "a13_importance_of_trees", "a1_quantiles", "a2_fold_mean_std",
    "a3_fold_population", "a4_scaled_variance", "a5_row_sum", "a6_hit_rate", "a7_counts",
    "a9_any_all", "b10_result_table", "b5_initial_window", "b6_test_rows",
    "b6_train_rows_expanding", "b6_train_rows_sliding", "b7_refit_backtest", "b8_eval_results",
    "b8_level_metrics",
)
FITTED = ("a13_importance_of_trees", "b7_refit_backtest")


def write_tables(spark, path, days):
    """Some orders a day with a line each, gaps among them, and events of 400 hours."""
    orders = [
        (k, k % 7, "FOP"[k % 3], 1000.0 * (k * k % 97) + k % 5, START + timedelta(days=k // 2), "1-URGENT")
        for k in range(2 * days)
        if k // 2 % 11 or k // 2 in (0, days - 1)
    ]
    lines = [(k, float(k % 50), k % 10 / 100, day + timedelta(days=k % 3 - 1)) for k, _, _, _, day, _ in orders]
    events = [(k, START + timedelta(minutes=40 * k), k % 9, "click", float(k * k % 31)) for k in range(600)]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    columns += "o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(orders, columns).write.parquet(f"{path}/orders.parquet")
    columns = "l_orderkey long, l_quantity double, l_discount double, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, columns).write.parquet(f"{path}/lineitem.parquet")
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    spark.createDataFrame(events, columns).write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return {n: write_tables(spark, tmp_path_factory.mktemp(f"days{n}"), n) for n in (DAYS, SHORT)}


@pytest.fixture
def cluster(spark, monkeypatch, tmp_path):
    """The session says that it has another master, and where all machines can write."""
    get, own = type(spark.conf).get, {"spark.checkpoint.dir": str(tmp_path), "spark.master": "spark://host:7077"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: own.get(key) or get(self, key, *a))
    monkeypatch.setattr(spark.sparkContext, "master", own["spark.master"])
    return tmp_path / "panelcast"


@pytest.mark.parametrize("name", STAGED)
def test_whole_result_on_a_cluster(spark, tables, cluster, name):
    path = tables[SHORT if name in FITTED else DAYS]
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    ok, text = oracle.compare(spark, con, name, path, QUERIES, ORACLES)
    assert ok, text
    assert list(cluster.iterdir())
