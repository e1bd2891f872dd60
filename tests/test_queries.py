"""Registered queries: against SQL in DuckDB, and as a whole."""

from __future__ import annotations

import os
import re

import oracle
import pytest

import __spark_entry__ as entry
from panelcast.plans.catalog import ORACLES, QUERIES

# One or two per family, checked alone with QUICK=1.
QUICK = (
    "a11_boxplot_by_hour", "b6_train_rows_sliding", "e6_calibration", "f9_forecast_hours",
    "j3_holiday", "j6_phase_lookup", "m1_baseline_hourly_clipped", "p5_localize_dst",
    "p17_interpolate_prefix", "p18_backfill", "s4_json_feed", "v6_target_rules",
    "v11_prepare", "w4_rolling_quantiles_daily",
)
# Minutes of fitting at the registered settings; what they are made of is tested on small
# panels.  FULL=1 checks them too.
HEAVY = {
    "m4_boosted_leafwise", "m5_boosted_early_stopping", "m6_boosted_symmetric", "m7_quantile_forest",
    "m8_direct_boosting", "m9_direct_linear", "m10_recursive_forecast", "m15_model_registry",
    "b7_refit_backtest", "b8_times", "m2_quantile_shares", "v10_submit_fitted",
}
if os.environ.get("QUICK"):
    CHECKED = QUICK
else:
    CHECKED = sorted(set(ORACLES) - (set() if os.environ.get("FULL") else HEAVY))


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, sf_dir, name):
    ok, text = oracle.compare(spark, con, name, sf_dir, QUERIES, ORACLES)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "metric", "mean", "std"]
    assert df.count() > 0


def test_registry_is_consistent():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) <= set(queries)
    families = {re.match(r"[a-z]\d+", n).group() for n in QUERIES}
    wanted = {
        "s": 12, "p": 25, "j": 9, "a": 13, "w": 9, "o": 6, "u": 3, "f": 15, "r": 3,
        "e": 6, "v": 14,
    }
    for letter, last in wanted.items():
        for i in range(1, last + 1):
            assert f"{letter}{i}" in families, f"{letter}{i} has no query"


def test_skewed_plans_do_not_window_over_a_whole_series(spark, sf_dir):
    """Row-level windows are partitioned by block, not by series alone."""
    for name in ("p16_interpolate", "w2_target_lags", "m1_baseline_backtest", "w5_rolling_mean"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "max(" not in line:
                assert "_block" in line, (name, line)
