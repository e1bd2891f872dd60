"""Registered queries, one per operator, each with its SQL where SQL can say it."""

from panelcast.plans.catalog import (  # noqa: F401
    aggregates,
    backtests,
    cleaning,
    forecasts,
    functions,
    joins,
    models,
    scores,
    sources,
    submissions,
    windows,
)
from panelcast.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
