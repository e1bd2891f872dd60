"""Probabilistic time-series forecasting on panels of many series, as Spark jobs."""

import sys

from pyspark import cloudpickle

from panelcast.config import LEVELS, QCOLS
from panelcast.functions.calendar import DAILY, HOURLY, Freq
from panelcast.session import build_session, scratch_dir

__all__ = ["DAILY", "HOURLY", "Freq", "LEVELS", "QCOLS", "build_session", "scratch_dir"]

# Functions sent to executors carry their code along, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
