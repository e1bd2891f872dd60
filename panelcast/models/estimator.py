"""Registered models as ``pyspark.ml`` estimators of a whole panel.

``PanelForecaster`` fits any model of the registry, or one that a caller has registered with
:func:`register`, on a regular panel; its model forecasts, and can be written and read like
any other of ``pyspark.ml``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import Freq
from panelcast.models.forecast import forecast, train
from panelcast.models.registry import NAMES, Baseline, Setup, get_model
from panelcast.operators.baseline import baseline_lookup, baseline_table
from panelcast.operators.panel import SERIES
from panelcast.session import stage

Factory = Callable[..., Setup]
_OWN: dict[str, Factory] = {}


def register(name: str, factory: Factory) -> None:
    """Make ``factory(freq, x_cols, **options)`` available under a name of its own; reading
    a saved model of that name needs the same call before."""
    if name in NAMES:
        raise ValueError(f"{name} is a registered model already")
    _OWN[name] = factory


class _PanelParams(Params):
    modelName = Param(Params._dummy(), "modelName", "name in the registry", TypeConverters.toString)
    freq = Param(Params._dummy(), "freq", "D or h", TypeConverters.toString)
    xCols = Param(Params._dummy(), "xCols", "covariates", TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "settings as JSON", TypeConverters.toString)
    steps = Param(Params._dummy(), "steps", "steps to forecast", TypeConverters.toInt)

    def setup(self) -> Setup:
        name, freq = self.getOrDefault(self.modelName), Freq(self.getOrDefault(self.freq))
        x_cols = tuple(self.getOrDefault(self.xCols))
        options = json.loads(self.getOrDefault(self.options))
        for key in ("lags", "lag_cols"):  # JSON knows no tuples
            if isinstance(options.get(key), list):
                options[key] = tuple(options[key])
        if name in _OWN:
            return _OWN[name](freq, x_cols, **options)
        return get_model(name, freq, x_cols, **options)


class PanelForecaster(Estimator, _PanelParams, DefaultParamsWritable, DefaultParamsReadable):
    """Fits one model per series of a grid (with bounds), on all rows up to its last target."""

    @keyword_only
    def __init__(self, *, modelName="benchmark", freq="D", xCols=(), options="{}", steps=7):
        super().__init__()
        self._setDefault(modelName="benchmark", freq="D", xCols=[], options="{}", steps=7)
        given = dict(self._input_kwargs)
        if "xCols" in given:
            given["xCols"] = list(given["xCols"])
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> PanelForecasterModel:
        setup = self.setup()
        if isinstance(setup.model, Baseline):
            known = dataset.filter(F.col("y").isNotNull()).groupBy(SERIES)
            last = known.agg(F.max("pos").alias("hi"))
            history = dataset.drop("hi").join(last, SERIES).filter(F.col("pos") <= F.col("hi"))
            table = baseline_table(history, Freq(self.getOrDefault(self.freq)), setup.model.n_weeks)
            models = stage(table.join(last, SERIES), "baseline-models")
        else:
            models = train(stage(setup.prepared(dataset), "prepared"), setup.spec, setup.model)
        return self._copyValues(PanelForecasterModel(models))


class PanelForecasterModel(Model, _PanelParams, MLWritable, MLReadable):
    """``transform`` takes a grid that reaches over the horizon and gives its forecasts:
    ``series_id, h, ts`` and a column per quantile."""

    def __init__(self, models: DataFrame | None = None):
        super().__init__()
        self._setDefault(modelName="benchmark", freq="D", xCols=[], options="{}", steps=7)
        self.models = models

    def copy(self, extra=None):
        that = super().copy(extra)
        that.models = self.models
        return that

    def _transform(self, dataset: DataFrame) -> DataFrame:
        setup, steps = self.setup(), self.getOrDefault(self.steps)
        if not isinstance(setup.model, Baseline):
            grid = stage(setup.prepared(dataset), "prepared")
            rows = forecast(grid, self.models, setup.spec, setup.model, steps)
            return rows.drop("fold", "pos", "y")
        freq = Freq(self.getOrDefault(self.freq))
        ahead = F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + steps)).alias("pos")
        dates = self.models.groupBy(SERIES).agg(F.max("hi").alias("hi")).select(SERIES, "hi", ahead)
        rows = baseline_lookup(dates, self.models.drop("hi"), freq)
        step = (F.col("pos") - F.col("hi")).alias("h")
        return rows.select(SERIES, step, freq.at("pos").alias("ts"), *rows.columns[3:])

    def write(self) -> MLWriter:
        return _PanelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PanelReader(cls)


class _PanelWriter(MLWriter):
    def __init__(self, instance: PanelForecasterModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.models.write.parquet(f"{path}/models")


class _PanelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PanelForecasterModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/models"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
