"""Quantile regression as ``pyspark.ml`` estimators."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.linear import LinearQuantile
from panelcast.models.passes import MODEL_SCHEMA, PACK_ROWS, pack
from panelcast.session import stage


class _LinearParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    quantile = Param(
        Params._dummy(), "quantile", "level to predict", typeConverter=TypeConverters.toFloat
    )
    l1 = Param(Params._dummy(), "l1", "L1 penalty", typeConverter=TypeConverters.toFloat)


class LinearQuantileRegression(Estimator, _LinearParams):
    """Linear regression of one quantile of ``labelCol`` on a vector column."""

    @keyword_only
    def __init__(
        self,
        *,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
        quantile=0.5,
        l1=1.0,
    ):
        super().__init__()
        self._setDefault(quantile=0.5, l1=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearQuantileRegressionModel:
        return self.fit_levels(dataset, [self.getOrDefault(self.quantile)])[0]

    def fit_levels(self, dataset: DataFrame, levels: list[float]) -> list[LinearQuantileRegressionModel]:
        """A model per level, all of them from the same rows, which are packed once.

        They are staged before they are numbered: a lost task that is computed again gives
        the same blocks.
        """
        x, y = self.getFeaturesCol(), self.getLabelCol()
        rows = dataset.select(F.col(y).cast("double").alias("y"), vector_to_array(x).alias("_x"))
        rows = stage(rows.filter(F.col("y").isNotNull()), "ml-rows")
        count, width = rows.agg(F.count("*"), F.max(F.size("_x"))).first()
        names = tuple(f"x{i}" for i in range(width))
        blocks = max(1, -(-count // PACK_ROWS))
        # rows that are alike would meet in one block: the staged file's own order, which
        # no longer changes, spreads them
        place = F.xxhash64("y", "_x", F.monotonically_increasing_id())
        frame = rows.select(
            F.lit("all").alias("series_id"),
            F.pmod(place, F.lit(blocks * PACK_ROWS)).alias("idx"),
            "y",
            *[F.col("_x")[i].alias(n) for i, n in enumerate(names)],
        )
        engine = LinearQuantile(names, raw=names, levels=tuple(levels), l1=self.getOrDefault(self.l1))
        none: list[float] = []
        one = [("all", 0, 0, blocks * PACK_ROWS, False, 0.0, none, none)]
        empty = dataset.sparkSession.createDataFrame(one, MODEL_SCHEMA)
        fitted = engine.fit(stage(pack(frame, list(names)), "ml"), empty).first()
        lines = engine.coefficients(np.asarray(fitted["params"])).tolist()
        models = [LinearQuantileRegressionModel(line[0], line[1:]) for line in lines]
        return [
            self._copyValues(m, {self.quantile: q}) for m, q in zip(models, levels, strict=True)
        ]


class LinearQuantileRegressionModel(Model, _LinearParams, MLWritable, MLReadable):
    def __init__(self, intercept: float = 0.0, coefficients: list[float] | None = None):
        super().__init__()
        self._setDefault(quantile=0.5, l1=1.0)
        self.intercept = intercept
        self.coefficients = coefficients or []

    def copy(self, extra=None):
        that = super().copy(extra)
        that.intercept, that.coefficients = self.intercept, self.coefficients
        return that

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(b) for b in self.coefficients])
        products = F.zip_with(vector_to_array(self.getFeaturesCol()), weights, lambda a, b: a * b)
        score = F.aggregate(products, F.lit(self.intercept), lambda acc, v: acc + v)
        return dataset.withColumn(self.getPredictionCol(), score)

    def write(self) -> MLWriter:
        return _Writer(self, {"intercept": self.intercept, "coefficients": self.coefficients})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls, lambda path, extra: cls(**extra))


class _Writer(MLWriter):
    """Parameters and a few plain values in the metadata, then models of their own."""

    def __init__(self, instance, extra: dict, parts: list[Model] = ()):
        super().__init__()
        self.instance, self.extra, self.parts = instance, extra, parts

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"extra": self.extra})
        for i, part in enumerate(self.parts):
            part.write().save(f"{path}/{i}")


class _Reader(MLReader):
    def __init__(self, cls, make):
        super().__init__()
        self.cls, self.make = cls, make

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
        model = self.make(path, metadata["extra"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class MultipleQuantileRegressor(Estimator):
    """One copy of a single-quantile estimator per level, fitted side by side; an estimator
    with ``fit_levels`` fits all levels together.

    ``alpha_name`` is the estimator's parameter for the level.  The model adds an array
    column ``predictions`` with one value per level.
    """

    def __init__(self, quantiles, regressor: Estimator, alpha_name="quantile", n_jobs=1):
        super().__init__()
        self.quantiles = list(quantiles)
        self.regressor = regressor
        self.alpha_name = alpha_name
        self.n_jobs = n_jobs

    def _copies(self) -> list[Estimator]:
        copies = []
        for q in self.quantiles:
            if not self.regressor.hasParam(self.alpha_name):
                raise ValueError(f"{self.regressor} has no level parameter {self.alpha_name}")
            param = self.regressor.getParam(self.alpha_name)
            one = self.regressor.copy({param: q})
            if one.getOrDefault(param) != q:
                raise ValueError(f"{self.regressor} did not take {self.alpha_name}={q}")
            copies.append(one)
        return copies

    def _fit(self, dataset: DataFrame) -> MultipleQuantileModel:
        copies = self._copies()
        if hasattr(self.regressor, "fit_levels") and self.alpha_name == "quantile":
            models = self.regressor.fit_levels(dataset, self.quantiles)  # reads the rows once
            return MultipleQuantileModel(dict(zip(self.quantiles, models, strict=True)))
        # the fits read the rows once each
        rows = stage(dataset, "multiple-quantiles")
        with ThreadPool(max(1, self.n_jobs)) as pool:
            models = pool.map(lambda e: e.fit(rows), copies)
        return MultipleQuantileModel(dict(zip(self.quantiles, models, strict=True)))


class MultipleQuantileModel(Model, MLWritable, MLReadable):
    """One fitted model per level, written and read as a whole."""

    def __init__(self, regressors: dict[float, Model]):
        super().__init__()
        self.regressors = regressors

    def write(self) -> MLWriter:
        return _Writer(self, {"levels": list(self.regressors)}, list(self.regressors.values()))

    @classmethod
    def read(cls) -> MLReader:
        def make(path: str, extra: dict) -> MultipleQuantileModel:
            spark = SparkSession.getActiveSession()
            parts = [
                DefaultParamsReader.loadParamsInstance(f"{path}/{i}", spark)
                for i in range(len(extra["levels"]))
            ]
            return cls(dict(zip(extra["levels"], parts, strict=True)))

        return _Reader(cls, make)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        names = []
        for i, model in enumerate(self.regressors.values()):
            names.append(f"_p{i}")
            column = model.getPredictionCol()
            out = model.transform(out).withColumnRenamed(column, names[-1])
        return out.withColumn("predictions", F.array(*names)).drop(*names)
