"""Estimator / Model base for the fitted operators.

Each fitted operator is a ``pyspark.ml`` Estimator whose ``fit`` runs one or
a few aggregate jobs and keeps the small fitted constants (fences, levels,
lambdas, weights) as a JSON ``Param``; its Model's ``transform`` only adds
column expressions.  Both mix in ``DefaultParamsWritable/Readable``, so a
fitted ``PipelineModel`` of them saves and loads with Spark ML persistence.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


class _StageParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "input column names, in order",
                      typeConverter=TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "operator options as JSON",
                    typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCols=[], options="{}")

    def input_cols(self) -> list[str]:
        return list(self.getOrDefault(self.inputCols))

    def opts(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.options))


class FittedModel(Model, _StageParams, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted constants as JSON",
                  typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(state="{}")

    @classmethod
    def make(cls, input_cols: list[str], options: dict, state: dict) -> "FittedModel":
        m = cls()
        m._set(inputCols=list(input_cols), options=json.dumps(options),
               state=json.dumps(state, allow_nan=True))
        return m

    def fitted(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.state))

    def output_cols(self) -> list[str]:
        """Feature columns after this stage (default: the inputs, in place)."""
        return self.input_cols()

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df, self.fitted())

    def apply(self, df: DataFrame, state: dict) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    def params_table(self, spark):
        """The fitted constants as a DataFrame (what SQL* oracles compare)."""
        rows = [(k, json.dumps(v)) for k, v in sorted(self.fitted().items())]
        return spark.createDataFrame(rows, "name string, value string")


class FitEstimator(Estimator, _StageParams, DefaultParamsReadable, DefaultParamsWritable):
    model_class: type[FittedModel] = FittedModel

    def __init__(self, inputCols: list[str] | None = None, **options):
        super().__init__()
        self._set(inputCols=list(inputCols or []), options=json.dumps(options))

    def _fit(self, df: DataFrame) -> FittedModel:
        state = self.fit_state(df, self.input_cols(), self.opts())
        return self.model_class.make(self.input_cols(), self.opts(), state)

    def fit_state(self, df: DataFrame, cols: list[str], opts: dict) -> dict:  # pragma: no cover
        raise NotImplementedError


class StatelessTransformer(Transformer, _StageParams, DefaultParamsReadable, DefaultParamsWritable):
    """A stage with nothing to fit (binarizer, log1p, ...)."""

    def __init__(self, inputCols: list[str] | None = None, **options):
        super().__init__()
        self._set(inputCols=list(inputCols or []), options=json.dumps(options))

    def output_cols(self) -> list[str]:
        return self.input_cols()

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)

    def apply(self, df: DataFrame) -> DataFrame:  # pragma: no cover
        raise NotImplementedError
