"""The five named feature pipelines (L1-L5) and their glue.

A pipeline is declared as a numeric branch, a category branch and a tail.
``fit_pipeline`` fits the stages in order on the train rows (each ``fit``
is one or a few aggregate jobs over the persisted train frame), tracks the
feature column list through the branches (the ColumnTransformer role), and
returns a ``pyspark.ml.PipelineModel``: ``transform`` on train or test only
adds projections, and the model saves / loads with Spark ML persistence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanframe.functions.gram import Interactions
from loanframe.operators.encode import MostFrequentImputer, OneHotEncoder
from loanframe.operators.impute import IterativeImputer
from loanframe.operators.numeric import (Assemble, KBinsDiscretizer, PolynomialFeatures,
                                         StandardScaler, YeoJohnson)
from loanframe.operators.outliers import Winsorizer
from loanframe.sources import loans as L

Step = Callable[[list[str]], object]


@dataclass
class PipelineSpec:
    name: str
    numeric: list[Step]
    category: list[Step] = field(default_factory=lambda: [
        lambda cols: MostFrequentImputer(cols),
        lambda cols: OneHotEncoder(cols, drop="if_binary")])
    interactions: bool = False
    scale: bool = True


def _impute_cap():
    return [lambda c: IterativeImputer(c, max_iter=10), lambda c: Winsorizer(c, fold=1.5)]


def _impute_cap_power():
    return _impute_cap() + [lambda c: YeoJohnson(c)]


SPECS: dict[str, PipelineSpec] = {
    # L1: I2 -> O6 -> I3 | I1 -> E3 | I10 -> I6
    "linear": PipelineSpec("linear", _impute_cap_power(), interactions=True),
    # L2: I2 -> O6 | I1 -> E3 | no tail
    "tree": PipelineSpec("tree", _impute_cap(), scale=False),
    # L3: I2 -> O6 -> I3 | I1 -> E3 | I6
    "distance": PipelineSpec("distance", _impute_cap_power()),
    # L4: I2 -> O6 -> I3 -> I7 -> E5 | I1 -> E3 | I6
    "probability": PipelineSpec("probability", _impute_cap_power() + [
        lambda c: KBinsDiscretizer(c, n_bins=3), lambda c: OneHotEncoder(c, drop="first")]),
    # Same stages as L3
    "neural": PipelineSpec("neural", _impute_cap_power()),
}

NUMERIC = L.NUMERIC
CATEGORY = L.CATEGORICAL + ["cb_person_default_on_file"]


def prepare(df: DataFrame) -> DataFrame:
    """Flags out, the boolean flag as a category (cited casts)."""
    d = df.drop(*[c for c in L.FLAG_SOURCES if c in df.columns])
    return d.withColumn("cb_person_default_on_file", F.col("cb_person_default_on_file").cast("string"))


def fit_pipeline(spec: PipelineSpec | str, train: DataFrame, numeric: list[str] = NUMERIC,
                 category: list[str] = CATEGORY, keep: list[str] = (L.KEY, L.LABEL),
                 output_col: str = "features") -> PipelineModel:
    """L7 + L8: fit the stages in order on ``train``; returns the fitted
    PipelineModel (L9: ``model.transform(test)`` uses train constants only)."""
    spec = SPECS[spec] if isinstance(spec, str) else spec
    data = prepare(train).select(*keep, *numeric, *category).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stages = []
        cur = data
        num_cols = list(numeric)
        for make in spec.numeric:
            est = make(num_cols)
            m = est.fit(cur) if isinstance(est, Estimator) else est
            stages.append(m)
            cur = m.transform(cur)
            num_cols = m.output_cols()
        cat_cols = list(category)
        for make in spec.category:
            m = make(cat_cols).fit(cur)
            stages.append(m)
            cur = m.transform(cur)
            cat_cols = m.output_cols()
        feats = num_cols + cat_cols
        if spec.interactions:
            tail = PolynomialFeatures(feats, interaction_only=True, output_col=output_col)
            cur = tail.transform(cur)
            stages.append(tail)
        else:
            tail = Assemble(feats, output_col=output_col, keep=list(keep))
            cur = tail.transform(cur)
            stages.append(tail)
        if spec.scale:
            sc = StandardScaler(array_col=output_col).fit(cur)
            stages.append(sc)
        return PipelineModel(stages=stages)
    finally:
        data.unpersist()


def interactions(model: PipelineModel) -> Interactions:
    """The scaled products that a pipeline with an interaction tail ends in, as a function of its base columns."""
    scaler = model.stages[-1].fitted()
    return Interactions(np.array(scaler["mean"]), np.array(scaler["scale"]))


def base_columns(model: PipelineModel, df: DataFrame, keep: list[str] = (L.KEY, L.LABEL), output_col: str = "base") -> DataFrame:
    """(keep, base): what the interaction tail of a fitted pipeline starts from, as one array column."""
    tail = model.stages[-2]
    before = PipelineModel(stages=model.stages[:-2]).transform(prepare(df))
    return Assemble(tail.input_cols(), output_col=output_col, keep=list(keep)).transform(before)


def feature_names(model: PipelineModel) -> list[str]:
    """The ordered names of the output features."""
    for st in reversed(model.stages):
        if isinstance(st, (PolynomialFeatures, Assemble)):
            return st.output_cols()
    return []


def transform(model: PipelineModel, df: DataFrame, keep: list[str] = (L.KEY, L.LABEL),
              output_col: str = "features") -> DataFrame:
    """Apply the fitted pipeline: (key, label, features)."""
    return model.transform(prepare(df)).select(*keep, output_col)


def expand(df: DataFrame, names: list[str], array_col: str = "features",
           keep: list[str] = (L.KEY, L.LABEL)) -> DataFrame:
    """Named feature columns from the array (for CSV sinks and display)."""
    return df.select(*keep, *[F.col(array_col)[i].alias(n) for i, n in enumerate(names)])
