"""Estimator and transformer forms of the preprocessing steps, for pyspark.ml pipelines that are saved and loaded (L14 to L18)."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwell.operators import windows as W

SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


class _Steps(HasInputCols):
    impute = Param(Params._dummy(), "impute", "whether missing values become the training median", TypeConverters.toBoolean)
    clip = Param(Params._dummy(), "clip", "whether values are held within the 1 % and 99 % points of training", TypeConverters.toBoolean)
    scale = Param(Params._dummy(), "scale", "standard, robust or none", TypeConverters.toString)


class TrainingScaler(Estimator, _Steps, DefaultParamsReadable, DefaultParamsWritable):
    """Learns median, bounds and scale of each input column from the rows it is fitted on, in one aggregation."""

    @keyword_only
    def __init__(self, *, inputCols=None, impute=True, clip=True, scale="standard"):
        super().__init__()
        self._setDefault(impute=True, clip=True, scale="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TrainingScalerModel:
        if (scale := self.getOrDefault(self.scale)) not in ("standard", "robust", "none"):
            raise ValueError(f"unknown scale {scale}")
        columns = self.getInputCols()
        one = dataset.agg(*(F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.percentile(c, F.array(*map(F.lit, SHARES))).alias("q")).alias(f"s{i}") for i, c in enumerate(columns))).first()
        learned = {c: {"mean": one[i].mean, "sd": one[i].sd, "q": one[i].q} for i, c in enumerate(columns)}
        model = TrainingScalerModel()._set(learned=json.dumps(learned))
        return self._copyValues(model)


class TrainingScalerModel(Model, _Steps, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces the input columns by their imputed, clipped and scaled values; a column never seen in training stays as it is."""

    learned = Param(Params._dummy(), "learned", "statistics of each column, as JSON", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        learned, new = json.loads(self.getOrDefault(self.learned)), {}
        for c in self.getInputCols():
            s, x = learned[c], F.col(c).cast("double")
            if s["mean"] is None:
                new[c] = x
                continue
            low, first, middle, third, high = s["q"]
            x = F.coalesce(x, F.lit(middle)) if self.getOrDefault(self.impute) else x
            if self.getOrDefault(self.clip):
                x = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
            scale = self.getOrDefault(self.scale)
            centre, width = {"standard": (s["mean"], s["sd"]), "robust": (middle, third - first), "none": (0.0, 1.0)}[scale]
            new[c] = (x - F.lit(centre)) / F.lit(width) if width > 0 else F.when(x.isNotNull(), F.lit(0.0))
        return dataset.withColumns(new)


class RankScaler(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Replaces the input columns by their percentile ranks within each date; nothing is learned."""

    date = Param(Params._dummy(), "date", "column of the dates", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, date="date"):
        super().__init__()
        self._setDefault(date="date")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: W.percentile_rank(c, [self.getOrDefault(self.date)]) for c in self.getInputCols()})
