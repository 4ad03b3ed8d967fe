"""Standard scaling of one feature family, as a Spark ML stage.

Semantics: mean and POPULATION std of each listed column on the rows the
stage is fitted on; a zero std divides by 1; other columns are untouched.
(``ml.feature.StandardScaler`` uses the sample std and maps zero-spread
columns to 0, so it is not used.)  Fitting is one aggregate; applying is
plain column arithmetic with the fitted numbers as literals, so it stays in
whole-stage codegen.  Inside a ``Pipeline`` the stage is re-fitted on every
training split, which keeps test rows out of the statistics.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _FamilyScalerParams(HasInputCols, HasOutputCols):
    pass


class FamilyScaler(Estimator, _FamilyScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: z = (x - mean) / (std_pop if std_pop > 0 else 1) on ``inputCols``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> "FamilyScalerModel":
        cols = self.getInputCols()
        row = dataset.agg(
            *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        model = FamilyScalerModel(inputCols=cols, outputCols=self.getOutputCols() or cols,
                                  means=means, stds=stds)
        return self._copyValues(model)


class FamilyScalerModel(Model, _FamilyScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        kwargs = self._input_kwargs
        self._set(**kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self.getOrDefault(self.outputCols)
        means, stds = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        exprs = {
            o: (F.col(i).cast("double") - F.lit(m)) / F.lit(s if s > 0 else 1.0)
            for i, o, m, s in zip(ins, outs, means, stds)
        }
        return dataset.withColumns(exprs)
