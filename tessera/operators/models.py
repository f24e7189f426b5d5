"""Model registry and cross-validation over fold columns.

Gradient boosting, forests and linear models come from Spark ML.  They stand in for
the boosters, kernel machines and networks of other libraries and do not give the same
numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import clip, fill
from tessera.operators.encode import target_encode, target_table


def _boost(binary: bool, **o):
    base = {"maxIter": 20, "maxDepth": 5, "seed": 0} | o
    return (GBTClassifier if binary else GBTRegressor)(featuresCol="features", labelCol="__y", **base)


def _forest(binary: bool, **o):
    base = {"numTrees": 30, "maxDepth": 8, "seed": 0} | o
    return (RandomForestClassifier if binary else RandomForestRegressor)(featuresCol="features", labelCol="__y", **base)


def _linear(binary: bool, **o):
    base = {"regParam": 0.01, "maxIter": 50} | o
    if binary:
        return LogisticRegression(featuresCol="features", labelCol="__y", **base)
    return LinearRegression(featuresCol="features", labelCol="__y", elasticNetParam=0.0, **base)


def _margin(binary: bool, **o):
    if not binary:
        return _linear(False, **o)
    return LinearSVC(featuresCol="features", labelCol="__y", **({"regParam": 0.01, "maxIter": 50} | o))


def _factors(binary: bool, **o):
    base = {"factorSize": 4, "maxIter": 50, "seed": 0} | o
    return (FMClassifier if binary else FMRegressor)(featuresCol="features", labelCol="__y", **base)


MODELS: dict[str, Callable] = {
    "lightgbm": _boost,
    "xgb": lambda binary, **o: _boost(binary, **({"maxBins": 256} | o)),
    "cat": _boost,
    "ert": _forest,
    "ktb": _boost,
    "rgf": _boost,
    "ridge": _linear,
    "svm": _margin,
    "tabnet": _factors,
}


def model(name: str, binary: bool = False, **options):
    """An estimator by name."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name](binary, **options)


@dataclass
class Fitted:
    """A fitted model of one fold; the same for every kind of estimator."""

    pipeline: object
    features: list[str]
    binary: bool
    encoded: dict[str, DataFrame] = field(default_factory=dict)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = self.pipeline.transform(df)
        kinds = dict(out.dtypes)
        value = vector_to_array("probability").getItem(1) if self.binary and "probability" in kinds else F.col("__p")
        drop = [c for c in ("__raw", "features", "__p", "rawPrediction", "probability", "prediction") if c in out.columns and c not in df.columns]
        return out.withColumn("__value", value.cast("double")).drop(*drop).withColumnRenamed("__value", name)

    def importance(self) -> dict[str, float]:
        last = self.pipeline.stages[-1]
        if hasattr(last, "featureImportances"):
            v = last.featureImportances.toArray()
        elif hasattr(last, "coefficients"):
            v = abs(last.coefficients.toArray())
        elif hasattr(last, "linear"):
            v = abs(last.linear.toArray())
        else:
            return {}
        return {f: float(x) for f, x in zip(self.features, v, strict=False)}


def fit(df: DataFrame, features: list[str], target: str, name: str = "lightgbm", binary: bool = False, scale: bool = False, **options) -> Fitted:
    """Fit on rows with a known target; missing features read as -999, or 0 if scaled."""
    rows = df.where(F.col(target).isNotNull()).withColumn("__y", F.col(target).cast("double"))
    estimator = model(name, binary, **options).setPredictionCol("__p")
    scale = scale or name in ("ridge", "svm", "tabnet")
    stages = [VectorAssembler(inputCols=features, outputCol="__raw" if scale else "features", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    prepared = prepare(rows, features, 0.0 if scale else -999.0)
    return Fitted(_Prepared(Pipeline(stages=[*stages, estimator]).fit(prepared), features, 0.0 if scale else -999.0), features, binary)


class _Prepared:
    def __init__(self, fitted, features, value):
        self.fitted, self.features, self.value, self.stages = fitted, features, value, fitted.stages

    def transform(self, df):
        return self.fitted.transform(prepare(df, self.features, self.value))


def prepare(df: DataFrame, features: list[str], value: float) -> DataFrame:
    return df.withColumns({c: fill(F.col(c).cast("double"), value) for c in features})


@dataclass
class Result:
    oof: DataFrame
    test: DataFrame | None
    scores: list[float]
    importance: dict[str, float]


def cross_validate(
    df: DataFrame,
    features: list[str],
    target: str,
    metric: Callable[[Column, Column], Column],
    *,
    row_id: str,
    fold: str = "fold",
    test: DataFrame | None = None,
    name: str = "lightgbm",
    binary: bool = False,
    encode: list[str] | None = None,
    smooth: float = 0.3,
    sampler: Callable[[DataFrame], DataFrame] | None = None,
    clip_to: tuple[float, float] | None = None,
    folds: list[int] | None = None,
    pseudo: DataFrame | None = None,
    **options,
) -> Result:
    """Fit on all folds but one, predict that one; test predictions are the mean over the
    folds run.  ``encode`` columns are target-encoded within the training folds;
    ``pseudo`` rows (with a target) join every training part."""
    encode = encode or []
    used = features + [f"{c}_TE" for c in encode]
    ids = folds if folds is not None else [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # fold numbers
    parts, tests, scores, importance = [], [], [], {}
    for k in ids:
        train, valid = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        if pseudo is not None:
            train = train.unionByName(pseudo.withColumn(fold, F.lit(-1)), allowMissingColumns=True)
        held_test = test
        for c in encode:
            table = target_table(train, c, target, smooth)
            mean = train.agg(F.avg(F.col(target).cast("double"))).first()[0]
            look = table.withColumnRenamed(c, "__c")
            valid, held_test = (None if t is None else t.join(look, t[c].eqNullSafe(look["__c"]), "left").drop("__c").withColumn(f"{c}_TE", F.coalesce(f"{c}_TE", F.lit(mean))) for t in (valid, held_test))
        if encode:
            train = target_encode(train, encode, target, fold, smooth)
        if sampler:
            train = sampler(train)
        m = fit(train, used, target, name, binary, **options)
        p = m.predict(valid)
        if clip_to:
            p = p.withColumn("prediction", clip(F.col("prediction"), *clip_to))
        p = p.select(row_id, F.col(fold), F.col(target), "prediction")
        scores.append(p.agg(metric(F.col(target), F.col("prediction"))).first()[0])
        parts.append(p)
        if held_test is not None:
            tests.append(m.predict(held_test).select(row_id, "prediction"))
        for f, v in m.importance().items():
            importance[f] = importance.get(f, 0.0) + v / len(ids)
    averaged = None
    if tests:
        averaged = reduce(DataFrame.unionByName, tests).groupBy(row_id).agg(F.avg("prediction").alias("prediction"))
        if clip_to:
            averaged = averaged.withColumn("prediction", clip(F.col("prediction"), *clip_to))
    return Result(reduce(DataFrame.unionByName, parts), averaged, scores, importance)


def halving_rate(rate: float, history: int, warmup: int, every: int, least: float) -> float:
    """Learning rate after ``history`` rounds: halved every so many rounds past a warm-up."""
    return max(least, rate / 2) if history > warmup and history % every == 0 else rate


def early_stop(scores: list[float], patience: int, lower_is_better: bool = True) -> int | None:
    """Round of the best score once ``patience`` rounds brought no better one, else None."""
    best = min(range(len(scores)), key=lambda k: scores[k] if lower_is_better else -scores[k], default=None)
    return best if best is not None and len(scores) - 1 - best >= patience else None
