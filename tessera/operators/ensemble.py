"""Blending, seed averaging and stacking of predictions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import join_all


def residual_gram(df: DataFrame, y: str, predictions: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of residuals, from one aggregate."""
    m = len(predictions)
    e = [F.col(p).cast("double") - F.col(y).cast("double") for p in predictions]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(e[i] * e[j]).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    g = np.zeros((m, m))
    for i in range(m):
        for j in range(i, m):
            g[i, j] = g[j, i] = r[f"g{i}_{j}"] or 0.0
    return g, r["n"]


def blend_weights(df: DataFrame, y: str, predictions: list[str], draws: int = 1000) -> tuple[list[float], float]:
    """Best of ``draws`` random weight vectors on the simplex (seeded by their number) by
    RMSE; the table is read once however many are tried."""
    g, n = residual_gram(df, y, predictions)
    best, score = None, float("inf")
    for k in range(draws):
        u = np.random.RandomState(k).rand(len(predictions))
        w = u / u.sum()
        s = float(np.sqrt(max(0.0, w @ g @ w) / max(1, n)))
        if s < score:
            best, score = w.tolist(), s
    return best or [], score


def blend_by_metric(df: DataFrame, predictions: list[str], metric, draws: int = 32) -> tuple[list[float], float]:
    """As :func:`blend_weights` for any aggregate ``metric(column)``, lower being better:
    all draws in one pass."""
    ws = []
    for k in range(draws):
        u = np.random.RandomState(k).rand(len(predictions))
        ws.append((u / u.sum()).tolist())
    mix: list[Column] = [sum((F.col(p) * w for p, w in zip(predictions, v, strict=True)), F.lit(0.0)) for v in ws]
    r = df.agg(*[metric(c).alias(f"m{k}") for k, c in enumerate(mix)]).first()
    k = min(range(draws), key=lambda i: r[f"m{i}"])
    return ws[k], r[f"m{k}"]


def blend(df: DataFrame, predictions: list[str], weights: list[float], name: str = "blend") -> DataFrame:
    return df.withColumn(name, sum((F.col(p) * w for p, w in zip(predictions, weights, strict=True)), F.lit(0.0)))


def average_runs(runs: DataFrame, row_id: str, value: str = "prediction") -> DataFrame:
    """Mean prediction of a row over runs (``run, row_id, prediction``)."""
    return runs.groupBy(row_id).agg(F.avg(value).alias(value))


def average_importance(tables: list[DataFrame], name: str = "feature", value: str = "importance") -> DataFrame:
    """Mean importance over runs of the features that all of them have."""
    parts = [t.select(name, F.col(value).alias(f"__{k}")) for k, t in enumerate(tables)]
    both = join_all(parts, [name], "inner")
    total = sum((F.col(f"__{k}") for k in range(len(tables))), F.lit(0.0))
    return both.select(name, (total / len(tables)).alias(value))


def stack_predictions(features: DataFrame, predictions: dict[str, DataFrame], row_id: str, value: str = "prediction", keep_features: bool = True) -> DataFrame:
    """Out-of-fold predictions of earlier models as features, joined on the row id."""
    base = features if keep_features else features.select(row_id)
    return join_all([base, *[t.select(row_id, F.col(value).alias(f"pred_{k}")) for k, t in predictions.items()]], [row_id])
