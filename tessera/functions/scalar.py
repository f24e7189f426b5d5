"""Scalar column functions: missing values, scaling, encodings, bins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """NaN and infinities become null, the one marker of a missing number."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where b is 0 or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clip to a range; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def fill(c: Column, value) -> Column:
    """Missing and infinite numbers become ``value``."""
    return F.coalesce(missing(c), F.lit(value))


def text_or(c: Column, default: str = "none") -> Column:
    """As text, with a default for null."""
    return F.coalesce(c.cast("string"), F.lit(default))


def strict_number(c: Column, marker: str) -> Column:
    """Text to double; the marker reads as null, any other non-number is an error."""
    return F.nullif(c, F.lit(marker)).cast("double")


def map_values(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Dictionary map; values without an entry become ``default`` (null)."""
    pairs = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), list(mapping.items())[1:], F.when(c == next(iter(mapping)), F.lit(next(iter(mapping.values())))))
    return pairs if default is None else pairs.otherwise(default)


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic value."""
    x = c.cast("double") * F.lit(2 * math.pi / period)
    return F.sin(x), F.cos(x)


def hex_to_long(c: Column) -> Column:
    """Last 16 hex digits as a signed 64-bit integer."""
    return F.conv(F.substring(c, -16, 16), 16, -10).cast("long")


def digitize(c: Column, edges: list[float]) -> Column:
    """Number of edges that are at most the value (left-closed bins)."""
    return sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0)) + F.when(c.isNull(), None).otherwise(0)


def cut(c: Column, edges: list[float]) -> Column:
    """Right-closed bin number between edges, open at both ends."""
    return sum((F.when(c > e, 1).otherwise(0) for e in edges), F.lit(0)) + F.when(c.isNull(), None).otherwise(0)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def focal_loss(y: Column, raw: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of a raw score; the probability is kept away from 0 and 1."""
    p = clip(sigmoid(raw), 1e-12, 1 - 1e-12)
    t = y.cast("double")
    weight = alpha * t + (1 - alpha) * (1 - t)
    return -weight * F.pow(1 - (t * p + (1 - t) * (1 - p)), F.lit(gamma)) * (t * F.log(p) + (1 - t) * F.log(1 - p))


def focal_gradient(y: Column, raw: Column, alpha: float = 0.25, gamma: float = 2.0) -> tuple[Column, Column]:
    """First and second derivative of :func:`focal_loss` by central differences."""
    h = 1e-3
    at = lambda d: focal_loss(y, raw + d, alpha, gamma)
    return (at(h) - at(-h)) / (2 * h), (at(h) - 2 * at(0.0) + at(-h)) / (h * h)


def softmax_expectation(scores: Column, top: float) -> Column:
    """Expected class of raw class scores (an array), over ``top``."""
    high = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - high))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) / total / F.lit(top)


def hash_number(*parts: Column, seed: int = 0) -> Column:
    """Portable non-negative 32-bit hash of ids: the first 8 hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def double_array(values: list[float]) -> Column:
    """A literal array; a call for each of many literals would take seconds."""
    return F.expr(f"cast(split('{','.join(repr(float(v)) for v in values)}', ',') as array<double>)")


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function (Acklam's rational approximation)."""
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
    poly = lambda k, x: reduce(lambda s, v: s * x + v, k[1:], F.lit(k[0]))
    tail = lambda q: poly(c, q) / (poly(d, q) * q + 1)
    mid = p - 0.5
    r = mid * mid
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(poly(a, r) * mid / (poly(b, r) * r + 1))


def shift_number(name: str) -> int | None:
    """Number in a column name such as ``shift_12_sales``."""
    import re

    m = re.search(r"shift_([0-9]{1,2})_", name)
    return int(m[1]) if m else None
