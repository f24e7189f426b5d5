"""Declarative group-by features: aggregate, join back, difference and ratio."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import missing, ratio

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "nunique": F.count_distinct,
    "median": F.median,
    "mean_variance": lambda v: ratio(F.stddev_pop(v), F.avg(v)),
    "iqr_ratio": lambda v: ratio(F.percentile(v, 0.75), F.percentile(v, 0.25)),
    "range_diff": lambda v: F.max(v) - F.min(v),
    "range_per": lambda v: ratio(F.max(v), F.min(v)),
}

#: Statistics that compare rows with a statistic of their group.
TWO_LEVEL = ("median_absolute_deviation", "hl_ratio", "beyond1std_ratio")


@dataclass(frozen=True)
class GroupSpec:
    """Aggregates ``agg`` of columns ``var`` by ``key``."""

    key: tuple[str, ...]
    var: tuple[str, ...]
    agg: tuple[str, ...]
    on: tuple[str, ...] = field(default=())

    def names(self) -> list[tuple[str, str, str]]:
        """``(output, aggregate, column)`` of every feature."""
        return [(f"{a}_{v}_groupby_{'_'.join(self.key)}", a, v) for v in self.var for a in self.agg]


def register(name: str, aggregate: Callable[[Column], Column]) -> None:
    """Add an aggregate: a function from a column to an aggregate column."""
    AGGREGATES[name] = aggregate


def aggregate(df: DataFrame, specs: list[GroupSpec], width: int = 100) -> dict[tuple[str, ...], DataFrame]:
    """One table a key.  Specs of equal key share one pass; beyond ``width`` expressions
    (the limit of code generation) a key's aggregates run in chunks that join on the key."""
    wanted: dict[tuple[str, ...], dict[str, tuple[str, str]]] = {}
    for s in specs:
        for name, a, v in s.names():
            wanted.setdefault(s.key, {})[name] = (a, v)
    out = {}
    for key, features in wanted.items():
        plain = [(n, a, v) for n, (a, v) in features.items() if a not in TWO_LEVEL]
        parts = []
        for i in range(0, len(plain), width):
            exprs = [AGGREGATES[a](_value(df, v, a)).alias(n) for n, a, v in plain[i : i + width]]
            parts.append(df.groupBy(*key).agg(*exprs))
        for n, (a, v) in features.items():
            if a in TWO_LEVEL:
                parts.append(two_level(df, key, v, a).withColumnRenamed(a, n))
        table = parts[0]
        for p in parts[1:]:
            table = _same_key(table, p, key)
        out[key] = table
    return out


def _value(df: DataFrame, v: str, a: str) -> Column:
    return missing(F.col(v)) if a not in ("count", "nunique") and dict(df.dtypes)[v] in ("double", "float") else F.col(v)


def _same_key(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Join two tables of the same groups, null keys included."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in key})
    on = [left[k].eqNullSafe(r[f"__{k}"]) for k in key]
    return left.join(r, on).drop(*[f"__{k}" for k in key])


def two_level(df: DataFrame, key: tuple[str, ...], var: str, name: str) -> DataFrame:
    """Statistics that need a group statistic first: two aggregations and a join, so a
    large group is combined map-side and never sorted as a window."""
    v = missing(F.col(var).cast("double"))
    rows = df.select(*key, v.alias("__v"))
    first = rows.groupBy(*key).agg(F.median("__v").alias("__med"), F.avg("__v").alias("__avg"), F.stddev_pop("__v").alias("__std"))
    both = _rows_with(rows, first, key)
    x = F.col("__v")
    exprs = {
        "median_absolute_deviation": F.median(F.abs(x - F.col("__med"))),
        "hl_ratio": ratio(F.sum((x >= F.col("__avg")).cast("long")), F.sum((x < F.col("__avg")).cast("long"))),
        "beyond1std_ratio": ratio(F.coalesce(F.sum((x >= F.col("__avg") + F.col("__std")).cast("long")), F.lit(0)), F.count(F.lit(1))),
    }
    return both.groupBy(*key).agg(exprs[name].alias(name))


def _rows_with(rows: DataFrame, table: DataFrame, key: tuple[str, ...]) -> DataFrame:
    t = table.withColumnsRenamed({k: f"__{k}" for k in key})
    return rows.join(t, [rows[k].eqNullSafe(t[f"__{k}"]) for k in key], "left").drop(*[f"__{k}" for k in key])


def join_back(df: DataFrame, specs: list[GroupSpec], width: int = 100) -> DataFrame:
    """Every row with the features of its groups; rows with a null key get null features."""
    out = df
    on = {s.key: s.on or s.key for s in specs}
    for key, table in aggregate(df, specs, width).items():
        t = table.withColumnsRenamed({k: f"__{k}" for k in key})
        out = out.join(t, [out[o] == t[f"__{k}"] for o, k in zip(on[key], key, strict=True)], "left").drop(*[f"__{k}" for k in key])
    return out


def differences(df: DataFrame, specs: list[GroupSpec]) -> DataFrame:
    """``diff_*``: aggregate minus the row's value, for numeric columns."""
    return df.withColumns({f"diff_{n}": F.col(n) - F.col(v) for s in specs for n, _, v in s.names()})


def ratios(df: DataFrame, specs: list[GroupSpec]) -> DataFrame:
    """``ratio_*``: aggregate over the row's value; null where the value is 0."""
    return df.withColumns({f"ratio_{n}": ratio(F.col(n), F.col(v)) for s in specs for n, _, v in s.names()})


def relative(df: DataFrame, key: list[str], var: str) -> DataFrame:
    """``x_diff, x_ratio, x_zscore`` of a column against its group (population std)."""
    v = missing(F.col(var).cast("double"))
    stats = df.groupBy(*key).agg(F.avg(v).alias("__avg"), F.stddev_pop(v).alias("__std"))
    both = _rows_with(df, stats, tuple(key))
    return both.withColumns({f"{var}_diff": v - F.col("__avg"), f"{var}_ratio": ratio(v, F.col("__avg")), f"{var}_zscore": ratio(v - F.col("__avg"), F.col("__std"))}).drop("__avg", "__std")


def frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """``{c}_Frequency``: share of all rows with the row's value; null for a null value."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    out = df
    for c in columns:
        t = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        t = t.crossJoin(F.broadcast(total)).select("__v", (F.col("__c") / F.col("__n")).alias(f"{c}_Frequency"))  # one row
        out = out.join(t, out[c] == t["__v"], "left").drop("__v")
    return out
