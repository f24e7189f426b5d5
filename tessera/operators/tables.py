"""Joins, de-duplication, set operations and column bookkeeping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitise_names(names: list[str]) -> list[str]:
    """Every character that is not a letter, digit or underscore becomes an underscore."""
    return [re.sub(r"\W", "_", n) for n in names]


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns with equal names."""
    places: dict[str, int] = {}
    for k, n in enumerate(df.columns):
        places.setdefault(n, k)
    tagged = df.toDF(*[f"__{k}" for k in range(len(df.columns))])
    return tagged.select(*[F.col(f"__{k}").alias(n) for n, k in places.items()])


def affix(df: DataFrame, prefix: str = "", suffix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename columns to ``prefix_name_suffix``, but for the kept ones."""
    return df.withColumnsRenamed({c: "_".join(x for x in (prefix, c, suffix) if x) for c in df.columns if c not in keep})


def columns_of(df: DataFrame, *, starts: str | None = None, ends: str | None = None, match: str | None = None, kinds: tuple[str, ...] | None = None) -> list[str]:
    """Column names by prefix, suffix, pattern and type, in order."""
    return [c for c, t in df.dtypes if (not starts or c.startswith(starts)) and (not ends or c.endswith(ends)) and (not match or re.search(match, c)) and (not kinds or t in kinds)]


def classify_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and other (categorical) columns."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if t in numeric or t.startswith("decimal")], [c for c, t in df.dtypes if t not in numeric and not t.startswith("decimal")]


def left_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Left equi-join on differently named keys; the right keys go, its other columns get
    a prefix, so one dimension can be joined in several roles."""
    keys = right_on or left_on
    r = right.withColumnsRenamed({c: f"__k_{c}" if c in keys else f"{prefix}{c}" for c in right.columns})
    return left.join(r, [left[a] == r[f"__k_{b}"] for a, b in zip(left_on, keys, strict=True)], "left").drop(*[f"__k_{b}" for b in keys])


def join_all(tables: list[DataFrame], on: list[str], how: str = "left") -> DataFrame:
    """Fold tables into one on shared keys; other column names must be unique."""
    seen = set(on)
    for t in tables:
        clash = seen & (set(t.columns) - set(on))
        if clash:
            raise ValueError(f"column names stand in two tables: {sorted(clash)}")
        seen |= set(t.columns)
    return reduce(lambda a, b: a.join(b, on, how), tables)


def join_rows(tables: list[DataFrame], row_id: str) -> DataFrame:
    """Column concatenation: tables of the same rows, joined on an explicit row id.

    Rows that miss in any table are an error, raised while the join runs."""
    first = join_all([t.withColumn(f"__in{k}", F.lit(1)) for k, t in enumerate(tables)], [row_id], "full")
    there = reduce(lambda a, b: a & b, [F.col(f"__in{k}").isNotNull() for k in range(len(tables))])
    checked = F.when(there, F.col(row_id)).otherwise(F.raise_error(F.lit("tables to be joined row by row have different rows")).cast(dict(tables[0].dtypes)[row_id]))
    return first.withColumn(row_id, checked).drop(*[f"__in{k}" for k in range(len(tables))])


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """One row a key, the first (or last) by an explicit order; combines map-side."""
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("__r"))
    return got.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def semi(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key stands in ``ids``."""
    return df.join(ids, on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key does not stand in ``ids``."""
    return df.join(ids, on, "left_anti")


def stack(tables: list[DataFrame], split: list[str] | None = None) -> DataFrame:
    """Rows of all tables, columns by name, missing ones null; ``split`` labels them."""
    if split:
        tables = [t.withColumn("split", F.lit(s)) for t, s in zip(tables, split, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def value_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Number of distinct values only in a, only in b, and in both."""
    x, y = a.select(column).distinct().withColumn("__a", F.lit(1)), b.select(column).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, column, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return both.agg(n(F.col("__b").isNull()).alias("only_a"), n(F.col("__a").isNull()).alias("only_b"), n(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"))


def shrink(df: DataFrame, date: str, first=None, last=None, not_before: str | None = None, week: str | None = None) -> DataFrame:
    """Rows from ``first`` on and before ``last``, optionally with ``week >= not_before``."""
    out = df
    if not_before and week:
        out = out.where(F.col(week) >= F.col(not_before))
    if first is not None:
        out = out.where(F.col(date) >= F.lit(first))
    if last is not None:
        out = out.where(F.col(date) < F.lit(last))
    return out
