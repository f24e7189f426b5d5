"""Categorical and numeric encoders that learn from a table and apply to another."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import double_array, hash_number, missing, normal_quantile, text_or
from tessera.operators.ranks import exact_quantiles, running_sums

#: Separator of combined categories; it stands in no ordinary text.
SEPARATOR = "\u0001"


def label_table(df: DataFrame, column: str) -> DataFrame:
    """``value, code``: codes from 0 in the order of the distinct non-null values.

    Values are numbered inside ranges (numbers) or initial letters (text), and each of
    those starts where the one before ends, so no task sorts all values."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "float", "double"):  # exact as doubles
        ranked = running_sums(values.withColumn("one", F.lit(1)), "value", ["one"])
        return ranked.select("value", (F.col("run_one") - 1).cast("int").alias("code"))
    part = F.substring(F.col("value").cast("string"), 1, 3) if dict(df.dtypes)[column] == "string" else F.lit("")
    values = values.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per initial
    starts = values.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__low"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("value")) - 1
    return values.join(starts, "__part").select("value", (place + F.col("__low")).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: list[str], fitted: dict[str, DataFrame] | None = None, unknown: int | None = None) -> DataFrame:
    """``{c}_code`` for each column; null stays null and unseen values get ``unknown``."""
    out = df
    for c in columns:
        t = (fitted or {}).get(c)
        t = (label_table(df, c) if t is None else t).withColumnsRenamed({"value": "__v", "code": f"{c}_code"})
        out = out.join(t, out[c] == t["__v"], "left").drop("__v")
        if unknown is not None:
            out = out.withColumn(f"{c}_code", F.when(F.col(c).isNotNull(), F.coalesce(f"{c}_code", F.lit(unknown))))
    return out


def combine(df: DataFrame, columns: list[str], sizes: tuple[int, ...] = (2, 3, 4), missing_text: str = "none") -> DataFrame:
    """All combinations of ``sizes`` columns as ``{a}_{b}_combi`` text, in one projection."""
    exprs = {"_".join(cs) + "_combi": F.concat_ws(SEPARATOR, *[text_or(F.col(c), missing_text) for c in cs]) for r in sizes for cs in combinations(columns, r)}
    return df.withColumns(exprs)


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """An indicator a value and one for missing; the fitted values fix the columns."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values} | {f"{column}_missing": F.col(column).isNull().cast("int")})


def quantile_edges(df: DataFrame, column: str, at: tuple[float, ...] = (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)) -> list[float]:
    """Exact quantiles, without repeats."""
    row = df.agg(F.percentile(missing(F.col(column).cast("double")), F.array(*[F.lit(float(a)) for a in at]))).first()[0]
    return sorted(set(row or []))


def quantile_bin(c: Column, edges: list[float]) -> Column:
    """Right-closed bin between edges, the lowest value included; null outside."""
    inner = edges[1:-1]
    code = sum((F.when(c > e, 1).otherwise(0) for e in inner), F.lit(0))
    return F.when((c >= edges[0]) & (c <= edges[-1]), code)


def column_means(train: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Means of the known numbers of a training table."""
    return train.agg(*[F.avg(missing(F.col(c).cast("double"))).alias(c) for c in columns]).first().asDict()


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Missing numbers become their column's value."""
    return df.withColumns({c: F.coalesce(missing(F.col(c).cast("double")), F.lit(v)) for c, v in values.items()})


def mean_impute(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become the mean of the training table."""
    return impute(df, column_means(train, columns))


def rank_gauss(train: DataFrame, df: DataFrame, column: str, knots: int = 1000) -> DataFrame:
    """``{c}_gauss``: normal quantile of the value's place among ``knots`` quantiles of the
    training table, interpolated linearly and clipped at 1e-7."""
    from pyspark.ml.feature import Bucketizer

    edges = exact_quantiles(train, column, [k / (knots - 1) for k in range(knots)]) or [0.0] * knots
    # First and last knot of every distinct edge; a value between edges lies between their knots.
    first: dict[float, int] = {}
    last: dict[float, int] = {}
    for k, e in enumerate(edges):
        first.setdefault(e, k)
        last[e] = k
    values = sorted(first)
    x, i = F.col("__x"), F.col("__i")
    splits = [float("-inf"), *values, float("inf")]
    rows = df.withColumn("__x", missing(F.col(column).cast("double")))
    rows = Bucketizer(splits=splits, inputCol="__x", outputCol="__i", handleInvalid="keep").transform(rows).withColumn("__i", (F.col("__i") - 1).cast("int"))
    of = lambda xs: F.get(double_array(xs), i)
    pairs = list(zip(values, values[1:]))
    step = (x - of(values)) / of([f - e for e, f in pairs] + [1.0])
    place = F.when(i < 0, F.lit(0.0)).when(x == of(values), of([(first[v] + last[v]) / 2 for v in values])).when(i >= len(values) - 1, F.lit(float(knots - 1))).otherwise(of([last[v] for v in values]) + step * of([first[f] - last[e] for e, f in pairs] + [0.0]))
    # A column of its own: normal_quantile names it dozens of times.
    rows = rows.withColumn("__p", F.greatest(F.least(place / (knots - 1), F.lit(1 - 1e-7)), F.lit(1e-7)))
    return rows.withColumn(f"{column}_gauss", F.when(x.isNotNull(), normal_quantile(F.col("__p")))).drop("__x", "__i", "__p")


def fold_of(ids: list[str], folds: int, seed: int = 0) -> Column:
    """Fold from a portable hash of the ids."""
    return (hash_number(*[F.col(c) for c in ids], seed=seed) % folds).cast("int")


def target_encode(df: DataFrame, columns: list[str], target: str, fold: str, smooth: float = 0.0) -> DataFrame:
    """``{c}_TE``: mean target of a category over the other folds; with ``smooth``, drawn to
    their overall mean by that many rows.  Null where no other fold has the category and
    nothing is smoothed.  Sums by (category, fold) are joined back, so no row is sorted."""
    out = df
    y = F.col(target).cast("double")
    total = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    whole = total.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    rest = total.crossJoin(F.broadcast(whole)).select(F.col(fold).alias("__f"), (F.col("all_s") - F.col("s")).alias("__rs"), (F.col("all_n") - F.col("n")).alias("__rn"))  # a row a fold
    for c in columns:
        part = df.groupBy(c, fold).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
        full = part.groupBy(F.col(c).alias("__c2")).agg(F.sum("__s").alias("__all_s"), F.sum("__n").alias("__all_n"))
        t = part.join(full, part[c].eqNullSafe(full["__c2"])).join(F.broadcast(rest), F.col(fold) == F.col("__f"))
        s, n = F.col("__all_s") - F.coalesce("__s", F.lit(0.0)), F.col("__all_n") - F.col("__n")
        value = F.try_divide(s + smooth * F.try_divide(F.col("__rs"), F.col("__rn")), n + smooth) if smooth else F.try_divide(s, n.cast("double"))
        t = t.select(F.col(c).alias("__c"), F.col(fold).alias("__g"), value.alias(f"{c}_TE"))
        out = out.join(t, out[c].eqNullSafe(t["__c"]) & (out[fold] == t["__g"]), "left").drop("__c", "__g")
    return out


def target_table(df: DataFrame, column: str, target: str, smooth: float = 0.0) -> DataFrame:
    """``column, {c}_TE`` from a whole table, to encode another one."""
    y = F.col(target).cast("double")
    mean = df.agg(F.avg(y)).first()[0]
    value = F.try_divide(F.sum(y) + F.lit(smooth * (mean or 0.0)), F.count(y) + F.lit(float(smooth)))
    return df.groupBy(column).agg(value.alias(f"{column}_TE"))
