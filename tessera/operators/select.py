"""Feature selection: constants, duplicates, correlation, drift and importance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import missing, shift_number
from tessera.operators.ranks import running_sums
from tessera.operators.tables import classify_columns


def constant_columns(df: DataFrame) -> list[str]:
    """Columns to drop: numbers without spread that are all known or all missing; others
    with one value (missing counts as one) or none.  One pass over the table."""
    numeric, other = classify_columns(df)
    exprs = [F.count(F.lit(1)).alias("__n")]
    for c in numeric:
        v = missing(F.col(c).cast("double"))
        exprs += [F.stddev_samp(v).alias(f"s_{c}"), F.count(v).alias(f"c_{c}")]
    for c in other:
        text = F.col(c).cast("string")
        exprs += [F.min(text).alias(f"l_{c}"), F.max(text).alias(f"h_{c}"), F.count(c).alias(f"c_{c}")]
    r = df.agg(*exprs).first()
    n = r["__n"]
    flat = [c for c in numeric if not (r[f"s_{c}"] or 0) > 0 and r[f"c_{c}"] in (0, n)]
    return flat + [c for c in other if r[f"c_{c}"] == 0 or (r[f"l_{c}"] == r[f"h_{c}"] and r[f"c_{c}"] == n)]


def duplicate_columns(df: DataFrame) -> list[str]:
    """Columns that equal an earlier one in every row: checksums first, then exact checks."""
    sums = df.agg(*[F.sum(F.xxhash64(F.col(c), F.col(c).isNull()).cast("decimal(38,0)")).alias(c) for c in df.columns]).first()
    kinds, seen, out = dict(df.dtypes), {}, []
    pairs = []
    for c in df.columns:
        k = (kinds[c], sums[c])
        if k in seen:
            pairs.append((seen[k], c))
        else:
            seen[k] = c
    if pairs:
        same = df.agg(*[F.coalesce(F.bool_and(F.col(a).eqNullSafe(F.col(b))), F.lit(True)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).first()
        out = [b for k, (_, b) in enumerate(pairs) if same[f"p{k}"]]
    return out


def correlation_table(df: DataFrame, columns: list[str], method: str = "pearson", width: int = 400) -> dict[tuple[str, str], float]:
    """Correlation of every pair of columns, in few passes; Spearman ranks columns first."""
    rows = df.select(*[missing(F.col(c).cast("double")).alias(c) for c in columns])
    if method == "spearman":
        for c in columns:
            v = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            ranked = running_sums(v, c, ["n"]).select(F.col(c).alias("__v"), (F.col("run_n") - (F.col("n") - 1) / 2.0).alias("__r"))
            rows = rows.join(ranked, rows[c] == ranked["__v"], "left").withColumn(c, F.col("__r")).drop("__v", "__r")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out: dict[tuple[str, str], float] = {}
    for k in range(0, len(pairs), width):
        some = pairs[k : k + width]
        r = rows.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(some)]).first()
        out |= {p: r[f"p{i}"] for i, p in enumerate(some)}
    return out


def correlated_columns(df: DataFrame, columns: list[str], threshold: float = 0.9, method: str = "pearson", protected: tuple[str, ...] = ()) -> list[str]:
    """Columns with ``|r| > threshold`` to any earlier column."""
    r = correlation_table(df, columns, method)
    return [c for i, c in enumerate(columns) if c not in protected and any(abs(r[a, c] or 0) > threshold for a in columns[:i])]


def greedy_correlated(df: DataFrame, columns: list[str], threshold: float = 0.995) -> list[str]:
    """Columns with ``r > threshold`` (signed) to an earlier column that is kept."""
    r = correlation_table(df, columns)
    kept: list[str] = []
    for c in columns:
        if not any((r[a, c] if r[a, c] is not None else -2) > threshold for a in kept):
            kept.append(c)
    return [c for c in columns if c not in kept]


def ks_table(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``column, d, n, m``: two-sample Kolmogorov-Smirnov distance of each column, by
    cumulative counts of distinct values that no single task sums alone."""
    part = lambda df, s: df.select(F.lit(s).alias("s"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), missing(F.col(c).cast("double")).alias("v")) for c in columns])).alias("x")).select("s", "x.*").where("v is not null")
    both = part(train, 0).unionByName(part(test, 1))
    counts = both.groupBy("column", "v").agg(F.sum((F.col("s") == 0).cast("long")).alias("a"), F.sum((F.col("s") == 1).cast("long")).alias("b"))
    run = running_sums(counts, "v", ["a", "b"], ["column"])
    size = counts.groupBy(F.col("column").alias("c2")).agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    return run.join(F.broadcast(size), F.col("column") == F.col("c2")).groupBy("column").agg(F.max(F.abs(F.col("run_a") / F.nullif(F.col("n"), F.lit(0)) - F.col("run_b") / F.nullif(F.col("m"), F.lit(0)))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))


def ks_p_value(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of a two-sample distance."""
    if not d or not n or not m:
        return 1.0
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def drifted_columns(train: DataFrame, test: DataFrame, columns: list[str], p: float = 0.1) -> list[str]:
    """Columns whose distributions differ between the tables."""
    rows = {r["column"]: r for r in ks_table(train, test, columns).collect()}  # a row a column
    return [c for c in columns if c in rows and rows[c]["d"] is not None and ks_p_value(rows[c]["d"], rows[c]["n"], rows[c]["m"]) < p]


def top_features(importance: DataFrame, k: int | float, name: str = "feature", value: str = "importance") -> DataFrame:
    """The first k features by importance; a fraction takes that share, rounded down."""
    if isinstance(k, bool) or not isinstance(k, (int, float)):
        raise TypeError("k must be a number of features or a share of them")
    n = k if isinstance(k, int) else int(k * importance.count())
    return importance.orderBy(F.col(value).desc(), name).limit(n)


def null_importance(scores: DataFrame, columns: list[str], k: int = 500, name: str = "features", protected: tuple[str, ...] = ()) -> DataFrame:
    """Features in the top k of any mean score, and the protected ones."""
    mean = scores.groupBy(name).agg(*[F.avg(c).alias(c) for c in columns])
    long = mean.select(name, F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("v")) for c in columns])).alias("x")).select(name, "x.*")
    top = long.withColumn("r", F.row_number().over(Window.partitionBy("score").orderBy(F.col("v").desc(), name))).where(F.col("r") <= k).select(name)
    if protected:
        top = top.union(scores.where(F.col(name).isin(*protected)).select(name))
    return top.distinct()


def shifted_columns(columns: list[str], day: int) -> list[str]:
    """Columns without a shift, and those shifted by ``day`` or more."""
    return [c for c in columns if shift_number(c) is None or shift_number(c) >= day]


def default_selection(df: DataFrame, threshold: float = 0.9) -> list[str]:
    """Columns that are left after duplicates, constants and correlated ones go."""
    left = [c for c in df.columns if c not in duplicate_columns(df)]
    left = [c for c in left if c not in constant_columns(df.select(*left))]
    numeric, _ = classify_columns(df.select(*left))
    gone = correlated_columns(df, numeric, threshold)
    return [c for c in left if c not in gone]
