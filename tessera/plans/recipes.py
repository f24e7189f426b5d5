"""Composite recipes: denormalised tables and the combined-category feature set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import hex_to_long, map_values, strict_number
from tessera.operators.encode import column_means, combine, impute, label_encode, one_hot, rank_gauss
from tessera.operators.groupby import GroupSpec, differences, join_back, ratios
from tessera.operators.tables import keep_first, left_join, stack

#: Age ratings in order.
RATINGS = {"RP": 0, "EC": 0, "K-A": 1, "E": 1, "E10+": 2, "T": 3, "M": 4, "AO": 5}


def basic_features(train: DataFrame, test: DataFrame, encode: list[str], *, rating: str | None = None, score: str | None = None, marker: str = "tbd", year: str | None = None, years: dict | None = None, log: dict[str, str] | None = None) -> DataFrame:
    """Stack both tables, map ratings, read scores, mend years, take logs, encode labels."""
    rows = stack([train, test], ["train", "test"])
    exprs = {}
    if rating:
        exprs[rating] = map_values(F.col(rating), RATINGS)
    if score:
        exprs[score] = strict_number(F.col(score), marker)
    if year and years:
        exprs[year] = map_values(F.col(year), years, F.col(year))
    for name, c in (log or {}).items():
        exprs[name] = F.log1p(F.col(c).cast("double"))
    return label_encode(rows.withColumns(exprs) if exprs else rows, encode)


def combined_categories(rows: DataFrame, columns: list[str], sizes=(2, 3, 4), encode: bool = False) -> DataFrame:
    """All category combinations, optionally with their codes."""
    out = combine(rows, columns, sizes)
    return label_encode(out, [c for c in out.columns if c not in rows.columns]) if encode else out


def combined_groupby(rows: DataFrame, columns: list[str], numbers: list[str], categories: list[str], sizes=(2, 3, 4)) -> DataFrame:
    """Group-by features of every combination: five statistics of numbers with difference
    and ratio to the row, and count and distinct count of categories."""
    made = combine(rows, columns, sizes)
    keys = [c for c in made.columns if c not in rows.columns]
    numeric = [GroupSpec((k,), tuple(numbers), ("mean", "std", "min", "max", "sum")) for k in keys]
    other = [GroupSpec((k,), tuple(categories), ("count", "nunique")) for k in keys] if categories else []
    out = join_back(made, numeric + other)
    return ratios(differences(out, numeric), numeric)


def denormalise(fact: DataFrame, steps: list[tuple[DataFrame, list[str], list[str], str]]) -> DataFrame:
    """Left joins in order, each ``(table, fact keys, table keys, prefix)``; one table may
    come twice in two roles."""
    for table, left, right, prefix in steps:
        fact = left_join(fact, table, left, right, prefix)
    return fact


def entity_target(rows: DataFrame, labels: DataFrame, entity: str, hex_id: str, target: str) -> DataFrame:
    """``entity, target``: labels keyed by a hex id joined to the distinct entities."""
    known = labels.select(hex_to_long(F.col(hex_id)).alias("__e"), F.col(target))
    known = keep_first(known, ["__e"], [target], last=True)
    return left_join(rows.select(entity).distinct(), known, [entity], ["__e"])


def linear_features(train: DataFrame, df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """Inputs of linear models, fitted on the training rows only: numbers imputed and
    mapped to a normal distribution, categories one-hot with an indicator for missing."""
    means = column_means(train, numbers)  # once: a sum made anew may round otherwise, and miss the fitted tie
    out, base = impute(df, means), impute(train, means)
    for c in numbers:
        out = rank_gauss(base, out, c)
    for c in categories:
        values = sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect())  # the columns to make
        out = one_hot(out, c, values)
    return out
