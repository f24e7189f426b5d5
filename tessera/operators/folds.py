"""Fold construction and resampling; folds are columns, keyed by row ids."""

from __future__ import annotations

import datetime as dt
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import hash_number
from tessera.operators.ranks import hashed_row_number


def kfold(df: DataFrame, ids: list[str], folds: int, seed: int = 0) -> DataFrame:
    """``fold`` by a hash of the ids: no shuffle, sizes equal up to chance."""
    return df.withColumn("fold", (hash_number(*[F.col(c) for c in ids], seed=seed) % folds).cast("int"))


def kfold_exact(df: DataFrame, ids: list[str], folds: int, seed: int = 0) -> DataFrame:
    """``fold`` with sizes that differ by one at most."""
    return hashed_row_number(df, ids, [], seed).withColumn("fold", ((F.col("rn") - 1) % folds).cast("int")).drop("rn")


def group_kfold(df: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` by group, so no group is split."""
    return kfold(df, [group], folds, seed)


def stratified_kfold(df: DataFrame, ids: list[str], label: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` with counts of each label that differ by one at most."""
    return hashed_row_number(df, ids, [label], seed).withColumn("fold", ((F.col("rn") - 1) % folds).cast("int")).drop("rn")


def stratified_group_kfold(df: DataFrame, group: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """``fold`` by group with label shares as even as a greedy pass makes them.

    Groups with the same label counts are interchangeable, so the driver sees distinct
    count profiles with their numbers, and groups take their places by rank."""
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # classes of the target
    counts = df.groupBy(group).agg(*[F.sum(F.col(label).eqNullSafe(F.lit(v)).cast("long")).alias(f"n{k}") for k, v in enumerate(labels)])
    names = [f"n{k}" for k in range(len(labels))]
    profiles = [tuple(r) for r in counts.groupBy(*names).agg(F.count(F.lit(1)).alias("m")).orderBy(*names).toLocalIterator()]
    profiles.sort(key=lambda r: (-(statistics.pstdev(r[:-1]) if len(r) > 2 else 0), r))
    total = [max(1, sum(r[k] * r[-1] for r in profiles)) for k in range(len(labels))]
    have = [[0] * len(labels) for _ in range(folds)]
    places = []
    for r in profiles:
        given = [0] * folds
        for _ in range(min(r[-1], folds)) if r[-1] <= folds else [None]:
            if r[-1] > folds:
                # Many equal groups: whole rounds first, the rest one by one below.
                for f in range(folds):
                    given[f] += r[-1] // folds
                    have[f] = [h + c * (r[-1] // folds) for h, c in zip(have[f], r[:-1], strict=True)]
                break
        for _ in range(r[-1] - sum(given)):
            best, at = None, 0
            for f in range(folds):
                trial = [[h + c for h, c in zip(have[x], r[:-1], strict=True)] if x == f else have[x] for x in range(folds)]
                cost = sum(statistics.pstdev([trial[x][k] / total[k] for x in range(folds)]) for k in range(len(labels)))
                if best is None or cost < best - 1e-12:
                    best, at = cost, f
            given[at] += 1
            have[at] = [h + c for h, c in zip(have[at], r[:-1], strict=True)]
        low = 0
        for f, n in enumerate(given):
            if n:
                places.append((*r[:-1], low, low + n, f))
                low += n
    ranked = hashed_row_number(counts, [group], names, seed)
    spark = df.sparkSession
    table = spark.createDataFrame(places or [(*[0] * len(labels), 0, 0, 0)], ", ".join([f"p{k} long" for k in range(len(labels))] + ["low long", "high long", "fold int"]))
    on = [ranked[f"n{k}"] == table[f"p{k}"] for k in range(len(labels))] + [ranked["rn"] > table["low"], ranked["rn"] <= table["high"]]
    found = ranked.join(table, on).select(F.col(group).alias("__g"), "fold")
    return df.join(found, df[group].eqNullSafe(found["__g"])).drop("__g")


def sliding_windows(last: dt.date, splits: int, train_days: int, valid_days: int, step_days: int) -> list[tuple[int, dt.date, dt.date, dt.date]]:
    """``(split, train_first, valid_first, valid_last)``, the last split ending on ``last``."""
    out = []
    for i in range(splits):
        first = last - dt.timedelta(days=(splits - (i + 1)) * step_days + train_days + valid_days - 1)
        valid = first + dt.timedelta(days=train_days)
        out.append((i, first, valid, valid + dt.timedelta(days=valid_days - 1)))
    return out


def sliding_split(df: DataFrame, date: str, splits: int, train_days: int, valid_days: int, step_days: int) -> DataFrame:
    """Rows with ``split`` and ``role``, one a split they belong to."""
    last = df.agg(F.max(F.to_date(date))).first()[0]
    if last is None:
        return df.withColumns({"split": F.lit(0), "role": F.lit("train")}).where("false")
    day = F.to_date(date)
    options = [
        F.when((day >= F.lit(a)) & (day < F.lit(b)), F.struct(F.lit(i).alias("split"), F.lit("train").alias("role"))).when((day >= F.lit(b)) & (day <= F.lit(c)), F.struct(F.lit(i).alias("split"), F.lit("valid").alias("role")))
        for i, a, b, c in sliding_windows(last, splits, train_days, valid_days, step_days)
    ]
    return df.withColumn("__s", F.explode(F.filter(F.array(*options), lambda s: s.isNotNull()))).select("*", "__s.split", "__s.role").drop("__s")


def weekday_refined(split: DataFrame, date: str, windows, day: int) -> DataFrame:
    """Validation rows on the weekday of each split's ``day``-th validation day (from 1); all
    training rows on that weekday too."""
    wanted = {i: (b + dt.timedelta(days=day - 1)).isoweekday() for i, _, b, _ in windows}
    keep = F.lit(False)
    for i, d in wanted.items():
        keep = keep | ((F.col("split") == i) & (F.weekday(F.to_date(date)) + 1 == d))
    return split.where(keep)


def date_hold_out(df: DataFrame, date: str, threshold) -> DataFrame:
    """``role``: train before the threshold, valid from it on."""
    return df.withColumn("role", F.when(F.col(date) < F.lit(threshold), "train").otherwise("valid"))


VALIDATIONS = {"kfold": kfold, "kfold_exact": kfold_exact, "group_kfold": group_kfold, "stratified_kfold": stratified_kfold, "stratified_group_kfold": stratified_group_kfold, "slide_window_split_by_day": sliding_split, "date_hold_out": date_hold_out}


def validation(name: str, df: DataFrame, *args, cache: str | None = None, ids: tuple[str, ...] = (), **options) -> DataFrame:
    """Folds by name; with ``cache``, ``ids`` and the fold are kept there as Parquet and a
    second call with equal name and options reads them."""
    if name not in VALIDATIONS:
        raise ValueError(f"unknown validation {name!r}; known: {sorted(VALIDATIONS)}")
    if not cache:
        return VALIDATIONS[name](df, *args, **options)
    import hashlib

    path = f"{cache.rstrip('/')}/{name}-{hashlib.md5(repr((args, sorted(options.items()), ids)).encode()).hexdigest()}"
    spark = df.sparkSession
    try:
        table = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        made = VALIDATIONS[name](df, *args, **options)
        made.select(*ids, *[c for c in ("fold", "split", "role") if c in made.columns and c not in df.columns]).write.parquet(path)
        table = spark.read.parquet(path)
    return df.join(table, list(ids))


def under_sample(df: DataFrame, ids: list[str], label: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest class has, by hash order."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    return hashed_row_number(df, ids, [label], seed).where(F.col("rn") <= least).drop("rn")


def smote(df: DataFrame, ids: list[str], label: str, features: list[str], neighbours: int = 5, seed: int = 0, bucket: int = 512) -> DataFrame:
    """Raise every class to the size of the largest by points between a row and one of its
    nearest neighbours of the same class.

    Neighbours are exact inside cells of about ``bucket`` rows, cut by random projection
    ranges, so no class is compared in full; made rows have null ids."""
    import numpy as np
    import pandas as pd

    sizes = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # classes
    if not sizes:
        return df
    most = max(sizes.values())
    rng = np.random.default_rng(seed)
    direction = rng.normal(size=len(features)).tolist()
    rows = df.select(*ids, label, *[F.col(c).cast("double").alias(c) for c in features])
    along = sum((F.col(c) * w for c, w in zip(features, direction, strict=True)), F.lit(0.0))
    rows = rows.withColumn("__p", along)
    cells = max(1, -(-most // bucket))
    cuts = {}
    for v in sizes:
        q = rows.where(F.col(label) == F.lit(v)).agg(F.percentile_approx("__p", [k / cells for k in range(1, cells)] or [0.5], 10_000)).first()[0]
        cuts[v] = sorted(set(q or [])) if cells > 1 else []
    cell = F.lit(0)
    for v, c in cuts.items():
        if c:
            cell = F.when(F.col(label) == F.lit(v), F.size(F.filter(F.array(*[F.lit(x) for x in c]), lambda e: F.col("__p") > e))).otherwise(cell)
    need = F.lit(0.0)
    for v, n in sizes.items():
        need = F.when(F.col(label) == F.lit(v), F.lit((most - n) / n)).otherwise(need)
    rows = hashed_row_number(rows.withColumn("__cell", cell).withColumn("__need", need), ids, [label], seed)
    # Row number r of a class makes floor(r * need) - floor((r - 1) * need) points: in all, what is missing.
    rows = rows.withColumn("__make", (F.floor(F.col("rn") * F.col("__need") + 1e-9) - F.floor((F.col("rn") - 1) * F.col("__need") + 1e-9)).cast("int"))
    rows = rows.withColumn("__seed", hash_number(*[F.col(c) for c in ids], seed=seed))
    kinds = dict(df.dtypes)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[features].to_numpy(dtype=float)
        out = []
        for k in np.flatnonzero(pdf["__make"].to_numpy() > 0):
            d = ((x - x[k]) ** 2).sum(axis=1)
            d[k] = np.inf
            near = np.argsort(d, kind="stable")[: min(neighbours, len(x) - 1)]
            r = np.random.default_rng(int(pdf["__seed"].iloc[k]))
            for _ in range(int(pdf["__make"].iloc[k])):
                j = k if not len(near) else near[r.integers(len(near))]
                out.append(x[k] + r.random() * (x[j] - x[k]))
        made = pd.DataFrame(out, columns=features)
        made.insert(0, label, pdf[label].iloc[0])
        return made

    made = rows.groupBy(label, "__cell").applyInPandas(grow, ", ".join([f"{label} {kinds[label]}"] + [f"{c} double" for c in features]))
    return df.select(*ids, label, *[F.col(c).cast("double").alias(c) for c in features]).unionByName(made, allowMissingColumns=True)


SAMPLINGS = {"none": lambda df, *a, **k: df, "random_under_sampling": under_sample, "smote": smote, "random_under_sampling_and_smote": lambda df, ids, label, features, **k: smote(under_sample(df, ids, label), ids, label, features, **k)}


def sampling(name: str, df: DataFrame, *args, **options) -> DataFrame:
    if name not in SAMPLINGS:
        raise ValueError(f"unknown sampling {name!r}; known: {sorted(SAMPLINGS)}")
    return SAMPLINGS[name](df, *args, **options)
