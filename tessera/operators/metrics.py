"""Evaluation metrics as aggregates, threshold search, truncated evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import focal_loss, hash_number
from tessera.operators.ranks import hashed_row_number, running_sums


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y.cast("double") - p.cast("double"), F.lit(2.0))))


def rmsle(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.log1p(y.cast("double")) - F.log1p(p.cast("double")), F.lit(2.0))))


def mean_focal_loss(y: Column, raw: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    return F.avg(focal_loss(y, raw, alpha, gamma))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """``pr_auc``: sum of recall steps times precision over distinct scores, ties together."""
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = running_sums(counts, score, ["tp", "n"], descending=True)
    total = counts.agg(F.sum("tp").alias("pos"))
    return run.crossJoin(F.broadcast(total)).agg(F.sum(F.try_divide(F.col("tp"), F.col("pos")) * F.col("run_tp") / F.col("run_n")).alias("pr_auc"))  # one row


def quadratic_weighted_kappa(df: DataFrame, y: str, p: str, top: int = 3) -> DataFrame:
    """``qwk`` of integer grades 0..top; predicted grades that never occur in y are left out
    of the expected histogram."""
    counts = df.groupBy(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    r = counts.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("y") - F.col("p"), F.lit(2.0))).alias("observed"),
        *[F.coalesce(F.sum(F.when(F.col("y") == k, F.col("n"))), F.lit(0)).alias(f"a{k}") for k in range(top + 1)],
        *[F.coalesce(F.sum(F.when(F.col("p") == k, F.col("n"))), F.lit(0)).alias(f"b{k}") for k in range(top + 1)],
    )
    expected = F.lit(0.0)
    for i in range(top + 1):
        for j in range(top + 1):
            expected = expected + F.when(F.col(f"a{j}") > 0, F.col(f"a{i}") * F.col(f"b{j}")).otherwise(0) * float((i - j) ** 2)
    return r.select((1 - F.try_divide(F.col("observed"), expected / F.col("n"))).alias("qwk"))


def confusion(df: DataFrame, y: str, p: str, normalise: bool = False) -> DataFrame:
    """``y, p, n`` (and ``share`` of the row)."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y"))) if normalise else counts


def fold_timeline(df: DataFrame, date: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min(date).alias("first"), F.max(date).alias("last"))


def density(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts of a prediction in equal bins, ends included."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / (high - low) * bins).cast("int")))
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# -- thresholds -----------------------------------------------------------------


def _kappa(hist: dict[tuple[int, float], int], cuts: list[float], closed_left: bool) -> float:
    """Kappa of cut scores from an aggregated histogram of (grade, score)."""
    from bisect import bisect_left, bisect_right

    side = bisect_right if closed_left else bisect_left
    top = len(cuts)
    a, b, n, observed = [0] * (top + 1), [0] * (top + 1), 0, 0.0
    for (y, s), c in hist.items():
        p = side(cuts, s)
        n += c
        observed += c * (y - p) ** 2
        if 0 <= y <= top:
            a[y] += c
        b[p] += c
    expected = sum(a[i] * b[j] * (i - j) ** 2 for i in range(top + 1) for j in range(top + 1) if a[j]) / max(1, n)
    return 1 - observed / expected if expected else 0.0


def score_histogram(df: DataFrame, y: str, score: str, step: float = 1e-4) -> dict[tuple[int, float], int]:
    """Counts of (grade, score rounded to ``step``); its size is bounded by the step, not by
    the rows."""
    s = F.round(F.col(score).cast("double") / step).cast("long")
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(y).cast("int").alias("y"), s.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return {(r["y"], r["s"] * step): r["n"] for r in rows.toLocalIterator()}


def golden_section(objective, start: list[tuple[float, float]], outer: int = 5, inner: int = 5, reverse: bool = False) -> list[float]:
    """Coordinate search of ascending thresholds, the interval of each cut by the golden
    ratio ``inner`` times, ``outer`` rounds; ``objective`` is maximised."""
    ratio = 0.618
    cuts = [(a + b) / 2 for a, b in start]
    for _ in range(outer):
        for k in reversed(range(len(cuts))) if reverse else range(len(cuts)):
            a, b = start[k]
            at = lambda x, k=k: objective(sorted([*cuts[:k], x, *cuts[k + 1 :]]))
            for _ in range(inner):
                x1, x2 = b - ratio * (b - a), a + ratio * (b - a)
                if at(x1) > at(x2):
                    b = x2
                else:
                    a = x1
            best = max((a, b, (a + b) / 2, cuts[k]), key=at)
            cuts[k] = best
    return sorted(cuts)


def simplex_search(objective, start: list[float], steps: int = 200) -> list[float]:
    """Nelder-Mead minimisation in a few dimensions."""
    points = [list(start)] + [[v + (0.05 * v if v else 0.025) * (k == i) for k, v in enumerate(start)] for i in range(len(start))]
    vals = [objective(p) for p in points]
    for _ in range(steps):
        order = sorted(range(len(points)), key=vals.__getitem__)
        points, vals = [points[k] for k in order], [vals[k] for k in order]
        if abs(vals[-1] - vals[0]) < 1e-12 and max(abs(a - b) for a, b in zip(points[0], points[-1], strict=True)) < 1e-9:
            break
        mid = [sum(p[k] for p in points[:-1]) / (len(points) - 1) for k in range(len(start))]
        move = lambda t: [m + t * (m - w) for m, w in zip(mid, points[-1], strict=True)]
        r = move(1.0)
        fr = objective(r)
        if fr < vals[0]:
            e = move(2.0)
            fe = objective(e)
            points[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            points[-1], vals[-1] = r, fr
        else:
            c = move(0.5 if fr < vals[-1] else -0.5)
            fc = objective(c)
            if fc < min(fr, vals[-1]):
                points[-1], vals[-1] = c, fc
            else:
                points = [points[0]] + [[(a + b) / 2 for a, b in zip(points[0], p, strict=True)] for p in points[1:]]
                vals = [vals[0]] + [objective(p) for p in points[1:]]
    return points[min(range(len(points)), key=vals.__getitem__)]


def fit_thresholds(df: DataFrame, y: str, score: str, method: str = "golden", start=((0.01, 0.5), (0.5, 0.7), (0.7, 0.9)), reverse: bool = False) -> list[float]:
    """Three thresholds that maximise kappa, searched on one aggregated histogram."""
    hist = score_histogram(df, y, score)
    return search_thresholds(hist, method, start, reverse)


def search_thresholds(hist, method: str = "golden", start=((0.01, 0.5), (0.5, 0.7), (0.7, 0.9)), reverse: bool = False) -> list[float]:
    if method == "golden":
        return golden_section(lambda c: _kappa(hist, c, True), list(start), reverse=reverse)
    return sorted(simplex_search(lambda c: -_kappa(hist, sorted(c), False), [(a + b) / 2 for a, b in start]))


def fit_thresholds_by_group(df: DataFrame, group: str, y: str, score: str, step: float = 1e-3) -> DataFrame:
    """``group, c0, c1, c2``: thresholds of each group, from its aggregated histogram."""
    import pandas as pd

    kind = dict(df.dtypes)[group]
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(group, F.col(y).cast("int").alias("y"), F.round(F.col(score) / step).cast("long").alias("s")).agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = {(int(a), b * step): int(c) for a, b, c in zip(pdf["y"], pdf["s"], pdf["n"], strict=True)}
        c = search_thresholds(hist)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "c0": [c[0]], "c1": [c[1]], "c2": [c[2]]})

    return rows.groupBy(group).applyInPandas(fit, f"{group} {kind}, c0 double, c1 double, c2 double")


# -- truncated evaluation ---------------------------------------------------------


def truncated_draws(df: DataFrame, group: str, ids: list[str], trials: int, seed: int = 0) -> DataFrame:
    """One row a group and trial: the row with the smallest hash of (trial, id)."""
    h = F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.struct(t.alias("trial"), hash_number(F.lit(seed), t, *[F.col(c) for c in ids]).alias("h")))
    rest = [c for c in df.columns if c != group]
    long = df.select("*", F.explode(h).alias("__t"))
    best = long.groupBy(group, F.col("__t.trial").alias("trial")).agg(F.min_by(F.struct(*rest), F.struct("__t.h", *ids)).alias("__r"))
    return best.select(group, "trial", "__r.*")


def truncated_evaluation(draws: DataFrame, metric: Column) -> DataFrame:
    """``mean, std, low, high`` of a metric over trials (mean and two population std)."""
    per = draws.groupBy("trial").agg(metric.alias("m"))
    r = per.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))
    return r.select("mean", "std", (F.col("mean") - 2 * F.col("std")).alias("low"), (F.col("mean") + 2 * F.col("std")).alias("high"))


def _stratum_counts(groups: list[int], shares: list[float]) -> list[int]:
    """Rows to draw of each stratum: the most that keep the shares (largest remainders), for
    numbers of groups by their deepest stratum."""
    whole = sum(shares)
    tails = [sum(groups[s:]) for s in range(len(shares))]
    total = min(int(t * whole / sum(shares[s:]) + 1e-9) for s, t in enumerate(tails) if sum(shares[s:]) > 0)
    while True:
        exact = [total * x / whole for x in shares]
        counts = [int(x + 1e-9) for x in exact]
        for s in sorted(range(len(shares)), key=lambda s: (counts[s] - exact[s], s))[: total - sum(counts)]:
            counts[s] += 1
        if total <= 0 or all(sum(counts[s:]) <= t for s, t in enumerate(tails)):
            return counts
        total -= 1


def _stratum_deal(groups: list[int], counts: list[int], rng):
    """``[stratum, depth]``: how many groups of each depth serve a stratum in one trial.  From
    the first stratum on, drawn evenly from the unused groups that are deep enough, as far
    as later strata keep theirs."""
    import numpy as np

    free, counts = np.array(groups, dtype=np.int64), np.array(counts, dtype=np.int64)
    out = np.zeros((len(groups), len(groups)), dtype=np.int64)
    for s in range(len(groups)):
        able = free.copy()
        able[:s] = 0
        x = rng.multivariate_hypergeometric(able, counts[s])
        for j in range(len(groups) - 1, s, -1):
            over = x[j:].sum() - (free[j:].sum() - counts[j:].sum())
            if over > 0:
                x[j:] -= rng.multivariate_hypergeometric(x[j:], over)
                room = able - x
                room[j:] = 0
                x += rng.multivariate_hypergeometric(room, over)
        out[s] = x
        free -= x
    return out


def adjusted_draws(df: DataFrame, group: str, order: list[str], shares: list[float], trials: int, seed: int = 0, later_rows: bool = False) -> DataFrame:
    """Rows of each stratum (position in the group: 1st, 2nd, ..., last and later) in given
    shares; a group serves one stratum a trial.

    Each trial has the same exact counts, the most that keep the shares; strata are dealt in
    turn to unused groups that are deep enough, in hash order.  The last stratum gives one of
    its rows a group, or with ``later_rows`` its count of rows out of all later rows of the
    groups left."""
    import numpy as np

    last = len(shares) - 1
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    rows = df.where(F.col(group).isNotNull()).withColumn("stratum", F.least(nth, F.lit(last)).cast("int"))
    depth = rows.groupBy(group).agg(F.max("stratum").alias("__deep"))
    sizes = {r[0]: r[1] for r in depth.groupBy("__deep").agg(F.count(F.lit(1))).collect()}  # strata
    groups = [sizes.get(d, 0) for d in range(last + 1)]
    counts = _stratum_counts(groups, shares)
    plan = []
    for t in range(trials):
        ends = _stratum_deal(groups, counts, np.random.default_rng([seed, t])).cumsum(axis=0)
        for d in range(last + 1):
            for s in range(d + 1):
                high = groups[d] if later_rows and s == last else int(ends[s, d])
                plan.append((t, d, s, int(ends[s - 1, d]) if s else 0, high))
    plan = df.sparkSession.createDataFrame(plan, "trial int, __deep int, __pick int, __low long, __high long")  # trials times strata squared
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    dealt = hashed_row_number(depth.select(F.col(group).alias("__g"), "__deep", trial), ["__g", "trial"], ["trial", "__deep"], seed, name="__rn")
    dealt = dealt.join(F.broadcast(plan), ["trial", "__deep"]).where((F.col("__rn") > F.col("__low")) & (F.col("__rn") <= F.col("__high"))).select("__g", "trial", "__pick")
    both = rows.join(dealt, (rows[group] == dealt["__g"]) & (rows["stratum"] == dealt["__pick"])).drop("__g", "__pick")
    rest = [c for c in both.columns if c not in (group, "trial")]
    if later_rows:
        late = hashed_row_number(both.where(F.col("stratum") == last), [group, *order, "trial"], ["trial"], seed + 1, name="__rn").where(F.col("__rn") <= counts[last])
        return both.where(F.col("stratum") < last).select(group, "trial", *rest).unionByName(late.select(group, "trial", *rest))
    best = both.groupBy(group, "trial").agg(F.min_by(F.struct(*rest), F.struct(hash_number(F.lit(seed + 1), F.col("trial"), *[F.col(c) for c in order]), *order)).alias("__r"))
    return best.select(group, "trial", "__r.*")


def equal_bins(df: DataFrame, ids: list[str], bins: int, seed: int = 0) -> DataFrame:
    """Rows dealt evenly to bins by hash order."""
    return hashed_row_number(df, ids, [], seed).withColumn("bin", ((F.col("rn") - 1) % bins).cast("int")).drop("rn")


def shapiro_wilk(values) -> float | None:
    """W statistic (Royston 1995) of more than three values, else None."""
    import numpy as np

    x = np.sort(np.asarray([v for v in values if v is not None and not math.isnan(v)], dtype=float))
    n = len(x)
    if n <= 3:
        return None
    from statistics import NormalDist

    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = (m**2).sum()
    u = 1 / math.sqrt(n)
    c = m / math.sqrt(mm)
    a = np.zeros(n)
    an = c[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    if n > 5:
        an1 = c[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = an1, -an1
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = an, -an
    spread = ((x - x.mean()) ** 2).sum()
    return float((a @ x) ** 2 / spread) if spread > 0 else None


def shapiro_by_group(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``sw_stat`` of a column in each group."""
    import pandas as pd

    kinds = dict(df.dtypes)

    def stat(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in key}, "sw_stat": [shapiro_wilk(pdf[value].tolist())]})

    return df.select(*key, F.col(value).cast("double").alias(value)).groupBy(*key).applyInPandas(stat, ", ".join([f"{k} {kinds[k]}" for k in key] + ["sw_stat double"]))
