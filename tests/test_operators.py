"""Operators on small frames worked out by hand: nulls, ties, zero division, edges."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar, text, vectors
from tessera.operators import encode, ensemble, folds, groupby, metrics, models, ranks, select, tables, vectorize
from tessera.operators.groupby import GroupSpec


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 7.0), ("c", float("nan")), ("d", 0.0)]
    return spark.createDataFrame(rows, "k string, v double").withColumn("id", F.monotonically_increasing_id())


def test_group_features_and_nulls(small):
    spec = GroupSpec(("k",), ("v",), ("mean", "std", "count", "nunique", "sum"))
    out = {r["id"]: r for r in groupby.ratios(groupby.differences(groupby.join_back(small, [spec]), [spec]), [spec]).collect()}
    rows = {r["id"]: r for r in small.collect()}
    by = {(rows[i]["k"], rows[i]["v"]): out[i] for i in rows if rows[i]["v"] == rows[i]["v"]}
    assert by["a", 1.0]["mean_v_groupby_k"] == 2.0 and by["a", 1.0]["count_v_groupby_k"] == 2
    assert by["a", 1.0]["diff_mean_v_groupby_k"] == 1.0 and by["a", 3.0]["ratio_mean_v_groupby_k"] == pytest.approx(2 / 3)
    assert by["b", 5.0]["std_v_groupby_k"] is None  # one row has no sample deviation
    assert by[None, 7.0]["mean_v_groupby_k"] is None  # a null key matches no group
    assert by["d", 0.0]["ratio_mean_v_groupby_k"] is None  # division by zero
    assert len(out) == 7


def test_statistics(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 10.0)] + [(2, 4.0)], "g int, v double")
    names = ("median_absolute_deviation", "mean_variance", "hl_ratio", "beyond1std_ratio", "iqr_ratio", "range_diff", "range_per")
    t = groupby.aggregate(df, [GroupSpec(("g",), ("v",), names)])[("g",)]
    r = {x["g"]: x for x in t.collect()}
    at = lambda g, n: r[g][f"{n}_v_groupby_g"]
    assert at(1, "median_absolute_deviation") == 1.0 and at(1, "hl_ratio") == pytest.approx(1 / 3)
    assert at(1, "mean_variance") == pytest.approx(math.sqrt(12.5) / 4) and at(1, "beyond1std_ratio") == 0.25
    assert at(1, "iqr_ratio") == pytest.approx(4.75 / 1.75) and at(1, "range_diff") == 9 and at(1, "range_per") == 10
    assert at(2, "hl_ratio") is None and at(2, "beyond1std_ratio") == 1.0
    many = [GroupSpec(("g",), ("v",), ("mean", "sum", "min", "max"))]
    assert len(groupby.aggregate(df, many, width=2)[("g",)].columns) == 5


def test_frequency_and_relative(small):
    out = groupby.frequency(small, ["k"])
    got = {r["k"]: r["k_Frequency"] for r in out.collect()}
    assert got["a"] == pytest.approx(3 / 7) and got[None] is None
    rel = {r["v"]: r for r in groupby.relative(small.where("k = 'a'"), ["k"], "v").collect()}
    assert rel[1.0]["v_diff"] == -1.0 and rel[1.0]["v_ratio"] == 0.5 and rel[1.0]["v_zscore"] == -1.0


def test_scalars(spark):
    df = spark.createDataFrame([(None, 0.5, "ffffffffffffffff"), (2.0, float("inf"), "x00000000000000010"), (-1.0, 1.0, None)], "a double, b double, h string")
    r = df.select(scalar.clip(F.col("a")).alias("c"), scalar.fill(F.col("b"), -999.0).alias("f"), scalar.hex_to_long(F.col("h")).alias("h"), scalar.digitize(F.col("b"), [0.5, 1.0]).alias("d"), scalar.cut(F.col("b"), [0.5, 1.0]).alias("u"), scalar.ratio(F.col("a"), F.lit(0)).alias("z")).collect()
    assert [x["c"] for x in r] == [None, 1.0, 0.0]
    assert [x["f"] for x in r] == [0.5, -999.0, 1.0] and [x["h"] for x in r] == [-1, 16, None]
    assert [x["d"] for x in r] == [1, 2, 2] and [x["u"] for x in r] == [0, 2, 1] and {x["z"] for x in r} == {None}
    assert scalar.shift_number("shift_12_x") == 12 and scalar.shift_number("x") is None
    q = spark.range(1).select(*[scalar.normal_quantile(F.lit(p)).alias(f"p{k}") for k, p in enumerate((0.5, 0.975, 0.01))]).first()
    assert q[0] == pytest.approx(0, abs=1e-8) and q[1] == pytest.approx(1.959964, abs=1e-6) and q[2] == pytest.approx(-2.326348, abs=1e-6)
    s = spark.range(1).select(scalar.softmax_expectation(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), 3.0).alias("s")).first()[0]
    assert s == pytest.approx(0.5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x",)], "a string").select(scalar.strict_number(F.col("a"), "tbd")).collect()


def test_text_features(spark):
    rows = [("",), (None,), ("  ",), ("Ñandú ñ 😀 A! :-) ;) a?",)]
    r = text.with_basic_features(spark.createDataFrame(rows, "t string"), ["t"]).collect()
    assert [x["t_num_chars"] for x in r] == [0, 0, 2, 22]
    assert r[3]["t_num_capitals"] == 2 and r[3]["t_num_words"] == 7 and r[3]["t_num_unique_words"] == 7
    assert r[3]["t_num_exclamation_marks"] == 1 and r[3]["t_num_question_marks"] == 1 and r[3]["t_num_smilies"] == 2
    assert r[0]["t_caps_vs_length"] is None and r[0]["t_words_vs_unique"] is None


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 6.0]), (2, []), (3, None)], "k int, v array<double>")
    got = {r["k"]: r for r in df.select("k", *[c.alias(n) for n, c in vectors.row_statistics(F.col("v")).items()]).collect()}
    assert (got[1]["mean"], got[1]["median"], got[1]["sum"], got[1]["max"], got[1]["min"]) == (3.0, 2.0, 9.0, 6.0, 1.0)
    assert got[1]["var"] == pytest.approx(14 / 3) and got[2]["mean"] is None and got[3]["mean"] is None


def test_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id int, n string")
    b = spark.createDataFrame([(1, 10), (3, 30)], "key int, w int")
    assert {(r["n"], r["r_w"]) for r in tables.left_join(a, b, ["id"], ["key"], "r_").collect()} == {("x", 10), ("y", None), ("z", None)}
    assert tables.sanitise_names(["a b", "c-d", "é"]) == ["a_b", "c_d", "é"]
    twice = a.select("id", "n", F.col("id"))
    assert tables.drop_duplicate_columns(twice).columns == ["id", "n"]
    first = tables.keep_first(spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 1, "c"), (None, 1, "d"), (None, 2, "e")], "k int, o int, v string"), ["k"], ["o"])
    assert {(r["k"], r["v"]) for r in first.collect()} == {(1, "b"), (2, "c"), (None, "d")}
    last = tables.keep_first(spark.createDataFrame([(1, 5, "a"), (1, 3, "b")], "k int, o int, v string"), ["k"], ["o"], last=True)
    assert last.first()["v"] == "a"
    with pytest.raises(ValueError, match="two tables"):
        tables.join_all([a, a], ["id"])
    with pytest.raises(Exception, match="different rows"):
        tables.join_rows([a.where("id = 1"), b.withColumnRenamed("key", "id")], "id").collect()
    s = tables.stack([a, b], ["train", "test"])
    assert s.count() == 5 and set(s.columns) == {"id", "n", "key", "w", "split"}


def test_ranks_do_not_depend_on_buckets(spark):
    df = spark.range(500).withColumn("g", (F.col("id") % 3).cast("int"))
    a = {r["id"]: r["rn"] for r in ranks.hashed_row_number(df, ["id"], ["g"], buckets=1).collect()}
    b = {r["id"]: r["rn"] for r in ranks.hashed_row_number(df.repartition(7), ["id"], ["g"], buckets=64).collect()}
    assert a == b and sorted(v for k, v in a.items() if k % 3 == 0) == list(range(1, 168))
    sums = ranks.running_sums(df.select("id", "g", F.lit(1).alias("b")), "id", ["b"], ["g"], buckets=8, descending=True)
    assert {r["id"]: r["run_b"] for r in sums.collect()} == {k: (499 - k) // 3 + 1 for k in range(500)}


def test_fill(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None)], "g string, o int, v double")
    got = {(r["g"], r["o"]): r["v"] for r in ranks.forward_backward_fill(df, ["v"], ["g"], ["o"]).collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): None}


def test_encoders(spark):
    df = spark.createDataFrame([("x", 1.0, 0), ("y", 0.0, 0), ("x", 0.0, 1), (None, 1.0, 1), ("z", 1.0, 1)], "c string, y double, fold int")
    codes = {r["c"]: r["c_code"] for r in encode.label_encode(df, ["c"]).collect()}
    assert codes == {"x": 0, "y": 1, "z": 2, None: None}
    fitted = {"c": encode.label_table(df.where("c <> 'z'"), "c")}
    assert {r["c"]: r["c_code"] for r in encode.label_encode(df, ["c"], fitted, unknown=-1).collect()}["z"] == -1
    te = {(r["c"], r["fold"]): r["c_TE"] for r in encode.target_encode(df, ["c"], "y", "fold").collect()}
    assert te["x", 0] == 0.0 and te["x", 1] == 1.0 and te["y", 0] is None and te["z", 1] is None
    smooth = {(r["c"], r["fold"]): r["c_TE"] for r in encode.target_encode(df, ["c"], "y", "fold", 0.3).collect()}
    assert smooth["y", 0] == pytest.approx(2 / 3) and smooth["x", 1] == pytest.approx((1 + 0.3 * 0.5) / 1.3)
    hot = encode.one_hot(df, "c", ["x", "y"]).collect()
    assert [(r["c_x"], r["c_y"], r["c_missing"]) for r in hot] == [(1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    combi = encode.combine(df.withColumn("d", F.lit("q")), ["c", "d"], (2,)).collect()
    assert combi[0]["c_d_combi"] == f"x{encode.SEPARATOR}q" and combi[3]["c_d_combi"] == f"none{encode.SEPARATOR}q"
    n = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    g = {r["v"]: r["v_gauss"] for r in encode.rank_gauss(n, n.union(spark.createDataFrame([(None,), (5000.0,), (-1.0,)], "v double")), "v").collect()}
    assert g[500.0] == pytest.approx(0, abs=1e-6) and g[5000.0] == pytest.approx(5.199, abs=1e-2) and g[-1.0] == pytest.approx(-5.199, abs=1e-2) and g[None] is None
    vals = [g[float(k)] for k in range(1001)]
    assert vals == sorted(vals)


@pytest.mark.parametrize("buckets", [2, 4096])
def test_exact_quantiles(spark, buckets):
    at = [k / 999 for k in range(1000)] + [0.5]
    spread = [(-1.0) ** k * (k * 7919 % 5003) / 7 for k in range(6000)]
    odd = [0.0] * 4000 + [-0.0, 1e300, -1e300, 5e-324, 1e-9, -1.5] + spread[:50] + [None, float("nan"), float("inf"), float("-inf")]
    for values in (spread, odd, [3.25], [2.0, 1.0], [7.0] * 30):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        whole = df.where("v > double('-inf') and v < double('inf')").agg(F.percentile("v", F.array(*[F.lit(a) for a in at]))).first()[0]
        assert ranks.exact_quantiles(df, "v", at, buckets) == whole
    assert ranks.exact_quantiles(spark.createDataFrame([(None,), (float("nan"),)], "v double"), "v", at, buckets) == []


def test_rank_gauss_gathers_no_values_and_compiles(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("one task gathers all distinct values"))
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, (F.col("id") % 1700).cast("double")).alias("v"))
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code that does not compile is an error then
    try:
        got = {r["id"]: (r["v"], r["v_gauss"]) for r in encode.rank_gauss(rows, rows, "v").collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    train = np.array([v for v, _ in got.values() if v is not None])
    edges, at = np.quantile(train, np.linspace(0, 1, 1000)), np.linspace(0, 1, 1000)
    assert len(got) == 5000 and all((v is None) == (g is None) for v, g in got.values())
    for v, g in got.values():
        if v is not None:
            p = (np.interp(v, edges, at) - np.interp(-v, -edges[::-1], -at[::-1])) / 2
            assert g == pytest.approx(statistics.NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-6)


def test_linear_features_fit_means_once_and_compile(spark, monkeypatch):
    from tessera.plans.recipes import linear_features

    means = []
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("one task gathers all distinct values"))
    monkeypatch.setattr(F, "avg", lambda c, f=F.avg: means.append(c) or f(c))
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 > 0, F.rand(5) * 100 - 3).alias("v"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 2)).alias("c"))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {r["id"]: r for r in linear_features(rows.where("id % 5 > 0"), rows, ["v"], ["c"]).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(means) == 1 and len(got) == 6000
    train, at = np.array([r["v"] for k, r in got.items() if k % 5]), np.linspace(0, 1, 1000)
    edges = np.quantile(train, at)
    for k, r in got.items():
        if k % 3 == 0:
            assert r["v"] == got[0]["v"]  # the training rows' mean, a third of all rows
        p = (np.interp(r["v"], edges, at) - np.interp(-r["v"], -edges[::-1], -at[::-1])) / 2
        assert r["v_gauss"] == pytest.approx(statistics.NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-6)
        assert (r["c_k0"], r["c_k1"], r["c_missing"]) == (int(k % 7 > 0 and k % 2 == 0), int(k % 7 > 0 and k % 2 == 1), int(k % 7 == 0))
    assert got[0]["v"] == pytest.approx(np.mean([r["v"] for k, r in got.items() if k % 5 and k % 3]), rel=1e-12)


def test_selection(spark):
    rows = [(k, float(k % 7), float(k % 7) * 2 + (k % 2) * 1e-3, -float(k % 7), 1.0, None, "t", None if k % 2 else 1.0) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, a double, b double, m double, one double, none double, t string, half double")
    assert set(select.constant_columns(df)) == {"one", "none", "t"}
    assert select.duplicate_columns(df.withColumn("a2", F.col("a"))) == ["a2"]
    assert select.correlated_columns(df, ["a", "b", "m"]) == ["b", "m"] and select.correlated_columns(df, ["a", "b", "m"], protected=("b",)) == ["m"]
    assert select.greedy_correlated(df, ["a", "b", "m"]) == ["b"]
    mono = df.withColumn("e", F.exp("a"))
    assert select.correlation_table(mono, ["a", "e"], "spearman")["a", "e"] == pytest.approx(1.0)
    x, y = spark.range(200).select(F.col("id").cast("double").alias("v")), spark.range(100).select((F.col("id") + 150).cast("double").alias("v"))
    r = select.ks_table(x, y, ["v"]).first()
    assert r["d"] == pytest.approx(0.75) and (r["n"], r["m"]) == (200, 100)
    assert select.drifted_columns(x, y, ["v"]) == ["v"] and select.drifted_columns(x, x, ["v"]) == []
    assert select.ks_p_value(0.1, 100, 100) == pytest.approx(0.6994, abs=2e-3)
    imp = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0)], "feature string, importance double")
    assert [r[0] for r in select.top_features(imp, 2).collect()] == ["a", "b"] and select.top_features(imp, 0.5).count() == 1
    with pytest.raises(TypeError):
        select.top_features(imp, "2")


def test_folds(spark):
    df = spark.range(1000).select("id", (F.col("id") % 97).alias("g"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    for f in (folds.kfold(df, ["id"], 5), folds.kfold_exact(df, ["id"], 5), folds.stratified_kfold(df, ["id"], "y", 5)):
        assert f.count() == 1000 and {r[0] for r in f.select("fold").distinct().collect()} == set(range(5))
    sizes = [r["n"] for r in folds.kfold_exact(df, ["id"], 7).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    strata = folds.stratified_kfold(df, ["id"], "y", 3).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()
    for y in (0, 1):
        n = [r["n"] for r in strata if r["y"] == y]
        assert max(n) - min(n) <= 1
    for f in (folds.group_kfold(df, "g", 5), folds.stratified_group_kfold(df, "g", "y", 5)):
        assert f.count() == 1000 and f.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    share = folds.stratified_group_kfold(df, "g", "y", 5).groupBy("fold").agg(F.avg("y").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 0.1) < 0.03 and 120 < r["n"] < 280 for r in share)
    w = folds.sliding_windows(dt.date(2020, 1, 31), 2, 10, 5, 5)
    assert w == [(0, dt.date(2020, 1, 12), dt.date(2020, 1, 22), dt.date(2020, 1, 26)), (1, dt.date(2020, 1, 17), dt.date(2020, 1, 27), dt.date(2020, 1, 31))]
    with pytest.raises(ValueError, match="unknown validation"):
        folds.validation("no", df)


def test_fold_cache(spark, tmp_path):
    df = spark.range(50).select("id")
    a = folds.validation("kfold", df, ["id"], 5, cache=f"file://{tmp_path}", ids=("id",))
    b = folds.validation("kfold", df, ["id"], 5, cache=f"file://{tmp_path}", ids=("id",))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 50


def test_sampling(spark):
    df = spark.range(110).select("id", (F.col("id") < 10).cast("int").alias("y"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    under = folds.under_sample(df, ["id"], "y")
    assert sorted(r["count"] for r in under.groupBy("y").count().collect()) == [10, 10]
    up = folds.smote(df, ["id"], "y", ["a", "b"])
    assert sorted(r["count"] for r in up.groupBy("y").count().collect()) == [100, 100]
    made = up.where("id IS NULL").collect()
    assert len(made) == 90 and all(r["y"] == 1 and 0 <= r["a"] <= 9 and r["b"] == pytest.approx(2 * r["a"]) for r in made)
    assert folds.sampling("none", df) is df
    both = folds.sampling("random_under_sampling_and_smote", df, ["id"], "y", ["a", "b"])
    assert sorted(r["count"] for r in both.groupBy("y").count().collect()) == [10, 10]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (0, 0.8, 1), (1, 0.8, 2), (0, 0.1, 0), (1, 0.05, 3)], "y int, s double, p int")
    # Distinct scores down: .9 (1 of 1), .8 (2 of 3), .1 (2 of 4), .05 (3 of 5).
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    grades = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (3, 0)], "y int, p int")
    a, b = {0: 1, 1: 1, 2: 1, 3: 2}, {0: 2, 1: 1, 2: 1, 3: 1}
    expected = sum(a[i] * b[j] * (i - j) ** 2 for i in a for j in b) / 5
    assert metrics.quadratic_weighted_kappa(grades, "y", "p").first()[0] == pytest.approx(1 - 9 / expected)
    c = {(r["y"], r["p"]): r["share"] for r in metrics.confusion(grades, "y", "p", True).collect()}
    assert c[3, 0] == 0.5 and c[0, 0] == 1.0
    f = df.agg(metrics.mean_focal_loss(F.col("y"), F.lit(0.0)).alias("f")).first()[0]
    assert f == pytest.approx((3 * 0.25 + 2 * 0.75) * 0.25 * math.log(2) / 5)
    grad, hess = scalar.focal_gradient(F.lit(1), F.lit(0.3))
    g, h = spark.range(1).select(grad, hess).first()
    assert g < 0 < h
    assert metrics.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]) == pytest.approx(0.79, abs=0.005)
    assert metrics.shapiro_wilk([1, 2, 3]) is None


def test_thresholds(spark):
    rows = [(k % 4, (k % 4) / 4 + 0.05 + (k // 4 % 10) / 100) for k in range(400)]
    df = spark.createDataFrame(rows, "y int, s double").withColumn("g", F.lit(1))
    for cuts in (metrics.fit_thresholds(df, "y", "s"), metrics.fit_thresholds(df, "y", "s", "simplex")):
        assert len(cuts) == 3 and cuts == sorted(cuts)
    by = metrics.fit_thresholds_by_group(df, "g", "y", "s").first()
    assert by["c0"] <= by["c1"] <= by["c2"]
    assert metrics._kappa(metrics.score_histogram(df, "y", "s"), [0.2, 0.45, 0.7], True) == pytest.approx(1.0)
    x = metrics.simplex_search(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, [0.0, 0.0])
    assert x == pytest.approx([1, -2], abs=1e-3)


def test_truncated(spark):
    df = spark.createDataFrame([(g, i, float(i)) for g in range(40) for i in range(1 + g % 6)], "g int, i int, v double")
    draws = metrics.truncated_draws(df, "g", ["g", "i"], 8)
    assert draws.count() == 320 and draws.groupBy("trial").agg(F.count_distinct("g").alias("n")).where("n <> 40").count() == 0
    adjusted = metrics.adjusted_draws(df, "g", ["i"], [1, 1, 1, 1, 1], 8)
    assert adjusted.count() == 320 and adjusted.groupBy("g", "trial").count().where("count > 1").count() == 0
    assert adjusted.where("stratum > 4").count() == 0


def test_adjusted_draws_keep_shares(spark):
    # Half of the groups hold one row; the deepest have 9.
    df = spark.createDataFrame([(g, i) for g in range(400) for i in range(1 if g % 2 else 1 + g % 9)], "g int, i int")
    shares = [0.4, 0.3, 0.15, 0.1, 0.05]
    for later in (False, True):
        out = metrics.adjusted_draws(df, "g", ["i"], shares, 6, later_rows=later).collect()
        for t in range(6):
            mine = [r for r in out if r["trial"] == t]
            drawn = [sum(r["stratum"] == s for r in mine) for s in range(5)]
            assert all(abs(n - len(mine) * s) < 1 for n, s in zip(drawn, shares)) and len(mine) > 250
            assert all(r["stratum"] == min(r["i"], 4) for r in mine) and len({(r["g"], r["i"]) for r in mine}) == len(mine)
            by = {}
            for r in mine:
                by.setdefault(r["g"], set()).add(r["stratum"])
            assert all(len(s) == 1 for s in by.values())
    assert len({tuple(sorted(r["g"] for r in out if r["trial"] == t and r["stratum"] == 0)) for t in range(6)}) == 6
    # Every later row may be drawn, also two of one group.
    few = spark.createDataFrame([(g, i) for g in range(12) for i in range(40)], "g int, i int")
    late = [r for r in metrics.adjusted_draws(few, "g", ["i"], [0.2, 0.2, 0.1, 0.1, 0.4], 30, later_rows=True).collect() if r["stratum"] == 4]
    assert len({(r["g"], r["trial"]) for r in late}) < len(late) and max(r["i"] for r in late) > 30


def test_ensembles(spark):
    df = spark.createDataFrame([(float(k), float(k) + (-1) ** k, float(k) - (-1) ** k, 9.0) for k in range(50)], "y double, a double, b double, c double")
    w, score = ensemble.blend_weights(df, "y", ["a", "b", "c"], 300)
    assert sum(w) == pytest.approx(1) and score < 2
    direct = ensemble.blend(df, ["a", "b", "c"], w).agg(metrics.rmse(F.col("y"), F.col("blend"))).first()[0]
    assert direct == pytest.approx(score)
    w2, s2 = ensemble.blend_by_metric(df, ["a", "b", "c"], lambda p: metrics.rmse(F.col("y"), p), 20)
    assert s2 >= score - 1e-9 and sum(w2) == pytest.approx(1)


def test_models(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 4).cast("string").alias("c"))
    df = df.withColumn("y", F.col("a") * 3 + F.coalesce("b", F.lit(0.0)))
    rows = folds.kfold(df, ["row_id"], 3)
    base = df.agg(F.stddev_pop("y")).first()[0]
    for name in ("lightgbm", "ert", "ridge"):
        r = models.cross_validate(rows, ["a", "b"], "y", metrics.rmse, row_id="row_id", test=df.limit(20), name=name, encode=["c"] if name == "ridge" else None, clip_to=(0.0, 40.0))
        assert r.oof.count() == 300 and r.test.count() == 20 and len(r.scores) == 3 and max(r.scores) < base
        assert set(r.importance) >= {"a", "b"}
    binary = rows.withColumn("y", (F.col("a") > 5).cast("int"))
    m = models.fit(binary, ["a", "b"], "y", "lightgbm", True, maxIter=3)
    p = m.predict(binary).agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= p[0] < p[1] <= 1
    with pytest.raises(ValueError, match="unknown model"):
        models.model("no")
    assert models.halving_rate(0.1, 20, 10, 5, 0.001) == 0.05 and models.halving_rate(0.1, 8, 10, 4, 0.001) == 0.1
    assert models.early_stop([3, 2, 2.5, 2.6], 2) == 1 and models.early_stop([3, 2, 1], 2) is None


def test_array_word_statistics_of_each_dimension(spark):
    rows = [(k, [f"t{(k * j) % 13}" for j in range(k % 5)]) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    vectors = {r[0]: np.array(r[1].toArray()) for r in vectorize.word_vectors(df, "t", 3, window=1, rounds=20).getVectors().collect()}
    got = {r["k"]: r.asDict() for r in vectorize.array_word_statistics(df, "k", "t", 3, rounds=20).collect()}
    assert len(got) == 30 and len(got[1]) == 1 + 6 * 3
    for k, tokens in rows:
        for name, f in {"mean": np.mean, "median": np.median, "sum": np.sum, "min": np.min, "max": np.max, "std": np.std}.items():
            mine = [got[k][f"t_w2v_{name}_{i}"] for i in range(3)]
            assert mine == [None] * 3 if not tokens else mine == pytest.approx(f([vectors[t] for t in tokens], axis=0), abs=1e-6)
    reduced = vectorize.array_word_statistics(df, "k", "t", 4, rounds=2, svd=2)
    assert reduced.columns == ["k"] + [f"t_w2v_{n}_svd_{i:03}" for n in ("mean", "median", "sum", "min", "max", "std") for i in range(2)] and reduced.count() == 30


def test_text_vectors_keep_rare_words(spark):
    # 16,500 words of 150 rows, each in one row; the last row has no other one.
    df = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(110))) for k in range(150)] + [(150, "once alone")], "k int, t string")
    v = vectorize.vectorise(df.select("k", vectorize.word_tokens(F.col("t")).alias("tokens")), "tokens")
    assert v.first()["features"].size == 16502 and min(len(r["features"].indices) for r in v.collect()) == 2
    few = spark.createDataFrame([(k, f"a{k} a{k} " * (k + 1)) for k in range(6)], "k int, t string")
    got = vectorize.text_vectors(few, "k", "t", "count", 6).collect()
    for r in got:  # every word is of a single row
        assert sum(x * x for x in r[1:]) == pytest.approx((2 * (r["k"] + 1)) ** 2)


def test_vectorizers(spark):
    df = spark.createDataFrame([(k, f"v{k % 3}", f"w{k % 2}", f"word{k % 4} other word{k % 3}") for k in range(24)], "k long, a string, b string, t string")
    v = vectorize.vectorise(vectorize.bags(df, "k", ["a", "b"]), "tokens")
    svd = vectorize.svd_features(v, "k", "features", 2, "s").collect()
    assert len(svd) == 24 and len(svd[0]) == 3
    # Columns are orthogonal: they are left vectors times singular values.
    assert abs(sum(r[1] * r[2] for r in svd)) < 1e-6
    assert vectorize.text_vectors(df, "k", "t", "tfidf", 3).count() == 24
    words = spark.createDataFrame([("word0", [1.0, 0.0]), ("OTHER", [0.0, 3.0])], "word string, vector array<double>")
    got = {r["k"]: r["vector"] for r in vectorize.pretrained_mean(df.limit(6), "k", "t", words, 2).collect()}
    assert got[0] == [2 / 3, 1.0] and got[1] == [0.0, 3.0]
    enc = vectorize.encoded(df, "k", "t", lambda ts: [[[float(len(t)), 1.0], [2.0, 0.0]] for t in ts], 2, "max").first()
    assert enc["vector"][1] == 1.0
    assert vectorize.translated(df, "k", "t", lambda ts: [t.upper() for t in ts]).first()["text"].isupper()


def test_registry_and_config(spark, tmp_path):
    from tessera.sources import config, readers, store

    assert config.merge({"a": {"b": 1}}, {"a": {"c": 2}, "d": {"e": 3}}) == {"a": {"b": 1, "c": 2}, "d": {"e": 3}}
    seeds = config.seed_settings(config.load(), 3)
    assert [s["seed"] for s in seeds] == [0, 1, 2] and len({s["output"] for s in seeds}) == 3
    name = "length_of_n"
    if name not in store.FEATURES:
        store.feature(name)(lambda rows: rows.select("row_id", "split", F.length("n").alias("n_length")))
    rows = spark.createDataFrame([(1, "train", "ab"), (2, "test", "abc")], "row_id long, split string, n string")
    folder = f"file://{tmp_path}"
    assert store.make(rows, folder, [name]) == [name] and store.make(rows, folder, [name]) == []
    assert store.load(spark, folder, [name], "test").first()["n_length"] == 3
    with pytest.raises(ValueError):
        store.feature(name)(lambda rows: rows)
    small = readers.downcast(spark.createDataFrame([(1, 300), (2, None)], "a long, b long"))
    assert dict(small.dtypes) == {"a": "tinyint", "b": "smallint"}
    pred = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, prediction double")
    readers.write_submission(pred, pred.select("id"), f"{folder}/sub", "id", "target")
    assert readers.read_csv(spark, f"{folder}/sub", "id long, target double").count() == 2
    with pytest.raises(ValueError, match="do not match"):
        readers.write_submission(pred.limit(1), pred.select("id"), f"{folder}/sub2", "id", "target")


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.groupby import windowed

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, m), f"k{m % 2}", float(m)) for m in range(0, 60, 5)], "ts timestamp, k string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", ["k"], "v", size="30 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed_out").start()
    try:
        q.processAllAvailable()
        got = sorted(map(str, spark.table("windowed_out").collect()))
    finally:
        q.stop()
    assert got == sorted(map(str, windowed(rows, "ts", ["k"], "v", size="30 minutes").collect()))
    with pytest.raises(ValueError):
        windowed(rows, "ts", ["k"], "v", ("nunique",))


def test_label_codes_follow_the_order(spark):
    text_values = [f"{a}{b}{c}{d}" for a in "abz" for b in "qx" for c in "éa" for d in range(9)] + ["", "a", "zz"]
    for values, kind in ((text_values, "string"), ([3, -1, 7, 1 << 30], "int"), ([0.5, -2.0, 1e9], "double"), ([(1 << 60) + k for k in range(5)], "bigint")):
        df = spark.createDataFrame([(v,) for v in [*values, values[0], None]], f"v {kind}")
        got = {r["value"]: r["code"] for r in encode.label_table(df, "v").collect()}
        want = sorted(set(values), key=lambda v: v.encode() if isinstance(v, str) else v)
        assert got == {v: k for k, v in enumerate(want)}
