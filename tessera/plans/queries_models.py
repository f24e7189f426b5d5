"""Selection, folds, sampling, metrics, ensembles and models as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import ensemble, folds, metrics, models, select
from tessera.plans._register import LINE, registry, rounded, table, whole

QUERIES, ORACLES, query = registry()
_MD5 = lambda e: f"('0x' || substr(md5('0:' || ({e})::VARCHAR), 1, 8))::BIGINT"
_IMPORTANCE = "(SELECT p_type || '/' || p_brand AS feature, round(sum(p_retailprice), 2) AS importance FROM part GROUP BY 1)"


def _importance(spark, d):
    return table(spark, d, "part").groupBy(F.concat_ws("/", "p_type", "p_brand").alias("feature")).agg(F.round(F.sum("p_retailprice"), 2).alias("importance"))


@query(f"SELECT feature, importance FROM {_IMPORTANCE} ORDER BY importance DESC, feature LIMIT 10")
def topk_importance_int(spark, d):
    return select.top_features(_importance(spark, d), 10)


@query(f"SELECT feature, importance FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS r, count(*) OVER () AS n FROM {_IMPORTANCE}) WHERE r <= floor(0.3 * n)")
def topk_importance_frac(spark, d):
    return select.top_features(_importance(spark, d), 0.3)


@query(
    """WITH m AS (SELECT p_brand AS features, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY 1),
    r AS (SELECT features, row_number() OVER (ORDER BY a DESC, features) AS ra, row_number() OVER (ORDER BY b DESC, features) AS rb FROM m)
    SELECT features FROM r WHERE ra <= 5 OR rb <= 5"""
)
def topk_union_scores(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("features"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return select.null_importance(s, ["a", "b"], 5)


@query("SELECT unnest(['const_number', 'const_text', 'all_null']) AS dropped")
def sel_constant(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(3.0).alias("const_number"), F.lit("x").alias("const_text"), F.lit(None).cast("double").alias("all_null"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("half"))
    gone = select.constant_columns(o)
    return spark.createDataFrame([(c,) for c in ("const_number", "const_text", "all_null", "o_totalprice", "half") if c in gone], "dropped string")


def _pairs(spark, d, gone):
    return spark.createDataFrame([(c,) for c in gone], "dropped string")


_CORR = "lineitem"


@query("SELECT 'gross' AS dropped FROM (SELECT corr(l_extendedprice, l_extendedprice * 2 + l_tax) AS r FROM lineitem) WHERE abs(r) > 0.9 UNION ALL SELECT 'minus' FROM (SELECT corr(l_quantity, -l_quantity) AS r FROM lineitem) WHERE abs(r) > 0.9")
def sel_corr_pearson(spark, d):
    line = table(spark, d, "lineitem").select("l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * 2 + F.col("l_tax")).alias("gross"), F.col("l_quantity"), (-F.col("l_quantity")).alias("minus"))
    order = ["l_extendedprice", "l_discount", "l_tax", "gross", "l_quantity", "minus"]
    gone = select.correlated_columns(line, order)
    return _pairs(spark, d, [c for c in gone if c in ("gross", "minus")])


@query("SELECT 'gross' AS dropped FROM (SELECT corr(l_extendedprice, l_extendedprice * 2 + l_tax) AS r FROM lineitem) WHERE r > 0.995")
def sel_corr_greedy(spark, d):
    line = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_extendedprice") * 2 + F.col("l_tax")).alias("gross"), "l_quantity", (-F.col("l_quantity")).alias("minus"))
    return _pairs(spark, d, select.greedy_correlated(line, ["l_extendedprice", "gross", "l_quantity", "minus"]))


@query("SELECT 'a' AS a, 'b' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def sel_corr_value(spark, d):
    r = select.correlation_table(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])["l_quantity", "l_extendedprice"]
    return spark.createDataFrame([("a", "b", round(r, 6))], "a string, b string, r double")


@query(
    """WITH c AS (SELECT 'value' AS col, value AS v, (event_id % 3 = 0)::INT AS t FROM events),
    g AS (SELECT v, sum(1 - t) AS a, sum(t) AS b FROM c GROUP BY 1), r AS (SELECT v, sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b FROM g), m AS (SELECT sum(1 - t) AS n, sum(t) AS m FROM c)
    SELECT 'value' AS "column", round(max(abs(a::DOUBLE / n - b::DOUBLE / m)), 6) AS d, max(n)::BIGINT AS n, max(m)::BIGINT AS m FROM r, m"""
)
def sel_ks_stat(spark, d):
    e = table(spark, d, "events")
    return rounded(select.ks_table(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["value"]), {"d": 6})


@query("SELECT unnest(['sales', 'shift_28_sales', 'shift_14_sales']) AS kept")
def sel_shift_day(spark, d):
    return spark.createDataFrame([(c,) for c in select.shifted_columns(["sales", "shift_7_sales", "shift_28_sales", "shift_14_sales"], 14)], "kept string")


@query(f"SELECT o_orderkey, ({_MD5('o_orderkey')} % 5)::BIGINT AS fold FROM orders")
def split_kfold(spark, d):
    return folds.kfold(table(spark, d, "orders"), ["o_orderkey"], 5).select("o_orderkey", *whole("fold"))


@query(f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {_MD5('o_orderkey')}, o_orderkey) - 1) % 5)::BIGINT AS fold FROM orders")
def split_kfold_exact(spark, d):
    return folds.kfold_exact(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5).select("o_orderkey", *whole("fold"))


@query(f"SELECT o_orderkey, ({_MD5('o_custkey')} % 5)::BIGINT AS fold FROM orders")
def split_group_kfold(spark, d):
    return folds.group_kfold(table(spark, d, "orders"), "o_custkey", 5).select("o_orderkey", *whole("fold"))


@query(f"SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_MD5('o_orderkey')}, o_orderkey) - 1) % 5)::BIGINT AS fold FROM orders")
def split_stratified(spark, d):
    return folds.stratified_kfold(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "o_orderpriority", 5).select("o_orderkey", *whole("fold"))


@query()
def split_stratified_group(spark, d):
    return folds.stratified_group_kfold(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", 5).select("o_orderkey", "o_custkey", "fold")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'valid' END AS role FROM orders")
def split_date_holdout(spark, d):
    return folds.date_hold_out(table(spark, d, "orders"), "o_orderdate", dt.datetime(1996, 1, 1)).select("o_orderkey", "role")


_SLIDE = """WITH m AS (SELECT max(o_orderdate::DATE) AS last FROM orders), s AS (SELECT i, last - ((2 - i) * 30 + 300 + 30 - 1)::INT AS first FROM m, (SELECT unnest([0, 1, 2]) AS i)),
    b AS (SELECT i, first, first + 300 AS vfirst, first + 329 AS vlast FROM s)"""


@query(_SLIDE + " SELECT o_orderkey, i::BIGINT AS split, CASE WHEN o_orderdate::DATE < vfirst THEN 'train' ELSE 'valid' END AS role FROM orders JOIN b ON o_orderdate::DATE >= first AND o_orderdate::DATE <= vlast")
def split_sliding_window(spark, d):
    return folds.sliding_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 3, 300, 30, 30).select("o_orderkey", *whole("split"), "role")


@query(_SLIDE + " SELECT o_orderkey, i::BIGINT AS split, CASE WHEN o_orderdate::DATE < vfirst THEN 'train' ELSE 'valid' END AS role FROM orders JOIN b ON o_orderdate::DATE >= first AND o_orderdate::DATE <= vlast WHERE dayofweek(o_orderdate) = dayofweek(vfirst + 2)")
def split_weekday_refined(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    last = o.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    rows = folds.sliding_split(o, "o_orderdate", 3, 300, 30, 30)
    return folds.weekday_refined(rows, "o_orderdate", folds.sliding_windows(last, 3, 300, 30, 30), 3).select("o_orderkey", *whole("split"), "role")


@query(f"WITH n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) SELECT doc_id, toxic::BIGINT AS toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {_MD5('doc_id')}, doc_id) AS r FROM labels), n WHERE r <= n")
def sample_under(spark, d):
    return folds.under_sample(table(spark, d, "labels").select("doc_id", "toxic"), ["doc_id"], "toxic").select("doc_id", *whole("toxic"))


@query()
def sample_smote(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), F.length("source").cast("double").alias("b")), "doc_id").select("doc_id", "toxic", "a", "b")
    return folds.smote(rows, ["doc_id"], "toxic", ["a", "b"])


_P = "(SELECT o_orderkey, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM orders)"


def _predicted(spark, d):
    from tessera.operators.groupby import GroupSpec, join_back

    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("y"))
    return join_back(o, [GroupSpec(("o_orderpriority",), ("y",), ("mean",))]).withColumnRenamed("mean_y_groupby_o_orderpriority", "p")


@query(f"SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM {_P}")
def metric_rmse(spark, d):
    return rounded(_predicted(spark, d).agg(metrics.rmse(F.col("y"), F.col("p")).alias("rmse")), {"rmse": 4})


@query(f"SELECT round(sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)), 6) AS rmsle FROM {_P}")
def metric_rmsle(spark, d):
    return rounded(_predicted(spark, d).agg(metrics.rmsle(F.col("y"), F.col("p")).alias("rmsle")), {"rmsle": 6})


_SCORED = "(SELECT l.doc_id, l.toxic AS y, (d.n_chars % 97)::DOUBLE / 97 AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", ((F.col("n_chars") % 97).cast("double") / 97).alias("s")), "doc_id").select("doc_id", F.col("toxic").alias("y"), "s")


@query(f"WITH g AS (SELECT s, sum(y) AS tp, count(*) AS n FROM {_SCORED} GROUP BY 1), r AS (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS rtp, sum(n) OVER (ORDER BY s DESC) AS rn, sum(tp) OVER () AS pos FROM g) SELECT round(sum(tp / pos * rtp / rn), 6) AS pr_auc FROM r")
def metric_pr_auc(spark, d):
    return rounded(metrics.average_precision(_scored(spark, d), "y", "s"), {"pr_auc": 6})


_GRADED = "(SELECT o_orderkey, (o_orderkey * 7 % 4)::INT AS y, ((o_orderkey * 7 + o_custkey % 2) % 4)::INT AS p FROM orders)"


def _graded(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 4).cast("int").alias("y"), ((F.col("o_orderkey") * 7 + F.col("o_custkey") % 2) % 4).cast("int").alias("p"))


@query(
    f"""WITH t AS {_GRADED}, a AS (SELECT y AS i, count(*) AS a FROM t GROUP BY 1), b AS (SELECT p AS j, count(*) AS b FROM t WHERE p IN (SELECT DISTINCT y FROM t) GROUP BY 1), n AS (SELECT count(*) AS n, sum((y - p) ** 2) AS o FROM t)
    SELECT round(1 - max(o) / (sum(a * b * (i - j) ** 2) / max(n)), 6) AS qwk FROM a, b, n"""
)
def metric_qwk(spark, d):
    return rounded(metrics.quadratic_weighted_kappa(_graded(spark, d), "y", "p"), {"qwk": 6})


@query(f"WITH t AS (SELECT y::DOUBLE AS t, 1 / (1 + exp(-(s * 4 - 2))) AS p FROM {_SCORED}) SELECT round(avg(-(0.25 * t + 0.75 * (1 - t)) * (1 - (t * p + (1 - t) * (1 - p))) ** 2 * (t * ln(p) + (1 - t) * ln(1 - p))), 6) AS loss FROM t")
def metric_focal(spark, d):
    return rounded(_scored(spark, d).agg(metrics.mean_focal_loss(F.col("y"), F.col("s") * 4 - 2).alias("loss")), {"loss": 6})


@query(f"SELECT y::BIGINT AS y, p::BIGINT AS p, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM {_GRADED} GROUP BY y, p")
def metric_confusion(spark, d):
    return rounded(metrics.confusion(_graded(spark, d), "y", "p", True).withColumns({c: F.col(c).cast("long") for c in ("y", "p")}), {"share": 6})


@query("SELECT event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def metric_fold_timeline(spark, d):
    return metrics.fold_timeline(table(spark, d, "events"), "ts", ["event_type"])


@query("SELECT greatest(0, least(19, floor(value / 100 * 20)))::BIGINT AS bin, count(*)::BIGINT AS n FROM events GROUP BY 1")
def metric_density(spark, d):
    return metrics.density(table(spark, d, "events"), "value", 0.0, 100.0, 20).select(*whole("bin"), "n")


@query(
    """WITH t AS (SELECT t.t, user_id, value, event_id, ('0x' || substr(md5('0:0:' || t.t::VARCHAR || ':' || event_id::VARCHAR), 1, 8))::BIGINT AS h FROM events, (SELECT unnest(range(5)) AS t) t),
    x AS (SELECT t, value FROM (SELECT *, row_number() OVER (PARTITION BY t, user_id ORDER BY h, event_id) AS r FROM t) WHERE r = 1), m AS (SELECT t, sqrt(avg((value - 50) ** 2)) AS m FROM x GROUP BY 1)
    SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(avg(m) - 2 * stddev_pop(m), 6) AS low, round(avg(m) + 2 * stddev_pop(m), 6) AS high FROM m"""
)
def truncated_eval(spark, d):
    draws = metrics.truncated_draws(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], 5)
    return rounded(metrics.truncated_evaluation(draws, metrics.rmse(F.col("value"), F.lit(50.0))), {c: 6 for c in ("mean", "std", "low", "high")})


@query()
def truncated_adjusted(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return metrics.adjusted_draws(rows, "user_id", ["ts", "event_id"], [0.4, 0.3, 0.15, 0.1, 0.05], 5, later_rows=True)


def _graded_scores(spark, d):
    return _graded(spark, d).withColumn("s", F.col("y") / 4.0 + (F.col("o_orderkey") % 13) / 40.0).withColumn("g", (F.col("o_orderkey") % 4).cast("int"))


@query()
def rounder_fit(spark, d):
    rows = _graded_scores(spark, d)
    out = [(m, *metrics.fit_thresholds(rows, "y", "s", m)) for m in ("golden", "simplex")]
    return spark.createDataFrame(out, "method string, c0 double, c1 double, c2 double")


@query()
def rounder_groupwise(spark, d):
    return metrics.fit_thresholds_by_group(_graded_scores(spark, d).withColumn("y", F.col("p")), "g", "y", "s")


@query()
def blend_search(spark, d):
    rows = _predicted(spark, d).withColumns({"p2": F.col("y") * 0.9 + 1000, "p3": F.lit(100000.0)})
    w, score = ensemble.blend_weights(rows, "y", ["p", "p2", "p3"], 200)
    return spark.createDataFrame([(*w, score)], "w0 double, w1 double, w2 double, rmse double")


@query("SELECT o_orderkey, round((o_totalprice * 0.9 + o_totalprice * 1.1 + o_totalprice) / 3, 4) AS prediction FROM orders")
def seed_average(spark, d):
    o = table(spark, d, "orders")
    runs = o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("run"), (F.col("o_totalprice") * w).alias("prediction")) for k, w in enumerate((0.9, 1.1, 1.0))])).alias("x")).select("o_orderkey", "x.*")
    return rounded(ensemble.average_runs(runs, "o_orderkey"), {"prediction": 4})


@query("SELECT o_orderkey, o_totalprice, o_totalprice * 0.9 AS pred_a, o_totalprice + 1 AS pred_b FROM orders")
def stack_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ensemble.stack_predictions(o, {"a": o.select("o_orderkey", (F.col("o_totalprice") * 0.9).alias("prediction")), "b": o.select("o_orderkey", (F.col("o_totalprice") + 1).alias("prediction"))}, "o_orderkey")


@query("WITH a AS (SELECT p_brand AS feature, avg(p_size) AS x FROM part GROUP BY 1), b AS (SELECT p_brand AS feature, avg(p_retailprice) AS x FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1) SELECT feature, round((a.x + b.x) / 2, 6) AS importance FROM a JOIN b USING (feature)")
def importance_average(spark, d):
    p = table(spark, d, "part")
    a = p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("importance"))
    b = p.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return rounded(ensemble.average_importance([a, b]), {"importance": 6})


def _training(spark, d):
    line = table(spark, d, "lineitem").withColumn("row_id", F.xxhash64(*LINE)).select("row_id", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("l_extendedprice").alias("y"))
    return folds.kfold(line, ["row_id"], 3)


@query()
def cv_gbt(spark, d):
    return models.cross_validate(_training(spark, d), ["l_quantity", "l_discount", "l_tax"], "y", metrics.rmse, row_id="row_id", name="lightgbm", maxIter=5, maxDepth=3).oof


@query()
def cv_ridge(spark, d):
    return models.cross_validate(_training(spark, d), ["l_quantity", "l_discount", "l_tax"], "y", metrics.rmse, row_id="row_id", name="ridge", encode=["l_returnflag"]).oof


@query()
def cv_pseudo_label(spark, d):
    rows = _training(spark, d)
    pseudo = rows.where("row_id % 10 = 0").withColumn("y", F.col("l_quantity") * 1500)
    return models.cross_validate(rows.where("row_id % 10 <> 0"), ["l_quantity", "l_discount", "l_tax"], "y", metrics.rmse, row_id="row_id", name="ridge", pseudo=pseudo).oof


@query(
    """WITH a AS (SELECT l_quantity AS q, l_extendedprice AS e, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rq, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS re FROM lineitem)
    SELECT 'a' AS a, 'b' AS b, round(corr(rq, re), 6) AS r FROM a"""
)
def sel_corr_spearman(spark, d):
    r = select.correlation_table(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "spearman")["l_quantity", "l_extendedprice"]
    return spark.createDataFrame([("a", "b", round(r, 6))], "a string, b string, r double")


@query("SELECT unnest(['price_again', 'key_again']) AS dropped")
def sel_duplicate_columns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_totalprice").alias("price_again"), F.col("o_orderkey").alias("key_again"), (F.col("o_totalprice") + 1).alias("other"))
    return _pairs(spark, d, select.duplicate_columns(o))


@query()
def sample_under_smote(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), F.length("source").cast("double").alias("b")), "doc_id").select("doc_id", "toxic", "a", "b")
    return folds.sampling("random_under_sampling_and_smote", rows, ["doc_id"], "toxic", ["a", "b"])


@query(f"SELECT feature, importance FROM {_IMPORTANCE} ORDER BY importance DESC, feature LIMIT 50")
def importance_report(spark, d):
    return select.top_features(_importance(spark, d), 50)


@query()
def blend_by_metric(spark, d):
    rows = _predicted(spark, d).withColumns({"p2": F.col("y") * 0.9 + 1000, "p3": F.lit(100000.0)})
    w, score = ensemble.blend_by_metric(rows, ["p", "p2", "p3"], lambda p: metrics.rmsle(F.col("y"), p), 24)
    return spark.createDataFrame([(*w, score)], "w0 double, w1 double, w2 double, rmsle double")


@query("SELECT event_id, (row_number() OVER (ORDER BY ('0x' || substr(md5('0:' || event_id::VARCHAR), 1, 8))::BIGINT, event_id) - 1) % 4 AS bin FROM events")
def split_equal_bins(spark, d):
    return metrics.equal_bins(table(spark, d, "events").select("event_id"), ["event_id"], 4).select("event_id", *whole("bin"))


@query()
def cv_forest_binary(spark, d):
    rows = folds.stratified_kfold(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"), F.length("lang").cast("double").alias("l")), "doc_id"), ["doc_id"], "toxic", 3)
    return models.cross_validate(rows.select("doc_id", "toxic", "n", "l", "fold"), ["n", "l"], "toxic", lambda y, p: metrics.rmse(y, p), row_id="doc_id", name="ert", binary=True, numTrees=5, maxDepth=4, clip_to=(0.0, 1.0)).oof
