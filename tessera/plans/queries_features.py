"""Group-by features, statistics, encoders, text and vector features as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar, text, vectors
from tessera.operators import encode, groupby, vectorize
from tessera.operators.groupby import GroupSpec
from tessera.plans._register import registry, rounded, spread, table, whole

QUERIES, ORACLES, query = registry()
_MD5 = lambda e: f"('0x' || substr(md5('0:' || ({e})::VARCHAR), 1, 8))::BIGINT"


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, round(sum(o_totalprice), 2) AS sum FROM orders GROUP BY 1")
def groupby_mean_std_min_max_sum(spark, d):
    key = ("o_orderpriority",)
    t = groupby.aggregate(table(spark, d, "orders"), [GroupSpec(key, ("o_totalprice",), ("mean", "std", "min", "max", "sum"))])[key]
    t = t.withColumnsRenamed({f"{a}_o_totalprice_groupby_o_orderpriority": a for a in ("mean", "std", "min", "max", "sum")})
    return rounded(t, {"mean": 4, "std": 4, "sum": 2})


@query("SELECT user_id, count(event_type)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS u FROM events GROUP BY 1")
def groupby_count_nunique(spark, d):
    t = groupby.aggregate(table(spark, d, "events"), [GroupSpec(("user_id",), ("event_type",), ("count", "nunique"))])[("user_id",)]
    return t.select("user_id", F.col("count_event_type_groupby_user_id").alias("n"), F.col("nunique_event_type_groupby_user_id").alias("u"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean_discount, max(l_quantity) AS max_quantity FROM lineitem GROUP BY 1, 2")
def groupby_multi_key(spark, d):
    key = ("l_returnflag", "l_linestatus")
    t = groupby.aggregate(table(spark, d, "lineitem"), [GroupSpec(key, ("l_discount",), ("mean",)), GroupSpec(key, ("l_quantity",), ("max",))])[key]
    return rounded(t.select(*key, F.col("mean_l_discount_groupby_l_returnflag_l_linestatus").alias("mean_discount"), F.col("max_l_quantity_groupby_l_returnflag_l_linestatus").alias("max_quantity")), {"mean_discount": 6})


_SPEC = [GroupSpec(("o_orderpriority",), ("o_totalprice",), ("mean", "std", "min", "max", "sum"))]
_OVER = "OVER (PARTITION BY o_orderpriority)"


@query(f"SELECT o_orderkey, round(avg(o_totalprice) {_OVER}, 4) AS mean, round(stddev_samp(o_totalprice) {_OVER}, 4) AS std, min(o_totalprice) {_OVER} AS min, max(o_totalprice) {_OVER} AS max, round(sum(o_totalprice) {_OVER}, 2) AS sum FROM orders")
def groupby_joinback(spark, d):
    out = groupby.join_back(table(spark, d, "orders"), _SPEC)
    return rounded(out.select("o_orderkey", *[F.col(n).alias(a) for n, a, _ in _SPEC[0].names()]), {"mean": 4, "std": 4, "sum": 2})


@query(f"SELECT o_orderkey, round(avg(o_totalprice) {_OVER} - o_totalprice, 4) AS mean, min(o_totalprice) {_OVER} - o_totalprice AS min FROM orders")
def groupby_diff(spark, d):
    out = groupby.differences(groupby.join_back(table(spark, d, "orders"), _SPEC), _SPEC)
    return rounded(out.select("o_orderkey", *[F.col(f"diff_{n}").alias(a) for n, a, _ in _SPEC[0].names() if a in ("mean", "min")]), {"mean": 4})


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, round(avg(l_discount) OVER (PARTITION BY l_suppkey) / nullif(l_discount, 0), 6) AS r FROM lineitem")
def groupby_ratio(spark, d):
    from tessera.plans._register import LINE

    spec = [GroupSpec(("l_suppkey",), ("l_discount",), ("mean",))]
    out = groupby.ratios(groupby.join_back(table(spark, d, "lineitem"), spec), spec)
    return rounded(out.select(*LINE, F.col("ratio_mean_l_discount_groupby_l_suppkey").alias("r")), {"r": 6})


@query("WITH g AS (SELECT o_custkey, count(o_orderkey)::BIGINT AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT c_custkey, g.n FROM customer LEFT JOIN g ON c_custkey = o_custkey")
def groupby_on_alias(spark, d):
    spec = GroupSpec(("o_custkey",), ("o_orderkey",), ("count",))
    t = groupby.aggregate(table(spark, d, "orders").where("o_totalprice > 100000"), [spec])[spec.key].withColumnRenamed(spec.names()[0][0], "n")
    from tessera.operators.tables import left_join

    return left_join(table(spark, d, "customer").select("c_custkey"), t, ["c_custkey"], ["o_custkey"])


def _stat(name: str, sql: str, digits: int = 6):
    def f(spark, d):
        t = groupby.aggregate(table(spark, d, "events"), [GroupSpec(("event_type",), ("value",), (name,))])[("event_type",)]
        return rounded(t.withColumnRenamed(f"{name}_value_groupby_event_type", "stat"), {"stat": digits})

    f.__name__ = f"stat_{ {'median_absolute_deviation': 'mad', 'beyond1std_ratio': 'beyond1std'}.get(name, name)}"
    query(sql)(f)


_stat("median_absolute_deviation", "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_type, round(median(abs(value - m)), 6) AS stat FROM events JOIN m USING (event_type) GROUP BY 1")
_stat("mean_variance", "SELECT event_type, round(stddev_pop(value) / nullif(avg(value), 0), 6) AS stat FROM events GROUP BY 1")
_stat("hl_ratio", "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round(sum((value >= m)::INT)::DOUBLE / nullif(sum((value < m)::INT), 0), 6) AS stat FROM events JOIN m USING (event_type) GROUP BY 1")
_stat("beyond1std_ratio", "WITH m AS (SELECT event_type, avg(value) + stddev_pop(value) AS m FROM events GROUP BY 1) SELECT event_type, round(sum((value >= m)::INT)::DOUBLE / count(*), 6) AS stat FROM events JOIN m USING (event_type) GROUP BY 1")
_stat("iqr_ratio", "SELECT event_type, round(quantile_cont(value, 0.75) / nullif(quantile_cont(value, 0.25), 0), 6) AS stat FROM events GROUP BY 1")
_stat("range_diff", "SELECT event_type, round(max(value) - min(value), 6) AS stat FROM events GROUP BY 1")
_stat("range_per", "SELECT event_type, round(max(value) / nullif(min(value), 0), 6) AS stat FROM events GROUP BY 1")


@query("SELECT p_partkey, round(count(p_brand) OVER (PARTITION BY p_brand)::DOUBLE / (SELECT count(*) FROM part), 6) AS p_brand_Frequency FROM part")
def win_frequency(spark, d):
    return rounded(groupby.frequency(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"]).select("p_partkey", "p_brand_Frequency"), {"p_brand_Frequency": 6})


def _relative(name: str, sql: str):
    def f(spark, d):
        return rounded(groupby.relative(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", F.col(f"value_{name}").alias("x")), {"x": 6})

    f.__name__ = f"win_{name}"
    query(sql)(f)


_relative("diff", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS x FROM events")
_relative("ratio", "SELECT event_id, round(value / nullif(avg(value) OVER (PARTITION BY event_type), 0), 6) AS x FROM events")
_relative("zscore", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / nullif(stddev_pop(value) OVER (PARTITION BY event_type), 0), 6) AS x FROM events")


@query("SELECT event_id, round(ln(1 + value), 6) AS v FROM events WHERE value > -1")
def enc_log1p(spark, d):
    return rounded(table(spark, d, "events").where("value > -1").select("event_id", F.log1p("value").alias("v")), {"v": 6})


@query("SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders")
def enc_sincos(spark, d):
    s, c = scalar.cyclic(F.month("o_orderdate"), 12)
    return table(spark, d, "orders").select("o_orderkey", (F.round(s, 6) + 0.0).alias("month_sin"), (F.round(c, 6) + 0.0).alias("month_cos"))


@query("WITH v AS (SELECT DISTINCT p_type FROM part), c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM v) SELECT p_partkey, code::BIGINT AS p_type_code FROM part JOIN c USING (p_type)")
def enc_label(spark, d):
    return encode.label_encode(table(spark, d, "part").select("p_partkey", "p_type"), ["p_type"]).select("p_partkey", *whole("p_type_code"))


_CATS = ["l_returnflag", "l_linestatus", "p_brand", "p_type", "c_mktsegment", "o_orderpriority"]
_FROM = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"


def _combi(size: int):
    from itertools import combinations

    names = ["_".join(cs) + "_combi" for cs in combinations(_CATS, size)]

    def f(spark, d):
        rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.groupBy(*_CATS).agg(F.count(F.lit(1)).alias("n"))  # few distinct rows
        made = encode.combine(rows, _CATS, (size,))
        # A table of (combination, value, count) shows all of them at once.
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("combi"), F.replace(F.col(n), F.lit(encode.SEPARATOR), F.lit("|")).alias("value")) for n in names])).alias("x")
        return made.select("n", pairs).select("n", "x.*").groupBy("combi", "value").agg(F.sum("n").alias("n"))

    f.__name__ = f"enc_combine_r{size}"
    parts = [f"SELECT '{n}' AS combi, concat_ws('|', {', '.join(cs)}) AS value, count(*)::BIGINT AS n FROM {_FROM} GROUP BY 1, 2" for n, cs in zip(names, combinations(_CATS, size), strict=True)]
    query(" UNION ALL ".join(parts))(f)


for _n in (2, 3, 4):
    _combi(_n)


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 18, 15))::BIGINT AS h FROM documents")
def enc_hex_to_int(spark, d):
    return table(spark, d, "documents").select("doc_id", scalar.hex_to_long(F.concat(F.lit("abc0"), F.substring(F.md5(F.col("doc_id").cast("string")), 18, 15))).alias("h"))


@query("SELECT doc_id, (q = 0)::BIGINT AS q_0, (q = 1)::BIGINT AS q_1, (q IS NULL)::BIGINT AS q_missing FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE q IS NOT NULL UNION ALL SELECT d.doc_id, 0, 0, 1 FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def enc_onehot_missing(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id", "left")
    return encode.one_hot(rows, "q", [0, 1]).select("doc_id", *whole("q_0", "q_1", "q_missing"))


@query(
    """WITH e AS (SELECT quantile_cont(o_totalprice, 0.1) AS a, quantile_cont(o_totalprice, 0.25) AS b, quantile_cont(o_totalprice, 0.5) AS c, quantile_cont(o_totalprice, 0.75) AS d, quantile_cont(o_totalprice, 0.9) AS e FROM orders)
    SELECT o_orderkey, ((o_totalprice > a)::INT + (o_totalprice > b)::INT + (o_totalprice > c)::INT + (o_totalprice > d)::INT + (o_totalprice > e)::INT)::BIGINT AS bin FROM orders, e"""
)
def enc_qcut(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", encode.quantile_bin(F.col("o_totalprice"), encode.quantile_edges(o, "o_totalprice")).cast("long").alias("bin"))


@query("SELECT event_id, ((value >= 10)::INT + (value >= 25)::INT + (value >= 60)::INT)::BIGINT AS bin FROM events")
def enc_digitize(spark, d):
    return table(spark, d, "events").select("event_id", scalar.digitize(F.col("value"), [10.0, 25.0, 60.0]).cast("long").alias("bin"))


@query("SELECT event_id, ((value > 10)::INT + (value > 25)::INT + (value > 60)::INT)::BIGINT AS bin FROM events")
def enc_cut(spark, d):
    return table(spark, d, "events").select("event_id", scalar.cut(F.col("value"), [10.0, 25.0, 60.0]).cast("long").alias("bin"))


_TE = f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, {_MD5('o_orderkey')} % 5 AS f FROM orders),
    a AS (SELECT c, f, sum(y) AS s, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT c, sum(s) AS s, sum(n) AS n FROM a GROUP BY 1),
    g AS (SELECT f, sum(s) AS s, sum(n) AS n FROM a GROUP BY 1), w AS (SELECT sum(s) AS s, sum(n) AS n FROM g)"""


@query(_TE + " SELECT o_orderkey, round((b.s - a.s) / nullif(b.n - a.n, 0), 4) AS te FROM t JOIN a USING (c, f) JOIN b USING (c)")
def enc_target_oof(spark, d):
    rows = table(spark, d, "orders").withColumn("fold", encode.fold_of(["o_orderkey"], 5))
    return rounded(encode.target_encode(rows, ["o_orderpriority"], "o_totalprice", "fold").select("o_orderkey", F.col("o_orderpriority_TE").alias("te")), {"te": 4})


@query(_TE + " SELECT o_orderkey, round((b.s - a.s + 0.3 * (w.s - g.s) / (w.n - g.n)) / (b.n - a.n + 0.3), 4) AS te FROM t JOIN a USING (c, f) JOIN b USING (c) JOIN g USING (f), w")
def enc_target_smooth(spark, d):
    rows = table(spark, d, "orders").withColumn("fold", encode.fold_of(["o_orderkey"], 5))
    return rounded(encode.target_encode(rows, ["o_orderpriority"], "o_totalprice", "fold", 0.3).select("o_orderkey", F.col("o_orderpriority_TE").alias("te")), {"te": 4})


@query()
def enc_rankgauss(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return encode.rank_gauss(o, o, "o_totalprice").select("o_orderkey", "o_totalprice_gauss")


_W = "list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')"


@query(
    f"""SELECT doc_id, length(text)::BIGINT AS text_num_chars, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS text_num_capitals,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS text_num_exclamation_marks, (length(text) - length(replace(text, '?', '')))::BIGINT AS text_num_question_marks,
    (length(text) - length(regexp_replace(text, '[.,;:]', '', 'g')))::BIGINT AS text_num_punctuation, (length(text) - length(regexp_replace(text, '[*&$%]', '', 'g')))::BIGINT AS text_num_symbols,
    len({_W})::BIGINT AS text_num_words, len(list_distinct({_W}))::BIGINT AS text_num_unique_words,
    ((length(text) - length(replace(text, ':-)', ''))) / 3 + (length(text) - length(replace(text, ':)', ''))) / 2 + (length(text) - length(replace(text, ';-)', ''))) / 3 + (length(text) - length(replace(text, ';)', ''))) / 2)::BIGINT AS text_num_smilies,
    round(length(text)::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')), 0), 6) AS text_caps_vs_length,
    round(len(list_distinct({_W}))::DOUBLE / nullif(len({_W}), 0), 6) AS text_words_vs_unique FROM documents"""
)
def text_basic_features(spark, d):
    out = text.with_basic_features(spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), ["text"]).drop("text")
    return rounded(out, {"text_caps_vs_length": 6, "text_words_vs_unique": 6})


@query("SELECT user_id, 'event_type_' || event_type AS token, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def cat_token_counts(spark, d):
    return vectorize.count_table(table(spark, d, "events"), "user_id", ["event_type"])


@query(
    """WITH c AS (SELECT user_id, 'event_type_' || event_type AS token, count(*)::BIGINT AS n FROM events GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), m AS (SELECT count(DISTINCT user_id) AS m FROM c)
    SELECT user_id, token, n, round(n * ln((m + 1)::DOUBLE / (df + 1)), 6) AS tfidf FROM c JOIN df USING (token), m"""
)
def cat_token_tfidf(spark, d):
    return rounded(vectorize.tfidf_table(vectorize.count_table(table(spark, d, "events"), "user_id", ["event_type"]), "user_id"), {"tfidf": 6})


@query()
def text_count_svd(spark, d):
    return vectorize.text_vectors(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text"), "row", "text", "count", 8)


@query()
def text_tfidf_svd(spark, d):
    return vectorize.text_vectors(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text"), "row", "text", "tfidf", 8)


@query()
def cat_pair_lda(spark, d):
    return vectorize.category_pair_topics(table(spark, d, "part").select("p_brand", "p_type"), ["p_brand", "p_type"], 3)["p_brand", "p_type"]


@query()
def cat_user2vec(spark, d):
    return vectorize.each_category_vectors(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", ["o_orderpriority", "o_orderstatus"], 3)


@query()
def cat_group_vectors(spark, d):
    return vectorize.entity_vectors(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", ["o_orderpriority", "o_orderstatus"], "tfidf", 5)


@query()
def cat_w2v_stats(spark, d):
    return vectorize.entity_word_statistics(table(spark, d, "events").select("user_id", "ts", "event_type"), "user_id", ["event_type"], ["ts"], 4)


@query()
def grouped_w2v(spark, d):
    rows = vectorize.bags(table(spark, d, "events").select("user_id", "ts", "event_type"), "user_id", ["event_type"], ["ts"])
    return vectorize.array_word_statistics(rows, "user_id", "tokens")


@query(
    """SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_median(e), 6) AS median, round(list_sum(e), 4) AS sum, round(list_max(e), 6) AS max, round(list_min(e), 6) AS min, round(list_var_pop(e), 6) AS var
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"""
)
def vec_row_stats(spark, d):
    v = vectors.row_statistics(F.col("embedding"))
    out = table(spark, d, "embeddings").select("vec_id", *[c.alias(n) for n, c in v.items()])
    return rounded(out, {"mean": 6, "median": 6, "sum": 4, "max": 6, "min": 6, "var": 6})


@query(
    """SELECT label::BIGINT AS label, dim::BIGINT AS dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(median(x), 6) AS median, round(min(x), 6) AS min, round(max(x), 6) AS max, round(sum(x), 4) AS sum
    FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(list_transform(embedding, lambda y: y::DOUBLE)) AS x FROM embeddings) GROUP BY 1, 2"""
)
def vec_group_stats(spark, d):
    out = vectors.group_statistics(table(spark, d, "embeddings"), ["label"], "embedding").withColumns({"label": F.col("label").cast("long"), "dim": F.col("dim").cast("long")})
    return rounded(out, {"mean": 6, "std": 6, "median": 6, "min": 6, "max": 6, "sum": 4})


@query()
def stat_shapiro(spark, d):
    from tessera.operators.metrics import shapiro_by_group

    return shapiro_by_group(table(spark, d, "events"), ["user_id"], "value")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(sum(value), 2) AS sum FROM events GROUP BY 1, 2")
def windowed_groupby(spark, d):
    from tessera.streaming.groupby import windowed

    out = windowed(table(spark, d, "events"), "ts", ["event_type"], "value")
    return rounded(out.select("event_type", F.col("window.start").alias("hour"), F.col("count_value").alias("n"), F.col("mean_value").alias("mean"), F.col("sum_value").alias("sum")), {"mean": 6, "sum": 2})


@query()
def recipe_combined_groupby(spark, d):
    from tessera.plans.recipes import combined_groupby

    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal")
    return combined_groupby(o, ["o_orderstatus", "o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"], ["c_mktsegment"], (2, 3))


@query("SELECT d.doc_id, l.toxic::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def recipe_target(spark, d):
    from tessera.plans.recipes import entity_target

    labels = table(spark, d, "labels").select(F.concat(F.lit("9f3c"), F.lpad(F.hex("doc_id"), 16, "0")).alias("key"), "toxic")
    return entity_target(table(spark, d, "documents"), labels, "doc_id", "key", "toxic").select("doc_id", *whole("toxic"))


@query(
    """WITH v AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#11'), c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM v)
    SELECT p_partkey, coalesce(code, -1)::BIGINT AS p_brand_code FROM part LEFT JOIN c USING (p_brand)"""
)
def enc_category_unknown(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return encode.label_encode(p, ["p_brand"], {"p_brand": encode.label_table(p.where("p_brand <> 'Brand#11'"), "p_brand")}, unknown=-1).select("p_partkey", *whole("p_brand_code"))


@query("SELECT event_id, round((exp(value / 100) + 2 * exp(value / 50) + 3 * exp(0.5)) / (1 + exp(value / 100) + exp(value / 50) + exp(0.5)) / 3, 6) AS p FROM events")
def enc_softmax_expectation(spark, d):
    scores = F.array(F.lit(0.0), F.col("value") / 100, F.col("value") / 50, F.lit(0.5))
    return rounded(table(spark, d, "events").select("event_id", scalar.softmax_expectation(scores, 3.0).alias("p")), {"p": 6})


@query()
def recipe_linear_features(spark, d):
    from tessera.plans.recipes import linear_features

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return linear_features(o.where("o_orderkey % 5 > 0"), o, ["o_totalprice"], ["o_orderstatus"])


@query("SELECT p_partkey, p_size::BIGINT AS rating, ln(1 + p_retailprice) > 0 AS positive, split FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM part)")
def recipe_basic(spark, d):
    from tessera.plans.recipes import basic_features

    p = table(spark, d, "part").withColumn("rating", F.col("p_size").cast("string"))
    out = basic_features(p.where("p_partkey % 3 > 0"), p.where("p_partkey % 3 = 0"), ["p_type"], score="rating", log={"log_price": "p_retailprice"})
    return out.select("p_partkey", F.col("rating").cast("long").alias("rating"), (F.col("log_price") > 0).alias("positive"), "split")
