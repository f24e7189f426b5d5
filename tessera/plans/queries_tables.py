"""Joins, de-duplication, sets, projections and filters as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import ranks, tables
from tessera.plans._register import LINE, registry, rounded, table, whole

QUERIES, ORACLES, query = registry()
_ORDER = ", ".join(LINE)


@query("SELECT c.c_custkey, c.c_name, n.n_name AS nation_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_left_rename(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation_name"))
    return tables.left_join(table(spark, d, "customer"), n, ["c_nationkey"], ["n_nationkey"]).select("c_custkey", "c_name", "nation_name")


@query(
    f"""WITH m AS (SELECT l_partkey AS pk, l_suppkey AS sk, count(*)::BIGINT AS n, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT {_ORDER}, a.n AS first_n, a.q AS first_q, b.n AS second_n, b.q AS second_q
    FROM lineitem l LEFT JOIN m a ON l.l_partkey = a.pk AND l.l_suppkey = a.sk
    LEFT JOIN m b ON l.l_partkey = b.pk AND l.l_linenumber = b.sk"""
)
def join_composite2_twice(spark, d):
    line = table(spark, d, "lineitem")
    m = line.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    out = tables.left_join(line, m, ["l_partkey", "l_suppkey"], ["pk", "sk"], "first_")
    out = tables.left_join(out, m, ["l_partkey", "l_linenumber"], ["pk", "sk"], "second_")
    return out.select(*LINE, "first_n", "first_q", "second_n", "second_q")


@query(
    f"""WITH m AS (SELECT l_orderkey AS a, l_partkey AS b, l_linenumber AS c, max(l_tax) AS tax FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3)
    SELECT {_ORDER}, m.tax AS open_tax FROM lineitem l LEFT JOIN m ON l.l_orderkey = m.a AND l.l_partkey = m.b AND l.l_linenumber = m.c"""
)
def join_composite3(spark, d):
    line = table(spark, d, "lineitem")
    m = line.where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_linenumber").alias("c")).agg(F.max("l_tax").alias("tax"))
    return tables.left_join(line, m, ["l_orderkey", "l_partkey", "l_linenumber"], ["a", "b", "c"], "open_").select(*LINE, "open_tax")


@query(
    f"""SELECT {_ORDER}, o.o_totalprice, c.c_mktsegment, cn.n_name AS cust_n_name, sn.n_name AS supp_n_name, p.p_brand, r.r_name
    FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey
    LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey
    LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
    LEFT JOIN region r ON cn.n_regionkey = r.r_regionkey"""
)
def join_denormalise(spark, d):
    from tessera.plans.recipes import denormalise

    t = lambda n: table(spark, d, n)
    nation = t("nation")
    steps = [
        (t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["l_orderkey"], ["o_orderkey"], ""),
        (t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["o_custkey"], ["c_custkey"], ""),
        (t("part").select("p_partkey", "p_brand"), ["l_partkey"], ["p_partkey"], ""),
        (t("supplier").select("s_suppkey", "s_nationkey"), ["l_suppkey"], ["s_suppkey"], ""),
        (nation, ["c_nationkey"], ["n_nationkey"], "cust_"),
        (nation, ["s_nationkey"], ["n_nationkey"], "supp_"),
        (t("region"), ["cust_n_regionkey"], ["r_regionkey"], ""),
    ]
    return denormalise(t("lineitem").select(*LINE), steps).select(*LINE, "o_totalprice", "c_mktsegment", "cust_n_name", "supp_n_name", "p_brand", "r_name")


@query("SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality, l.toxic::BIGINT AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_inner(spark, d):
    return tables.join_all([table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")], ["doc_id"], "inner").select("doc_id", "lang", *whole("quality", "toxic"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_semi(spark, d):
    return tables.semi(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 1"), ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti(spark, d):
    return tables.anti(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT o_orderkey, o_totalprice, year(o_orderdate)::BIGINT AS y, length(o_orderpriority)::BIGINT AS w FROM orders")
def join_rowid_concat(spark, d):
    o = table(spark, d, "orders")
    parts = [o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", F.year("o_orderdate").cast("long").alias("y")), o.select("o_orderkey", F.length("o_orderpriority").cast("long").alias("w"))]
    return tables.join_rows(parts, "o_orderkey").select("o_orderkey", "o_totalprice", "y", "w")


@query(f"SELECT l_partkey, l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {_ORDER}) AS rn FROM lineitem) WHERE rn = 1")
def dedupe_first(spark, d):
    return tables.keep_first(table(spark, d, "lineitem").select(*LINE), ["l_partkey", "l_suppkey"], LINE).select("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedupe_last(spark, d):
    return tables.keep_first(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], last=True).select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, 'train' AS split FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'test' FROM supplier")
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return tables.stack([a, b], ["train", "test"])


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(spark, d):
    line = table(spark, d, "lineitem")
    return line.where("l_returnflag = 'R'").select("l_partkey").intersect(line.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_except(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_partkey").subtract(line.where("l_returnflag = 'R'").select("l_partkey"))


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity > 40)
    SELECT count(*) FILTER (b.v IS NULL)::BIGINT AS only_a, count(*) FILTER (a.v IS NULL)::BIGINT AS only_b, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL)::BIGINT AS both FROM a FULL JOIN b ON a.v = b.v"""
)
def value_overlap(spark, d):
    line = table(spark, d, "lineitem")
    return tables.value_overlap(line.where("l_returnflag = 'R'"), line.where("l_quantity > 40"), "l_partkey")


@query("SELECT o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 4 END)::BIGINT AS priority FROM orders")
def proj_dict_map(spark, d):
    m = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 4}
    return table(spark, d, "orders").select("o_orderkey", scalar.map_values(F.col("o_orderpriority"), m).cast("long").alias("priority"))


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE p_size END::DOUBLE AS size FROM part")
def proj_replace_to_null_cast(spark, d):
    text = F.when(F.col("p_size") == 10, "tbd").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", scalar.strict_number(text, "tbd").alias("size"))


@query("SELECT event_id, CASE WHEN value > 90 OR user_id % 7 = 0 THEN -999.0 ELSE value END::DOUBLE AS v FROM events")
def fill_const(spark, d):
    v = F.when(F.col("value") > 90, F.lit(float("inf"))).when(F.col("user_id") % 7 == 0, F.lit(None)).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", scalar.fill(v, -999.0).alias("v"))


@query("WITH t AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events), m AS (SELECT avg(v) AS m FROM t WHERE event_id % 2 = 0) SELECT event_id, round(coalesce(v, m), 6) AS v FROM t, m WHERE event_id % 2 = 1")
def fill_mean(spark, d):
    from tessera.operators.encode import mean_impute

    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return rounded(mean_impute(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["v"]), {"v": 6})


@query("SELECT event_id, CASE WHEN value / 50 < 0 THEN 0.0 WHEN value / 50 > 1 THEN 1.0 ELSE value / 50 END::DOUBLE AS p FROM events")
def clip01(spark, d):
    return table(spark, d, "events").select("event_id", scalar.clip(F.col("value") / 50).alias("p"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def filter_date(spark, d):
    import datetime as dt

    return tables.shrink(table(spark, d, "orders"), "o_orderdate", dt.datetime(1995, 1, 1), dt.datetime(1996, 1, 1)).select("o_orderkey", "o_totalprice")


@query(f"SELECT {_ORDER} FROM lineitem WHERE l_suppkey >= l_linenumber * 10")
def filter_col_col(spark, d):
    rows = table(spark, d, "lineitem").withColumn("least", F.col("l_linenumber") * 10)
    return tables.shrink(rows, "l_shipdate", not_before="least", week="l_suppkey").select(*LINE)


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def filter_equality(spark, d):
    from tessera.sources.readers import read_parquet

    return read_parquet(spark, f"{d}/events.parquet", {"event_type": "click"}, ["event_id", "event_type"])


@query(
    """WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
    SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM t"""
)
def ffill_bfill(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return ranks.forward_backward_fill(rows, ["v"], ["user_id"], ["ts", "event_id"]).select("event_id", "v")


@query("SELECT event_id, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 4)::BIGINT AS nth FROM events")
def nth_in_group(spark, d):
    return ranks.nth_in_group(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], last=4).select("event_id", "nth")


@query("SELECT p_partkey AS part_p_partkey, p_name AS part_p_name, p_brand AS p_brand FROM part")
def rename_prefix(spark, d):
    return tables.affix(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), prefix="part", keep=("p_brand",))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def drop_duplicate_columns(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tables.drop_duplicate_columns(o.select("o_orderkey", "o_totalprice", F.col("o_totalprice")))
