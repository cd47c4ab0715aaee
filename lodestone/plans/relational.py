"""Queries of projection, filter, join, aggregation and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import aggregate as A
from ..operators import joins as J
from .catalog import query, table


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
       sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_quantity) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.sum(price).alias("sum_disc_price"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("count_order"))


@query("""
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F') AND contains(lower(o_orderpriority), 'urgent') AND NOT (o_orderkey = 7)""")
def filter_conjunction(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(P.all_of([("o_totalprice", "between", (1000, 200000)), ("o_orderstatus", "in", ["O", "F"]), ("o_orderpriority", "contains", "URGENT"), ("o_orderkey", "ne", 7)])).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("""
SELECT event_id, event_type FROM events
WHERE (event_type IN ('click', 'purchase') OR coalesce(value > 90, false)) AND NOT coalesce(user_id < 5, false) AND regexp_matches(event_type, '^[a-z_]+$')""")
def rule_tree(spark, sf_dir):
    tree = {"all": [{"any": [{"field": "event_type", "op": "in", "value": ["click", "purchase"]}, {"field": "value", "op": "gt", "value": 90}]}, {"not": {"field": "user_id", "op": "lt", "value": 5}}, {"field": "event_type", "op": "regex", "value": "^[a-z_]+$"}]}
    return table(spark, sf_dir, "events").where(P.rule(tree)).select("event_id", "event_type")


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10")
def order_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("""
SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 10""")
def group_having(spark, sf_dir):
    return A.aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], [A.Agg("n_orders", "count"), A.Agg("total", "sum", "o_totalprice")], F.col("n_orders") >= 10)


@query("""
SELECT event_type, count(*) AS n, coalesce(sum(value), 0.0) AS total, min(value) AS lo, max(value) AS hi, avg(value) AS mean,
       count(DISTINCT user_id) AS users, quantile_cont(value, 0.95) AS p95, median(value) AS mid,
       coalesce(stddev_samp(value), 0.0) AS sd, coalesce(var_samp(value), 0.0) AS var,
       arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value,
       sum(value * user_id) / nullif(sum(user_id), 0) AS weighted
FROM events GROUP BY event_type""")
def aggregate_engine(spark, sf_dir):
    g = A.Agg
    return A.aggregate(table(spark, sf_dir, "events"), ["event_type"], [g("n", "count"), g("total", "sum", "value"), g("lo", "min", "value"), g("hi", "max", "value"), g("mean", "avg", "value"), g("users", "count_distinct", "user_id"), g("p95", "percentile", "value"), g("mid", "median", "value"), g("sd", "stddev", "value"), g("var", "variance", "value"), g("first_value", "first", "value", order="event_id"), g("last_value", "last", "value", order="event_id"), g("weighted", "weighted_avg", "value", weight="user_id")])


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, grouping(l_returnflag) = 1 AS is_total
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""")
def grand_totals(spark, sf_dir):
    return A.with_totals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [A.Agg("qty", "sum", "l_quantity"), A.Agg("n", "count")])


@query("""
WITH s AS (SELECT p_brand AS key, sum(l_extendedprice) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY total DESC, key) AS rn FROM s)
SELECT CASE WHEN rn <= 5 THEN key ELSE 'other' END AS key, sum(total) AS total FROM r GROUP BY 1""")
def top_segments_other(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return A.top_with_other(sold, "p_brand", "l_extendedprice", 5)


@query("""
WITH s AS (SELECT 'c_mktsegment' AS dimension, c_mktsegment AS member, sum(c_acctbal) AS total FROM customer GROUP BY 2
UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, sum(c_acctbal) FROM customer GROUP BY 2)
SELECT *, total / nullif(sum(total) OVER (PARTITION BY dimension), 0) AS share FROM s""")
def dimension_breakdown(spark, sf_dir):
    return A.breakdown(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal")


@query("""
WITH n AS (SELECT event_type::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1)
SELECT value, n, n / (SELECT sum(n) FROM n) AS share FROM n""")
def value_frequencies(spark, sf_dir):
    return A.frequencies(table(spark, sf_dir, "events"), "event_type")


@query("""
WITH n AS (SELECT p_brand AS v, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)
SELECT count(*) AS n_distinct, arg_max(v, (n, v)) AS mode, -sum(n / t * log2(n / t)) AS entropy FROM n, t""")
def column_entropy(spark, sf_dir):
    return A.entropy(table(spark, sf_dir, "part"), "p_brand")


@query("""
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS t FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM lineitem, e WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT bin, lo + (hi - lo) / 10 * bin AS low, lo + (hi - lo) / 10 * (bin + 1) AS high, n, n / t AS share,
       sum(n) OVER (ORDER BY bin) / t AS cumulative FROM b, e""")
def equal_width_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)


@query("""
WITH a AS (SELECT o_orderpriority, sum(o_totalprice) AS current FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
b AS (SELECT o_orderpriority, sum(o_totalprice) AS previous FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1),
c AS (SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(current, 0.0) AS current, coalesce(previous, 0.0) AS previous FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority)
SELECT *, current - previous AS delta, (current - previous) * 100 / nullif(abs(previous), 0) AS pct,
       CASE WHEN current - previous > 1e-9 THEN 'up' WHEN current - previous < -1e-9 THEN 'down' ELSE 'flat' END AS trend FROM c""")
def period_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return A.compare_periods(o.where(F.year("o_orderdate") == 1997), o.where(F.year("o_orderdate") == 1996), ["o_orderpriority"], "o_totalprice")


@query("""
SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def left_joins(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


@query("""
SELECT o.*, c.c_mktsegment, c.c_custkey IS NOT NULL AS matched FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey""")
def enrichment_lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.enrich(table(spark, sf_dir, "orders"), dim, ["o_custkey"], ["c_mktsegment"], missing="mark")


@query("SELECT o.* FROM orders o ANTI JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey WHERE o_custkey IS NOT NULL")
def foreign_key_orphans(spark, sf_dir):
    return J.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0"), {"o_custkey": "c_custkey"})


@query("""
SELECT count(*) AS n_ref, count(o_custkey) AS n_covered, count(o_custkey) / count(*) AS coverage
FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""")
def reference_coverage(spark, sf_dir):
    return J.coverage(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE l_extendedprice IS NOT DISTINCT FROM p_retailprice AND p_partkey IS NOT NULL) AS n_matching,
       count(*) FILTER (WHERE l_extendedprice IS NOT DISTINCT FROM p_retailprice AND p_partkey IS NOT NULL) / count(*) AS accuracy
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def reference_accuracy(spark, sf_dir):
    ref = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return J.value_accuracy(table(spark, sf_dir, "lineitem"), ref, "l_partkey", "l_extendedprice", "p_retailprice")


@query("""
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts AS seen, max(value) AS last_value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, e.ts, v.last_value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.seen""")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("value").alias("last_value"))
    return J.asof(left, right, ["user_id"], "ts", "seen", ["last_value"])


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) AS similarity
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.8""")
def fuzzy_block_join(spark, sf_dir):
    return J.fuzzy_matches(table(spark, sf_dir, "part"), "p_partkey", "p_name", F.concat("p_brand", F.lit("|"), F.col("p_size").cast("string")), 0.8)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).subtract(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nation, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("side"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("side")))


@query("""
SELECT p_brand, p_partkey, p_retailprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rn FROM part) WHERE rn <= 3""")
def top_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("p_brand", "p_partkey", "p_retailprice", "rn")
