"""Queries of features, series, hypothesis tests, metrics and finance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import finance as N
from ..operators import stats as S
from ..operators import timeseries as T
from .catalog import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("""
SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS day_of_week, dayofyear(ts)::INT AS day_of_year, weekofyear(ts)::INT AS week, hour(ts)::INT AS hour, quarter(ts)::INT AS quarter,
  isodow(ts) >= 6 AS is_weekend, day(ts) = 1 AS is_month_start, last_day(ts) = ts::DATE AS is_month_end, sin(month(ts) * 2 * pi() / 12) AS month_sin, cos(month(ts) * 2 * pi() / 12) AS month_cos FROM events""")
def calendar_features(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in E.calendar(F.col("ts")).items()))


@query("""
SELECT o_orderkey, (o_orderstatus = 'F')::INT AS status_F, (o_orderstatus = 'O')::INT AS status_O, (o_totalprice >= 50000)::INT + (o_totalprice >= 150000)::INT + (o_totalprice >= 250000)::INT AS price_bin,
  coalesce(nullif(CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE '' END, ''), o_orderpriority) AS label FROM orders""")
def row_features(spark, sf_dir):
    status = F.col("o_orderstatus")
    hot = E.one_hot(status, ["F", "O"], "status")
    return orders(spark, sf_dir).select("o_orderkey", *(c.alias(n) for n, c in hot.items()), E.binned(F.col("o_totalprice"), [50000, 150000, 250000]).alias("price_bin"), E.first_text(F.when(status != "F", status).otherwise(""), F.col("o_orderpriority")).alias("label"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) / count(*) OVER () AS o_orderpriority_share FROM orders")
def frequency_encoding(spark, sf_dir):
    return E.frequency_encoded(orders(spark, sf_dir), "o_orderpriority").select("o_orderkey", "o_orderpriority_share")


@query("""
SELECT event_id, ln(1 + greatest(value, 0)) AS value_log, CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS value_z FROM events WINDOW w AS (PARTITION BY user_id)""")
def entity_scaling(spark, sf_dir):
    return E.scaled_within(events(spark, sf_dir), ["user_id"], "value").select("event_id", "value_log", "value_z")


@query("SELECT o_orderkey, sum(o_totalprice) OVER w AS group_sum, count(*) OVER w AS group_n, o_totalprice / sum(o_totalprice) OVER w AS group_share FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def group_shares(spark, sf_dir):
    return E.group_share(orders(spark, sf_dir), ["o_custkey"], "o_totalprice").select("o_orderkey", "group_sum", "group_n", "group_share")


@query("SELECT * FROM (SELECT event_id, value, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL")
def supervised_target(spark, sf_dir):
    return E.supervised(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", "value", "target")


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS time, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def duplicate_times(spark, sf_dir):
    return E.one_for_each_time(events(spark, sf_dir), ["user_id"], F.date_trunc("day", "ts"), "event_id", "value")


@query("""
WITH t AS (SELECT DISTINCT user_id, epoch(date_trunc('hour', ts))::BIGINT AS t FROM events), s AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS step, count(*) OVER (PARTITION BY user_id) AS n FROM t),
c AS (SELECT user_id, step, count(*) AS n FROM s WHERE step IS NOT NULL AND n >= 3 GROUP BY 1, 2)
SELECT user_id, step AS step_seconds FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, step) = 1""")
def inferred_frequency(spark, sf_dir):
    return E.inferred_step(events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts")), ["user_id"], "ts")


@query("""
WITH b AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (b) AS backward FROM b GROUP BY 1""")
def monotonic_check(spark, sf_dir):
    return E.backward_steps(events(spark, sf_dir), ["user_id"], "event_id", "value")


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AND row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS is_new FROM events""")
def new_value_flags(spark, sf_dir):
    return E.new_values(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("event_id", "is_new")


@query("""
SELECT event_id, count(value) OVER w AS past_n, avg(value) OVER w AS past_mean, stddev_samp(value) OVER w AS past_sd, coalesce(stddev_pop(value) OVER w, 0) AS past_spread, median(value) OVER f AS past_median, quantile_cont(value, 0.95) OVER f AS past_p95,
  coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS past_last
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)""")
def entity_running_stats(spark, sf_dir):
    return E.running_stats(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("event_id", "past_n", "past_mean", "past_sd", "past_spread", "past_median", "past_p95", "past_last")


@query("""
SELECT DISTINCT x.event_id FROM events x JOIN events y ON x.event_type = y.event_type AND abs(x.value - y.value) <= 0.01 + 1e-9 AND (y.ts < x.ts OR y.ts = x.ts AND y.event_id < x.event_id) AND epoch_us(x.ts) - epoch_us(y.ts) <= 7200000000""")
def duplicate_candidates(spark, sf_dir):
    return E.repeated_amounts(events(spark, sf_dir), ["event_type"], "event_id", "value", "ts", 7200)


@query("""
SELECT event_id, coalesce(event_type <> lag(event_type) OVER w AND epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000, false) AS is_jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def place_jumps(spark, sf_dir):
    return E.quick_changes(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", "ts", 3600).select("event_id", "is_jump")


_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


def _windows(hours):
    return ", ".join(f"count(value) FILTER ({w}) AS n_{n}, sum(value) FILTER ({w}) AS sum_{n}, avg(value) FILTER ({w}) AS mean_{n}, arg_max(value, ts) FILTER ({w}) AS last_{n}" for n, h in hours.items() for w in (f"ts <= {_AS_OF} AND ts > {_AS_OF} - INTERVAL {h} HOUR",))


HOURS = {"1d": 24, "7d": 168, "30d": 720}


@query(f"SELECT user_id, {_windows(HOURS)} FROM events GROUP BY 1")
def feature_windows(spark, sf_dir):
    return E.windows_as_of(events(spark, sf_dir), ["user_id"], "ts", "value", F.lit("2024-01-20 00:00:00").cast("timestamp"), HOURS)


@query("""
WITH s AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS b, avg(p_retailprice) AS c, stddev_samp(p_retailprice) AS d FROM part) SELECT p_partkey, sqrt(pow((p_size - a) / b, 2) + pow((p_retailprice - c) / d, 2)) > 2 AS is_outlier FROM part, s""")
def multivariate_outliers(spark, sf_dir):
    return E.distances(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("p_partkey", (F.col("distance") > 2).alias("is_outlier"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, ts, sha256(event_id || ':' || CASE WHEN event_id % 70 = 3 THEN 'other' ELSE event_type END) AS own FROM events), c AS (SELECT *, CASE WHEN event_id % 50 = 7 THEN 'x' ELSE lag(own) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS prev FROM e)
SELECT event_id, own <> sha256(event_id || ':' || event_type) AS tampered, prev IS DISTINCT FROM lag(own) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS unlinked FROM c""")
def hash_chain(spark, sf_dir):
    """A chain of the events' hashes in which every fiftieth link is spoilt, and every seventieth row was changed after it was hashed."""
    from pyspark.sql import Window

    digest = F.sha2(F.concat_ws(":", "event_id", "event_type"), 256)
    before = F.lag("own").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    chain = events(spark, sf_dir).withColumn("own", F.when(F.col("event_id") % 70 == 3, F.sha2(F.concat_ws(":", "event_id", F.lit("other")), 256)).otherwise(digest)).withColumn("prev", F.when(F.col("event_id") % 50 == 7, "x").otherwise(before))
    return E.broken_links(chain, ["user_id"], ["ts", "event_id"], "own", "prev", digest).select("event_id", "tampered", "unlinked")


@query("""
WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
x AS (SELECT o_orderpriority, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER (PARTITION BY o_orderpriority) - (row_number() OVER w - 1) AS back FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY p)),
q AS (SELECT o_orderpriority, stddev_samp(pm) AS ps FROM (SELECT o_orderpriority, i % 12 AS k, avg(v) AS pm FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderpriority, max(n) AS n, (max(v) FILTER (back = 1) - max(v) FILTER (back = 4)) / abs(max(v) FILTER (back = 4)) AS momentum,
  regr_slope(v, i) FILTER (back <= 3) - regr_slope(v, i) FILTER (back > 3 AND back <= 6) AS acceleration, abs(stddev_samp(v) / avg(v)) AS volatility,
  (avg(v) FILTER (back <= 12) - avg(v) FILTER (back > 12 AND back <= 24)) / abs(avg(v) FILTER (back > 12 AND back <= 24)) AS regime_change, any_value(ps) / abs(avg(v)) AS seasonal_strength
FROM x JOIN q USING (o_orderpriority) GROUP BY 1""")
def series_shapes(spark, sf_dir):
    monthly = orders(spark, sf_dir).groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("p")).agg(F.sum("o_totalprice").alias("v"))
    return T.series_shape(monthly, ["o_orderpriority"], "p", "v", 3, 12, 12)


@query("""
SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) / sqrt(count(*)) AS standard_error, avg(l_extendedprice) - 1.959963984540054 * stddev_samp(l_extendedprice) / sqrt(count(*)) AS lower,
  avg(l_extendedprice) + 1.959963984540054 * stddev_samp(l_extendedprice) / sqrt(count(*)) AS upper FROM lineitem GROUP BY 1""")
def confidence_intervals(spark, sf_dir):
    return S.confidence_intervals(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""
WITH t AS (SELECT l_returnflag, (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS one, (avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus <> 'F')) / sqrt(var_samp(l_quantity) FILTER (l_linestatus = 'F') / count(*) FILTER (l_linestatus = 'F') + var_samp(l_quantity) FILTER (l_linestatus <> 'F') / count(*) FILTER (l_linestatus <> 'F')) AS two,
  count(*) FILTER (l_discount > 0.05) / count(*) AS share, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'mean' AS test, one AS statistic, abs(one) > 1.959963984540054 AS reject FROM t UNION ALL SELECT l_returnflag, 'means', two, abs(two) > 1.959963984540054 FROM t
UNION ALL SELECT l_returnflag, 'share', (share - 0.45) / sqrt(0.45 * 0.55 / n), (share - 0.45) / sqrt(0.45 * 0.55 / n) > 1.6448536269514722 FROM t""")
def hypothesis_tests(spark, sf_dir):
    li, by = table(spark, sf_dir, "lineitem"), ["l_returnflag"]
    named = lambda df, n: df.select("l_returnflag", F.lit(n).alias("test"), "statistic", "reject")
    one, two = S.one_sample_test(li, by, "l_quantity", 25), S.two_sample_test(li, by, "l_quantity", F.col("l_linestatus") == "F")
    return named(one, "mean").unionByName(named(two, "means")).unionByName(named(S.proportion_test(li, by, F.col("l_discount") > 0.05, 0.45, alternative="greater"), "share"))


@query("""
WITH s AS (SELECT year(o_orderdate)::INT AS year, coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0) AS revenue, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS expenses FROM orders GROUP BY 1)
SELECT *, revenue - expenses AS net_profit, CASE WHEN revenue > 0 THEN (revenue - expenses) / revenue * 100 ELSE 0 END AS margin FROM s""")
def income_statement(spark, sf_dir):
    return N.income_statement(orders(spark, sf_dir).withColumn("year", F.year("o_orderdate")), ["year"], "o_totalprice", F.col("o_orderstatus") != "F")


@query("""
WITH c AS (SELECT o_custkey AS c, year(o_orderdate)::INT AS p, sum(o_totalprice) AS cur FROM orders GROUP BY 1, 2),
e AS (SELECT c, p, sum(cur) AS cur, sum(prev) AS prev FROM (SELECT c, p, cur, 0 AS prev FROM c UNION ALL SELECT c, p + 1, 0, cur FROM c) WHERE p <= (SELECT max(p) FROM c) GROUP BY 1, 2)
SELECT p AS period, sum(cur) AS revenue, sum(CASE WHEN prev = 0 THEN cur ELSE 0 END) AS new, sum(CASE WHEN prev > 0 AND cur > prev THEN cur - prev ELSE 0 END) AS expansion, sum(CASE WHEN cur > 0 AND cur < prev THEN prev - cur ELSE 0 END) AS contraction,
  sum(CASE WHEN cur = 0 THEN prev ELSE 0 END) AS churned, count(*) FILTER (cur > 0) AS customers,
  (sum(prev) + sum(CASE WHEN prev > 0 AND cur > prev THEN cur - prev ELSE 0 END) - sum(CASE WHEN cur > 0 AND cur < prev THEN prev - cur ELSE 0 END) - sum(CASE WHEN cur = 0 THEN prev ELSE 0 END)) / nullif(sum(prev), 0) AS nrr FROM e GROUP BY 1""")
def revenue_periods(spark, sf_dir):
    return N.revenue_periods(orders(spark, sf_dir), "o_custkey", F.year("o_orderdate"), "o_totalprice")


@query("""
WITH c AS (SELECT o_custkey AS c, year(o_orderdate)::INT AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), f AS (SELECT *, min(p) OVER (PARTITION BY c) AS cohort FROM c)
SELECT cohort, p - cohort AS age, count(*) AS customers, sum(v) AS revenue FROM f GROUP BY 1, 2""")
def revenue_cohorts(spark, sf_dir):
    return N.revenue_cohorts(orders(spark, sf_dir), "o_custkey", F.year("o_orderdate"), "o_totalprice")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 550 + (c_acctbal - 5000) * 0.3 WHEN c_acctbal >= 2000 THEN 100 + (c_acctbal - 2000) * 0.15 WHEN c_acctbal >= 1000 THEN (c_acctbal - 1000) * 0.1 ELSE 0 END AS tax FROM customer""")
def bracket_tax(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.bracket_tax(F.col("c_acctbal"), [(1000, 0, 0.1), (2000, 100, 0.15), (5000, 550, 0.3)]).alias("tax"))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_totalprice AS amount, o_orderdate::DATE AS date, o_orderpriority AS text FROM orders), t AS (SELECT id + 7 AS id, amount + 0.01 * (id % 3) AS amount, date + (id % 5)::INT AS date, CASE WHEN id % 2 = 0 THEN upper(text) ELSE 'other' END AS text FROM s),
p AS (SELECT s.id AS statement_id, t.id AS transaction_id, round(0.5 + 0.3 * (1 - abs(date_diff('day', s.date, t.date)) / 3) + CASE WHEN lower(s.text) = lower(t.text) THEN 0.2 ELSE 0 END, 9) AS score FROM s JOIN t ON abs(s.amount - t.amount) <= 0.01 + 1e-9 AND abs(date_diff('day', s.date, t.date)) <= 3)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY score DESC, transaction_id) = 1""")
def bank_matching(spark, sf_dir):
    """The orders as statements, and transactions made of them: other amounts, dates and texts."""
    s = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("text"))
    late = F.date_add("date", (F.col("id") % 5).cast("int"))
    t = s.select((F.col("id") + 7).alias("id"), (F.col("amount") + 0.01 * (F.col("id") % 3)).alias("amount"), late.alias("date"), F.when(F.col("id") % 2 == 0, F.upper("text")).otherwise("other").alias("text"))
    return N.bank_matches(s, t)


@query("""
WITH m AS (SELECT o_orderpriority AS k, count(*) AS orders, sum(o_totalprice) AS revenue, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders GROUP BY 1)
SELECT k AS o_orderpriority, revenue / orders AS average_order, closed / orders AS closed_share, 0.7 * revenue / customers / 1000 + 0.3 * closed / orders AS health, CASE WHEN closed / orders >= 0.5 THEN 'on_track' WHEN closed / orders >= 0.3 THEN 'at_risk' ELSE 'off_track' END AS status FROM m""")
def derived_metrics(spark, sf_dir):
    """Simple metrics in one aggregate; ratios, a weighted composite and a status as expressions over them."""
    m = orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("revenue"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    share = F.try_divide(F.col("closed"), F.col("orders"))
    return m.select("o_orderpriority", F.try_divide(F.col("revenue"), F.col("orders")).alias("average_order"), share.alias("closed_share"), (0.7 * F.try_divide(F.col("revenue"), F.col("customers")) / 1000 + 0.3 * share).alias("health"), F.when(share >= 0.5, "on_track").when(share >= 0.3, "at_risk").otherwise("off_track").alias("status"))


@query("SELECT o_orderstatus, o_orderpriority, sum(o_totalprice) AS total, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_cube(spark, sf_dir):
    return orders(spark, sf_dir).cube("o_orderstatus", "o_orderpriority").agg(F.sum("o_totalprice").alias("total"), F.grouping_id().alias("level"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS first_keys, count(*) > 0 AS any_order FROM orders GROUP BY 1")
def list_aggregate(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(F.slice(F.sort_array(F.collect_list("o_orderkey")), 1, 3), ",").alias("first_keys"), (F.count("*") > 0).alias("any_order"))


@query("""
WITH s AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
u AS (SELECT user_id, count(*) AS events, count(*) FILTER (gap IS NULL OR gap > 1800000000) AS sessions, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS f, max(ts) AS latest FROM s GROUP BY 1),
x AS (SELECT *, events + 5 * sessions + 20 * p + 3 * f + greatest(0, 30 - (epoch_us((SELECT max(ts) FROM events)) - epoch_us(latest)) // 86400000000) AS score FROM u)
SELECT user_id, events, sessions, score::DOUBLE AS score, CASE WHEN score >= 150 THEN 'power_user' WHEN score >= 75 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM x""")
def engagement(spark, sf_dir):
    """As of the last event; clicks stand for uses of a feature."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    return E.engagement(e.crossJoin(F.broadcast(now)), "user_id", "ts", "event_id", "event_type", F.col("now"), feature="click")
