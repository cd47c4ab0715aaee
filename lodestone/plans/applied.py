"""Queries of sources, sinks and DML, windows over events, search, governance, forecasts and finance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import forecast as P
from ..operators import governance as V
from ..operators import search as S
from ..session import shared_folder
from ..sources import files
from ..streaming import windows as W
from .catalog import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _shared(spark) -> str:
    return f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"


def measures(*names: str) -> dict:
    found = {"n": F.count("*"), "total": F.sum("value"), "users": F.count_distinct("user_id")}
    return {n: found[n] for n in names or found}


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, sum(value) AS total, count(DISTINCT user_id) AS users
FROM events GROUP BY ALL""")
def window_tumbling(spark, sf_dir):
    return W.windowed(events(spark, sf_dir), "ts", "1 hour", ["event_type"], measures())


@query("""
WITH s AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - to_hours(i::INTEGER) AS window_start, event_type, value, user_id FROM events, (VALUES (0), (2), (4)) AS o(i))
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, sum(value) AS total, count(DISTINCT user_id) AS users FROM s GROUP BY ALL""")
def window_sliding(spark, sf_dir):
    return W.windowed(events(spark, sf_dir), "ts", "6 hours", ["event_type"], measures(), slide="2 hours")


@query("""
WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k""")
def window_sessions(spark, sf_dir):
    return W.session_windows(events(spark, sf_dir), "ts", "30 minutes", ["user_id"], measures("n", "total"))


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, sum(value) AS total, 'daily_total' AS rule, 'daily_total:' || user_id AS identity FROM events GROUP BY ALL HAVING sum(value) > 100""")
def window_alerts(spark, sf_dir):
    days = W.windowed(events(spark, sf_dir), "ts", "1 day", ["user_id"], {"total": F.sum("value")}).drop("window_end")
    return W.alerts(days, "total", "gt", 100, ["user_id"], "daily_total")


@query("""
WITH c AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
SELECT *, window_start + INTERVAL 1 HOUR AS window_end FROM c WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_closed_windows(spark, sf_dir):
    """The events as a stream: windows that the watermark has closed are appended to a table; the open ones are not in it."""
    at = _shared(spark)
    kind = events(spark, sf_dir).schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = W.windowed(stream, "ts", "1 hour", ["event_type"], measures("n", "total"), lateness="10 minutes")
    W.run_available(closed, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("""SELECT event_type, sum((props->>'$.k')::BIGINT) AS k_total, count(props->>'$.k') AS k_known FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("k_total"), F.count(k).alias("k_known"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 1.5 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N', o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def upsert_orders(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = old.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 1.5)
    new = old.where("o_orderstatus = 'P'").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N")})
    return files.upsert(old, changed.union(new), ["o_orderkey"])


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment = 'BUILDING' AS is_deleted, CASE WHEN c_mktsegment = 'BUILDING' THEN 'job' END AS deleted_by
FROM customer WHERE NOT (c_mktsegment = 'MACHINERY')""")
def update_delete(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    df = files.update(files.delete(df, F.col("c_mktsegment") == "MACHINERY"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})
    return files.soft_delete(df, F.col("c_mktsegment") == "BUILDING", "job", F.current_timestamp()).select("c_custkey", "c_acctbal", "is_deleted", "deleted_by")


@query("""
SELECT to_json(list_filter([CASE WHEN user_id IS NULL THEN 'missing:user_id' END, CASE WHEN coalesce(value <= 10, false) THEN NULL ELSE 'rule:small' END, CASE WHEN coalesce(event_type <> 'error', false) THEN NULL ELSE 'rule:no_error' END], lambda x: x IS NOT NULL))::VARCHAR AS reasons, count(*) AS n
FROM events GROUP BY 1 HAVING reasons <> '[]'""")
def dead_letters(spark, sf_dir):
    _, dead = files.split_bad(events(spark, sf_dir), ["user_id"], {"small": F.col("value") <= 10, "no_error": F.col("event_type") != "error"})
    return dead.groupBy(F.to_json("reasons").alias("reasons")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, round(CASE WHEN len(ws) > 0 THEN least(1.0, 0.75 * len(list_intersect(['and', 'of', 'river', 'the'], ws)) / 4 + 0.10 * len(list_filter(ws, lambda w: w IN ('and', 'of', 'river', 'the'))) / greatest(1, len(ws)) + 0.15 * contains(low, 'the river and of')::INTEGER) ELSE 0 END, 12) AS score FROM t)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 ORDER BY rank LIMIT 50""")
def keyword_ranking(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("words", S.word_list(F.col("text")))
    return S.ranked(docs, "doc_id", F.round(S.keyword_score(F.col("text"), F.col("words"), "the river and of"), 12), 50)


@query("""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 100),
b AS (SELECT l_orderkey AS o_orderkey, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_orderkey) AS rank FROM lineitem GROUP BY 1 ORDER BY rank LIMIT 100),
f AS (SELECT o_orderkey, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (FROM a UNION ALL FROM b) GROUP BY 1)
SELECT o_orderkey, s / (SELECT max(s) FROM f) AS score FROM f""")
def rank_fusion(spark, sf_dir):
    price = S.ranked(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice"), 100)
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return S.fused([price, S.ranked(sums, "o_orderkey", F.col("q"), 100)], "o_orderkey")


@query("""
WITH n AS (SELECT doc_id, text, CASE WHEN length(text) > 0 THEN greatest(1, ceil((length(text) - 50) / 450.0))::INTEGER ELSE 0 END AS c FROM documents),
k AS (SELECT doc_id, text, unnest(range(0, c)) AS chunk FROM n)
SELECT doc_id, chunk, chunk * 450 AS start, md5(substr(text, chunk * 450 + 1, 500)) AS content_md5 FROM k""")
def chunk_windows(spark, sf_dir):
    return S.chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 500, 50).select("doc_id", "chunk", "start", F.md5("content").alias("content_md5"))


_NUMBER = "('0x' || substr(sha256('pepper' || c_custkey), 1, 8))::BIGINT"


@query(f"""
SELECT c_custkey, sha256('pepper' || c_name) AS c_name, NULL::VARCHAR AS c_mktsegment, c_acctbal + c_acctbal * 0.2 * ({_NUMBER} / 4294967295.0::DOUBLE - 0.5) AS c_acctbal FROM customer""")
def masked_customers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return V.masked(df, {"c_name": F.sha2(F.concat(F.lit("pepper"), "c_name"), 256), "c_mktsegment": None, "c_acctbal": V.noisy(F.col("c_acctbal"), F.col("c_custkey"), "pepper", 0.1)})


@query("""
SELECT o_orderkey, (o_orderdate::DATE + ((('0x' || substr(sha256('pepper' || o_custkey), 1, 8))::BIGINT % 61 - 30)::INTEGER))::VARCHAR AS shifted FROM orders""")
def shifted_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.shifted_date(F.col("o_orderdate"), F.col("o_custkey"), "pepper", 30).cast("string").alias("shifted"))


def _pad(byte: int, key: bytes = b"key") -> str:
    """The key's block of an HMAC, xor a byte, in hexadecimal."""
    return bytes(c ^ byte for c in key.ljust(64, b"\0")).hex()


@query(f"""
SELECT c_custkey, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode('t1|p1|c_name|' || c_name)))) AS token FROM customer""")
def tokenised_customers(spark, sf_dir):
    """HMAC tokens."""
    return table(spark, sf_dir, "customer").select("c_custkey", V.hmac_sha256(F.concat_ws("|", F.lit("t1"), F.lit("p1"), F.lit("c_name"), "c_name"), b"key").alias("token"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'review' WHEN o_orderstatus = 'F' THEN CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') < 365 THEN 'keep' WHEN o_totalprice > 200000 THEN 'review' ELSE 'delete' END
  WHEN o_orderstatus = 'O' THEN CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-01-01') < 1000 THEN 'keep' ELSE 'archive' END ELSE 'no_policy' END AS action FROM orders""")
def retention_actions(spark, sf_dir):
    status = F.col("o_orderstatus")
    action = V.retention(F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date"), [(status == "F", 365, "delete"), (status == "O", 1000, "archive")], F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 200000)
    return table(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"))


CONTRACT = {"l_quantity": {"required": True, "min": 1, "max": 45}, "l_returnflag": {"allowed": ["A", "N"]}, "l_linestatus": {"pattern": "^[A-Z]$", "longest": 1}}


@query("""
SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'l_quantity_max' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'l_returnflag_allowed' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def contract_breaches(spark, sf_dir):
    rules = V.contract_rules(CONTRACT)
    broken = F.array_compact(F.array(*(F.when(~r, F.lit(n)) for n, r in rules.items())))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(broken).alias("rule"))


@query("""
SELECT event_id, 1 - (CASE WHEN value > 10 THEN 0.6 ELSE 1 END) * (CASE WHEN event_type = 'error' THEN 0.5 ELSE 1 END) * (CASE WHEN hour(ts) < 6 THEN 0.8 ELSE 1 END) AS risk,
  CASE WHEN (CASE WHEN value > 10 THEN 0.6 ELSE 1 END) * (CASE WHEN event_type = 'error' THEN 0.5 ELSE 1 END) * (CASE WHEN hour(ts) < 6 THEN 0.8 ELSE 1 END) <= 0.55 THEN 'high'
       WHEN value > 10 OR event_type = 'error' OR hour(ts) < 6 THEN 'medium' ELSE 'low' END AS risk_level FROM events""")
def risk_scores(spark, sf_dir):
    risk, _ = V.noisy_or({"large": (F.col("value") > 10, 0.4), "error": (F.col("event_type") == "error", 0.5), "night": (F.hour("ts") < 6, 0.2)})
    return events(spark, sf_dir).select("event_id", risk.alias("risk"), V.level(risk, [(0.1, "medium"), (0.45, "high")], "low").alias("risk_level"))


def _monthly(spark, sf_dir):
    return P.series(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice"))


_SERIES = """
WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS p, sum(o_totalprice) AS x FROM orders GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM m)"""


@query(f"""{_SERIES}
SELECT o_orderpriority, h AS step, regr_intercept(x, i) + regr_slope(x, i) * (max(n) - 1 + h) AS value FROM i, (VALUES (1), (2), (3)) AS t(h) GROUP BY 1, 2""")
def forecast_trend(spark, sf_dir):
    return P.forecast(_monthly(spark, sf_dir), ["o_orderpriority"], "trend", 3)


@query(f"""{_SERIES} SELECT o_orderpriority, (i - (n - 12) + 1)::INTEGER AS step, x AS value FROM i WHERE i >= n - 12 AND i < n - 6""")
def forecast_seasonal(spark, sf_dir):
    return P.forecast(_monthly(spark, sf_dir), ["o_orderpriority"], "seasonal", 6)


@query(f"""{_SERIES}
SELECT o_orderpriority, h AS step, sum(x * CASE WHEN i = 0 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - 1 - i) END) AS value FROM i, (VALUES (1), (2), (3)) AS t(h) GROUP BY 1, 2""")
def forecast_smoothed(spark, sf_dir):
    return P.forecast(_monthly(spark, sf_dir), ["o_orderpriority"], "smoothed", 3)


@query(f"""{_SERIES},
a AS (SELECT o_orderpriority, avg(x) AS v1, max(x) FILTER (i = n - 1) AS l1, max(x) FILTER (i = n - 2) AS l2 FROM i WHERE i >= n - 3 GROUP BY 1)
SELECT o_orderpriority, 1 AS step, v1 AS value FROM a UNION ALL SELECT o_orderpriority, 2, (l2 + l1 + v1) / 3 FROM a""")
def forecast_moving(spark, sf_dir):
    return P.forecast(_monthly(spark, sf_dir), ["o_orderpriority"], "moving", 2)


@query("""
WITH p AS (SELECT o_orderkey, o_totalprice AS p, o_totalprice * (0.01 * pow(1.01, 12) / (pow(1.01, 12) - 1)) AS pay, unnest(range(1, 13))::INTEGER AS k FROM orders),
b AS (SELECT *, p * pow(1.01, k - 1) - pay * (pow(1.01, k - 1) - 1) / 0.01 AS before, CASE WHEN k = 12 THEN 0 ELSE p * pow(1.01, k) - pay * (pow(1.01, k) - 1) / 0.01 END AS after FROM p)
SELECT o_orderkey, k AS period, before * 0.01 AS interest, before - after AS repaid, after AS balance FROM b""")
def loan_schedule(spark, sf_dir):
    return P.schedule(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 0.01, 12)


@query("""
SELECT o_custkey, sum(o_totalprice / pow(1.08, year(o_orderdate) - 1992)) AS npv FROM orders GROUP BY 1""")
def net_present_value(spark, sf_dir):
    return P.net_present_value(table(spark, sf_dir, "orders"), ["o_custkey"], F.year("o_orderdate") - 1992, F.col("o_totalprice"), 0.08)
