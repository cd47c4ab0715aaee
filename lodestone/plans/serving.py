"""Queries of cleaning and mapping, retrieval, anomalies, strong components, statements and scorecards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import anomaly as A
from ..operators import cleaning as C
from ..operators import finance as N
from ..operators import graph as G
from ..operators import retrieval as R
from ..session import shared_folder
from ..streaming import state as ST
from ..streaming import windows as W
from .analytics import EDGES_SQL, trade_edges
from .catalog import query, table

CUSTOMER = [
    C.Field("c_custkey", "id", "integer", required=True),
    C.Field("c_name", "name", text={"case": "upper", "longest": 20}, shortest=3),
    C.Field("c_acctbal", "balance", "number", low=0, high=9000, outside="clip", digits=1),
    C.Field("c_nationkey", "nation", "integer", high=22, outside="drop"),
    C.Field("c_mktsegment", "segment", text={"case": "lower"}, allowed=("building", "automobile", "machinery")),
]

_CLEAN_SQL = """
c AS (SELECT c_custkey AS id, upper(c_name)[1:20] AS name, round(least(greatest(c_acctbal, 0), 9000), 1) AS balance, c_nationkey::BIGINT AS nation, lower(c_mktsegment) AS segment FROM customer WHERE c_nationkey <= 22)"""


@query(f"WITH {_CLEAN_SQL} SELECT * FROM c WHERE segment IN ('building', 'automobile', 'machinery')")
def cleaned_customers(spark, sf_dir):
    good, _ = C.cleaned(table(spark, sf_dir, "customer"), CUSTOMER)
    return good


@query(f"WITH {_CLEAN_SQL} SELECT 'allowed:segment' AS reason, count(*) AS n FROM c WHERE segment NOT IN ('building', 'automobile', 'machinery') HAVING count(*) > 0")
def cleaning_errors(spark, sf_dir):
    _, dead = C.cleaned(table(spark, sf_dir, "customer"), CUSTOMER)
    return dead.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) > 1 AS _duplicate FROM orders")
def marked_duplicates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return C.marked_duplicates(o, ["o_custkey", "day"], ["o_orderkey"]).select("o_orderkey", "_duplicate")


@query("""
WITH m AS (SELECT p_partkey AS id, coalesce(nullif(trim(p_brand), ''), p_type) AS label, p_size AS size, p_retailprice * 2 AS price FROM part)
SELECT id, label, size, price, CASE WHEN size > 40 THEN 'check:size:small' ELSE '' END AS errors FROM m""")
def schema_mapping(spark, sf_dir):
    targets = [
        C.Target("id", ("partkey", "p_partkey"), "long", required=True),
        C.Target("label", ("p_brand", "p_type")),
        C.Target("size", ("p_size",), "int", checks={"small": F.col("size") <= 40}),
        C.Target("price", dtype="double", derive=F.col("p_retailprice") * 2),
    ]
    return C.mapped(table(spark, sf_dir, "part"), targets).withColumn("errors", F.array_join("errors", ","))


@query("""
SELECT event_id, array_to_string([trim(x) for x in string_split(event_type || ', ,' || user_id, ',') if trim(x) <> ''], '|') AS parts, 'b' AS last_a, user_id::VARCHAR AS user, props->>'$.k' AS k FROM events""")
def parsed_values(spark, sf_dir):
    listed = X.listed(F.concat_ws(", ,", "event_type", F.col("user_id").cast("string")))
    m = X.pairs(F.concat(F.lit("a=1; user = "), F.col("user_id").cast("string"), F.lit("; a=b")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(listed, "|").alias("parts"), m["a"].alias("last_a"), m["user"].alias("user"), X.at_path(F.col("props"), "k").alias("k"))


def _fragment(i: int) -> str:
    start = f"(length(array_to_string(p[1:{i + 1}], '')) + length(array_to_string(m[1:{i}], '')))"
    stop = f"({start} + length(m[{i + 1}]))"
    cut = f"regexp_replace(substr(text, greatest(0, {start} - 30) + 1, least(length(text), {stop} + 30) - greatest(0, {start} - 30)), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN len(m) > {i} THEN CASE WHEN {start} > 30 THEN '...' ELSE '' END || {cut} || CASE WHEN {stop} + 30 < length(text) THEN '...' ELSE '' END END"


@query(f"""
WITH t AS (SELECT item_id, text, string_split_regex(text, '(?i)(the|and|with)') AS p, regexp_extract_all(text, '(?i)(the|and|with)') AS m FROM benchmark)
SELECT item_id, concat_ws('|', {_fragment(0)}, {_fragment(1)}, {_fragment(2)}) AS shown FROM t""")
def highlighted(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(R.highlights(F.col("text"), "The and with a", 3, 60), "|").alias("shown"))


@query("""
WITH r AS (SELECT lang, coalesce(source, 'unknown') AS source, doc_id, n_chars, coalesce(text, '') AS text, row_number() OVER (PARTITION BY lang, coalesce(source, 'unknown') ORDER BY n_chars NULLS LAST, doc_id) AS turn FROM documents QUALIFY turn <= 6),
t AS (SELECT *, first(n_chars) OVER w AS top, first(doc_id) OVER w AS fk FROM r WINDOW w AS (PARTITION BY lang, source ORDER BY turn)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, top NULLS LAST, fk) AS position FROM t QUALIFY position <= 6),
u AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY lang ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p)
SELECT lang, doc_id, position, CASE WHEN length(text) > 1200 - used THEN substr(text, 1, greatest(0, 1200 - used - 18)::INT) || chr(10) || '...[TRUNCATED]' ELSE text END AS content FROM u WHERE used < 1200""")
def context_packing(spark, sf_dir):
    """The shortest documents of each language, sources in turn, in 1,200 characters."""
    docs = table(spark, sf_dir, "documents").withColumn("score", -F.col("n_chars"))
    return R.packed(docs, ["lang"], "source", "doc_id", "score", "text", 1200, 6)


@query()
def diverse_documents(spark, sf_dir):
    """Greedy choice depends on every choice before, which SQL cannot say plainly; tested against a plain loop."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.log1p("n_chars").alias("score"), "text")
    return R.diverse(docs, ["lang"], "doc_id", "score", "text", 10, like="text")


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}_]+'))"


@query(f"""
WITH one AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) = 1),
c AS (SELECT conv_id, turn AS claim, {_WORDS} AS w FROM one WHERE role = 'assistant'), e AS (SELECT conv_id, turn AS doc, {_WORDS} AS w FROM one WHERE role <> 'assistant'),
s AS (SELECT conv_id, claim, doc, len(list_intersect(c.w, e.w)) / len(list_distinct(list_concat(c.w, e.w))) AS s FROM c JOIN e USING (conv_id) WHERE len(list_intersect(c.w, e.w)) > 0)
SELECT c.conv_id, c.claim, coalesce(max(s), 0) AS support, arg_min(doc, (-s, doc)) AS doc, coalesce(max(s), 0) >= 0.2 AS is_supported FROM c LEFT JOIN s ON c.conv_id = s.conv_id AND c.claim = s.claim GROUP BY 1, 2""")
def supported_claims(spark, sf_dir):
    """How far the assistant's turns rest on what the conversation says elsewhere. Of rows that repeat a turn the least by role and text counts."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.role", "x.text")
    mine = F.col("role") == "assistant"
    claims = turns.where(mine).withColumnRenamed("turn", "claim")
    return R.supported(claims, turns.where(~mine).withColumnRenamed("turn", "doc"), ["conv_id"], "claim", "doc", "text", 0.2)


@query()
def hashed_embeddings(spark, sf_dir):
    """BLAKE2b is in neither engine; tested against a plain loop."""
    return R.hashed_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query()
def isolation_scores(spark, sf_dir):
    """A forest has no SQL; its scores are tested row by row, and planted strangers must be found."""
    return A.isolation_forest(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey", "isolation", "is_outlier")


@query("""
WITH RECURSIVE a AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, event_id, i FROM a WHERE i = 1
  UNION ALL SELECT n.user_id, n.ts, n.event_id, n.i FROM (SELECT a.*, row_number() OVER (PARTITION BY a.user_id ORDER BY a.i) AS k FROM r JOIN a ON a.user_id = r.user_id AND a.i > r.i AND a.ts >= r.ts + INTERVAL 1 DAY) n WHERE k = 1)
SELECT user_id, ts, event_id FROM r""")
def alert_cooldown(spark, sf_dir):
    hits = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return A.cooled(hits, ["user_id"], "ts", 86400, F.col("event_id"))


@query("""
SELECT user_id::VARCHAR AS entity, ts, coalesce(value, 0) AS value, event_type AS label, count(*) OVER w AS n_recent, sum(coalesce(value, 0)) OVER w AS sum_recent
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def stream_velocity(spark, sf_dir):
    """The events as a stream; labels depend on the time to live and are tested in small."""
    at = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet")
    W.run_available(ST.velocity(stream, "user_id", "ts", "value", "event_type", 86400, 30 * 86400, "1 day"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").drop("is_new_label")


@query()
def graph_strong_components(spark, sf_dir):
    """Needs reach in both directions of every node; tested against brute force."""
    return G.strong_components(trade_edges(spark, sf_dir))


@query(f"WITH {EDGES_SQL}, n AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 0 UNION SELECT -s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT src, dst FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def graph_subgraph(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select((-F.col("s_suppkey")).alias("node"))
    return G.subgraph(trade_edges(spark, sf_dir), c.union(s))


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0) AS receipts, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0) AS payments FROM orders GROUP BY 1),
r AS (SELECT *, receipts - payments AS net, 1000 + sum(receipts - payments) OVER (ORDER BY period) AS closing FROM m)
SELECT period, receipts, payments, net, closing - net AS opening, closing FROM r""")
def cash_flow(spark, sf_dir):
    return N.cash_flow(table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyy-MM"), "o_totalprice", F.col("o_orderstatus") != "F", 1000)


@query("""
WITH x AS (SELECT CASE WHEN c_acctbal >= 0 THEN 'assets' ELSE 'liabilities' END AS side, c_mktsegment AS grp, abs(c_acctbal) AS v FROM customer)
SELECT side, grp, sum(v) AS total FROM x GROUP BY ROLLUP (side, grp) HAVING grouping(side) = 0
UNION ALL SELECT 'equity', NULL, sum(CASE WHEN side = 'assets' THEN v ELSE -v END) FROM x""")
def balance_sheet(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("v", F.abs("c_acctbal"))
    return N.balance_sheet(c, F.when(F.col("c_acctbal") >= 0, "assets").otherwise("liabilities"), F.col("c_mktsegment"), "v")


@query("""
WITH k AS (SELECT l_returnflag AS domain, 'discount' AS kpi, avg(l_discount) / 0.05 * 100 AS achieved FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'tax', 0.03 / avg(l_tax) * 100 FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'quantity', avg(l_quantity) / 30 * 100 FROM lineitem GROUP BY 1),
s AS (SELECT *, CASE WHEN achieved >= 110 THEN 100 WHEN achieved >= 95 THEN 85 WHEN achieved >= 75 THEN 60 WHEN achieved IS NULL THEN 50 ELSE 30 END AS points FROM k)
SELECT domain, count(*) AS kpis, round(avg(points), 2) AS health, count(*) FILTER (points = 30) AS critical FROM s GROUP BY 1""")
def scorecard(spark, sf_dir):
    """Three measures of one scan, each against its target, as rows; a health score for each domain."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("domain"))
    m = m.agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    targets = {"discount": (0.05, True), "tax": (0.03, False), "quantity": (30.0, True)}
    kpis = [F.struct(F.lit(n).alias("kpi"), N.achievement(F.col(n), F.lit(t), up)[1].alias("status")) for n, (t, up) in targets.items()]
    rows = m.select("domain", F.inline(F.array(*kpis)))
    return rows.groupBy("domain").agg(F.count("*").alias("kpis"), N.health(F.col("status")).alias("health"), F.count_if(F.col("status") == "critical").alias("critical"))


@query("""
WITH f AS (SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM events)
SELECT x.event_id, y.total AS total_a_day_before FROM events x LEFT JOIN LATERAL (SELECT total FROM f WHERE f.user_id = x.user_id AND f.ts <= x.ts - INTERVAL 1 DAY ORDER BY f.ts DESC, f.event_id DESC LIMIT 1) y ON true""")
def point_in_time(spark, sf_dir):
    """Each event with the running total that its user had a day before: features materialised at their time, read as of another."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    of_user = Window.partitionBy("user_id")
    made = e.select("user_id", "ts", F.lit(None).cast("long").alias("ask"), "event_id", F.sum("value").over(of_user.orderBy("ts", "event_id")).alias("total"))
    asked = e.select("user_id", (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("event_id").alias("ask"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("total"))
    latest = F.last("total", ignorenulls=True).over(of_user.orderBy("ts", F.col("ask").isNotNull(), "event_id", "ask"))
    both = made.unionByName(asked).withColumn("total_a_day_before", latest)
    return both.where(F.col("ask").isNotNull()).select(F.col("ask").alias("event_id"), "total_a_day_before")
