"""Queries of feature selection, anomaly detectors and policies, kept states, aggregates of one's own and metric formulas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import inference as I
from ..operators import lagged as X
from ..operators import materialise as Z
from ..operators import metrics as M
from ..operators import privacy as P
from ..operators import selection as L
from ..operators import states as S
from ..operators import triggers as G
from ..operators.aggregate import Agg
from ..session import cut, shared_folder, spread
from ..streaming import windows as W
from .catalog import query, table

#: The columns that are offered to the selection, as SQL: two that move together, one that never changes, one that is mostly missing, some that tell nothing.
OFFERED = {
    "quantity": "l_quantity", "price": "l_extendedprice", "gross": "l_extendedprice * (1 + l_tax)", "discount": "l_discount", "tax": "l_tax", "line": "CAST(l_linenumber AS DOUBLE)",
    "flat": "CAST(1 AS DOUBLE)", "rare": "CASE WHEN l_orderkey % 50 = 0 THEN l_tax END",
}
CLASSES = {"linestatus": "l_linestatus", "ship_year": "CAST(year(l_shipdate) AS STRING)", "parity": "CASE WHEN l_partkey % 2 = 0 THEN 'even' WHEN l_partkey % 3 = 0 THEN '' ELSE 'odd' END"}


def selection_sql(numeric: dict, categorical: dict, target: str, numeric_target: bool, required: tuple, most: int | None, max_correlation: float = 0.95, min_target: float = 0.0) -> str:
    """The same rows as ``select_features`` over lineitem, a query for each column and pair of columns."""
    names = sorted(numeric)
    columns = ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in {**numeric, **categorical}.items())
    profile = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') AS missing, count(DISTINCT nullif({c}::VARCHAR, '')) AS distinct_count, {f'var_pop({c})' if c in numeric else 'NULL'} AS variance FROM base" for c in [*numeric, *categorical])
    if numeric_target:
        scores = " UNION ALL ".join([f"SELECT '{c}' AS feature, abs(coalesce(CASE WHEN isnan(corr({c}, t)) THEN 0 ELSE corr({c}, t) END, 0)) AS a FROM base" for c in numeric])
    else:
        eta = [
            f"SELECT '{c}' AS feature, CASE WHEN count(*) > 1 THEN sum(n * (m - mean) ** 2) / greatest(sum(n * (m - mean) ** 2) + sum(n * v), 1e-12) ELSE 0 END AS a FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS mean FROM (SELECT t, count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM base WHERE t IS NOT NULL AND t <> '' GROUP BY t) WHERE n > 0)"
            for c in numeric
        ]
        chi = [
            f"SELECT '{c}' AS feature, least(1, sum((n - e) ** 2 / greatest(e, 1e-12)) / max(total)) AS a FROM (SELECT n, total, (sum(n) OVER (PARTITION BY x))::DOUBLE * sum(n) OVER (PARTITION BY t) / total AS e FROM (SELECT *, sum(n) OVER () AS total FROM (SELECT {c} AS x, t, count(*) AS n FROM base WHERE {c} <> '' AND t <> '' GROUP BY 1, 2)))"
            for c in categorical
        ]
        scores = " UNION ALL ".join(eta + chi)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(coalesce(CASE WHEN isnan(corr({a}, {b})) THEN 0 ELSE corr({a}, {b}) END, 0)) AS r FROM base" for i, a in enumerate(names) for b in names[i + 1 :])
    needed = f"feature IN ({', '.join(repr(r) for r in required)})" if required else "false"
    numbers = ", ".join(repr(c) for c in names)
    late = f"NOT needed AND rank > {most}" if most else "false"
    return f"""
WITH base AS (SELECT {columns}, {target} AS t FROM lineitem),
profile AS ({profile}), scores AS ({scores}), pairs AS ({pairs}),
own AS (SELECT feature, round(missing / n, 6) AS missing_ratio, distinct_count, variance, round(coalesce(a, 0), 8) AS target_score, coalesce(a, 0) AS a, round(greatest(0, 1 - round(missing / n, 6) + coalesce(a, 0)), 8) AS own, round(distinct_count / n, 6) AS dr FROM profile LEFT JOIN scores USING (feature)),
paid AS (SELECT CASE WHEN x.own >= y.own THEN b ELSE a END AS feature, round(max(r), 8) AS penalty FROM (SELECT * FROM pairs WHERE r >= {max_correlation}) JOIN (SELECT feature AS a, own FROM own) x USING (a) JOIN (SELECT feature AS b, own FROM own) y USING (b) GROUP BY 1),
ruled AS (SELECT *, {needed} AS needed, coalesce(penalty, 0) AS fine, list_filter([CASE WHEN missing_ratio > 0.95 THEN 'missing_ratio' END, CASE WHEN distinct_count < 1 THEN 'distinct_count' END, CASE WHEN dr > 1 THEN 'distinct_ratio' END, CASE WHEN feature IN ({numbers}) AND coalesce(variance, 0) <= 0 THEN 'variance' END, CASE WHEN a < {min_target} THEN 'target_score' END], lambda w: w IS NOT NULL) AS w FROM own LEFT JOIN paid USING (feature)),
chosen AS (SELECT *, CASE WHEN len(w) = 0 AND fine > 0 AND NOT needed THEN ['correlation'] ELSE w END AS why, round(greatest(0, own - fine), 8) AS score FROM ruled),
ranked AS (SELECT *, CASE WHEN needed OR len(why) = 0 THEN row_number() OVER (ORDER BY needed DESC, len(why) = 0 DESC, score DESC, feature) END AS rank FROM chosen)
SELECT feature, CASE WHEN needed THEN 'required' WHEN len(why) = 0 AND NOT coalesce({late}, false) THEN 'selected' ELSE 'rejected' END AS status, CASE WHEN coalesce({late}, false) THEN NULL ELSE rank END AS rank, score, target_score, fine::DOUBLE AS penalty, missing_ratio, distinct_count,
  CASE WHEN coalesce({late}, false) THEN 'max_features' ELSE array_to_string(why, ',') END AS reasons FROM ranked
"""


def _offered(spark, sf_dir, target):
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{e} AS {c}" for c, e in {**OFFERED, **CLASSES}.items()), f"{target} AS t")


@query(selection_sql(OFFERED, CLASSES, "l_returnflag", False, ("tax",), 4))
def selected_for_class(spark, sf_dir):
    return L.select_features(_offered(spark, sf_dir, "l_returnflag"), list(OFFERED), list(CLASSES), "t", required=("tax",), max_features=4)


@query(selection_sql(OFFERED, CLASSES, "l_extendedprice - l_quantity", True, (), None, 0.9, 0.001))
def selected_for_number(spark, sf_dir):
    return L.select_features(_offered(spark, sf_dir, "l_extendedprice - l_quantity"), list(OFFERED), list(CLASSES), "t", numeric_target=True, max_correlation=0.9, min_target=0.001)


DETECTORS = [
    D.Detector("zscore", 2.0, 30, 10), D.Detector("robust_zscore", 3.5, 30, 10), D.Detector("iqr", 1.5, 40, 10, "high"), D.Detector("ewma", 2.0, 30, 10), D.Detector("rolling_stddev", 1.5, 20, 10, "low"),
    D.Detector("rate_of_change", rate=150.0, least=1), D.Detector("static_threshold", lower=5.0, upper=90.0), D.Detector("seasonal_baseline", 2.0, 30, 10, period=86400, tolerance=3600),
]

_MEAN = "list_aggregate({b}, 'avg')"
_STD = "CASE WHEN list_aggregate({b}, 'stddev_pop') = 0 THEN 1e-12 ELSE list_aggregate({b}, 'stddev_pop') END"


def _bounded(name: str, base: str, middle: str, spread: str, threshold: float, direction: str = "both", score: str | None = None) -> str:
    """SQL of a detector with bounds around a middle."""
    low, high = f"value < lower AND '{direction}' <> 'high'", f"value > upper AND '{direction}' <> 'low'"
    score = score or "abs(value - expected) / greatest(spread, 1e-12)"
    return f"SELECT event_id, '{name}' AS detector, seen, 10 AS least, {low} OR {high} AS hit, {score} AS score, expected, lower, upper FROM (SELECT *, expected - {threshold} * spread AS lower, expected + {threshold} * spread AS upper FROM (SELECT *, {middle.format(b=base)} AS expected, {spread.format(b=base)} AS spread FROM w))"


_BEYOND = "CASE WHEN value > upper THEN abs(value - upper) / greatest(abs(upper), 1) WHEN value < lower THEN abs(lower - value) / greatest(abs(lower), 1) ELSE 0 END"
WALK_SQL = f"""
WITH e AS (SELECT event_id, event_type, ts, value, epoch(ts)::BIGINT AS sec FROM events WHERE value IS NOT NULL),
w AS (SELECT event_id, value, list(value) OVER h AS hist, list(sec) OVER h AS secs, list(value) OVER a AS past, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seen FROM e
  WINDOW h AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 512 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
near AS (SELECT *, list_filter(list_zip(hist, secs), lambda p: (secs[-1] - p[2]) % 86400 <= 3600 OR 86400 - (secs[-1] - p[2]) % 86400 <= 3600) AS z FROM w),
s AS (SELECT event_id, value, seen, CASE WHEN len(z) < 10 THEN hist[-30:] ELSE list_transform(z, lambda p: p[1]) END AS b FROM near),
judged AS (
{_bounded("zscore", "hist[-30:]", _MEAN, _STD, 2.0)}
UNION ALL SELECT event_id, 'robust_zscore', seen, 10, abs(0.6745 * (value - m) / mad) > 3.5, abs(0.6745 * (value - m) / mad), m, m - 3.5 / 0.6745 * mad, m + 3.5 / 0.6745 * mad FROM (SELECT *, CASE WHEN list_median(list_transform(hist[-30:], lambda x: abs(x - m))) = 0 THEN 1e-12 ELSE list_median(list_transform(hist[-30:], lambda x: abs(x - m))) END AS mad FROM (SELECT *, list_median(hist[-30:]) AS m FROM w))
UNION ALL SELECT event_id, 'iqr', seen, 10, value > upper, {_BEYOND}, m, lower, upper FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT *, list_median(hist[-40:]) AS m, list_aggregate(hist[-40:], 'quantile_cont', 0.25) AS q1, list_aggregate(hist[-40:], 'quantile_cont', 0.75) AS q3 FROM w))
UNION ALL SELECT event_id, 'ewma', seen, 10, value < e - 2 * sc OR value > e + 2 * sc, abs(value - e) / greatest(sc, 1e-12), e, e - 2 * sc, e + 2 * sc FROM (SELECT *, list_aggregate(list_transform(hist[-30:], lambda x: abs(x - e)), 'avg') AS sc FROM (SELECT *, list_reduce(past, lambda e, v: 0.3::DOUBLE * v + 0.7::DOUBLE * e) AS e FROM w WHERE seen > 0))
UNION ALL SELECT event_id, 'ewma', seen, 10, false, 0, NULL, NULL, NULL FROM w WHERE seen = 0
UNION ALL {_bounded("rolling_stddev", "hist[-20:]", _MEAN, _STD, 1.5, "low")}
UNION ALL SELECT event_id, 'rate_of_change', seen, 1, abs(c) > 150, abs(c) / 150, hist[-1], NULL, NULL FROM (SELECT *, (value - hist[-1]) / greatest(abs(hist[-1]), 1e-12) * 100 AS c FROM w)
UNION ALL SELECT event_id, 'static_threshold', seen, 0, value < 5 OR value > 90, {_BEYOND.replace("upper", "90.0::DOUBLE").replace("lower", "5.0::DOUBLE")}, NULL, 5, 90 FROM w
UNION ALL {_bounded("seasonal_baseline", "b", _MEAN, _STD, 2.0).replace("FROM w)", "FROM s)")})
SELECT event_id, detector, CASE WHEN seen < least THEN 'insufficient_baseline' WHEN hit THEN 'anomalous' ELSE 'normal' END AS status,
  CASE WHEN seen < least OR NOT hit THEN 'info' WHEN score >= 8 THEN 'critical' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN seen < least THEN 0 ELSE round(score, 6) END::DOUBLE AS score, CASE WHEN seen >= least THEN round(expected, 6) END::DOUBLE AS expected, CASE WHEN seen >= least THEN round(lower, 6) END::DOUBLE AS lower, CASE WHEN seen >= least THEN round(upper, 6) END::DOUBLE AS upper,
  least(seen, 512) AS baseline_size FROM judged"""


@query(WALK_SQL)
def anomaly_walk(spark, sf_dir):
    """Eight detectors over the values of each kind of event."""
    return D.walk_forward(table(spark, sf_dir, "events"), ["event_type"], "ts", ["event_id"], "value", DETECTORS, ["event_id"])


@query(WALK_SQL)
def stream_anomalies(spark, sf_dir):
    """The same over the events as a stream, with the series in the state store."""
    at = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    W.run_available(D.stream_walk_forward(stream, ["event_type"], "ts", ["event_id"], "value", DETECTORS, ["event_id"], "1 day", 30 * 86400), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query(f"""
WITH walk AS ({WALK_SQL}), r AS (SELECT *, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) AS level FROM walk WHERE status = 'anomalous')
SELECT event_id, count(*) AS agreeing, max(score) AS top_score, arg_max(severity, level) AS top_severity, array_to_string(list_sort(list(detector)), ',') AS detectors FROM r GROUP BY 1 HAVING count(*) >= 2""")
def anomaly_policies(spark, sf_dir):
    """Events that two detectors or more call anomalous."""
    walk = D.walk_forward(table(spark, sf_dir, "events"), ["event_type"], "ts", ["event_id"], "value", DETECTORS, ["event_id"])
    return D.policies(walk.drop("expected", "lower", "upper", "baseline_size"), "low", 2)


@query("""
SELECT event_type, count(*) AS n_rows, count(value) AS n, sum(value) AS total, avg(value) AS mean, var_samp(value) AS variance, stddev_samp(value) AS deviation, min(value) AS low, max(value) AS high FROM events GROUP BY 1""")
def merged_day_states(spark, sf_dir):
    """Each day's states stored, the stored states merged: the whole table's aggregates. (Sketches are tested against exact counts and ranks.)"""
    e = table(spark, sf_dir, "events")
    days = cut(S.partial_states(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", "user_id"), "states")
    return S.finished(S.merged_states(days, ["event_type"]), ["event_type"]).drop("n_distinct")


@query("""
WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS up, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC) AS down FROM lineitem)
SELECT l_returnflag, l_linestatus, exp(avg(ln(v))) AS geometric, avg(v) FILTER (up > 25 AND down > 25) AS trimmed FROM r GROUP BY 1, 2""")
def own_aggregates(spark, sf_dir):
    """A geometric mean and a mean without the 25 least and largest values, by init, update, merge and finish."""
    return S.aggregated(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"geometric": ("l_extendedprice", S.geometric_mean()), "trimmed": ("l_extendedprice", S.trimmed_mean(25))})


METRICS = [
    M.Metric("quality", formula="(closed_share + abs(growth) ** 0.5) / 2", target=0.5), M.Metric("growth", formula="min(late / early - 1, 1.0)"), M.Metric("orders", Agg("orders", "count")), M.Metric("revenue", Agg("revenue", "sum", "o_totalprice")),
    M.Metric("average", formula="revenue / orders", target=150000.0, higher=False), M.Metric("closed", Agg("closed", "sum", "is_closed")), M.Metric("closed_share", formula="round(closed / orders, 4)"),
    M.Metric("early", Agg("early", "sum", "early")), M.Metric("late", Agg("late", "sum", "late")), M.Metric("nothing", formula="revenue / (orders - orders)"), M.Metric("deeper", formula="sqrt(average) - log(revenue, 10) % 3 + nothing * 0"), M.Metric("deep", formula="sqrt(average) - log(revenue, 10) % 3"),
]


@query("""
WITH m AS (SELECT o_orderpriority, count(*)::DOUBLE AS orders, sum(o_totalprice) AS revenue, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS closed, sum(o_totalprice) FILTER (month(o_orderdate) <= 6) AS early, sum(o_totalprice) FILTER (month(o_orderdate) > 6) AS late FROM orders GROUP BY 1),
f AS (SELECT *, round_even(closed / orders, 4) AS closed_share, least(late / early - 1, 1) AS growth, revenue / orders AS average FROM m),
g AS (SELECT *, (closed_share + abs(growth) ** 0.5) / 2 AS quality FROM f)
SELECT o_orderpriority, quality, quality / 0.5 * 100 AS quality_achieved, growth, orders, revenue, average, 150000 / average * 100 AS average_achieved, closed, closed_share, early, late, NULL::DOUBLE AS nothing, NULL::DOUBLE AS deeper, sqrt(average) - log10(revenue) % 3 AS deep FROM g""")
def metric_graph(spark, sf_dir):
    """Formulas over formulas in one aggregate; a division by 0 is null, and so is what reads it."""
    late = F.month("o_orderdate") > 6
    o = table(spark, sf_dir, "orders").withColumns({"is_closed": (F.col("o_orderstatus") == "F").cast("int"), "early": F.when(~late, F.col("o_totalprice")), "late": F.when(late, F.col("o_totalprice"))})
    return M.computed(o, ["o_orderpriority"], METRICS)


_ROUTE = "CASE WHEN severity = 'critical' THEN CASE WHEN domain = 'security' THEN 'security' WHEN domain = 'fraud' THEN 'fraud' WHEN domain = 'finance' THEN 'finance' ELSE 'executive' END WHEN domain IN ('fraud', 'security', 'finance', 'data') THEN domain ELSE 'ops' END"


@query(f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, coalesce(value, 0) AS score, CASE WHEN event_id % 3 = 0 THEN value / 40 END AS z, CASE event_type WHEN 'purchase' THEN 'finance' WHEN 'error' THEN 'security' WHEN 'signup' THEN 'fraud' WHEN 'click' THEN 'data' END AS domain,
  event_type AS signal, event_id % 37 = 0 AS closed, CASE WHEN event_id % 101 = 0 THEN 'high' END AS hint FROM events),
w AS (SELECT *, count(*) OVER p AS past, avg(score) OVER p + 2.5 * coalesce(stddev_samp(score) OVER p, 0) AS usual, t - lag(t) OVER (PARTITION BY user_id, signal ORDER BY t, event_id) AS since,
  (SELECT count(*) FROM e y WHERE y.user_id = e.user_id AND (y.t < e.t OR y.t = e.t AND y.event_id < e.event_id) AND e.t - y.t <= 43200000000) AS recent
  FROM e WINDOW p AS (PARTITION BY signal ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN past >= 20 THEN greatest(0, least(greatest(usual, 35), 85)) ELSE 35 END AS threshold FROM w),
s AS (SELECT *, CASE WHEN score >= 85 OR z >= 4.5 THEN 'critical' WHEN hint = 'high' OR score >= 65 OR z >= 3 THEN 'high' WHEN score >= threshold OR z >= 2 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN closed THEN 'suppressed' WHEN score < threshold AND NOT coalesce(z >= 2, false) THEN 'below_threshold' WHEN since <= 3600000000 THEN 'deduped' END AS state FROM h),
c AS (SELECT event_id, user_id, signal, t, row_number() OVER (PARTITION BY user_id, signal ORDER BY t, event_id) AS i FROM s WHERE state IS NULL),
f AS (SELECT event_id, user_id, signal, t, i FROM c WHERE i = 1
  UNION ALL SELECT n.event_id, n.user_id, n.signal, n.t, n.i FROM (SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.signal ORDER BY c.i) AS k FROM f JOIN c ON c.user_id = f.user_id AND c.signal = f.signal AND c.i > f.i AND c.t > f.t + 172800000000) n WHERE k = 1),
d AS (SELECT s.*, coalesce(state, CASE WHEN s.event_id IN (SELECT event_id FROM f) THEN 'fired' ELSE 'cooldown' END) AS status FROM s),
o AS (SELECT *, CASE WHEN status = 'fired' AND recent >= 2 AND severity = 'medium' THEN 'high' WHEN status = 'fired' AND recent >= 2 AND severity = 'high' THEN 'critical' ELSE severity END AS loud FROM d),
x AS (SELECT *, CASE WHEN status IN ('suppressed', 'below_threshold') THEN 'ignore' WHEN status IN ('deduped', 'cooldown') THEN 'monitor' ELSE CASE loud WHEN 'critical' THEN 'incident' WHEN 'high' THEN 'escalate' WHEN 'medium' THEN 'alert' WHEN 'low' THEN 'monitor' ELSE 'ignore' END END AS decision FROM o)
SELECT event_id, status, decision, loud AS severity, CASE WHEN status IN ('suppressed', 'below_threshold') THEN 'none' ELSE {_ROUTE} END AS route, threshold::DOUBLE AS threshold, recent,
  concat_ws(',', CASE WHEN hint IS NOT NULL AND severity <> 'info' THEN 'severity_hint=high' END, CASE WHEN severity IN ('critical', 'high', 'medium') THEN severity || '_threshold_met' WHEN severity = 'low' THEN 'low_signal' ELSE 'informational' END,
    CASE status WHEN 'suppressed' THEN 'suppressed_by_policy' WHEN 'below_threshold' THEN 'score_below_threshold' WHEN 'deduped' THEN 'deduplicated_within_window' WHEN 'cooldown' THEN 'cooldown_active' END, CASE WHEN recent >= 2 THEN 'entity_burst_detected' END) AS reasons
FROM x""")
def alert_triggers(spark, sf_dir):
    """The events' values as anomaly scores: silenced, below a threshold that the signal's past sets, repeated, cooling down, or fired, louder in a burst."""
    kind = F.col("event_type")
    domain = F.when(kind == "purchase", "finance").when(kind == "error", "security").when(kind == "signup", "fraud").when(kind == "click", "data")
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("entity"), "ts", F.col("value").alias("score"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 40).alias("zscore"), domain.alias("domain"), F.lit(None).cast("string").alias("category"), kind.alias("signal"),
        F.when(F.col("event_id") % 37 == 0, "closed").alias("status"), F.when(F.col("event_id") % 101 == 0, "high").alias("hint"),
    )
    return G.triggered(e, "event_id", G.Policy(cooldown=2880, recent=720, burst=2)).drop("actions")


_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
_AT = "substr({d}, {i}, 1)::INT"
_CHECK_SQL = {
    "luhn": "CASE WHEN length({d}) BETWEEN 13 AND 19 THEN list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN 2 * substr({d}, i, 1)::INT % 10 + 2 * substr({d}, i, 1)::INT // 10 ELSE substr({d}, i, 1)::INT END)) % 10 = 0 ELSE false END",
    "cpf": "CASE WHEN length({d}) = 11 THEN {d} <> repeat(substr({d}, 1, 1), 11) AND list_sum(list_transform(range(1, 10), lambda i: substr({d}, i, 1)::INT * (11 - i))) * 10 % 11 % 10 = substr({d}, 10, 1)::INT AND list_sum(list_transform(range(1, 11), lambda i: substr({d}, i, 1)::INT * (12 - i))) * 10 % 11 % 10 = substr({d}, 11, 1)::INT ELSE false END",
    "cnpj": "CASE WHEN length({d}) = 14 THEN {d} <> repeat(substr({d}, 1, 1), 14) AND list_sum(list_transform(range(1, 13), lambda i: substr({d}, i, 1)::INT * [5,4,3,2,9,8,7,6,5,4,3,2][i])) * 10 % 11 % 10 = substr({d}, 13, 1)::INT AND list_sum(list_transform(range(1, 14), lambda i: substr({d}, i, 1)::INT * [6,5,4,3,2,9,8,7,6,5,4,3,2][i])) * 10 % 11 % 10 = substr({d}, 14, 1)::INT ELSE false END",
}


def findings_sql(source: str, texts: list[str], others: list[str]) -> str:
    """The rows of ``privacy.findings`` over a table: a count for each column and rule."""
    parts = []
    for c in [*texts, *others]:
        x, known = f"trim({c}::VARCHAR)", P.named(c)
        for r in P.RULES:
            if r in known:
                hit = "true"
            elif r.value:
                hit = f"regexp_matches({x}, '{r.value}')" + (f" OR {_CHECK_SQL[r.check].format(d=_DIGITS.format(x=x))}" if r.check else "")
                hit = f"({hit}) AND {x} <> ''"
            else:
                continue
            action = "BLOCK" if r.type in P.BLOCKED else r.action
            parts.append(f"SELECT '{c}' AS \"column\", '{r.type}' AS type, 'value' AS \"where\", '{r.severity}' AS severity, '{action}' AS action, count(*) FILTER ({c} IS NOT NULL AND {hit}) AS hits, count({c}) AS non_null FROM {source}")
        for t, pattern in P.SEARCHED.items() if c in texts else ():
            r = next(r for r in P.RULES if r.type == t)
            severity, action = ("CRITICAL" if r.severity == "CRITICAL" else "HIGH"), ("BLOCK" if t in P.BLOCKED else r.action)
            parts.append(f"SELECT '{c}', '{t}', 'text', '{severity}', '{action}', count(*) FILTER (length({c}) >= 20 AND regexp_matches({c}, '{pattern}')), count({c}) FROM {source}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE hits > 0"


_PEOPLE = "people AS (SELECT c_custkey AS customer, c_name, lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '@example.com' END AS contact, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS code, lpad((c_custkey * 104729)::VARCHAR, 11, '3') AS digits, CASE WHEN c_custkey % 2 = 0 THEN 'card 4111 1111 1111 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS note, 'sk-' || substr(sha256(c_name), 1, 20) AS opaque FROM customer)"


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(
        k.alias("customer"), "c_name", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.when(k % 3 == 0, "").otherwise("@example.com")).alias("contact"), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0").alias("code"),
        F.lpad((k * 104729).cast("string"), 11, "3").alias("digits"), F.when(k % 2 == 0, F.concat(F.lit("card 4111 1111 1111 "), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("note"), F.concat(F.lit("sk-"), F.substring(F.sha2("c_name", 256), 1, 20)).alias("opaque"),
    )


_PEOPLE_SQL = findings_sql("people", ["c_name", "contact", "code", "digits", "note", "opaque"], ["customer"])


@query(f"WITH {_PEOPLE} {_PEOPLE_SQL}")
def personal_columns(spark, sf_dir):
    """The customers with contacts, codes, digits, notes and keys, column by column."""
    return P.findings(_people(spark, sf_dir))


@query(findings_sql("documents", ["text", "lang", "source"], ["doc_id", "n_chars"]))
def personal_texts(spark, sf_dir):
    return P.findings(table(spark, sf_dir, "documents").select("text", "lang", "source", "doc_id", "n_chars"))


_POINTS = "hits * (CASE severity WHEN 'LOW' THEN 5 WHEN 'MEDIUM' THEN 15 WHEN 'HIGH' THEN 35 ELSE 60 END + CASE action WHEN 'WARN' THEN 5 WHEN 'MASK' THEN 10 WHEN 'BLOCK' THEN 30 ELSE 0 END + CASE WHEN type IN ('CREDIT_CARD', 'PASSWORD', 'API_KEY', 'TOKEN') THEN 15 ELSE 0 END)"


@query(f"""
WITH {_PEOPLE}, f AS ({_PEOPLE_SQL})
SELECT "column", sum(hits)::BIGINT AS detected, sum(hits) / max(non_null) AS ratio, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, arg_max(severity, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) AS severity, arg_max(action, list_position(['WARN', 'MASK', 'BLOCK'], action)) AS action,
  least(100, (sum({_POINTS}) + 2.5) / sqrt(sum(hits)))::DOUBLE AS risk FROM f GROUP BY 1""")
def personal_risk(spark, sf_dir):
    return P.columns_at_risk(P.findings(_people(spark, sf_dir)))


@query(f"""
WITH {_PEOPLE}, f AS ({_PEOPLE_SQL}), k AS (SELECT * FROM f WHERE hits >= 0.02 * greatest(non_null, 1)),
own AS (SELECT "column", max(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) AS s, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM k GROUP BY 1),
chars AS (SELECT * FROM (UNPIVOT (SELECT row_number() OVER () AS row_id, c_name, contact, code, digits, note, opaque, customer::VARCHAR AS customer FROM people) ON c_name, contact, code, digits, note, opaque, customer INTO NAME col VALUE v)),
bits AS (SELECT col, row_id, v, -sum(n / length(v) * log2(n / length(v))) AS e FROM (SELECT col, row_id, v, ch, count(*) AS n FROM (SELECT *, unnest(string_split(v, '')) AS ch FROM chars) GROUP BY ALL) GROUP BY 1, 2, 3),
stats AS (SELECT col AS "column", round(avg(e), 6) AS entropy, avg(length(v)) AS long, count(*) FILTER (contains(v, ' ')) AS spaced FROM bits GROUP BY 1)
SELECT "column", CASE WHEN entropy >= 4 AND long >= 20 AND spaced = 0 AND coalesce(s, 0) <= 2 THEN 'confidential' WHEN s = 4 THEN 'restricted' WHEN s = 3 THEN 'confidential' WHEN s IS NOT NULL THEN 'internal' ELSE 'public' END AS label, coalesce(types, '') AS types, entropy FROM stats LEFT JOIN own USING ("column")""")
def classified_columns(spark, sf_dir):
    return P.classified(_people(spark, sf_dir))


_DIRTY = """dirty AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderkey::VARCHAR END AS num, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 1000)::VARCHAR ELSE (o_orderkey % 977)::VARCHAR || '.' || (o_custkey % 90 + 10)::VARCHAR || '0' END AS price,
  CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE 'false' END AS flag, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS moment, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE WHEN o_orderkey % 500 = 7 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS mixed, NULL::VARCHAR AS nothing, o_orderpriority AS words FROM orders)"""
_KIND = "CASE WHEN v IS NULL OR lower(v) IN ('', 'null', 'none', 'na', 'n/a', 'nan', '-') THEN NULL " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{k}'" for k, p in I.KINDS.items()) + " ELSE 'string' END"


@query(f"""
WITH {_DIRTY}, u AS (SELECT row_number() OVER () AS i, * FROM dirty),
c AS (SELECT col AS "column", trim(v) AS v FROM u UNPIVOT INCLUDE NULLS (v FOR col IN (num, price, flag, moment, day, mixed, nothing, words))),
k AS (SELECT "column", v, {_KIND} AS kind FROM c),
n AS (SELECT *, CASE WHEN kind IN ('integer', 'decimal') THEN length(regexp_replace(regexp_extract(v, '^[+-]?([0-9]*)', 1), '^0+([0-9])', '\\1')) END AS w, CASE WHEN kind IN ('integer', 'decimal') THEN length(regexp_replace(regexp_extract(v, '\\.([0-9]*)$', 1), '0+$', '')) END AS s FROM k),
a AS (SELECT "column", list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds, count(*) - count(kind) AS nulls, count(kind) AS non_null, max(length(v)) FILTER (kind IS NOT NULL) AS max_length, greatest(1, max(w) + max(s)) AS p, max(s) AS s FROM n GROUP BY 1),
t AS (SELECT *, CASE WHEN kinds IS NULL THEN 'unknown' WHEN len(kinds) = 1 THEN kinds[1] WHEN kinds = ['decimal', 'integer'] THEN 'decimal' WHEN kinds = ['date', 'timestamp'] THEN 'timestamp' ELSE 'string' END AS type FROM a)
SELECT "column", type, nulls > 0 AS nullable, nulls, non_null, max_length, CASE WHEN type IN ('integer', 'decimal') THEN p END AS precision, CASE WHEN type IN ('integer', 'decimal') THEN s END AS scale FROM t""")
def inferred_schema(spark, sf_dir):
    """Types of a text table made of the orders, with blanks, mixed numbers, dates and times."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    text = lambda x: x.cast("string")
    dirty = table(spark, sf_dir, "orders").select(
        F.when(k % 9 == 0, " ").otherwise(text(k)).alias("num"), F.when(k % 4 == 0, text(k % 1000)).otherwise(F.concat(text(k % 977), F.lit("."), text(c % 90 + 10), F.lit("0"))).alias("price"),
        F.when(k % 2 == 0, "TRUE").when(k % 5 == 0, "N/A").otherwise("false").alias("flag"), F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("moment"), F.date_format(d, "yyyy-MM-dd").alias("day"),
        F.when(k % 500 == 7, F.concat(F.lit("x"), text(k))).otherwise(text(k)).alias("mixed"), F.lit(None).cast("string").alias("nothing"), F.col("o_orderpriority").alias("words"),
    )
    return I.inferred(dirty).drop("position")


def _stored_orders(spark, sf_dir):
    """The orders as features of customers, a chunk for each year, the second chunk written twice and the first one first wrongly."""
    at = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("k"))
    third = F.pmod(F.col("k"), F.lit(3))
    Z.write_chunk(o.where(third != 2), at, "orders", ["o_custkey"], "at", "c0")
    for chunk, n in (("c0", 0), ("c1", 1), ("c2", 2), ("c1", 1)):
        Z.write_chunk(o.where(third == n), at, "orders", ["o_custkey"], "at", chunk)
    return at, o


@query("SELECT o_custkey, o_orderdate AS \"at\", o_totalprice AS price, o_orderkey AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 3 DESC, o_totalprice DESC, o_orderkey DESC) = 1")
def latest_features(spark, sf_dir):
    """The stored latest rows after chunks were corrected and repeated."""
    at, _ = _stored_orders(spark, sf_dir)
    return Z.latest(spark, at, "orders")


@query("""
WITH s AS (SELECT c_custkey AS o_custkey, TIMESTAMP '2024-06-01' - INTERVAL 1 DAY * (c_custkey % 400) AS "at" FROM customer)
SELECT s.o_custkey, s."at", arg_max(o_totalprice, (o_orderdate, o_orderkey % 3)) AS price FROM s LEFT JOIN orders o ON o.o_custkey = s.o_custkey AND o.o_orderdate <= s."at" GROUP BY 1, 2""")
def features_as_of(spark, sf_dir):
    """The stored features as each customer had them at a day of its own."""
    at, o = _stored_orders(spark, sf_dir)
    kind = o.schema["at"].dataType
    spine = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr("timestamp'2024-06-01' - make_dt_interval(cast(c_custkey % 400 as int))").cast(kind).alias("at")).distinct()
    return Z.as_of(spine, spark, at, "orders", ["o_custkey"], "at", ["price"], first=("k",), known=True)


def _periods(spark, sf_dir):
    """The revenue of each order status in periods of four weeks, as numbered series."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.floor(F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")) / 28).cast("int").alias("p"), "o_totalprice")
    sums = o.groupBy("o_orderstatus", "p").agg(F.sum("o_totalprice").alias("v"))
    return X.indexed(sums, ["o_orderstatus"], "p", "v")


_WEEKS = """
WITH s AS (SELECT o_orderstatus, floor(date_diff('day', DATE '1990-01-01', o_orderdate::DATE) / 28) AS p, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
x AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY p) - 1 AS t, v FROM s)"""


@query(f"""{_WEEKS},
f AS (SELECT * FROM (VALUES (1, 40), (2, 55), (3, 70)) AS f(fold, train_end)),
m AS (SELECT fold, train_end, o_orderstatus, avg(v) FILTER (t >= train_end - 7) AS p1, sum(v) FILTER (t >= train_end - 6) AS rest FROM f JOIN x ON t < train_end GROUP BY ALL HAVING count(*) >= 7),
a AS (SELECT fold, train_end, p1 - v AS e, v FROM m JOIN x USING (o_orderstatus) WHERE t = train_end UNION ALL SELECT fold, train_end, (rest + p1) / 7 - v, v FROM m JOIN x USING (o_orderstatus) WHERE t = train_end + 1)
SELECT fold, train_end, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e / v)) FILTER (v <> 0) AS mape, avg(e) AS bias FROM a GROUP BY 1, 2""")
def forecast_backtest(spark, sf_dir):
    """Two steps ahead by the mean of the last seven values, from three expanding windows."""
    spec = X.Lags((1, 2, 3), (7,))
    return X.backtest(_periods(spark, sf_dir), ["o_orderstatus"], X.moving_average(7), spec, [(40, 42), (55, 57), (70, 72)])
