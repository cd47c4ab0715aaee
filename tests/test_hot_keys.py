"""Operators that many equal keys must not make quadratic, and alert triggers against a plain loop."""

import random
import statistics
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lodestone.operators import anomaly as A
from lodestone.operators import features as E
from lodestone.operators import finance as N
from lodestone.operators import triggers as G

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain_repeats(rows, seconds):
    out = set()
    for i, (k, g, a, t) in enumerate(rows):
        for k2, g2, a2, t2 in rows:
            if g == g2 and g is not None and a is not None and a2 is not None and abs(a - a2) <= 0.01 + 1e-9 and (t2 < t or t2 == t and k2 < k) and (t - t2).total_seconds() <= seconds:
                out.add(k)
                break
    return out


def test_repeated_amounts_is_the_pairwise_definition(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, round(rng.uniform(1, 2), 2), rng.uniform(1, 1.3), 1.0, 1.005, 1.015]), START + timedelta(seconds=rng.choice([0, 5, rng.randint(0, 20000)]))) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, v double, ts timestamp")
    for seconds in (60, 3600):
        got = {r.k for r in E.repeated_amounts(df, ["g"], "k", "v", "ts", seconds).collect()}
        assert got == plain_repeats([(k, g, a, t) for k, g, a, t in rows], seconds) and got
    assert E.repeated_amounts(df.limit(0), ["g"], "k", "v", "ts", 60).count() == 0


def test_many_equal_amounts_take_linear_time(spark):
    def took(n):
        df = spark.range(n).select(F.col("id").alias("k"), F.lit("a").alias("g"), F.lit(9.99).alias("v"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5000).alias("ts"))
        t = time.perf_counter()
        assert E.repeated_amounts(df, ["g"], "k", "v", "ts", 7200).count() == n - 1
        return time.perf_counter() - t

    took(1000)
    assert took(100_000) < 60  # in pairs that would be 10**10 rows


def test_bank_matches_with_many_equal_amounts(spark):
    n = 20_000
    s = spark.range(n).select("id", F.lit(100.0).alias("amount"), F.lit("2024-05-01").cast("date").alias("date"), F.when(F.col("id") % 2 == 0, "Rent").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("text"))
    t = spark.range(n).select((F.col("id") + 7).alias("id"), (F.lit(100.0) + 0.01 * (F.col("id") % 3)).alias("amount"), F.date_add(F.lit("2024-05-01").cast("date"), (F.col("id") % 5).cast("int")).alias("date"), F.when(F.col("id") % 2 == 1, "RENT").alias("text"))
    got = N.bank_matches(s, t)
    by = {r.score: (r.n, r.t) for r in got.groupBy("score").agg(F.count("*").alias("n"), F.min("transaction_id").alias("t")).collect()}
    # the same text on the same day: transaction 7 + 15; otherwise the first of the day with amount 100 or 100.01: 7
    assert by == {1.0: (n // 2, 7 + 15), 0.8: (n // 2, 7)}


def test_cooldown_jumps_like_the_loop(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), START + timedelta(seconds=rng.randint(0, 3000))) for k in range(400)] + [(900, "a", None), (901, None, START)]
    df = spark.createDataFrame(rows, "k long, who string, ts timestamp")
    got = sorted(r.k for r in A.cooled(df, ["who"], "ts", 60, F.col("k")).collect())
    last, want = {}, []
    for k, who, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if who not in last or (t - last[who]).total_seconds() >= 60:
            last[who] = t
            want.append(k)
    assert got == sorted(want)


def plain_triggers(events, p):
    history, seen, fired, recent, out = {}, {}, {}, {}, {}
    for e in sorted((e for e in events if e["ts"]), key=lambda e: (e["ts"], e["id"])):
        t, score, z, hint = e["ts"], e["score"] or 0.0, e["zscore"], e["hint"]
        signal = (e["domain"] or "unknown", e["category"] or "unknown", e["signal"] or "unknown")
        dedupe, cool, entity = (e["entity"], e["domain"], e["category"], e["signal"]), (e["entity"], e["domain"], e["signal"]), e["entity"]
        past = history.setdefault(signal, [])
        threshold = p.medium
        if len(past) >= p.least_events:
            threshold = max(0, min(max(statistics.fmean(past) + p.deviations * (statistics.stdev(past) if len(past) > 1 else 0), p.medium), p.critical))
        near = [u for u in recent.setdefault(entity, []) if t - u <= timedelta(minutes=p.recent)]
        big = lambda at: z is not None and z >= at
        if hint == "critical" or score >= p.critical or big(p.z_critical):
            severity = "critical"
        elif hint == "high" or score >= p.high or big(p.z_high):
            severity = "high"
        elif hint == "medium" or score >= threshold or big(p.z_medium):
            severity = "medium"
        else:
            severity = "low" if hint == "low" or score > 0 else "info"
        if e["status"] in G.CLOSED:
            status = "suppressed"
        elif score < threshold and not big(p.z_medium):
            status = "below_threshold"
        elif dedupe in seen and t - seen[dedupe] <= timedelta(minutes=p.dedupe):
            status = "deduped"
        elif cool in fired and t - fired[cool] <= timedelta(minutes=p.cooldown):
            status = "cooldown"
        else:
            status = "fired"
            fired[cool] = t
        loud = {"medium": "high", "high": "critical"}.get(severity, severity) if status == "fired" and len(near) >= p.burst else severity
        out[e["id"]] = (status, loud, len(near), round(threshold, 6))
        past.append(score)
        seen[dedupe] = t
        recent[entity].append(t)
    return out


def test_triggers_are_the_plain_state_machine(spark):
    rng = random.Random(7)
    events = [
        dict(id=k, entity=rng.choice(["x", "y", None]), ts=START + timedelta(minutes=rng.choice([0, 30, 60, rng.randint(0, 600)])) if k % 97 else None, score=rng.choice([None, 0.0, 20.0, 40.0, 70.0, 90.0, rng.uniform(0, 60)]),
             zscore=rng.choice([None, None, 1.0, 2.0, 3.5, 5.0]), domain=rng.choice([None, "fraud", "Security", "ml"]), category=rng.choice([None, "c"]), signal=rng.choice(["s", "t"]), status=rng.choice([None, None, None, "closed", "open"]), hint=rng.choice([None, None, "high", "low"]))
        for k in range(600)
    ]
    schema = "id long, entity string, ts timestamp, score double, zscore double, domain string, category string, signal string, status string, hint string"
    df = spark.createDataFrame([tuple(e.values()) for e in events], schema)
    for p in (G.Policy(), G.Policy(cooldown=5, dedupe=1, recent=3, burst=2, least_events=5)):
        rows = G.triggered(df, "id", p).collect()
        assert {r.id: (r.status, r.severity, r.recent, round(r.threshold, 6)) for r in rows} == plain_triggers(events, p)
        assert {r.status for r in rows} == {"suppressed", "below_threshold", "deduped", "cooldown", "fired"}
        assert all(r.route == "none" and r.decision == "ignore" and r.actions == "no_action" for r in rows if r.status in ("suppressed", "below_threshold"))
    assert G.triggered(df.limit(0), "id").count() == 0
