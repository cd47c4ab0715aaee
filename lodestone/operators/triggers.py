"""Alert triggers: which anomaly events fire, which are silenced and why, and how loud the ones that fire are.

Everything but the cooldown is a window over what came before (an event is behind those
with an earlier time, and of one time behind those with a smaller key). Whether an event
is in its cooldown depends on which earlier ones fired: that is one ordered pass for each
cooldown key, which jumps from one fired event to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anomaly import fires


@dataclass(frozen=True)
class Policy:
    """Thresholds of scores and z-scores, minutes of the windows, and what is silenced."""

    medium: float = 35.0
    high: float = 65.0
    critical: float = 85.0
    z_medium: float = 2.0
    z_high: float = 3.0
    z_critical: float = 4.5
    cooldown: int = 30
    dedupe: int = 60
    recent: int = 15
    burst: int = 5
    dynamic: bool = True
    least_events: int = 20
    deviations: float = 2.5
    silence_closed: bool = True
    silence_low: bool = False


#: States of closed events; the domains of each route, and those of critical events.
CLOSED = ("closed", "resolved", "suppressed", "cancelled", "canceled")
ROUTES = {
    "fraud": ("fraud", "payments", "transaction"), "security": ("security", "ueba", "iam", "soc"), "risk": ("risk", "credit", "compliance"),
    "finance": ("finance", "liquidity", "cashflow", "revenue", "payroll"), "data": ("data", "ml", "ai", "quality"),
}
CRITICAL_ROUTES = {"security": ("security", "ueba"), "fraud": ("fraud",), "finance": ("finance", "liquidity", "cashflow", "revenue")}
DECISIONS = {"critical": "incident", "high": "escalate", "medium": "alert", "low": "monitor", "info": "ignore"}
ACTIONS = {
    "incident": "open_incident,page_on_call,freeze_or_hold_if_applicable,executive_visibility", "escalate": "create_case,notify_owner_team,manual_review,increase_monitoring",
    "alert": "send_alert,add_to_review_queue,monitor_next_events", "monitor": "record_signal,monitor_trend", "ignore": "no_action",
}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def routed(domain: Column, severity: Column) -> Column:
    """Where an event of a domain goes."""
    d, usual, worst = F.lower(F.coalesce(domain, F.lit(""))), F.lit("ops"), F.lit("executive")
    for name, domains in reversed(ROUTES.items()):
        usual = F.when(d.isin(*domains), name).otherwise(usual)
    for name, domains in reversed(CRITICAL_ROUTES.items()):
        worst = F.when(d.isin(*domains), name).otherwise(worst)
    return F.when(severity == "critical", worst).otherwise(usual)


def triggered(df: DataFrame, key: str, policy: Policy = Policy()) -> DataFrame:
    """key, status, decision, severity, route, threshold, recent, reasons and actions of each event.

    df has ``key``, entity, ts, score, zscore, domain, category, signal, status and hint
    (a severity); all but the key and the time may be null. Events without time are left
    out; a null score counts 0. status: suppressed, below_threshold, deduped, cooldown, fired.
    """
    p, minute = policy, 60_000_000
    text = lambda c, other="": F.coalesce(F.col(c).cast("string"), F.lit(other))
    e = df.where(F.col("ts").isNotNull()).select(
        key, F.col("entity").cast("string").alias("_entity"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("_score"), F.col("zscore").cast("double").alias("_z"), "domain",
        F.lower("status").alias("_state"), F.lower("hint").alias("_hint"), F.struct(text("domain", "unknown"), text("category", "unknown"), text("signal", "unknown")).alias("_signal"),
        F.struct(text("entity"), text("domain"), text("category"), text("signal")).alias("_dedupe"), F.struct(text("entity"), text("domain"), text("signal")).alias("_cool"),
    )
    order = ("_t", key)
    past = Window.partitionBy("_signal").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    usual = F.avg("_score").over(past) + p.deviations * F.coalesce(F.stddev_samp("_score").over(past), F.lit(0.0))
    enough = F.count("*").over(past) >= max(1, p.least_events)
    threshold = F.when(enough, F.greatest(F.lit(0.0), F.least(F.greatest(usual, F.lit(p.medium)), F.lit(p.critical)))).otherwise(p.medium) if p.dynamic else F.lit(p.medium)
    near = Window.partitionBy("_entity").orderBy("_t").rangeBetween(-p.recent * minute, Window.currentRow)
    peers = Window.partitionBy("_entity", "_t")
    recent = F.count("*").over(near) - F.count("*").over(peers) + F.row_number().over(peers.orderBy(key)) - 1
    last = F.lag("_t").over(Window.partitionBy("_dedupe").orderBy(*order))
    e = e.withColumns({"threshold": threshold, "recent": recent, "_last": last})
    z = lambda least: F.coalesce(F.col("_z") >= least, F.lit(False))
    hint = lambda name: F.coalesce(F.col("_hint") == name, F.lit(False))
    score = F.col("_score")
    severity = F.when(hint("critical") | (score >= p.critical) | z(p.z_critical), "critical").when(hint("high") | (score >= p.high) | z(p.z_high), "high")
    severity = severity.when(hint("medium") | (score >= F.col("threshold")) | z(p.z_medium), "medium").when(hint("low") | (score > 0), "low").otherwise("info")
    silenced = F.lit(False)
    if p.silence_closed:
        silenced |= F.coalesce(F.col("_state").isin(*CLOSED), F.lit(False))
    if p.silence_low:
        silenced |= hint("info") | hint("low")
    status = F.when(silenced, "suppressed").when((score < F.col("threshold")) & ~z(p.z_medium), "below_threshold").when(F.col("_t") - F.col("_last") <= p.dedupe * minute, "deduped")
    e = e.withColumns({"_severity": severity, "_status": status, "_cool": F.to_json("_cool")}).drop("_signal", "_dedupe", "_entity", "_score", "_z", "_state", "_last")
    e = fires(e, ["_cool"], F.col("_t"), p.cooldown * minute + 1, F.col(key), F.col("_status").isNull())
    status = F.coalesce("_status", F.when(F.col("fired"), "fired").otherwise("cooldown"))
    burst = F.col("recent") >= p.burst
    louder = burst & (status == "fired")
    severity = F.when(louder & (F.col("_severity") == "medium"), "high").when(louder & (F.col("_severity") == "high"), "critical").otherwise(F.col("_severity"))
    quiet = status.isin("suppressed", "below_threshold")
    decision = F.when(quiet, "ignore").when(status.isin("deduped", "cooldown"), "monitor").otherwise(_mapped(severity, DECISIONS))
    actions = F.when(quiet, "no_action").when(status == "deduped", "attach_to_existing_case,update_correlation_context").when(status == "cooldown", "monitor_during_cooldown,update_existing_alert").otherwise(_mapped(decision, ACTIONS))
    met = F.when(F.col("_severity").isin("critical", "high", "medium"), F.concat("_severity", F.lit("_threshold_met"))).when(F.col("_severity") == "low", "low_signal").otherwise("informational")
    why = _mapped(status, {"suppressed": "suppressed_by_policy", "below_threshold": "score_below_threshold", "deduped": "deduplicated_within_window", "cooldown": "cooldown_active"})
    # an event without any signal is informational alone, whatever its hint
    hinted = F.when(F.col("_hint").isin(*DECISIONS) & (F.col("_severity") != "info"), F.concat(F.lit("severity_hint="), F.col("_hint")))
    reasons = F.concat_ws(",", hinted, met, why, F.when(burst, "entity_burst_detected"))
    return e.select(key, status.alias("status"), decision.alias("decision"), severity.alias("severity"), F.when(quiet, "none").otherwise(routed(F.col("domain"), F.col("_severity"))).alias("route"), "threshold", "recent", reasons.alias("reasons"), actions.alias("actions"))
