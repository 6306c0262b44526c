"""Alert channels and notifications."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import iso_ms
from ..schema import ALERT_COLUMNS
from .folds import greedy_cover

NOTIFY_TTL_SECONDS = 3600  # Fixed value.
# Message template of each rule, and the one for all others.
TEMPLATES = {
    "multiple_failed_logins": "brute_force.html", "threat_management_trigger": "threat_management.html",
    "rogue_ap_detection": "rogue_ap.html", "vpn_anomaly": "vpn_anomaly.html", "bandwidth_spike": "bandwidth.html",
    "device_offline": "device_offline.html", "critical_firewall_event": "firewall.html"}
FALLBACK_TEMPLATE = "alert_generic.html"


def _body():
    columns = [iso_ms("created_at").alias(c) if c == "created_at" else F.col(c) for c in ALERT_COLUMNS]
    return F.struct(*columns)


def alert_envelope(alerts: DataFrame) -> DataFrame:
    """Live channel: the alert wrapped as ``{"type": "alert", "data": {...}}``."""
    return alerts.select("id", F.to_json(F.struct(F.lit("alert").alias("type"), _body().alias("data"))).alias("value"))


def alert_payload(alerts: DataFrame) -> DataFrame:
    """Notification channel: the bare alert, same id."""
    return alerts.select("id", F.to_json(_body()).alias("value"))


def notify_dedup(alerts: DataFrame, ttl_seconds: int = NOTIFY_TTL_SECONDS) -> DataFrame:
    """One row per alert id and life: the earliest, and each next one at or after the end of the one before.

    Rows of one id and time are one. Only ids with several times are put in order, by a cover that no id makes one task of.
    """
    at = F.unix_millis("created_at")
    rest = [c for c in alerts.columns if c not in ("id", "created_at")]
    once = alerts.groupBy("id", at.alias("_ms")).agg(F.min("created_at").alias("created_at"), *[F.min_by(c, "created_at").alias(c) for c in rest])
    times = once.groupBy("id").agg(F.min("_ms").alias("_first"), F.max("_ms").alias("_last"))
    rows = once.join(times, "id")
    several = rows.filter("_last > _first").select(F.col("id").alias("key"), F.col("_ms").alias("ts_ms"), F.lit(ttl_seconds * 1000).alias("life_ms"))
    kept = greedy_cover(several).select(F.col("key").alias("id"), F.col("ts_ms").alias("_ms"), F.lit(True).alias("_kept"))
    return rows.join(kept, ["id", "_ms"], "left").filter("_last = _first OR _kept").select(*alerts.columns)


def notifications(alerts: DataFrame, product: str = "Security") -> DataFrame:
    """Subject, template and context of each alert's message."""
    template = F.lit(FALLBACK_TEMPLATE)
    for rule_id, name in TEMPLATES.items():
        template = F.when(F.col("rule_id") == rule_id, name).otherwise(template)
    subject = F.concat(F.lit("["), F.upper(F.coalesce("severity", F.lit("info"))), F.lit(f"] {product} Alert: "),
                       F.coalesce("title", F.lit("Security Alert")))
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.create_map(F.lit("alert"), F.to_json(_body()))
    context = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(meta, k)), meta)
    return alerts.select("id", "rule_id", subject.alias("subject"), template.alias("template"),
                         context.alias("context"))
