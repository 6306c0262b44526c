"""The six correlation detectors."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import is_private, normalize_mac
from ..functions.time import iso_ms
from ..schema import ALERT_COLUMNS
from .dashboard import is_auth_failure
from .folds import STORED_ITEMS, bucket_fold, reset_fold

# Window seconds and thresholds.
BRUTE_FORCE_WINDOW, BRUTE_FORCE_COUNT = 300, 10
PORT_SCAN_BUCKET, PORT_SCAN_PORTS = 60, 15
LATERAL_WINDOW, LATERAL_HOSTS = 60, 10
BUSINESS_START, BUSINESS_END = 6, 22
VPN_START_TYPES = ("start", "allowed", "connection")
# Name and severity of each detector.
DETECTORS = {
    "brute_force": ("Brute Force Authentication Attack", "high"),
    "port_scan": ("Port Scan Detected", "medium"),
    "rogue_device": ("Rogue Device Detected", "high"),
    "vpn_anomaly": ("VPN Login from New Geographic Location", "medium"),
    "lateral_movement": ("Lateral Movement Detected", "high"),
    "admin_abuse": ("Admin Access Outside Business Hours", "medium"),
}


def _alert(rule_id: str, identity: list, title: Column, description: Column, at: Column, count: Column,
           metadata: dict[str, Column]) -> list[Column]:
    name, severity = DETECTORS[rule_id]
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return [F.sha2(F.concat_ws("|", F.lit(rule_id), *[c.cast("string") for c in identity]), 256).alias("id"),
            F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), F.lit(severity).alias("severity"),
            title.alias("title"), description.alias("description"), at.alias("created_at"),
            count.cast("int").alias("event_count"), F.create_map(*pairs).alias("metadata")]


def auth_failures(events: DataFrame) -> DataFrame:
    """Failed authentications with a source: (key, ts_ms, ts)."""
    return events.filter(is_auth_failure() & (F.col("source.ip") != "")).select(
        F.col("source.ip").alias("key"), F.unix_millis("ts").alias("ts_ms"), "ts")


def port_contacts(events: DataFrame) -> DataFrame:
    return events.filter((F.col("source.ip") != "") & F.col("destination.port").isNotNull()).select(
        F.col("source.ip").alias("key"), F.unix_millis("ts").alias("ts_ms"), "ts",
        F.col("destination.port").cast("string").alias("item"))


def internal_contacts(events: DataFrame) -> DataFrame:
    return events.filter(is_private("source.ip") & (F.col("destination.ip") != "")).select(
        F.col("source.ip").alias("key"), F.unix_millis("ts").alias("ts_ms"), "ts",
        F.col("destination.ip").alias("item"))


def brute_force(events: DataFrame, window: int = BRUTE_FORCE_WINDOW, n: int = BRUTE_FORCE_COUNT) -> DataFrame:
    fired = reset_fold(auth_failures(events), n, window, distinct=False)
    return brute_force_alerts(fired.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times"))), window, n)


def brute_force_alerts(fired: DataFrame, window: int, n: int) -> DataFrame:
    """Alerts of firings (key, ts_ms, nth)."""
    ip = F.col("key")
    return fired.select(*_alert(
        "brute_force", [ip, F.col("ts_ms"), F.col("nth")], F.concat(F.lit("Brute Force: "), ip),
        F.concat(F.lit("Source IP "), ip, F.lit(f" had {n} authentication failures in the last {window} seconds.")),
        F.timestamp_millis("ts_ms"), F.lit(n),
        {"source_ip": ip, "failure_count": F.lit(n), "window_seconds": F.lit(window)}))


def port_scan(events: DataFrame, bucket: int = PORT_SCAN_BUCKET, n: int = PORT_SCAN_PORTS) -> DataFrame:
    return port_scan_alerts(bucket_fold(port_contacts(events), n, bucket), bucket, n)


def port_scan_alerts(fired: DataFrame, bucket: int, n: int) -> DataFrame:
    """Alerts of firings (key, ts_ms, item)."""
    ip = F.col("key")
    return fired.select(*_alert(
        "port_scan", [ip, F.col("ts_ms"), F.col("item")], F.concat(F.lit("Port Scan: "), ip),
        F.concat(F.lit("Source IP "), ip,
                 F.lit(f" contacted {n} distinct destination ports within a {bucket}-second window.")),
        F.timestamp_millis("ts_ms"), F.lit(n),
        {"source_ip": ip, "distinct_ports": F.lit(n), "threshold": F.lit(n)}))


def port_scan_totals(events: DataFrame, bucket: int = PORT_SCAN_BUCKET, n: int = PORT_SCAN_PORTS) -> DataFrame:
    """Buckets with at least n distinct ports, each reported once."""
    rows = port_contacts(events).withColumn("bucket", F.floor(F.col("ts_ms") / F.lit(bucket * 1000)))
    return (rows.groupBy("key", "bucket").agg(F.count_distinct("item").alias("ports"))
            .filter(F.col("ports") >= n).select(F.col("key").alias("source_ip"), "bucket", "ports"))


def lateral_movement(events: DataFrame, window: int = LATERAL_WINDOW, n: int = LATERAL_HOSTS,
                     stored: int | None = STORED_ITEMS) -> DataFrame:
    """Alerts name the first ``stored`` destinations; None for all."""
    return lateral_movement_alerts(reset_fold(internal_contacts(events), n, window, distinct=True, stored=stored), window, n)


def lateral_movement_alerts(fired: DataFrame, window: int, n: int) -> DataFrame:
    """Alerts of firings (key, ts_ms, item, items)."""
    ip = F.col("key")
    return fired.select(*_alert(
        "lateral_movement", [ip, F.col("ts_ms"), F.col("item")], F.concat(F.lit("Lateral Movement: "), ip),
        F.concat(F.lit("Internal host "), ip, F.lit(
            f" contacted {n} distinct destinations within {window} seconds. "
            "Possible lateral movement or scanning.")),
        F.timestamp_millis("ts_ms"), F.lit(n),
        {"source_ip": ip, "distinct_destinations": F.lit(n), "destination_ips": F.to_json("items"),
         "window_seconds": F.lit(window)}))


def sightings(events: DataFrame) -> DataFrame:
    """(mac, at, what) of every event with a MAC."""
    return events.filter(F.col("source.mac") != "").select(
        normalize_mac("source.mac").alias("mac"), F.struct("ts", F.col("event.id").alias("id")).alias("at"),
        F.struct(F.col("source.ip").alias("ip"), F.col("event.dataset").alias("dataset")).alias("what"))


def first_sightings(events: DataFrame) -> DataFrame:
    """First event of every normalised MAC. A partial aggregate: a chatty device costs one row per task."""
    return sightings(events).groupBy("mac").agg(F.min("at").alias("at"), F.min_by("what", "at").alias("what"))


def rogue_device(events: DataFrame, known_macs: DataFrame | None = None) -> DataFrame:
    firsts = first_sightings(events)
    if known_macs is not None:
        firsts = firsts.join(known_macs.select(normalize_mac("mac").alias("mac")).distinct(), "mac", "left_anti")
    return rogue_device_alerts(firsts)


def rogue_device_alerts(firsts: DataFrame) -> DataFrame:
    """Alerts of first sightings (mac, at, what)."""
    mac = F.col("mac")
    shown = F.coalesce("what.ip", F.lit("unknown"))
    return firsts.select(*_alert(
        "rogue_device", [mac], F.concat(F.lit("Rogue Device: "), mac),
        F.concat(F.lit("Unknown MAC address "), mac, F.lit(" (IP: "), shown,
                 F.lit(") observed on the network for the first time.")),
        F.col("at.ts"), F.lit(1), {"mac": mac, "source_ip": shown, "dataset": F.col("what.dataset")}))


def vpn_sessions(events: DataFrame) -> DataFrame:
    """(username, code, at, what) of every VPN session start with a user and a country."""
    start = F.exists("event.type", lambda t: t.isin(*VPN_START_TYPES))
    geo = F.col("source.geo")
    return events.filter(
        F.contains(F.lower("event.dataset"), F.lit("vpn")) & start & (F.col("user.name") != "")
        & (geo["country_iso_code"] != "")).select(
        F.col("user.name").alias("username"), geo["country_iso_code"].alias("code"),
        F.struct("ts", F.col("event.id").alias("id")).alias("at"),
        F.struct(F.coalesce("source.ip", F.lit("unknown")).alias("ip"),
                 F.coalesce(geo["country_name"], geo["country_iso_code"]).alias("country")).alias("what"))


def vpn_geo_anomaly(events: DataFrame) -> DataFrame:
    """A user's first VPN session from each country after the first one.

    Sessions shrink to one row per (user, country) before any window, so a
    user's window holds at most as many rows as there are countries.
    """
    firsts = vpn_sessions(events).groupBy("username", "code").agg(F.min("at").alias("at"), F.min_by("what", "at").alias("what"))
    earlier = Window.partitionBy("username").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fired = firsts.withColumn("known", F.array_sort(F.collect_list("code").over(earlier))) \
        .filter(F.size("known") > 0)
    return vpn_alerts(fired)


def vpn_alerts(fired: DataFrame) -> DataFrame:
    """Alerts of sessions from a new country (username, code, at, what, known)."""
    user, code, country = F.col("username"), F.col("code"), F.col("what.country")
    return fired.select(*_alert(
        "vpn_anomaly", [user, code, F.col("at.id")],
        F.concat(F.lit("VPN Geo-Anomaly: "), user, F.lit(" from "), country),
        F.concat(F.lit("User '"), user, F.lit("' connected via VPN from a new country: "), country, F.lit(" ("), code,
                 F.lit("). Previously seen countries: "), F.concat_ws(", ", "known"), F.lit(".")),
        F.col("at.ts"), F.lit(1),
        {"username": user, "new_country": code, "new_country_name": country, "source_ip": F.col("what.ip"),
         "known_countries": F.to_json("known")}))


def admin_off_hours(events: DataFrame, start: int = BUSINESS_START, end: int = BUSINESS_END) -> DataFrame:
    hour = F.hour("ts")
    rows = events.filter((F.col("event.dataset") == "unifi.admin") & ((hour < start) | (hour >= end)))
    user = F.coalesce("user.name", F.lit("unknown"))
    ip = F.coalesce("source.ip", F.lit("unknown"))
    return rows.select(*_alert(
        "admin_abuse", [F.col("event.id")], F.concat(F.lit("Off-Hours Admin Access by "), user),
        F.concat(F.lit(f"Admin activity detected outside business hours ({start:02d}:00–{end:02d}:00 UTC). User: "),
                 user, F.lit(", IP: "), ip, F.lit(", Hour: "), F.lpad(hour.cast("string"), 2, "0"),
                 F.lit(":xx UTC.")),
        F.col("ts"), F.lit(1),
        {"username": user, "source_ip": ip, "hour_utc": hour, "timestamp": iso_ms("ts"), "action": F.col("message"),
         "dataset": F.col("event.dataset")}))


Detector = Callable[[DataFrame], DataFrame]
# Fixed order.
DEFAULT_DETECTORS: dict[str, Detector] = {
    "brute_force": brute_force, "port_scan": port_scan, "rogue_device": rogue_device,
    "vpn_anomaly": vpn_geo_anomaly, "lateral_movement": lateral_movement, "admin_abuse": admin_off_hours}


def register_rule(detectors: dict[str, Detector], rule_id: str, rule_name: str, severity: str,
                  fn: Callable[[DataFrame], DataFrame]) -> dict[str, Detector]:
    """Detectors plus one; ``fn`` yields alert rows, whose rule id, name and severity are set here."""
    if rule_id in detectors:
        raise ValueError(f"rule {rule_id!r} already present")

    def run(events: DataFrame) -> DataFrame:
        return fn(events).withColumns({"rule_id": F.lit(rule_id), "rule_name": F.lit(rule_name),
                                       "severity": F.lit(severity)}).select(*ALERT_COLUMNS)
    return {**detectors, rule_id: run}


def correlate(events: DataFrame, detectors: dict[str, Detector] | None = None,
              failures: dict[str, Exception] | None = None) -> DataFrame:
    """Alerts of all detectors. One that cannot be planned is noted in ``failures`` and left out."""
    out = None
    for rule_id, detector in (detectors or DEFAULT_DETECTORS).items():
        try:
            alerts = detector(events).select(*ALERT_COLUMNS)
        except Exception as error:  # the others must still run
            if failures is None:
                raise
            failures[rule_id] = error
            continue
        out = alerts if out is None else out.unionByName(alerts)
    return out
