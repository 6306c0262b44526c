"""Dashboard roll-ups over events. Each is one partial aggregation and a small merge."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import field
from ..functions.time import between, utc
from .search import prune_days

HOT_DAYS, DELETE_DAYS = 7, 90  # Fixed values: age in days at which data turns warm, and is dropped.
TOP_IPS, TOP_COUNTRIES, TOP_SSIDS, TOP_TYPES = 10, 200, 20, 5  # Fixed values: report sizes.


def _in_range(events: DataFrame, from_ts, to_ts) -> DataFrame:
    return prune_days(events, from_ts, to_ts).filter(between("ts", from_ts, to_ts))


def _newest() -> Column:
    return F.struct("ts", "event.id")


def is_auth_failure() -> Column:
    return F.array_contains("event.category", "authentication") & (F.col("event.outcome") == "failure")


def dashboard_stats(events: DataFrame, alerts: DataFrame, from_ts: datetime, to_ts: datetime) -> DataFrame:
    """Six counters in one pass over each input. Alerts count from the start bound only."""
    conditions = {
        "blocked_connections": (F.col("event.dataset") == "unifi.firewall") & (F.col("event.outcome") == "failure"),
        "auth_failures": is_auth_failure(),
        "active_vpn_sessions": (F.col("event.dataset") == "unifi.vpn") & F.array_contains("event.type", "start"),
        "threat_intel_matches": F.col("source.threat_intel.matched"),
    }
    zero = F.lit(0).cast("long")
    from_events = _in_range(events, from_ts, to_ts).agg(
        F.count("*").alias("total_events"), *[F.count_if(c).alias(n) for n, c in conditions.items()],
        zero.alias("total_alerts"))
    from_alerts = prune_days(alerts, from_ts, None, "alert_date").filter(between("created_at", from_ts, None)).agg(
        zero.alias("total_events"), *[zero.alias(n) for n in conditions], F.count("*").alias("total_alerts"))
    names = ["total_events", "total_alerts", *conditions]
    return from_events.unionByName(from_alerts).agg(*[F.sum(n).alias(n) for n in names])


def top_source_ips(events: DataFrame, from_ts=None, to_ts=None, n: int = TOP_IPS) -> DataFrame:
    """Busiest sources with the country of their newest event."""
    return (_in_range(events, from_ts, to_ts).filter(F.col("source.ip").isNotNull())
            .groupBy(F.col("source.ip").alias("source_ip"))
            .agg(F.count("*").alias("event_count"),
                 F.coalesce(F.max_by("source.geo.country_name", _newest()), F.lit("Unknown")).alias("country"))
            .orderBy(F.desc("event_count"), "source_ip").limit(n))


def _buckets(spark, from_ts: datetime, to_ts: datetime, unit: str) -> DataFrame:
    """One row per bucket between the bounds; grows with the range, not with the data."""
    start, end = (F.date_trunc(unit, F.lit(utc(t))) for t in (from_ts, to_ts))
    return spark.range(1).select(F.explode(F.sequence(start, end, F.expr(f"interval 1 {unit}"))).alias("bucket"))


def histogram(events: DataFrame, from_ts: datetime, to_ts: datetime, unit: str,
              measures: dict[str, Column]) -> DataFrame:
    """Measures per time bucket, empty buckets filled with 0."""
    grouped = (_in_range(events, from_ts, to_ts).groupBy(F.date_trunc(unit, "ts").alias("bucket"))
               .agg(*[m.alias(name) for name, m in measures.items()]))
    return (_buckets(events.sparkSession, from_ts, to_ts, unit).join(grouped, "bucket", "left")
            .select("bucket", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures]))


def firewall_activity(events: DataFrame, from_ts: datetime, to_ts: datetime) -> DataFrame:
    fw = events.filter(F.col("event.dataset") == "unifi.firewall")
    return histogram(fw, from_ts, to_ts, "hour", {
        "allowed": F.count_if(F.col("event.outcome") == "success"),
        "denied": F.count_if(F.col("event.outcome") == "failure")})


def blocked_total(events: DataFrame, from_ts: datetime, to_ts: datetime) -> DataFrame:
    return firewall_activity(events, from_ts, to_ts).agg(F.sum("denied").alias("blocked"))


def timeseries(events: DataFrame, path: str, unit: str, from_ts: datetime, to_ts: datetime) -> DataFrame:
    """Events per bucket, and the sum of ``path`` unless it is the time itself."""
    measures = {"events": F.count("*")}
    if path != "@timestamp":
        measures["total"] = F.sum(field(events, path))
    return histogram(events, from_ts, to_ts, unit, measures)


def bandwidth(events: DataFrame, from_ts: datetime, to_ts: datetime) -> DataFrame:
    return timeseries(events, "network.bytes", "hour", from_ts, to_ts).select(
        "bucket", F.col("total").alias("bytes"))


def failed_auth_timeseries(events: DataFrame, from_ts: datetime, to_ts: datetime) -> DataFrame:
    return timeseries(events.filter(is_auth_failure()), "@timestamp", "hour", from_ts, to_ts)


def events_per_minute(events: DataFrame) -> DataFrame:
    return (events.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("events"))
            .select(F.col("w.start").alias("minute"), "events"))


def geo_map(events: DataFrame, from_ts=None, to_ts=None, n: int = TOP_COUNTRIES) -> DataFrame:
    """Located events per country, name and place taken from the newest one."""
    located = _in_range(events, from_ts, to_ts).filter(
        F.col("source.geo.location").isNotNull() & F.col("source.geo.country_iso_code").isNotNull())
    return (located.groupBy(F.col("source.geo.country_iso_code").alias("country_iso_code"))
            .agg(F.count("*").alias("count"),
                 F.max_by(F.struct("source.geo.country_name", "source.geo.location"), _newest()).alias("s"))
            .select("country_iso_code", F.coalesce("s.country_name", F.lit("Unknown")).alias("country"),
                    F.col("s.location.lat").alias("lat"), F.col("s.location.lon").alias("lon"), "count")
            .orderBy(F.desc("count"), "country_iso_code").limit(n))


def geo_map_scaled(events: DataFrame, from_ts=None, to_ts=None) -> DataFrame:
    """Marker size per country relative to the largest; at most TOP_COUNTRIES rows reach the window."""
    top = F.max("count").over(Window.partitionBy())
    return geo_map(events, from_ts, to_ts).withColumn("scale", F.col("count") / F.greatest(top, F.lit(1)))


def wireless_by_ssid(events: DataFrame, from_ts=None, to_ts=None) -> DataFrame:
    """Busiest networks with their most frequent event types.

    Only one row per (network, type) reaches the windows. An event of several
    types counts once for its network.
    """
    rows = (_in_range(events, from_ts, to_ts).filter(F.col("event.dataset") == "unifi.wireless")
            .select(F.try_element_at("labels", F.lit("ssid")).alias("ssid"),
                    F.posexplode_outer("event.type").alias("pos", "type"))
            .filter(F.col("ssid").isNotNull()))
    counted = rows.groupBy("ssid", "type").agg(
        F.count("type").alias("n"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("docs"))
    of_ssid = Window.partitionBy("ssid")
    ranked = (counted.withColumn("event_count", F.sum("docs").over(of_ssid))
              .withColumn("rank", F.row_number().over(of_ssid.orderBy(F.desc("n"), "type"))))
    kept = F.when((F.col("rank") <= TOP_TYPES) & F.col("type").isNotNull(), F.struct("type", "n"))
    return (ranked.groupBy("ssid")
            .agg(F.max("event_count").alias("event_count"),
                 F.map_from_entries(F.array_sort(F.collect_list(kept))).alias("by_type"))
            .orderBy(F.desc("event_count"), "ssid").limit(TOP_SSIDS))


def dataset_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event.dataset").alias("dataset")).agg(F.count("*").alias("n"))


def unacknowledged_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(~F.col("acknowledged")).alias("open_alerts"))


def retention_tiers(events: DataFrame, today: datetime) -> DataFrame:
    """Events and days per storage tier."""
    age = F.datediff(F.lit(today.date()), F.to_date("ts"))
    tier = F.when(age >= DELETE_DAYS, "delete").when(age >= HOT_DAYS, "warm").otherwise("hot")
    return (events.groupBy(F.to_date("ts").alias("event_date"), tier.alias("tier")).agg(F.count("*").alias("n"))
            .groupBy("tier").agg(F.count("*").alias("days"), F.sum("n").alias("events")))
