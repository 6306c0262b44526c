"""Detectors and rules over streams: what their batch forms give, as soon as the watermark passes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.network import normalize_mac
from ..operators import detect
from ..operators.detect import (BRUTE_FORCE_COUNT, BRUTE_FORCE_WINDOW, LATERAL_HOSTS, LATERAL_WINDOW,
                                PORT_SCAN_BUCKET, PORT_SCAN_PORTS, auth_failures, internal_contacts, port_contacts)
from ..operators.folds import STORED_ITEMS
from ..operators.rules import SHIPPED_RULES, Rule, pending_alerts
from ..schema import ALERT_COLUMNS
from .folds import (COUNT_MARK, CountFold, DistinctFold, FirstFold, Fold, InOrder, NewItemFold, RuleFold, SlidingFold,
                    SuppressFold)

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_time_order(rows: DataFrame, fold: Fold, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Run ``fold`` over streaming ``rows``: the keys, ts (with a watermark), tie, then any values.

    ``tie`` orders rows of one time. Set the watermark on the whole stream, so that rows a detector
    ignores still move its clock. The result is the keys and the fold's output. Map state needs the RocksDB state store, which is set here.
    """
    rows.sparkSession.conf.set(*STATE_STORE)
    # Times are numbers in state: a timestamp would depend on the time zones of the processes it passes through.
    rows = rows.withColumns({"ts_ms": F.unix_millis("ts"), "ts_us": F.unix_micros("ts")}).filter("ts_ms IS NOT NULL")
    waiting = T.StructType([f for f in rows.schema if f.name not in (*keys, "ts")])
    key_types = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    output = T.StructType.fromDDL(", ".join([*key_types, fold.output]))
    return rows.groupBy(*keys).transformWithState(InOrder(fold, waiting, output.fieldNames()), output, "append", "EventTime")


def clocked(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark that every row moves.

    Spark pushes filters that do not mention the event time below the
    watermark, where a quiet detector's clock would stand still. Tying each
    column to the time keeps its filters above.
    """
    marked = events.withWatermark("ts", delay)
    return marked.select("ts", *[F.when(F.col("ts").isNotNull(), F.col(c)).alias(c)
                                 for c in events.columns if c != "ts"])


def brute_force_firings(events: DataFrame, window: int = BRUTE_FORCE_WINDOW, n: int = BRUTE_FORCE_COUNT) -> DataFrame:
    rows = auth_failures(events).select("key", "ts", F.lit("").alias("tie"))
    return in_time_order(rows, CountFold(n, window * 1000))


def brute_force_stream(events: DataFrame, window: int = BRUTE_FORCE_WINDOW, n: int = BRUTE_FORCE_COUNT) -> DataFrame:
    return detect.brute_force_alerts(brute_force_firings(events, window, n), window, n)


def port_scan_stream(events: DataFrame, bucket: int = PORT_SCAN_BUCKET, n: int = PORT_SCAN_PORTS) -> DataFrame:
    rows = port_contacts(events).select("key", "ts", F.col("item").alias("tie"))
    return detect.port_scan_alerts(in_time_order(rows, DistinctFold(n, None, bucket * 1000)), bucket, n)


def lateral_movement_stream(events: DataFrame, window: int = LATERAL_WINDOW, n: int = LATERAL_HOSTS,
                            stored: int | None = STORED_ITEMS) -> DataFrame:
    rows = internal_contacts(events).select("key", "ts", F.col("item").alias("tie"))
    return detect.lateral_movement_alerts(in_time_order(rows, DistinctFold(n, window * 1000, stored=stored)), window, n)


def rogue_device_stream(events: DataFrame, known_macs: DataFrame | None = None) -> DataFrame:
    """First sight of each MAC. State is one small row per device ever seen, kept for good."""
    seen = detect.sightings(events)
    if known_macs is not None:
        seen = seen.join(known_macs.select(normalize_mac("mac").alias("mac")).distinct(), "mac", "left_anti")
    rows = seen.select("mac", F.col("at.ts").alias("ts"), F.col("at.id").alias("tie"), "what")
    firsts = in_time_order(rows, FirstFold(rows.schema["what"].dataType), ("mac",))
    return detect.rogue_device_alerts(firsts.withColumn("at", F.struct(F.timestamp_micros("ts_us").alias("ts"), "id")))


def vpn_anomaly_stream(events: DataFrame) -> DataFrame:
    """State is one small row per user and country ever seen, kept for good."""
    rows = detect.vpn_sessions(events).select("username", F.col("at.ts").alias("ts"), F.col("at.id").alias("tie"), F.col("code").alias("item"), "what")
    found = in_time_order(rows, NewItemFold(rows.schema["what"].dataType), ("username",))
    return detect.vpn_alerts(found.withColumnRenamed("item", "code")
                             .withColumn("at", F.struct(F.timestamp_micros("ts_us").alias("ts"), "id")))


STREAM_DETECTORS = {
    "brute_force": brute_force_stream, "port_scan": port_scan_stream, "rogue_device": rogue_device_stream,
    "vpn_anomaly": vpn_anomaly_stream, "lateral_movement": lateral_movement_stream, "admin_abuse": detect.admin_off_hours}


def correlate_stream(events: DataFrame, delay: str = "1 minute", detectors: dict[str, detect.Detector] | None = None,
                     failures: dict[str, Exception] | None = None) -> DataFrame:
    """Alert rows of all detectors over one stream of events, as ``correlate`` gives them over a table.

    The detectors share one watermark, ``delay`` behind the latest event.
    """
    return detect.correlate(clocked(events, delay), detectors or STREAM_DETECTORS, failures)


def evaluate_rules_stream(events: DataFrame, delay: str = "1 minute", rules: list[Rule] | None = None, compat: bool = True) -> DataFrame:
    """Alerts of the rules over a stream, as ``evaluate_rules`` gives them over a table.

    State per rule and group: one count per millisecond of the rule's window, and markers that are live.
    """
    rules = SHIPPED_RULES if rules is None else rules
    rows = pending_alerts(clocked(events, delay), rules, compat, COUNT_MARK)
    rows = rows.select("rule_no", "group_key", "ts", F.col("id").alias("tie"), "dedup_key", "threshold", "dedup_ms", "throttle_ms",
                       F.col("alert").dropFields("created_at").withField(
                           "metadata", F.to_json("alert.metadata", {"ignoreNullFields": "false"})).alias("alert"))
    fold = RuleFold([r.condition.window_seconds * 1000 for r in rules], rows.schema["alert"].dataType)
    fired = in_time_order(rows, fold, ("rule_no", "group_key"))
    return fired.withColumns({"created_at": F.timestamp_micros("ts_us"),
                              "metadata": F.from_json("metadata", "map<string,string>")}).select(*ALERT_COLUMNS)


def sliding_count_stream(rows: DataFrame, delay: str, window: int) -> DataFrame:
    """``rows``: key, ts, id. Each row's count of the key's rows in (ts - window, ts]."""
    keyed = rows.withWatermark("ts", delay).select("key", "ts", F.col("id").alias("tie"))
    return in_time_order(keyed, SlidingFold(window * 1000))


def suppress_stream(candidates: DataFrame, delay: str) -> DataFrame:
    """``candidates``: rule_no, group_key, dedup_key, ts, id, dedup_ms, throttle_ms. What becomes of each: id, disposition."""
    keyed = candidates.withWatermark("ts", delay).select("rule_no", "group_key", "ts", F.col("id").alias("tie"), "dedup_key", "dedup_ms", "throttle_ms")
    return in_time_order(keyed, SuppressFold(), ("rule_no", "group_key"))


def notify_dedup_stream(alerts: DataFrame, ttl: str = "1 hour") -> DataFrame:
    return alerts.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["id"])


def events_per_minute_stream(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute").alias("w"))
            .agg(F.count("*").alias("events")).select(F.col("w.start").alias("minute"), "events"))
