"""Every operator as a query over the driver tables."""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.network import ip_to_long, is_non_routable, is_private, long_to_ip
from ..functions.predicates import matches
from ..functions.text import any_term, format_bytes, format_severity, render, severity_level, split_terms
from ..functions.time import index_name, iso_ms
from ..operators import dashboard, detect, enrich, notify, requests as req, rules, search
from ..operators.parse import classify, dead_letters, header, parse_logs, pipeline_counts, to_ecs
from ..operators.parsers import DEFAULT_PARSERS
from ..operators.windows import sliding_count
from ..sources import feeds
from ..sources.raw_logs import decode_events, encode_events
from ..sources.store import read_events, write_events
from . import sample_events, sample_logs, samples
from .samples import DAY, MIXED_RULES, TUNED_RULES

FROM, TO, TODAY = datetime(2024, 1, 1), datetime(2024, 1, 31), datetime(2024, 2, 5)
MIDDLE = datetime(2024, 1, 15, 12)
SEARCH_WORDS = "error license password"
# Id of the alert about the first user's device.
KNOWN_ALERT = hashlib.sha256(b"rogue_device|b8:27:eb:00:00:00").hexdigest()
Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return sample_events.events_as_ecs(sample_events.read(spark, sf, "events"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    return sample_logs.events_as_syslog(sample_events.read(spark, sf, "events"))


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return sample_events.requests(sample_events.read(spark, sf, "events"))


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(events(spark, sf))


def _on_alerts(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(samples.alerts(events(spark, sf)))


def _stored(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over the events written by day and read again."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + mkdtemp(prefix='logweir-')}/events-{uuid4().hex}"
        write_events(events(spark, sf), path)
        return build(read_events(spark, path))
    return query


def _bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", iso_ms("bucket"))


def _flat_event(df: DataFrame) -> DataFrame:
    return df.select(F.col("event.id").alias("id"), iso_ms("ts").alias("ts"),
                     F.col("event.dataset").alias("dataset"), F.col("source.ip").alias("source_ip"),
                     F.col("event.severity").alias("severity"))


def _flat_alert(df: DataFrame) -> DataFrame:
    return df.select("id", "rule_id", "severity", "title", "description", iso_ms("created_at").alias("created_at"),
                     "event_count")


def _predicate(operator: str, path: str, value) -> Query:
    return _on_events(lambda e: e.filter(matches(e, path, operator, value)).select(F.col("event.id").alias("id")))


def _rule(rule: rules.Rule) -> Query:
    return _on_events(lambda e: rules.evaluate_rule(e, rule).select(
        "rule_id", "severity", "title", iso_ms("created_at").alias("created_at"), "event_count",
        F.col("metadata")["source_ip"].alias("meta_source_ip")))


def _fields(parsed: DataFrame) -> DataFrame:
    p = F.col("parsed")
    labels = F.array_join(F.transform(F.array_sort(F.map_entries(p["labels"])),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    plain = [n for n in sample_logs.FIELDS if n not in ("labels", "category", "tags")]
    return parsed.select("id", p["dataset"].alias("dataset"), iso_ms(p["ts"]).alias("ts"),
                         p["hostname"].alias("hostname"), *[p[n].cast("string").alias(n) for n in plain],
                         labels.alias("labels"), F.array_join(p["category"], " ").alias("category"),
                         F.array_join(p["tags"], " ").alias("tags"))


def _parse(name: str) -> Query:
    return lambda spark, sf: _fields(parse_logs(logs(spark, sf)).filter(
        (F.col("parser") == name) & F.col("reason").isNull()))


def _dims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    entries = feeds.feed_entries(samples.feed_lines(sample_events.read(spark, sf, "supplier")))
    return (samples.geo_ranges(sample_events.read(spark, sf, "nation")), feeds.feed_ips(entries),
            feeds.feed_cidrs(entries))


def _match_columns(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("event.id").alias("id"),
                     F.coalesce(F.col(f"{name}.matched"), F.lit(False)).alias("matched"),
                     F.col(f"{name}.feed").alias("feed"), F.coalesce(F.col(f"{name}.score"), F.lit(0)).alias("score"))


def enrich_geo(spark, sf, limit=enrich.BROADCAST_ROW_LIMIT):
    out = enrich.enrich_geo(events(spark, sf), _dims(spark, sf)[0], limit=limit)
    return out.select(F.col("event.id").alias("id"), "geo.country_iso_code", "geo.country_name",
                      F.col("geo.location.lat").alias("lat"), F.col("geo.location.lon").alias("lon"))


def enrich_geo_six(spark, sf, limit=enrich.BROADCAST_ROW_LIMIT):
    """Places of addresses of both families."""
    flat = sample_events.events_flat(sample_events.read(spark, sf, "events"))
    rows = flat.select("id", F.expr(samples.SIX_IP.format(str="string")).alias("ip"))
    out = enrich.enrich_geo(rows, samples.geo_of_both(sample_events.read(spark, sf, "nation")), "ip", limit=limit)
    return out.select("id", "ip", "geo.country_iso_code", "geo.country_name", F.col("geo.location.lat").alias("lat"))


def threat_dense(spark, sf, limit=enrich.BROADCAST_ROW_LIMIT):
    """Every source of the events is a listed block of its own."""
    e = events(spark, sf)
    ips = e.select(F.col("source.ip").alias("entry")).distinct()
    entries = ips.select(F.lit("own").alias("feed"), F.crc32("entry").alias("line_no"), F.lit("cidr").alias("kind"), F.concat("entry", F.lit("/32")).alias("entry"))
    return _match_columns(enrich.match_ip_cidr(e, feeds.feed_cidrs(entries), limit=limit), "block").filter("matched")


def threat_exact(spark, sf):
    return _match_columns(enrich.match_ip_exact(events(spark, sf), _dims(spark, sf)[1]), "exact")


def threat_cidr(spark, sf, limit=enrich.BROADCAST_ROW_LIMIT):
    return _match_columns(enrich.match_ip_cidr(events(spark, sf), _dims(spark, sf)[2], limit=limit), "block")


def enrich_threat(spark, sf):
    _, ips, blocks = _dims(spark, sf)
    out = enrich.enrich_threat(events(spark, sf), ips, blocks)
    details = enrich.with_feed_details(_match_columns(out, "threat_intel"), feeds.feed_catalog(spark))
    return details.select("id", "matched", "feed", "score", "confidence")


def mac_vendor(spark, sf):
    out = enrich.enrich_mac_vendor(events(spark, sf), feeds.read_oui(spark))
    return out.select(F.col("event.id").alias("id"), F.col("source.mac").alias("mac"), "mac_vendor")


def ingest(spark, sf):
    """Raw lines to enriched events, counted per log type."""
    geo, ips, blocks = _dims(spark, sf)
    out = enrich.enrich_events(to_ecs(parse_logs(logs(spark, sf))), geo, ips, blocks, feeds.read_oui(spark))
    return out.groupBy(F.col("event.dataset").alias("dataset")).agg(
        F.count("*").alias("n"), F.count_if(F.col("source.geo").isNotNull()).alias("located"),
        F.count_if(F.col("source.threat_intel.matched")).alias("threats"),
        F.count("observer.mac_vendor").alias("vendors"))


def full_text_search(spark, sf):
    docs = sample_events.read(spark, sf, "documents")
    return docs.filter(any_term("text", split_terms(SEARCH_WORDS))).select("doc_id", "lang", "source")


def url_hosts(spark, sf):
    return sample_events.read(spark, sf, "pages").select("page_id", feeds.url_host(F.col("url")).alias("host"))


def feed_parse(spark, sf):
    entries = feeds.feed_entries(samples.feed_lines(sample_events.read(spark, sf, "supplier")))
    return entries.select("feed", "line_no", "kind", "entry")


def parse_header(spark, sf):
    rows = logs(spark, sf).withColumn("h", header(F.col("raw"), F.col("received_at")))
    return rows.select("id", iso_ms("h.ts").alias("ts"), F.col("h.host").alias("host"))


def wireless(e):
    by_type = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")),
                                       lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return dashboard.wireless_by_ssid(e, FROM, TO).select("ssid", "event_count", by_type.alias("by_type"))


def _scan(df):
    return df.select(F.col("metadata")["source_ip"].alias("source_ip"), iso_ms("created_at").alias("created_at"),
                     "event_count", "title")


def lateral(e, window, n):
    return detect.lateral_movement(e, window, n).select(
        F.col("metadata")["source_ip"].alias("source_ip"), iso_ms("created_at").alias("created_at"), "event_count",
        F.col("metadata")["destination_ips"].alias("destinations"))


def rogue_known(spark, sf):
    """MACs of even users are known beforehand."""
    e = events(spark, sf)
    known = sample_events.events_flat(sample_events.read(spark, sf, "events")).filter("uid % 2 = 0").select("mac")
    return _flat_alert(detect.rogue_device(e, known))


def sliding(e):
    out = sliding_count(e, F.col("source.ip"), F.col("ts"), F.col("event.id"), DAY)
    return out.select("id", F.col("key").alias("source_ip"), F.col("count").alias("n"))


def candidates(e):
    rule = next(r for r in TUNED_RULES if r.id == "multiple_failed_logins")
    return rules.threshold_candidates(e, rule).select("id", "group_key", "event_count")


def dispositions(e):
    return rules.candidate_dispositions(e, TUNED_RULES).select("rule_no", "id", "group_key", "disposition")


def round_trip(e):
    good, _ = decode_events(encode_events(e))
    return _flat_event(good)


def notify_rows(a):
    return notify.notifications(a).select("id", "subject", "template", F.col("context")["source_ip"].alias("source_ip"))


def _repeated(a):
    """Each alert again after 30, 60, 100 and 130 minutes."""
    later = F.explode(F.array(*[F.lit(m) for m in (0, 30, 60, 100, 130)]))
    return a.withColumn("later", later).withColumn("created_at", F.col("created_at") + F.make_dt_interval(mins=F.col("later"))).drop("later")


def envelopes(a):
    out = notify.alert_envelope(a)
    return out.select("id", F.get_json_object("value", "$.type").alias("type"),
                      F.get_json_object("value", "$.data.id").alias("data_id"),
                      F.get_json_object("value", "$.data.created_at").alias("created_at"),
                      F.get_json_object("value", "$.data.metadata.source_ip").alias("source_ip"))


def payloads(a):
    return notify.alert_payload(a).select("id", F.get_json_object("value", "$.rule_id").alias("rule_id"),
                                          F.get_json_object("value", "$.title").alias("title"))


def acknowledged(a):
    return search.acknowledge(a, samples.acks(a)).select(
        "id", "acknowledged", "acknowledged_by", iso_ms("acknowledged_at").alias("acknowledged_at"))


def agents(spark, sf):
    ua = req.classify_user_agent("user_agent")
    return _requests(spark, sf).select("id", ua.alias("ua")).filter("ua IS NOT NULL").select(
        "id", F.col("ua.browser.family").alias("browser"), F.col("ua.os.family").alias("os"),
        F.col("ua.is_bot").alias("is_bot"), F.col("ua.is_mobile").alias("is_mobile"), F.col("ua.is_pc").alias("is_pc"))


def audit(spark, sf):
    return req.audit_log(_requests(spark, sf)).withColumn("created_at", iso_ms("created_at"))


def rate_limit(spark, sf):
    return req.rate_limited(_requests(spark, sf), limit=2, window=DAY).select(
        "id", "client_ip", "bucket", "retry_after")


def ip_functions(e):
    return e.select(F.col("source.ip").alias("ip"), F.col("destination.ip").alias("dest")).distinct().select(
        "ip", "dest", ip_to_long("ip").alias("number"), long_to_ip(ip_to_long("dest")).alias("back"),
        is_private("ip").alias("private"), is_non_routable("ip").alias("unrouted"))


def rendered(e):
    return e.select(F.col("event.id").alias("id"), render(
        e, "{event.dataset}: {user.name} at {source.ip} sent {network.bytes_human} ({no.such}) {host.name}")
        .alias("text"))


def formats(e):
    name = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "MEDIUM", "low", "info", "odd")]),
                        F.col("event.severity") % 6 + 1)
    return e.select(F.col("event.id").alias("id"), format_bytes("network.bytes").alias("size"),
                    severity_level(name).alias("level"), format_severity(name).alias("shown"),
                    index_name("ts").alias("index_name"))


def nested(spark, sf):
    e = to_ecs(parse_logs(logs(spark, sf)))
    return e.select(F.col("event.id").alias("id"), F.col("event.kind").alias("kind"),
                    F.array_join("event.category", " ").alias("category"),
                    F.array_join("event.type", " ").alias("type"), F.col("observer.type").alias("observer"),
                    F.col("observer.vendor").alias("vendor"), F.col("source.threat_intel.score").alias("score"))


def correlate_all(e):
    return _flat_alert(detect.correlate(e)).select("rule_id", "title", "created_at", "event_count")


QUERIES: dict[str, Query] = {
    "top_source_ips": _on_events(lambda e: dashboard.top_source_ips(e, FROM, TO)),
    "dashboard_stats": lambda spark, sf: dashboard.dashboard_stats(
        events(spark, sf), samples.alerts(events(spark, sf)), FROM, TO),
    "firewall_activity": _on_events(lambda e: _bucket(dashboard.firewall_activity(e, FROM, TO))),
    "blocked_total": _on_events(lambda e: dashboard.blocked_total(e, FROM, TO)),
    "timeseries_bytes": _on_events(lambda e: _bucket(dashboard.timeseries(e, "network.bytes", "day", FROM, TO))),
    "bandwidth_hourly": _on_events(lambda e: _bucket(dashboard.bandwidth(e, FROM, TO))),
    "failed_auth_hourly": _on_events(lambda e: _bucket(dashboard.failed_auth_timeseries(e, FROM, TO))),
    "events_per_minute": _on_events(lambda e: dashboard.events_per_minute(e).withColumn("minute", iso_ms("minute"))),
    "geo_map": _on_events(lambda e: dashboard.geo_map(e, FROM, TO)),
    "geo_map_scaled": _on_events(lambda e: dashboard.geo_map_scaled(e, FROM, TO).withColumn("scale", F.round("scale", 6))),
    "wireless_by_ssid": _on_events(wireless),
    "dataset_counts": _on_events(dashboard.dataset_counts),
    "retention_tiers": _on_events(lambda e: dashboard.retention_tiers(e, TODAY)),
    "search_logs": _on_events(lambda e: _flat_event(search.search_logs(
        e, number=2, size=50, q="click 33", severity_min=3, from_ts=FROM, to_ts=TO))),
    "full_text_search": full_text_search,
    "store_round_trip": _stored(_flat_event),
    "pruned_search": _stored(lambda e: _flat_event(search.matching_logs(e, from_ts=FROM, to_ts=TO))),
    "pruned_search_to": _stored(lambda e: _flat_event(search.matching_logs(e, to_ts=TO))),
    "pruned_search_from": _stored(lambda e: _flat_event(search.matching_logs(e, from_ts=MIDDLE))),
    "pruned_dashboard": _stored(lambda e: dashboard.top_source_ips(e, FROM, TO)),
    "get_event": _on_events(lambda e: _flat_event(search.get_event(e, "000000000123"))),
    "recent_vpn": _on_events(lambda e: _flat_event(search.recent_vpn(e, FROM, TO))),
    "recent_threat_matches": _on_events(lambda e: _flat_event(search.recent_threats(e, FROM, TO))),
    "list_alerts": _on_alerts(lambda a: _flat_alert(search.list_alerts(a, 1, 50, severity="medium", acknowledged=False))),
    "get_alert": _on_alerts(lambda a: _flat_alert(search.get_alert(a, KNOWN_ALERT))),
    "acknowledge_alerts": _on_alerts(acknowledged),
    "unacknowledged_count": _on_alerts(lambda a: dashboard.unacknowledged_count(search.acknowledge(a, samples.acks(a)))),
    "pred_eq": _predicate("eq", "event.outcome", "failure"),
    "pred_ne": _predicate("ne", "user.name", "user7"),
    "pred_contains": _predicate("contains", "message", "user 1"),
    "pred_regex": _predicate("regex", "source.ip", r"^10\.0\.\d+\.\d+$"),
    "pred_gt": _predicate("gt", "network.bytes", 100),
    "pred_gte": _predicate("gte", "network.bytes", 1073741824),
    "pred_lt": _predicate("lt", "event.severity", "4"),
    "pred_lte": _predicate("lte", "event.severity", 4),
    "sliding_count": _on_events(sliding),
    "threshold_candidates": _on_events(candidates),
    "suppress_alerts": _on_events(dispositions),
    "alerts_by_rule": _on_events(lambda e: rules.alerts_by_rule(e, TUNED_RULES)),
    "rules_mixed_windows": _on_events(lambda e: rules.alerts_by_rule(e, MIXED_RULES)),
    **{f"rule_{r.id}": _rule(r) for r in TUNED_RULES},
    "brute_force": _on_events(lambda e: _scan(detect.brute_force(e, DAY, 3))),
    "port_scan": _on_events(lambda e: _scan(detect.port_scan(e, DAY, 3))),
    "port_scan_no_reset": _on_events(lambda e: detect.port_scan_totals(e, DAY, 3)),
    "lateral_movement": _on_events(lambda e: lateral(e, DAY, 3)),
    "rogue_device": rogue_known,
    "vpn_geo_anomaly": _on_events(lambda e: _flat_alert(detect.vpn_geo_anomaly(e))),
    "admin_off_hours": _on_events(lambda e: _flat_alert(detect.admin_off_hours(e))),
    "correlate_all": _on_events(correlate_all),
    "enrich_geo": enrich_geo,
    "enrich_geo_large": lambda spark, sf: enrich_geo(spark, sf, limit=0),
    "threat_exact": threat_exact,
    "threat_cidr": threat_cidr,
    "threat_cidr_large": lambda spark, sf: threat_cidr(spark, sf, limit=0),
    "enrich_threat": enrich_threat,
    "mac_vendor": mac_vendor,
    "ip_functions": _on_events(ip_functions),
    "user_agent": agents,
    "user_agent_rollup": lambda spark, sf: req.user_agent_rollup(_requests(spark, sf)),
    "audit_log": audit,
    "rate_limit": rate_limit,
    "parse_header": parse_header,
    "classify": lambda spark, sf: classify(logs(spark, sf)).groupBy(
        F.coalesce("parser", F.lit("none")).alias("parser")).agg(F.count("*").alias("n")),
    **{f"parse_{p.name}": _parse(p.name) for p in DEFAULT_PARSERS},
    "dead_letters": lambda spark, sf: dead_letters(parse_logs(logs(spark, sf))).select("id", "reason"),
    "pipeline_counts": lambda spark, sf: pipeline_counts(parse_logs(logs(spark, sf))),
    "to_ecs": nested,
    "ingest": ingest,
    "render_template": _on_events(rendered),
    "formats": _on_events(formats),
    "feed_parse": feed_parse,
    "url_hosts": url_hosts,
    "event_round_trip": _on_events(round_trip),
    "alert_envelope": _on_alerts(envelopes),
    "alert_payload": _on_alerts(payloads),
    "notifications": _on_alerts(notify_rows),
    "enrich_geo_six": enrich_geo_six,
    "enrich_geo_six_large": lambda spark, sf: enrich_geo_six(spark, sf, 0),
    "threat_dense": threat_dense,
    "notify_dedup_hourly": _on_alerts(lambda a: _flat_alert(notify.notify_dedup(_repeated(a)))),
    "notify_dedup": _on_alerts(lambda a: _flat_alert(notify.notify_dedup(a.unionByName(a)))),
}
