"""Threshold alert rules: model, shipped set, validation, evaluation."""
from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import OPERATORS, dataset_in, field, field_text, matches
from ..functions.text import render
from ..functions.time import iso_ms
from ..schema import ALERT, ALERT_COLUMNS
from .folds import suppress
from .windows import mixed_tick_counts

SEVERITIES = ("critical", "high", "medium", "low", "info")  # Fixed values.
# Event fields copied into an alert's metadata.
METADATA_PATHS = ("source.ip", "destination.ip", "host.name", "host.mac", "user.name", "network.name", "event.action")
# Names rules use for log types that the parsers publish under another name.
DATASET_ALIASES = {"unifi.flows": "unifi.traffic", "unifi.dpi": "unifi.traffic",
                   "unifi.threat_management": "unifi.threat", "unifi.device_events": "unifi.device"}


@dataclass(frozen=True)
class Condition:
    field: str
    group_by: str
    threshold: int
    window_seconds: int
    value: object = None
    operator: str = "eq"

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"Invalid operator {self.operator!r}; must be one of {sorted(OPERATORS)}")
        if self.threshold < 1 or self.window_seconds < 1:
            raise ValueError("threshold and window_seconds must be positive")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    condition: Condition
    severity: str
    dedup_key: str
    dedup_ttl_seconds: int
    throttle_seconds: int
    title_template: str
    body_template: str
    dataset_filter: list[str] = dc_field(default_factory=list)
    description: str = ""

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"Invalid severity {self.severity!r}")


def load_rules(entries: list[dict]) -> list[Rule]:
    """Rules from plain dictionaries; missing or unknown keys raise."""
    return [Rule(condition=Condition(**e["condition"]), **{k: v for k, v in e.items() if k != "condition"})
            for e in entries]


def load_rules_file(path: str) -> list[Rule]:
    import yaml
    with open(path, encoding="utf-8") as handle:
        return load_rules(yaml.safe_load(handle)["rules"])


def _rule(id, name, datasets, condition, severity, dedup, ttl, throttle, title, body) -> dict:
    path, operator, value, group_by, threshold, window = condition
    return {"id": id, "name": name, "dataset_filter": datasets, "severity": severity, "dedup_key": dedup,
            "dedup_ttl_seconds": ttl, "throttle_seconds": throttle, "title_template": title, "body_template": body,
            "condition": {"field": path, "operator": operator, "value": value, "group_by": group_by,
                          "threshold": threshold, "window_seconds": window}}


# Ids, names, conditions, limits, keys and titles of the shipped rules.
SHIPPED_RULES = load_rules([
    _rule("multiple_failed_logins", "Multiple Failed Login Attempts", ["unifi.auth", "unifi.ids_ips"],
          ("event.outcome", "eq", "failure", "source.ip", 10, 300), "high",
          "brute_force:{source.ip}", 3600, 900, "Brute Force Detected from {source.ip}",
          "{event_count} failed logins from {source.ip} ({source.geo.city_name}, {source.geo.country_name}) on "
          "{observer.hostname} between {window_start} and {window_end}."),
    _rule("threat_management_trigger", "Threat Management Alert", ["unifi.ids_ips", "unifi.threat_management"],
          ("event.kind", "eq", "alert", "source.ip", 1, 60), "critical",
          "ids_ips:{source.ip}:{rule.name}", 1800, 600, "IDS/IPS Alert: {rule.name} from {source.ip}",
          "{rule.name} ({rule.id}): {source.ip} ({source.geo.country_name}) to {destination.ip}:{destination.port}, "
          "action {event.action}, seen by {observer.hostname} at {@timestamp}."),
    _rule("rogue_ap_detection", "Rogue Access Point Detected", ["unifi.wireless", "unifi.wids"],
          ("event.action", "eq", "rogue_ap_detected", "network.name", 1, 120), "high",
          "rogue_ap:{source.mac}:{network.name}", 7200, 3600,
          "Rogue AP Detected: SSID '{network.name}' from {source.mac}",
          "{source.mac} broadcasts SSID {network.name}; reported by {observer.hostname} at {@timestamp}."),
    _rule("vpn_auth_failures", "VPN Connection Anomaly", ["unifi.vpn", "unifi.remote_user_vpn"],
          ("event.outcome", "eq", "failure", "source.ip", 5, 600), "medium",
          "vpn_auth_failures:{source.ip}:{user.name}", 3600, 1800,
          "VPN Anomaly: {event_count} failures from {source.ip} for user {user.name}",
          "{event_count} VPN failures of {user.name} from {source.ip} ({source.geo.city_name}, "
          "{source.geo.country_name}) over {network.protocol} on {observer.hostname} between {window_start} and "
          "{window_end}."),
    _rule("bandwidth_spike", "Excessive Bandwidth Spike", ["unifi.flows", "unifi.dpi"],
          ("network.bytes", "gte", 1073741824, "source.ip", 1, 300), "medium",
          "bandwidth_spike:{source.ip}", 1800, 900,
          "Bandwidth Spike: {source.ip} transferred {network.bytes_human} in 5 min",
          "{source.ip} ({source.mac}, {host.hostname}) moved {network.bytes_human} to {destination.ip}; seen by "
          "{observer.hostname} at {@timestamp}."),
    _rule("device_offline", "UniFi Device Offline", ["unifi.device_events", "unifi.controller"],
          ("event.action", "eq", "device.disconnected", "observer.hostname", 1, 120), "medium",
          "device_offline:{observer.hostname}", 3600, 1800,
          "UniFi Device Offline: {observer.hostname} ({observer.type})",
          "{observer.hostname} ({observer.type}) was last seen at {@timestamp}."),
    _rule("critical_firewall_event", "Critical Firewall Event", ["unifi.firewall", "unifi.gateway"],
          ("event.action", "eq", "denied", "source.ip", 50, 120), "high",
          "firewall_scan:{source.ip}", 3600, 900,
          "Firewall: Port Scan Detected from {source.ip} ({event_count} blocked)",
          "{event_count} connections from {source.ip} ({source.geo.city_name}, {source.geo.country_name}) blocked by "
          "{observer.hostname} between {window_start} and {window_end}."),
])


def rule_by_id(rule_id: str) -> Rule:
    return next(r for r in SHIPPED_RULES if r.id == rule_id)


def _condition(events: DataFrame, rule: Rule, compat: bool) -> Column:
    names = list(rule.dataset_filter)
    if compat:
        names += [DATASET_ALIASES[n] for n in rule.dataset_filter if n in DATASET_ALIASES]
    hit = dataset_in(events, names)
    condition = rule.condition
    if condition.value is not None:
        hit = hit & matches(events, condition.field, condition.operator, condition.value)
    return hit


def matching_events(events: DataFrame, rule: Rule, compat: bool = True) -> DataFrame:
    """Events the rule looks at."""
    return events.filter(_condition(events, rule, compat))


def _of_rule(values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule_no"))


_COUNT_MARK = "\x01count\x01"


def _context(rule: Rule, count: Column | None = None) -> dict[str, Column]:
    end = F.col("ts")
    start = end - F.make_dt_interval(secs=F.lit(rule.condition.window_seconds))
    return {"event_count": F.col("event_count") if count is None else count, "group_key": F.col("group_key"), "rule.name": F.lit(rule.name),
            "rule.id": F.lit(rule.id), "window_start": iso_ms(start), "window_end": iso_ms(end)}


def _rule_rows(events: DataFrame, rules: list[Rule], compat: bool) -> DataFrame:
    """One row per event and rule it satisfies, from a single scan however many rules there are."""
    found = []
    for number, rule in enumerate(rules):
        group = F.coalesce(field_text(events, rule.condition.group_by), F.lit("unknown"))
        context = {**_context(rule), "event_count": F.lit(_COUNT_MARK), "group_key": group}
        found.append(F.when(_condition(events, rule, compat), F.struct(
            F.lit(number).alias("rule_no"), group.alias("group_key"),
            render(events, rule.dedup_key, context).alias("dedup_key"))))
    hits = F.filter(F.array(*found), lambda r: r.isNotNull())
    keep = [c for c in events.columns if c != "raw_message"]
    return events.select(*keep, F.explode(hits).alias("_r")).select(
        *keep, "_r.*", F.unix_millis("ts").alias("ts_ms"), F.col("event.id").alias("id"))


def _candidates(events: DataFrame, rules: list[Rule], compat: bool) -> DataFrame:
    """Rows at or past their rule's threshold, with ``event_count``.

    All rules share one window, in which each row's time is measured by its rule's own length.
    """
    rows = _rule_rows(events, rules, compat)
    ticks = rows.groupBy("rule_no", "group_key", "ts_ms").agg(F.count("*").alias("n"))
    ticks = ticks.select(F.struct("rule_no", "group_key").alias("key"), "ts_ms", "n",
                         _of_rule([r.condition.window_seconds * 1000 for r in rules]).cast("long").alias("window_ms"))
    through = mixed_tick_counts(ticks).select("key.*", "ts_ms", "n", "through")
    through = through.filter(F.col("through") >= _of_rule([r.condition.threshold for r in rules]))
    position = F.row_number().over(Window.partitionBy("rule_no", "group_key", "ts_ms").orderBy("id"))
    counted = rows.join(through, ["rule_no", "group_key", "ts_ms"]) \
        .withColumn("event_count", F.col("through") - F.col("n") + position).drop("through", "n")
    return counted.filter(F.col("event_count") >= _of_rule([r.condition.threshold for r in rules])) \
        .withColumn("dedup_key", F.replace("dedup_key", F.lit(_COUNT_MARK), F.col("event_count").cast("string")))


def threshold_candidates(events: DataFrame, rule: Rule, compat: bool = True) -> DataFrame:
    """Matching events at or past the threshold: ``group_key``, ``ts_ms``, ``id``, ``event_count``.

    There is no reset: each event past the threshold is a candidate.
    """
    return _candidates(events, [rule], compat).select("group_key", "ts_ms", "id", "event_count")


def alert_metadata(events: DataFrame) -> Column:
    """Common event fields as a map, nulls left out; the event's own metadata wins."""
    pairs = []
    for path in METADATA_PATHS:
        if field(events, path) is not None:
            pairs += [F.lit(path.replace(".", "_")), field_text(events, path)]
    base = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    own = field(events, "metadata")
    if own is None:
        return base
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def candidate_dispositions(events: DataFrame, rules: list[Rule] | None = None, compat: bool = True) -> DataFrame:
    """Every candidate with its disposition: emitted, throttled or deduplicated."""
    rules = SHIPPED_RULES if rules is None else rules
    rows = _candidates(events, rules, compat)
    narrow = rows.select(
        "rule_no", "group_key", "dedup_key", "ts_ms", "id",
        _of_rule([r.dedup_ttl_seconds * 1000 for r in rules]).cast("long").alias("dedup_ms"),
        _of_rule([r.throttle_seconds * 1000 for r in rules]).cast("long").alias("throttle_ms"))
    return rows.join(suppress(narrow), ["rule_no", "id"], "left").withColumn(
        "disposition", F.coalesce("disposition", F.lit("deduplicated")))


def _alert_columns(rows: DataFrame, rules: list[Rule], count: Column | None = None) -> list[Column]:
    """Alert columns of rows of several rules; ``count`` stands for the number of events in their texts."""
    def rendered(template: str) -> Column:
        out = F.lit(None).cast("string")
        for number, rule in enumerate(rules):
            out = F.when(F.col("rule_no") == number, render(rows, getattr(rule, template), _context(rule, count))) \
                .otherwise(out)
        return out

    rule_id = _of_rule([r.id for r in rules])
    return [F.sha2(F.concat_ws("|", rule_id, "group_key", "id"), 256).alias("id"), rule_id.alias("rule_id"),
            _of_rule([r.name for r in rules]).alias("rule_name"), _of_rule([r.severity for r in rules]).alias("severity"),
            rendered("title_template").alias("title"), rendered("body_template").alias("description"),
            F.col("ts").alias("created_at"), (F.lit(None) if count is not None else F.col("event_count")).cast("int").alias("event_count"),
            alert_metadata(rows).alias("metadata")]


def evaluate_rules(events: DataFrame, rules: list[Rule] | None = None, compat: bool = True) -> DataFrame:
    """Alerts of the rules, all of them in one plan."""
    rules = SHIPPED_RULES if rules is None else rules
    fired = candidate_dispositions(events, rules, compat).filter(F.col("disposition") == "emitted")
    return fired.select(*_alert_columns(fired, rules)).select(*ALERT_COLUMNS)


def pending_alerts(events: DataFrame, rules: list[Rule], compat: bool, count_mark: str) -> DataFrame:
    """One row per event and rule it satisfies, with the alert it would raise; ``count_mark`` holds the place of the count.

    (rule_no, group_key, ts, id, dedup_key, threshold, dedup_ms, throttle_ms, alert): all that a fold over a group needs.
    """
    rows = _rule_rows(events, rules, compat)
    dedup_key = F.replace("dedup_key", F.lit(_COUNT_MARK), F.lit(count_mark))
    return rows.select(
        "rule_no", "group_key", "ts", "id", dedup_key.alias("dedup_key"),
        _of_rule([r.condition.threshold for r in rules]).alias("threshold"),
        _of_rule([r.dedup_ttl_seconds * 1000 for r in rules]).cast("long").alias("dedup_ms"),
        _of_rule([r.throttle_seconds * 1000 for r in rules]).cast("long").alias("throttle_ms"),
        F.struct(*_alert_columns(rows, rules, F.lit(count_mark))).cast(ALERT).alias("alert"))


def evaluate_rule(events: DataFrame, rule: Rule, compat: bool = True) -> DataFrame:
    """Alerts of one rule."""
    return evaluate_rules(events, [rule], compat)


def alerts_by_rule(events: DataFrame, rules: list[Rule] | None = None, compat: bool = True) -> DataFrame:
    """Candidates per rule, severity and disposition."""
    rules = SHIPPED_RULES if rules is None else rules
    rows = candidate_dispositions(events, rules, compat)
    return rows.groupBy(_of_rule([r.id for r in rules]).alias("rule_id"),
                        _of_rule([r.severity for r in rules]).alias("severity"), "disposition") \
        .agg(F.count("*").alias("n"))
