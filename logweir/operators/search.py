"""Log search, alert lists and acknowledgement."""
from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_term, split_terms
from ..functions.time import between, utc

PAGE_LIMIT = 200  # Fixed value: largest page and largest top list.
VPN_LIST, THREAT_LIST = 100, 50  # Fixed values: sizes of the recent-event lists.


def full_text(query: str, columns: list[str]) -> Column:
    """Any word of the query in any of the fields, compared in lower case."""
    terms = split_terms(query)
    hit = F.lit(False)
    for name in columns:
        hit = hit | any_term(name, terms)
    return hit


def message_search(query: str) -> Column:
    """Words in the message and raw line; whole value for address and host."""
    exact = F.coalesce(F.lower("source.ip") == query.lower(), F.lit(False)) | \
        F.coalesce(F.lower("host.hostname").isin(*query.lower().split()), F.lit(False))
    return full_text(query, ["message", "raw_message"]) | exact


def prune_days(rows: DataFrame, from_ts: datetime | None, to_ts: datetime | None, day: str = "event_date") -> DataFrame:
    """Limit a table partitioned by ``day`` to the days the bounds touch, both ends included; an absent bound is open."""
    if day not in rows.columns:
        return rows
    if from_ts is not None:
        rows = rows.filter(F.col(day) >= F.lit(utc(from_ts).astimezone(timezone.utc).date()))
    if to_ts is not None:
        rows = rows.filter(F.col(day) <= F.lit(utc(to_ts).astimezone(timezone.utc).date()))
    return rows


def matching_logs(events: DataFrame, q: str | None = None, dataset: str | None = None,
                  severity_min: int | None = None, from_ts: datetime | None = None,
                  to_ts: datetime | None = None, source_ip: str | None = None) -> DataFrame:
    """All events that pass every given filter."""
    out = prune_days(events, from_ts, to_ts).filter(between("ts", from_ts, to_ts))
    if dataset:
        out = out.filter(F.col("event.dataset") == dataset)
    if severity_min is not None:
        out = out.filter(F.col("event.severity") >= severity_min)
    if source_ip:
        out = out.filter(F.col("source.ip") == source_ip)
    return out.filter(message_search(q)) if q else out


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= PAGE_LIMIT:
        raise ValueError("page starts at 1 and size is between 1 and 200")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_logs(events: DataFrame, number: int = 1, size: int = 50, **filters) -> DataFrame:
    """One page of matching events, newest first. ``matching_logs(...).count()`` is the total."""
    return page(matching_logs(events, **filters), [F.desc("ts"), F.col("event.id")], number, size)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event.id") == event_id).limit(1)


def recent_events(events: DataFrame, condition: Column, n: int) -> DataFrame:
    return events.filter(condition).orderBy(F.desc("ts"), F.col("event.id")).limit(n)


def recent_vpn(events: DataFrame, from_ts=None, to_ts=None, n: int = VPN_LIST) -> DataFrame:
    return recent_events(prune_days(events, from_ts, to_ts),
                         (F.col("event.dataset") == "unifi.vpn") & between("ts", from_ts, to_ts), n)


def recent_threats(events: DataFrame, from_ts=None, to_ts=None, n: int = THREAT_LIST) -> DataFrame:
    if not 1 <= n <= PAGE_LIMIT:
        raise ValueError("n is between 1 and 200")
    return recent_events(prune_days(events, from_ts, to_ts),
                         F.col("source.threat_intel.matched") & between("ts", from_ts, to_ts), n)


def matching_alerts(alerts: DataFrame, severity: str | None = None, acknowledged: bool | None = None,
                    from_ts: datetime | None = None, to_ts: datetime | None = None) -> DataFrame:
    out = prune_days(alerts, from_ts, to_ts, "alert_date").filter(between("created_at", from_ts, to_ts))
    if severity is not None:
        out = out.filter(F.col("severity") == severity)
    if acknowledged is not None:
        out = out.filter(F.col("acknowledged") == acknowledged)
    return out


def list_alerts(alerts: DataFrame, number: int = 1, size: int = 50, **filters) -> DataFrame:
    return page(matching_alerts(alerts, **filters), [F.desc("created_at"), F.col("id")], number, size)


def get_alert(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.filter(F.col("id") == alert_id)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply acknowledgements (alert_id, user_id, at): the first one of an alert wins, for good."""
    first = acks.groupBy("alert_id").agg(F.min(F.struct("at", "user_id")).alias("ack"))
    joined = alerts.join(first, alerts["id"] == first["alert_id"], "left")
    done = F.col("acknowledged")
    rest = [c for c in alerts.columns if c not in ("acknowledged", "acknowledged_by", "acknowledged_at")]
    return joined.select(
        *rest, (done | F.col("ack").isNotNull()).alias("acknowledged"),
        F.when(done, F.col("acknowledged_by")).otherwise(F.col("ack.user_id")).alias("acknowledged_by"),
        F.when(done, F.col("acknowledged_at")).otherwise(F.col("ack.at")).alias("acknowledged_at"))


def with_ack_columns(alerts: DataFrame) -> DataFrame:
    """Fresh alerts with the acknowledgement columns at their defaults."""
    return alerts.withColumns({"acknowledged": F.lit(False), "acknowledged_by": F.lit(None).cast("string"),
                               "acknowledged_at": F.lit(None).cast("timestamp")})
