"""Time expressions. Sessions run in UTC."""
from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Presets of the time-range picker.
RANGE_PRESETS = {"1h": timedelta(hours=1), "6h": timedelta(hours=6), "24h": timedelta(hours=24),
                 "7d": timedelta(days=7), "30d": timedelta(days=30)}
INDEX_NAME_FORMAT = "'siem-logs-'yyyy.MM.dd"
ISO_MS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def utc(moment: datetime) -> datetime:
    """Naive bounds are read as UTC, whatever zone the driver process runs in."""
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def time_range(preset: str, now: datetime) -> tuple[datetime, datetime]:
    return now - RANGE_PRESETS[preset], now


def default_window(from_ts: datetime | None, to_ts: datetime | None, now: datetime,
                   hours: int = 24) -> tuple[datetime, datetime]:
    """Bounds a dashboard uses when the caller gives none."""
    return from_ts or now - timedelta(hours=hours), to_ts or now


def between(ts, from_ts: datetime | None, to_ts: datetime | None) -> Column:
    """Inclusive on both ends; an absent bound is open."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    cond = F.lit(True)
    if from_ts is not None:
        cond = cond & (ts >= F.lit(utc(from_ts)))
    if to_ts is not None:
        cond = cond & (ts <= F.lit(utc(to_ts)))
    return cond


def to_ms(ts) -> Column:
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def index_name(ts) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, INDEX_NAME_FORMAT)


def event_date(ts) -> Column:
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def iso_ms(ts) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, ISO_MS_FORMAT)
