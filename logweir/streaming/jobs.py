"""Long-running jobs: ingest, detection per batch, alert channels."""
from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import enrich_events
from ..operators.parse import counts_observed, dead_letters, observed_counts, parse_logs, to_ecs
from ..operators.parsers import DEFAULT_PARSERS, Parser
from ..sources.feeds import exists
from ..sources.raw_logs import clean_raw
from ..sources.store import write_events

REFRESH_SECONDS = 6 * 3600  # Fixed value: age at which dimensions are read again.
log = logging.getLogger(__name__)


class Dimensions:
    """Lookup tables that are read again once they are old. A failed reload keeps the last good ones."""

    def __init__(self, load: Callable[[], dict[str, DataFrame]], max_age: float = REFRESH_SECONDS,
                 clock: Callable[[], float] = time.time):
        self._load, self._max_age, self._clock = load, max_age, clock
        self._tables: dict[str, DataFrame] | None = None
        self._read_at = 0.0

    def current(self) -> dict[str, DataFrame]:
        if self._tables is None or self._clock() - self._read_at >= self._max_age:
            try:
                self._tables, self._read_at = self._load(), self._clock()
            except Exception:
                if self._tables is None:
                    raise
                log.warning("dimension reload failed; keeping the last tables", exc_info=True)
        return self._tables


class Lateness:
    """Splits each batch at the mark Spark's watermark would have: the latest time of all batches before it, less the delay.

    Each batch's latest time is stored under its number, so that a repeated batch is split alike.
    """

    def __init__(self, path: str, delay_seconds: int):
        self.path, self.delay_ms = path, delay_seconds * 1000

    def mark(self, spark: SparkSession, batch_id: int) -> int | None:
        """The mark of a batch in ms; rows at or before it are late. None before anything was seen."""
        if not exists(spark, self.path):
            return None
        seen = spark.read.schema("latest long, batch long").parquet(self.path).filter(F.col("batch") < batch_id)
        latest = seen.agg(F.max("latest")).first()[0]
        return None if latest is None else latest - self.delay_ms

    def note(self, spark: SparkSession, batch_id: int, latest: int | None) -> None:
        rows = spark.createDataFrame([(latest,)], "latest long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def start_ingest(raw: DataFrame, dimensions: Dimensions, events_path: str, rejects_path: str, checkpoint: str,
                 parsers: tuple[Parser, ...] = DEFAULT_PARSERS, trigger: dict | None = None, counts_path: str | None = None,
                 late_path: str | None = None, delay_seconds: int = 60) -> StreamingQuery:
    """Raw envelopes to the event table. All tables are written once per batch, also after a retry.

    Lines are cleaned first, and empty ones dropped. ``counts_path`` gets each batch's lines per log type and outcome, noted
    while the batch is read. With ``late_path`` events behind the watermark (``delay_seconds``) are set aside under it, with the
    times that tell, instead of in the event table.
    """
    lateness = Lateness(f"{late_path}/marks", delay_seconds) if late_path else None

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation()
        parsed = parse_logs(clean_raw(batch), parsers).persist()
        try:
            # The pass that fills the cache also counts.
            latest = observed_counts(parsed, parsers, seen).agg(F.max(F.unix_millis("parsed.ts"))).first()[0]
            if counts_path:
                rows = spark.createDataFrame(counts_observed(seen), "dataset string, status string, n long")
                rows.coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")
            tables = dimensions.current()
            events = enrich_events(to_ecs(parsed), tables.get("geo"), tables["ips"], tables["blocks"], tables["oui"])
            if lateness:
                mark = lateness.mark(spark, batch_id)
                late = F.coalesce(F.unix_millis("ts") <= mark, F.lit(False)) if mark is not None else F.lit(False)
                events.filter(late).write.mode("overwrite").parquet(f"{late_path}/events/batch={batch_id}")
                events = events.filter(~late)
            write_events(events, events_path, batch_id=batch_id)
            dead_letters(parsed).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
            if lateness:
                lateness.note(spark, batch_id, latest)
        finally:
            parsed.unpersist()

    return (raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())


Sink = Callable[[DataFrame], None]


def deliver(alerts: DataFrame, sinks: dict[str, Sink], required: tuple[str, ...] = ()) -> dict[str, Exception]:
    """Hand the same alerts to every sink; one that fails does not keep the others from running.

    Failures are returned. One in ``required`` is raised after all sinks ran,
    which makes a streaming batch run again.
    """
    failures: dict[str, Exception] = {}
    alerts = alerts.persist()
    try:
        for name, sink in sinks.items():
            try:
                sink(alerts)
            except Exception as error:
                log.warning("alert sink %s failed", name, exc_info=True)
                failures[name] = error
    finally:
        alerts.unpersist()
    for name in required:
        if name in failures:
            raise failures[name]
    return failures


def start_alerts(alerts: DataFrame, sinks: dict[str, Sink], checkpoint: str, required: tuple[str, ...] = (),
                 trigger: dict | None = None) -> StreamingQuery:
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        deliver(batch, sinks, required)

    return (alerts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())
