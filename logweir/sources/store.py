"""Event and alert tables: day-partitioned writes, idempotent alert appends."""
from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import event_date
from ..operators.dashboard import DELETE_DAYS
from ..operators.search import acknowledge
from ..schema import ALERT
from ..session import broadcast_if_bounded
from .feeds import exists


# Alerts as stored; the last three are absent until a day has an acknowledgement.
STORED_ALERT = T.StructType([*ALERT.fields, T.StructField("acknowledged", T.BooleanType()), T.StructField("acknowledged_by", T.StringType()),
                             T.StructField("acknowledged_at", T.TimestampType()), T.StructField("alert_date", T.DateType())])


def write_events(events: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Write events under ``event_date=YYYY-MM-DD``.

    Rows are dealt out by day in parts of the session's advisory size, so that a day has as many files as its
    size asks for, however many tasks there were. Ids have Bloom filters, by which a
    lookup of one id skips the row groups without it.

    With ``batch_id`` the rows also go under ``batch=<id>`` and replace what an
    earlier attempt of the same batch left there, so a retried batch is not
    written twice.
    """
    out = events.withColumn("event_date", F.coalesce(event_date("ts"), F.current_date()))
    keys = ["event_date"]
    if batch_id is not None:
        out, keys, mode = out.withColumn("batch", F.lit(batch_id)), ["event_date", "batch"], "overwrite"
    (out.hint("rebalance", *keys).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("parquet.bloom.filter.enabled#event.id", "true").partitionBy(*keys).parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts whose id is not stored yet. Ids are hashes, so a retry finds its own rows.

    Only the days the new alerts fall on are read back for the comparison.
    """
    spark = alerts.sparkSession
    fresh = alerts.dropDuplicates(["id"]).withColumn("alert_date", event_date("created_at"))
    if exists(spark, path):
        days = fresh.select("alert_date").distinct()
        # The type is given, as a table may have no rows yet.
        stored = spark.read.schema(fresh.schema).parquet(path).join(broadcast_if_bounded(days, 10_000), "alert_date", "left_semi").select("id")
        fresh = fresh.join(stored, "id", "left_anti")
    fresh.write.mode("append").partitionBy("alert_date").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Stored alerts with their acknowledgement columns."""
    rows = spark.read.schema(STORED_ALERT).parquet(path)
    return rows.withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))


def acknowledge_stored(spark: SparkSession, path: str, acks: DataFrame) -> list[date]:
    """Store acknowledgements (alert_id, user_id, at) of open alerts; the first one of an alert wins, for good. Returns the days rewritten.

    Only days with an open alert among them are read whole and replaced, each at once when the write commits; other days' files stay as
    they are. Acknowledging again changes nothing, so a retry is safe.
    """
    acks = acks.filter("alert_id IS NOT NULL")
    named = acks.select(F.col("alert_id").alias("id")).distinct()
    opened = read_alerts(spark, path).filter("NOT acknowledged").select("id", "alert_date").join(named, "id", "left_semi")
    days = sorted(row["alert_date"] for row in opened.select("alert_date").distinct().collect())
    if days:
        rows = acknowledge(read_alerts(spark, path).filter(F.col("alert_date").isin(days)), acks)
        (rows.select(STORED_ALERT.fieldNames()).hint("rebalance", "alert_date").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("alert_date").parquet(path))
    return days


def drop_expired(spark: SparkSession, path: str, today: date, days: int = DELETE_DAYS) -> list[str]:
    """Delete the day folders that reached ``days``; returns their names. Only folder names are read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = (today - timedelta(days=days)).isoformat()
    expired = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("event_date=") and name.removeprefix("event_date=") <= limit:
            fs.delete(status.getPath(), True)
            expired.append(name)
    return sorted(expired)
