"""Session settings shared by jobs, tests and the bench."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a dimension may have and still be broadcast. At about 100 bytes per row
# this keeps the largest broadcast near 200 MB per executor.
BROADCAST_ROW_LIMIT = 2_000_000


def build_session(app: str = "logweir", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = (builder.master(master)
                   .config("spark.driver.memory", "12g")
                   .config("spark.ui.enabled", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def within_rows(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no further than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_bounded(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when its counted size is within ``limit``.

    Beyond the limit the frame is returned as is, so the join shuffles and AQE
    may split skewed partitions.
    """
    return F.broadcast(df) if within_rows(df, limit) else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once for several uses: as a checkpoint where the session has a folder for them, else kept by Spark."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
