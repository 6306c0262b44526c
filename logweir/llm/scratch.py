"""Tables written between steps, in the folder that all executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_BYTES = 8 << 20


def small_arrow_batches(spark: SparkSession) -> SparkSession:
    """Lets Spark send Python at most about 8 MB at a time, so that long texts and sets do not add up in memory."""
    spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="logweir-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: computed once, its lineage cut, safe when executors are lost.

    Its shuffle files go when it is written; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_SETTING) if before is None else spark.conf.set(_CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)
