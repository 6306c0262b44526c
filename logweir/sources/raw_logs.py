"""Raw log envelopes: reading, cleaning, decoding."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, RAW_LOG


def read_raw_logs(spark: SparkSession, path_or_topic: str, streaming: bool = False, fmt: str = "json",
                  kafka_servers: str | None = None, max_per_trigger: int | None = None) -> DataFrame:
    """Envelopes from a folder of files, or from a Kafka topic when ``kafka_servers`` is given.

    A streaming Kafka read starts at the newest record.
    """
    reader = spark.readStream if streaming else spark.read
    if kafka_servers:
        reader = reader.format("kafka").option("kafka.bootstrap.servers", kafka_servers) \
            .option("subscribe", path_or_topic)
        if streaming:
            reader = reader.option("startingOffsets", "latest")
            if max_per_trigger:
                reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        value = F.from_json(F.col("value").cast("string"), RAW_LOG)
        return reader.load().select(value.alias("v")).select("v.*")
    if streaming and max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.schema(RAW_LOG).format(fmt).load(path_or_topic)


def clean_text(data: Column) -> Column:
    """Bytes or text to trimmed text: UTF-8, else Latin-1; NULs removed."""
    text = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data.cast("binary"), "UTF-8")) \
        .otherwise(F.decode(data.cast("binary"), "ISO-8859-1"))
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_raw(df: DataFrame, column: str = "raw") -> DataFrame:
    """Clean ``column`` and drop rows left empty."""
    return df.withColumn(column, clean_text(F.col(column))).filter(F.col(column) != "")


def envelope(df: DataFrame, received_at: Column, source_ip: Column, position: Column | None = None) -> DataFrame:
    """Add id, arrival time (ms) and sender. The id is a hash, so a retried task repeats it.

    ``position`` should tell equal lines apart, such as a topic offset.
    """
    arrived = F.date_trunc("MILLISECOND", received_at)
    parts = [F.col("raw"), F.unix_millis(arrived).cast("string"), source_ip]
    if position is not None:
        parts.append(position.cast("string"))
    return df.select(F.sha2(F.concat_ws("|", *parts), 256).alias("id"), "raw", arrived.alias("received_at"),
                     source_ip.alias("source_ip"))


def decode_events(df: DataFrame, column: str = "event") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from a column of event JSON; a malformed row never fails the job."""
    schema = EVENT
    parsed = df.withColumn("_ok", F.try_parse_json(F.col(column)).isNotNull()) \
        .withColumn("_event", F.from_json(F.regexp_replace(F.col(column), r'^\s*\{\s*"@timestamp"', '{"ts"'), schema))
    good = F.col("_ok") & F.col("_event").isNotNull()
    return parsed.filter(good).select("_event.*"), parsed.filter(~F.coalesce(good, F.lit(False))).select(column)


def encode_events(events: DataFrame, column: str = "event") -> DataFrame:
    """One JSON text per event."""
    return events.select(F.to_json(F.struct(*events.columns)).alias(column))
