"""Sliding counts per key, split by time so that no key needs one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_chunks(rows: DataFrame, length_ms: int | Column, lookback_ms: int | Column) -> DataFrame:
    """Add ``chunk`` and ``own``; a row near the end of a chunk is also copied into the next one.

    The chunk is a pure function of the event time, so a recomputed task puts
    every row where it was before. A hot key spreads over as many groups as
    its time span has chunks.
    """
    length = F.lit(length_ms)
    chunk = F.floor(F.col("ts_ms") / length)
    near_end = F.pmod(F.col("ts_ms"), length) >= length - F.lit(lookback_ms)
    here = F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))
    beyond = F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))
    copies = F.when(near_end, F.array(here, beyond)).otherwise(F.array(here))
    return rows.withColumn("_c", F.explode(copies)).select(*rows.columns, "_c.chunk", "_c.own")


def tick_counts(ticks: DataFrame, window_ms: int) -> DataFrame:
    """Per (key, ts_ms) row with ``n`` events: ``through``, the events in (ts - window, ts].

    A group holds one row per millisecond of a chunk and its lookback, however
    many events there were.
    """
    spread = time_chunks(ticks, 4 * window_ms, window_ms)
    frame = Window.partitionBy("key", "chunk").orderBy("ts_ms").rangeBetween(-(window_ms - 1), 0)
    return (spread.withColumn("through", F.sum("n").over(frame)).filter("own")
            .select("key", "ts_ms", "n", "through"))


# Below the share of any window of up to 2^40 ms (35 years) that one millisecond is, above the error of a division.
_HALF_TICK = 2.0 ** -42


def mixed_tick_counts(ticks: DataFrame) -> DataFrame:
    """``tick_counts`` for keys whose windows differ: ``ticks`` has a column ``window_ms`` that depends on the key.

    Times are counted from the start of their chunk in units of the key's own window, so that all
    have a frame of length one whatever windows are combined.
    """
    window = F.col("window_ms")
    spread = time_chunks(ticks, 4 * window, window)
    spread = spread.withColumn("offset", (F.col("ts_ms") - F.col("chunk") * 4 * window) / window.cast("double"))
    through = F.expr(f"sum(n) OVER (PARTITION BY key, chunk ORDER BY offset "
                     f"RANGE BETWEEN {1 - _HALF_TICK!r}D PRECEDING AND CURRENT ROW)")
    return spread.withColumn("through", through).filter("own").select("key", "ts_ms", "n", "through")


def sliding_count(events: DataFrame, key: Column, ts: Column, event_id: Column, window_seconds: int,
                  at_least: int = 1) -> DataFrame:
    """(key, ts_ms, id, count): events of the key in (ts - window, ts], ties counted in id order.

    Events are first summed per key and millisecond, which is what the shuffle
    and the window see. ``at_least`` drops times that cannot reach a threshold
    before the events are joined back.
    """
    rows = events.select(key.alias("key"), F.unix_millis(ts).alias("ts_ms"), event_id.alias("id"))
    ticks = rows.groupBy("key", "ts_ms").agg(F.count("*").alias("n"))
    counted = tick_counts(ticks, window_seconds * 1000)
    if at_least > 1:
        counted = counted.filter(F.col("through") >= at_least)
    position = F.row_number().over(Window.partitionBy("key", "ts_ms").orderBy("id"))
    out = rows.join(counted, ["key", "ts_ms"]).withColumn("count", F.col("through") - F.col("n") + position)
    out = out.filter(F.col("count") >= at_least) if at_least > 1 else out
    return out.select("key", "ts_ms", "id", "count")
