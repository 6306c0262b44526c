"""Detectors that clear their window when they fire, and alert suppression.

These depend on the order of a key's whole history. Still no task gets a
key's history: time is cut into chunks, every chunk works out what it does
for each of the few ways its predecessor can end, the short per-chunk tables
are joined up per key, and each chunk then reports the firings of the way
that really happened.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .fold_steps import NONE, CountChunk, DistinctChunk
from .windows import time_chunks

MIN_CHUNK_MS = 600_000
STORED_ITEMS = 20  # Fixed value: items kept with a firing, unless asked otherwise.


def _in_key_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Partition by ``keys`` and sort; the count is given so that AQE keeps the Python work spread.

    Rows are dealt by a hash of the keys, not by the keys: below a join on the same keys Spark would take the join's
    partitioning for this one, and give it up when the join turns into a broadcast while running.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, dict]]:
    """(key, chunk, columns as arrays) of each run of equal key and chunk in sorted batches."""
    open_parts: list[dict] = []
    for pdf in batches:
        columns = {name: pdf[name].to_numpy() for name in pdf.columns}
        key, chunk = columns["key"], columns["chunk"]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, len(key)]):
            if low == high:
                continue
            part = {name: values[low:high] for name, values in columns.items()}
            if open_parts and (open_parts[0]["key"][0], open_parts[0]["chunk"][0]) != (part["key"][0], part["chunk"][0]):
                yield _joined(open_parts)
                open_parts = []
            open_parts.append(part)
    if open_parts:
        yield _joined(open_parts)


def _joined(parts: list[dict]) -> tuple[str, int, dict]:
    whole = parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
    return whole["key"][0], int(whole["chunk"][0]), whole


def _chunk_of(number: int, rows: dict, n: int, window_ms: int, length_ms: int, distinct: bool):
    ts, counts = rows["ts_ms"].astype(np.int64), rows["cnt"].astype(np.int64)
    first = int((~rows["own"].astype(bool)).sum())
    if distinct:
        return DistinctChunk(ts, rows["item"], counts, first, n, window_ms, number * length_ms,
                             (number + 1) * length_ms)
    return CountChunk(ts, counts, first, n, window_ms, (number + 1) * length_ms)


def _firings(key, chunk, fired, distinct: bool, stored: int | None = STORED_ITEMS) -> Iterator[tuple]:
    for row, what in fired:
        yield (key, int(chunk.ts[row]), chunk.items[row] if distinct else None, 1 if distinct else what,
               what[:stored] if distinct else [])


def _frames(rows: Iterator[tuple], names: list[str], size: int = 5000) -> Iterator[pd.DataFrame]:
    """Rows as frames of a few thousand; one small frame per chunk would cost more than the work."""
    while batch := list(islice(rows, size)):
        yield pd.DataFrame(batch, columns=names, dtype=object)


FIRING_COLUMNS = ["key", "ts_ms", "item", "times", "items"]
FIRING = "key string, ts_ms long, item string, times long, items array<string>"


def _ticks(rows: DataFrame, distinct: bool) -> DataFrame:
    keys = ["key", "ts_ms", "item"] if distinct else ["key", "ts_ms"]
    return rows.groupBy(*keys).agg(F.count("*").alias("cnt"))


def _able(chunks: DataFrame, n: int) -> DataFrame:
    """Drop chunks with fewer events than a firing needs."""
    total = F.sum("cnt").over(Window.partitionBy("key", "chunk"))
    return chunks.withColumn("_total", total).filter(F.col("_total") >= n).drop("_total")


def reset_fold(rows: DataFrame, n: int, window_seconds: int, distinct: bool, stored: int | None = STORED_ITEMS) -> DataFrame:
    """Firings over ``rows`` (key, ts_ms[, item]): the n-th event, or n-th distinct item, within the window.

    A firing clears the window. One row per key, time and item, with the first ``stored`` items; None for all.
    """
    if n < 2:
        one = _ticks(rows, distinct)
        return one.select("key", "ts_ms", (F.col("item") if distinct else F.lit(None).cast("string")).alias("item"),
                          F.col("cnt").alias("times"),
                          (F.array("item") if distinct else F.array().cast("array<string>")).alias("items"))
    window_ms = window_seconds * 1000
    lookback = (2 if distinct else 1) * window_ms
    length = max(2 * window_ms, MIN_CHUNK_MS)
    chunks = _able(time_chunks(_ticks(rows, distinct), length, lookback), n)
    place, order = ["key", "chunk"], ["ts_ms", "item"] if distinct else ["ts_ms"]

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for key, number, part in _runs(batches):
                chunk = _chunk_of(number, part, n, window_ms, length, distinct)
                if chunk.can_fire():
                    entries = chunk.entries()
                    yield key, number, entries, [chunk.fire(e)[1] for e in entries]
        return _frames(rows(), ["key", "chunk", "entries", "exits"])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state = None, NONE
        for pdf in batches:
            taken = []
            for key, number, entries, exits in pdf.itertuples(index=False):
                entry = state if before == (key, number - 1) else NONE
                taken.append(entry)
                state, before = dict(zip(entries, exits))[entry], (key, number)
            yield pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "entry": taken})

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for key, number, part in _runs(batches):
                chunk = _chunk_of(number, part, n, window_ms, length, distinct)
                yield from _firings(key, chunk, chunk.fire(part["entry"][0])[0], distinct, stored)
        return _frames(rows(), FIRING_COLUMNS)

    table = _in_key_order(chunks, place, order).mapInPandas(
        ways, "key string, chunk long, entries array<string>, exits array<string>")
    taken = _in_key_order(table, ["key"], ["chunk"]).mapInPandas(follow, "key string, chunk long, entry string")
    return _in_key_order(chunks.join(taken, place), place, order).mapInPandas(report, FIRING)


def bucket_fold(rows: DataFrame, n: int, bucket_seconds: int) -> DataFrame:
    """As ``reset_fold`` on distinct items, but the window is a fixed bucket, so buckets are independent."""
    length = bucket_seconds * 1000
    if n < 2:
        return reset_fold(rows, n, bucket_seconds, distinct=True)
    chunks = _able(_ticks(rows, True).withColumns({
        "chunk": F.floor(F.col("ts_ms") / F.lit(length)), "own": F.lit(True)}), n)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for key, number, part in _runs(batches):
                chunk = _chunk_of(number, part, n, 0, length, True)
                yield from _firings(key, chunk, chunk.fire(NONE)[0], True)
        return _frames(rows(), FIRING_COLUMNS)

    return _in_key_order(chunks, ["key", "chunk"], ["ts_ms", "item"]).mapInPandas(report, FIRING)


# Lifetimes that a chunk of a cover spans.
COVER_CHUNK = 8


class _Cover:
    """One chunk of one key: distinct times in order, each of which, once kept, ends what follows within its life."""

    def __init__(self, ts: np.ndarray, life: int):
        self.ts, self.life = ts, life
        # A chunk spans few lives, so that few jumps lead from any time to the last kept one.
        self.following = np.searchsorted(ts, ts + life, side="left")

    def exits(self) -> np.ndarray:
        """For each time the moment at which the last kept one from there on has ended."""
        last = np.arange(len(self.ts))
        while (more := self.following[last] < len(self.ts)).any():
            last[more] = self.following[last[more]]
        return self.ts[last] + self.life

    def kept(self, first: int) -> Iterator[int]:
        at = int(np.searchsorted(self.ts, first, side="left"))
        while at < len(self.ts):
            yield int(self.ts[at])
            at = int(self.following[at])


def greedy_cover(rows: DataFrame) -> DataFrame:
    """(key, ts_ms) of ``rows`` (key, ts_ms, life_ms) that are kept: a key's first time, and each next one that a kept one's life does not reach.

    The life, 1 ms or more, depends on the key. Time is cut into chunks of ``COVER_CHUNK`` lives. All that a chunk needs to know of the past is
    when the last kept time ends, and that is within its first life, so it tells for each of its times there what it would leave behind. One pass per
    key over these short lists finds what really happened, and the chunks report. No key's history is one task.
    """
    chunk = F.floor(F.col("ts_ms") / (COVER_CHUNK * F.col("life_ms")))
    chunks = rows.groupBy("key", "ts_ms").agg(F.min("life_ms").alias("life_ms")).withColumn("chunk", chunk)
    place = ["key", "chunk"]

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found():
            for key, number, part in _runs(batches):
                life, ts = int(part["life_ms"][0]), part["ts_ms"].astype(np.int64)
                # The times of the chunk's first life, and the next one.
                able = int(np.searchsorted(ts, (number * COVER_CHUNK + 1) * life, side="left")) + 1
                yield key, number, ts[:able], _Cover(ts, life).exits()[:able]
        return _frames(found(), ["key", "chunk", "times", "exits"], 20)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free = None, None
        for pdf in batches:
            taken = []
            for key, _, times, exits in pdf.itertuples(index=False):
                if key != current:
                    current, free = key, None
                at = 0 if free is None else int(np.searchsorted(times, free, side="left"))
                taken.append(int(times[at]) if at < len(times) else None)
                free = int(exits[at]) if at < len(times) else free
            yield pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "first": pd.array(taken, "Int64")})

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found():
            for key, _, part in _runs(batches):
                for t in _Cover(part["ts_ms"].astype(np.int64), int(part["life_ms"][0])).kept(int(part["first"][0])):
                    yield key, t
        return _frames(found(), ["key", "ts_ms"])

    table = _in_key_order(chunks, place, ["ts_ms"]).mapInPandas(ways, "key string, chunk long, times array<long>, exits array<long>")
    taken = _in_key_order(table, ["key"], ["chunk"]).mapInPandas(follow, "key string, chunk long, first long")
    return _in_key_order(chunks.join(taken.filter("first IS NOT NULL"), place), place, ["ts_ms"]).mapInPandas(report, "key string, ts_ms long")


def suppress(candidates: DataFrame) -> DataFrame:
    """Disposition of candidate alerts: (rule_no, id, disposition) of the emitted and throttled ones.

    Candidates have rule_no, group_key, dedup_key, ts_ms, id, dedup_ms and
    throttle_ms. In time order per rule and group: a live dedup key drops the
    candidate; otherwise the key is set, and a live throttle drops it with the
    key left set; otherwise it is emitted. Markers set at t end at t + ttl.
    Everything not returned is deduplicated.

    As the key is set either way, dedup does not depend on the throttle: it is a cover of each dedup key's times,
    and the throttle is a cover of the times of a group that are left. Of the candidates of a dedup key in a
    millisecond only the first can get past, so the rest leave before the shuffle.
    """
    group = ["rule_no", "group_key"]
    lone = F.when(F.col("dedup_ms") <= 0, F.col("id"))  # without a dedup time every candidate counts
    firsts = candidates.groupBy(*group, "dedup_key", "ts_ms", "dedup_ms", "throttle_ms", lone.alias("_lone")) \
        .agg(F.min("id").alias("id")).drop("_lone")
    firsts = settled(firsts)

    def covered(rows: DataFrame, keys: list[str], life: str) -> DataFrame:
        """``rows`` with ``kept``; a life of 0 or less keeps everything."""
        marked = rows.withColumn("key", F.to_json(F.struct(*keys)))
        kept = greedy_cover(marked.filter(F.col(life) > 0).select("key", "ts_ms", F.col(life).alias("life_ms"))).withColumn("_hit", F.lit(True))
        return marked.join(kept, ["key", "ts_ms"], "left").withColumn("kept", F.col("_hit").isNotNull() | (F.col(life) <= 0)).drop("key", "_hit")

    fresh = settled(covered(firsts, [*group, "dedup_key"], "dedup_ms").filter("kept").drop("kept"))
    through = covered(fresh, group, "throttle_ms")
    in_turn = F.row_number().over(Window.partitionBy(*group, "ts_ms").orderBy("id"))
    emitted = F.col("kept") & ((F.col("throttle_ms") <= 0) | (in_turn == 1))
    return through.select("rule_no", "id", F.when(emitted, "emitted").otherwise("throttled").alias("disposition"))
