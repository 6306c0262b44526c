"""Parities of sets of 64-bit hashes: how far two sets are apart at least, told without the sets.

A parity has a bit for each bucket of hashes, set where an odd number of the set's members are in it. A bucket whose
bits differ holds a member that only one of two sets has, so their differing bits count no more than their differing members.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.idset import in_set

# Words of 64 bits: of a short parity, which every parity can be folded to, and of the longest.
SHORT, LONG = 8, 32
SLACK = 1e-9


def parity(members: np.ndarray, least: int = SHORT) -> np.ndarray:
    """The parity of a set, of about two bits for each member, of ``least`` to ``LONG`` words."""
    words = least
    while words < LONG and words * 32 < len(members):
        words *= 2
    odd = np.bincount((members & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, count: int) -> np.ndarray:
    while len(words) > count:
        words = words[: len(words) // 2] ^ words[len(words) // 2:]
    return words


def differing(x: np.ndarray, y: np.ndarray) -> int:
    count = min(len(x), len(y))
    return int(np.bitwise_count((folded(x, count) ^ folded(y, count)).view(np.uint64)).sum())


def _wanted(batches: Iterator[pa.RecordBatch], wanted: Broadcast, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array(in_set(wanted.value, batch.column(0).to_numpy())))
        short = [folded(x.values.to_numpy(), words) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short, pa.list_(pa.int64()))], names=batch.schema.names)


def parities(rows: DataFrame, wanted: Broadcast, words: int = LONG) -> DataFrame:
    """``rows`` (class, n, parity) of wanted classes, and of some others, folded to ``words`` words where longer."""
    rows = rows.select("class", "n", "parity")
    return rows.mapInArrow(lambda batches: _wanted(batches, wanted, words), rows.schema)


def short_parities(rows: DataFrame, wanted: Broadcast) -> DataFrame:
    """(class, size, parity_0, parity_1, ...): as ``parities``, with each word of a short parity in a column."""
    words = [F.col("parity")[k].alias(f"parity_{k}") for k in range(SHORT)]
    return parities(rows, wanted, SHORT).select("class", F.col("n").alias("size"), *words)


def short_within(a: str, b: str, reach: Column) -> Column:
    """Whether two sets can be within a Jaccard distance by their short parities ``{a}_parity_*`` and sizes ``{a}_size``."""
    apart = reduce(add, (F.bit_count(F.col(f"{a}_parity_{k}").bitwiseXOR(F.col(f"{b}_parity_{k}"))) for k in range(SHORT)))
    return apart * (2 - reach - SLACK) <= (reach + SLACK) * (F.col(f"{a}_size") + F.col(f"{b}_size"))


def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, reach, n and parity of a, n and parity of b) whose sets can be within reach."""
    for batch in batches:
        sizes = batch.column(3).to_numpy() + batch.column(5).to_numpy()
        apart = np.array([differing(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column(4), batch.column(6))], np.int64)
        keep = 2 * apart <= (batch.column(2).to_numpy() + SLACK) * (sizes + apart)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def near_pairs(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): of ``pairs`` (a, b, reach) those that can be within reach by their parities, of which ``own`` (class, n, parity) has all."""
    one, two = (own.select(F.col("class").alias(x), F.col("n").alias(f"{x}_n"), F.col("parity").alias(f"{x}_parity")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "reach", "a_n", "a_parity", "b_n", "b_parity")
    return both.mapInArrow(within_reach, "a long, b long")
