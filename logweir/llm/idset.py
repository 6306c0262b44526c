"""A broadcast set of ids of bounded size, for skipping rows before they are dealt out."""
from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 8 MB. With more ids than a sixteenth of the bits the set lets more through.
MOST_BITS = 1 << 26
_LEAST_BITS = 1 << 16


def id_set(ids: DataFrame) -> Broadcast:
    """Bits of the ids in the one long column of ``ids``; nulls are left out.

    An id in ``ids`` is always found; others are found now and then, the more so the more ids
    there are. Whoever asks must be right with that: it is a filter before an exact join.
    """
    column = ids.columns[0]
    bits = _LEAST_BITS
    count = ids.count()
    while bits < MOST_BITS and bits < 16 * count:
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = (ids.where(F.col(column).isNotNull()).groupBy(F.shiftright(place, 6).alias("word"))
            .agg(F.bit_or(bit).alias("bits")).toPandas())
    found = np.zeros(bits // 64, np.uint64)
    found[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(found)


def in_set(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids.view(np.uint64) & np.uint64(len(found) * 64 - 1)
    return (found[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
