"""Postings (key, item) reduced to keys that several items have."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def several_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in order of their key, those whose key several items have."""
    held, last, is_open = None, None, False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None and not is_open and batch.column(0)[0].as_py() == last:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, item = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        several = np.minimum.reduceat(item, at) != np.maximum.reduceat(item, at)
        if is_open and key[0] == last:
            several[0] = True
        held, last, is_open = batch.slice(batch.num_rows - 1), int(key[-1]), bool(several[-1])
        yield batch.filter(pa.array(several[np.cumsum(new) - 1]))


def shared_postings(postings: DataFrame) -> DataFrame:
    """Rows of ``postings`` (key and item, longs, and others) whose key has at least two different items.

    Keys are dealt and sorted once and then streamed; a key with any number of items is never held.
    """
    key = postings.columns[0]
    return postings.repartition(key).sortWithinPartitions(key).mapInArrow(several_items, postings.schema)
