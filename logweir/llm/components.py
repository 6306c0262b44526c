"""Connected components by distributed union-find over long node ids."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.scratch import written
from logweir.llm.words import mix, signed

# Links one call of the local union-find holds at a time.
LOCAL_LINKS = 200_000
_PAIR = "node long, top long"


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _each(change, batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([pa.array(signed(change(c))) for c in columns], names=names)


def _shuffled_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _each(mix, batches, ["node", "top"])


def _own_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _each(_unmix, batches, ["node", "top"])


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces links by spanning forests whose trees hang on their smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def forest() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "top"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > LOCAL_LINKS:
            yield forest()
            parent.clear()
    yield forest()


def _first_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both steps in one call: a second one in the same task would be a second Python worker."""
    yield from _local_forest(_shuffled_ids(batches))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (its first two columns, longs).

    The component is its smallest node. Ids are first mixed by a bijection, so that their order
    is random whatever the input, and chains shorten by a constant factor a round. Each round
    joins links within tasks and hangs a node on its smallest top; what is left are links
    between tops, which are the next, smaller round. Once these are at most ``LOCAL_LINKS``
    they are one task's work. A node with any number of links is never a group: nodes are
    reduced by minima and all else is joins that Spark can split. Nodes without links are not
    in the result; null ends and loops are no links.
    """
    a, b = links.columns[:2]
    todo = (links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("top"))
            .where("node <> top"))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        forest = written(todo.mapInArrow(_local_forest if rounds else _first_forest, _PAIR), "forest")
        least = written(forest.groupBy("node").agg(F.min("top").alias("least")), "least")
        rounds.append((forest, least))
        between = (forest.join(least, "node").where("top <> least")
                   .select(F.col("top").alias("node"), F.col("least").alias("top")))
        tops = forest.select(F.col("top").alias("node")).distinct()
        hanging = least.join(tops, "node", "left_semi").select("node", F.col("least").alias("top"))
        todo = written(between.unionByName(hanging).distinct(), "between")
        left = todo.count()
        if left == 0:
            break
        if left <= LOCAL_LINKS:
            todo = todo.coalesce(1)
    known = None
    for forest, least in reversed(rounds):
        tops = forest.select(F.col("top").alias("node")).distinct().join(least, "node", "left_anti")
        flat = least.unionByName(tops.withColumn("least", F.col("node")))
        if known is None:
            known = flat.select("node", F.col("least").alias("component"))
        else:
            up = known.select(F.col("node").alias("least"), F.col("component").alias("above"))
            known = flat.join(up, "least", "left").select("node", F.coalesce("above", "least").alias("component"))
    found = written(known.mapInArrow(_own_ids, _PAIR), "found")
    smallest = found.groupBy("top").agg(F.min("node").alias("component"))
    return found.join(smallest, "top").select("node", "component")
