"""Near-duplicate embeddings by collision counting over sorted projections."""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import components
from logweir.llm.scratch import written
from logweir.llm.words import mix, seeds, signed

THRESHOLD = 0.98
RECALL = 0.9995
LEAST_COLLISIONS = 3
# Cells and windows as multiples of the distance of two unit vectors at the threshold.
CELL, WINDOW = 4.0, 2.0

_CLASS = "vec_id long, class long, label string, unit array<double>"
_LISTED = "class long, list int, cell long, bin long, at double"
_PAIR = "a long, b long, cosine double"


def _same_cell(ratio: float) -> float:
    """Chance that a normal difference falls in one cell with random edges; ratio is cell width over deviation."""
    tail = 2 * 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def calibrate(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(cell coordinates per list, lists) for labels of up to ``count`` distinct vectors.

    Coordinates are as many as make a vector meet about one unrelated vector per list. Lists are
    as many as let a pair exactly at the threshold collide ``LEAST_COLLISIONS`` times with
    probability ``recall``; nearer pairs collide more often. Both follow from the count, so the
    work per vector grows slowly with it and nothing is capped.
    """
    near = math.sqrt(2 - 2 * threshold)
    far = _same_cell(CELL * near / math.sqrt(2))
    depth = max(1, math.ceil(math.log(max(count, 2)) / math.log(1 / far)) - 1)
    hit = _same_cell(CELL) ** depth * math.erf(WINDOW / math.sqrt(2))
    lists = LEAST_COLLISIONS
    while sum(math.comb(lists, k) * hit ** k * (1 - hit) ** (lists - k) for k in range(LEAST_COLLISIONS)) > 1 - recall:
        lists += 1
    return depth, lists


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as unit vectors, with a 64-bit class of label and values."""
    for batch in batches:
        ids, kinds, keys, units = [], [], [], []
        for vec_id, values, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if values is None or label is None or None in values:
                continue
            v = np.asarray(values, dtype=np.float64)
            top = np.max(np.abs(v), initial=0.0)
            if not np.isfinite(v).all() or top == 0:
                continue
            v = v / top
            unit = v / np.sqrt(np.dot(v, v))
            words = np.frombuffer((np.asarray(values, np.float64) + 0.0).tobytes(), np.uint64)
            named = np.frombuffer(label.encode().ljust(-(-len(label.encode()) // 8) * 8 or 8, b"\0"), np.uint64)
            all_words = np.concatenate([words, named, [np.uint64(len(words))]])
            key = mix(np.add.reduce(mix(all_words) * seeds(len(all_words)), keepdims=True))
            ids.append(vec_id), keys.append(int(signed(key)[0])), kinds.append(label), units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(kinds, pa.string()),
             pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "class", "label", "unit"])


def _listed(batches: Iterator[pa.RecordBatch], depth: int, lists: int, near: float) -> Iterator[pa.RecordBatch]:
    """Each vector's place in each list: its cell, and its place on the list's own projection."""
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        classes, labels, units = (batch.column(k).to_pylist() for k in range(3))
        rows = {}
        for k, unit in enumerate(units):
            rows.setdefault(len(unit), []).append(k)
        for size, own in rows.items():
            if size not in made:
                random = np.random.default_rng([7, size])
                made[size] = (random.standard_normal((size, lists * (depth + 1))), random.random((lists, depth)))
            lines, edges = made[size]
            at = (np.asarray([units[k] for k in own]) @ lines).reshape(len(own), lists, depth + 1)
            cells = np.floor(at[:, :, :depth] / (CELL * near) + edges).astype(np.int64).view(np.uint64)
            named = np.asarray([hash_label(labels[k]) for k in own], np.uint64)[:, None]
            key = mix(np.add.reduce(mix(cells + np.uint64(1)) * seeds(depth), axis=2) + named + np.uint64(size))
            last = at[:, :, depth]
            n = len(own) * lists
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([classes[k] for k in own], lists)), pa.array(np.tile(np.arange(lists, dtype=np.int32), len(own))),
                 pa.array(signed(key.reshape(n))), pa.array(np.floor(last / (WINDOW * near)).astype(np.int64).reshape(n)),
                 pa.array(last.reshape(n))], names=["class", "list", "cell", "bin", "at"])


def hash_label(label: str) -> int:
    raw = label.encode()
    named = np.frombuffer(raw.ljust(-(-len(raw) // 8) * 8 or 8, b"\0"), np.uint64)
    return int(np.add.reduce(mix(named) * seeds(len(named), 50)))


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        cosine = np.asarray([np.dot(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(left, right)], np.float64)
        keep = pa.array(cosine >= threshold, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)],
                                         names=["a", "b", "cosine"]).filter(keep)


def near_links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b, cosine) of distinct vectors (class, label, unit) with one label and a cosine at the threshold or above.

    Every list orders vectors by label, cell and projection; two collide in it when they share the
    cell and stand within a window of each other. Pairs that collide in enough lists are
    verified in double precision.
    """
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth, lists = calibrate(largest, threshold, recall)
    near = math.sqrt(2 - 2 * threshold)
    places = written(classes.select("class", "label", "unit").mapInArrow(
        partial(_listed, depth=depth, lists=lists, near=near), _LISTED), "places")
    lower = places.select("list", "cell", "bin", F.col("class").alias("x"), F.col("at").alias("x_at"))
    upper = places.select("list", "cell", F.explode(F.array("bin", F.col("bin") - 1)).alias("bin"),
                          F.col("bin").alias("own_bin"), F.col("class").alias("y"), F.col("at").alias("y_at"))
    met = (lower.join(upper, ["list", "cell", "bin"])
           .where((F.abs(F.col("x_at") - F.col("y_at")) <= WINDOW * near)
                  & ((F.col("bin") != F.col("own_bin")) | (F.col("x") < F.col("y")))))
    pairs = (met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
             .count().where(F.col("count") >= LEAST_COLLISIONS).select("a", "b"))
    one = classes.select(F.col("class").alias("a"), F.col("unit").alias("a_unit"))
    two = classes.select(F.col("class").alias("b"), F.col("unit").alias("b_unit"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "a_unit", "b_unit")
            .mapInArrow(partial(_verified, threshold=threshold), _PAIR))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared within one non-null label and one length. Equal vectors of a label are
    one class with a count and are compared once; their copies are linked with each other
    and with all that the class is linked with. Null, empty and zero vectors, null labels and
    null or non-finite components link with nothing: such a row is its own component. Rows
    that repeat a vec_id count as vectors of their own. A null vec_id stays null in
    component_id where no other is in its component. No rows give no rows; other columns
    of ``vectors`` do not matter.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("string").alias("label"))
    usable = rows.mapInArrow(_classes, _CLASS)
    classes = written(usable.groupBy("class", "label").agg(
        F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")), "classes")
    links = written(near_links(classes, threshold, recall).select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("class").alias("b"), "copies")
    degrees = both.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("others"))
    groups = components(links).withColumnRenamed("node", "class")
    known = classes.join(degrees, "class", "left").join(groups, "class", "left").select(
        "class", "copies", "first_id", F.coalesce("others", F.lit(0)).alias("others"),
        F.coalesce("component", "class").alias("component"))
    known = written(known, "known")
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "component").select(
        F.col("class"), (F.col("copies") - 1 + F.col("others")).alias("n_links"), "component_id")
    members = usable.select("vec_id", "class").join(known, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where(~_usable(F.col("embedding"), F.col("label"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _usable(values, label):
    """What ``_classes`` keeps, as a column."""
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(values, lambda x: x == 0)
    return F.coalesce(label.isNotNull() & values.isNotNull() & ~bad & ~zero, F.lit(False))


# The same by comparing all pairs in DuckDB.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""
