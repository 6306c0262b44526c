"""Exact Jaccard similarity join of word n-gram sets in metric space."""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import components
from logweir.llm.idset import id_set, in_set
from logweir.llm.parity import SLACK, near_pairs, parities, parity, short_parities, short_within
from logweir.llm.postings import shared_postings
from logweir.llm.scratch import written
from logweir.llm.words import mix, seeds, shingles, signed, small_batches, texts_as_words

SHINGLE = 5
PERCENT = 75
# Minima by which a document looks for pivots.
KEYS = 16
# A shingle in the prefixes of this many documents, or more, is ordered last.
FREQUENT = 8
# How many shingles are ordered last at most; the most frequent ones are.
FREQUENT_MOST = 2_000_000
# Where a shingle has as many postings, pairs are told apart by short parities as they meet.
MANY = 16

_SKETCH = "doc_id long, class long, n long, keys array<long>, parity array<long>"
_POSTING = "shingle long, class long, at int, leads boolean"
_SET = "class long, members array<long>"
_MEASURED = "a long, b long, distance double, linked boolean"


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for words in texts_as_words(column, lower=True):
        yield np.unique(shingles(words, size))


def _class(members: np.ndarray) -> int:
    """A number for the set: equal sets have equal classes."""
    total = np.add.reduce(mix(members + np.uint64(11)), keepdims=True)
    return int(signed(mix(total + np.uint64(len(members))))[0])


def _sketches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    turn = seeds(KEYS, 300)
    for batch in small_batches(batches):
        classes, counts, keys, parities = [], [], [], []
        for members in _sets(batch.column(1), size):
            counts.append(len(members))
            if len(members) == 0:
                classes.append(None), keys.append(None), parities.append(None)
                continue
            classes.append(_class(members))
            least = np.array([np.min(members * t) for t in turn], np.uint64)
            keys.append(signed(mix(least + turn)))
            parities.append(signed(parity(members)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(classes, pa.int64()), pa.array(counts, pa.int64()),
             pa.array(keys, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
            names=["doc_id", "class", "n", "keys", "parity"])


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int,
              frequent: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set in one order for all: two linked sets share one of them.

    Sets that share at least percent of their union share percent of the larger one, so of n
    shingles in order, the first n - ceil(n * percent / 100) + 1 cannot all be missing. Two sets of n and
    more shingles share n * 2 * percent / (100 + percent) at least, so that the first they share is
    nearer to the front of the smaller one: its leading shingles are those up to there.
    A class is told once per task.
    """
    bits = frequent.value if frequent is not None else None
    told: set[int] = set()
    for batch in small_batches(batches):
        shingle_parts, class_parts, at_parts, lead_parts = [], [], [], []
        for members in _sets(batch.column(0), size):
            if len(members) == 0 or (own := _class(members)) in told:
                continue
            told.add(own)
            if bits is not None:
                often = in_set(bits, members)
                members = np.concatenate([members[~often], members[often]])
            n = len(members)
            head = members[: n - -(-n * percent // 100) + 1]
            shingle_parts.append(head), class_parts.append(np.full(len(head), own))
            at_parts.append(np.arange(len(head), dtype=np.int32))
            lead_parts.append(at_parts[-1] <= n - -(-2 * n * percent // (100 + percent)))
        if shingle_parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(shingle_parts))), pa.array(np.concatenate(class_parts)),
                 pa.array(np.concatenate(at_parts)), pa.array(np.concatenate(lead_parts))], names=["shingle", "class", "at", "leads"])


def _class_sets(batches: Iterator[pa.RecordBatch], size: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """Classes and sets of documents with wanted ids (and of all without an id); a class once per task."""
    told: set[int] = set()
    for batch in small_batches(batches):
        ids = batch.column(0)
        keep = in_set(wanted.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
        classes, sets = [], []
        for members in _sets(batch.column(1).filter(pa.array(keep)), size):
            if len(members) and (own := _class(members)) not in told:
                told.add(own)
                classes.append(own), sets.append(signed(members))
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                         names=["class", "members"])


def _distances(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        distance, linked = [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            both = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            union = len(both) - common
            distance.append(1 - common / union), linked.append(100 * common >= percent * union)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance, pa.float64()),
                                          pa.array(linked, pa.bool_())], names=["a", "b", "distance", "linked"])


def _met_often(met: DataFrame, *keep: str) -> DataFrame:
    """Pairs (a, b) with the number of shingles they meet in, and the last place of these in each."""
    return met.groupBy("a", "b", *keep).agg(F.count("*").alias("common"), F.max("a_at").alias("a_last"), F.max("b_at").alias("b_last"))


def _parted(postings: DataFrame) -> DataFrame:
    """Postings of shingles that classes of different components have; what is connected already needs no more links."""
    several = (postings.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("count"))
               .where("low <> high").select("shingle", (F.col("count") >= MANY).alias("many")))
    return postings.join(several, "shingle")


def _side(rows: DataFrame, side: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in keys])


class _Join:
    """The documents of one join, their classes, and how pairs of classes are measured."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.reach = 1 - percent / 100
        self.sketch = written(docs.mapInArrow(partial(_sketches, size=size), _SKETCH), "sketch")
        self.classes = written(self.sketch.where("class IS NOT NULL").groupBy("class").agg(
            F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity")), "classes")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, reach) of classes those that can be within reach by their parities."""
        pairs = written(pairs.select("a", "b", "reach"), "met")
        needed = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "met-classes")
        return near_pairs(written(parities(self.classes, id_set(needed)), "parities"), pairs)

    def measure(self, pairs: DataFrame) -> DataFrame:
        """(a, b, distance, linked) of pairs (a, b, reach) of classes that can be within reach, from their whole sets."""
        pairs = written(self.possible(pairs), "pairs")
        needed = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
                         .join(self.classes.select("class", "first_id"), "class"), "needed")
        found = self.docs.mapInArrow(partial(_class_sets, size=self.size, wanted=id_set(needed.select("first_id"))), _SET)
        sets = written(found.join(needed.select("class"), "class", "left_semi"), "sets")
        one = sets.select(F.col("class").alias("a"), F.col("members").alias("a_members"))
        two = sets.select(F.col("class").alias("b"), F.col("members").alias("b_members"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_members", "b_members")
        return written(both.mapInArrow(partial(_distances, percent=self.percent), _MEASURED), "measured")

    def pivot_distances(self) -> DataFrame:
        """Measured pairs of a class (a) and a pivot candidate (b) that shares a minimum with it.

        The candidate of a minimum is the class whose minima are shared most: it lies in the middle
        of the others. Candidates follow one order, so no two are each other's.
        """
        keyed = self._keyed()
        score = keyed.groupBy("class").agg(F.sum("often").alias("score"))
        best = (keyed.join(score, "class").groupBy("key")
                .agg(F.max(F.struct("score", "class", "n")).alias("best")))
        return self.measure(self._pairs(keyed, best))

    def _keyed(self) -> DataFrame:
        """(key, class, n, often): the minima that several classes have."""
        keyed = self.classes.select("class", "n", F.explode("keys").alias("key"))
        often = keyed.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
        return written(keyed.join(often, "key"), "keyed")

    def _pairs(self, keyed: DataFrame, best: DataFrame) -> DataFrame:
        """(a, b): each class with the one chosen for each of its keys, where their sizes allow a link."""
        best = best.select("key", F.col("best.class").alias("b"), F.col("best.n").alias("b_n"))
        near = (F.least("n", "b_n") * 100 >= F.greatest("n", "b_n") * self.percent)
        return (keyed.join(best, "key").where((F.col("class") != F.col("b")) & near)
                .select(F.col("class").alias("a"), "b", F.lit(self.reach).alias("reach")).distinct())

    def regions(self, measured: DataFrame) -> DataFrame:
        """(class, n, region, radius): the nearest pivot within reach, else the class itself.

        Pivots are candidates that are not within reach of a candidate before them.
        """
        linked = measured.where("linked")
        pivots = linked.select("b").distinct().join(linked.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        home = (linked.join(pivots, "b", "left_semi").groupBy(F.col("a").alias("class"))
                .agg(F.min(F.struct("distance", "b")).alias("home")))
        return written(self.classes.select("class", "n").join(home, "class", "left").select(
            "class", "n", F.coalesce("home.b", "class").alias("region"),
            F.coalesce("home.distance", F.lit(0.0)).alias("radius")), "regions")

    def postings(self) -> DataFrame:
        """(shingle, class, at, leads) of prefix shingles that several classes have; at is the place in the class's order."""
        texts = self.docs.select("text")
        counts = (texts.mapInArrow(partial(_prefixes, size=self.size, percent=self.percent, frequent=None), _POSTING)
                  .groupBy("shingle").count().where(F.col("count") >= FREQUENT))
        frequent = self._frequent(written(counts, "frequent"))
        rows = texts.mapInArrow(partial(_prefixes, size=self.size, percent=self.percent, frequent=frequent), _POSTING)
        return written(shared_postings(rows), "prefixes")

    def _frequent(self, counts: DataFrame) -> Broadcast:
        """The most frequent shingles as a bit set of fixed size, ``FREQUENT_MOST`` at most.

        The set only decides which order prefixes follow; any order gives the same links.
        """
        steps = (counts.groupBy(F.floor(F.log2("count")).cast("int").alias("step")).count()
                 .orderBy(F.col("step").desc()).collect())
        least, total = 63, 0
        for step, n in steps:
            if total + n > FREQUENT_MOST:
                break
            least, total = step, total + n
        return id_set(written(counts.where(F.col("count") >= F.lit(float(1 << least))).select("shingle"), "frequent-ids"))

    def _joined(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """``rows`` with the component of their class, by the links found so far."""
        joined = components(found).withColumnRenamed("node", "class")
        return rows.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))

    def _room(self, a_n: str, b_n: str) -> Column:
        """Whether two sets can be linked, by the prefix shingles they share and what follows the last of them in each.

        Both prefixes follow one order, so what comes before the last shared shingle is known to be all that is shared there.
        """
        after = F.least(F.col(a_n) - F.col("a_last"), F.col(b_n) - F.col("b_last")) - 1
        return (F.col("common") + after) * (100 + self.percent) >= (F.col(a_n) + F.col(b_n)) * self.percent

    def _place(self, a: str, b: str) -> Column:
        """Whether two sets can be linked that share a shingle at these places: of what comes before and after it they share the shorter at most."""
        before = F.least(f"{a}_at", f"{b}_at")
        after = F.least(F.col(f"{a}_n") - F.col(f"{a}_at"), F.col(f"{b}_n") - F.col(f"{b}_at")) - 1
        return (before + 1 + after) * (100 + self.percent) >= (F.col(f"{a}_n") + F.col(f"{b}_n")) * self.percent

    def links(self) -> DataFrame:
        """(a, b): links that join all classes which are connected.

        1. Classes are dealt to the Voronoi regions of their pivots; a class within reach of a pivot
           is linked with it, so a region is connected.
        2. Regions that share prefix shingles (of single documents: enough of them) are measured by their
           pivots. They are linked, or out of reach of each other by the triangle inequality, or open.
           Regions that links join already are not compared; only what they connect matters.
        3. Open pairs of regions are taken apart: only members in the boundary window of the
           other region, and of them only pairs whose distances to their pivots leave room for a
           link, are measured.
        """
        measured = self.pivot_distances()
        regions = self.regions(measured)
        found = measured.where("linked").select("a", "b")
        regions = self._joined(regions, found)
        # Tasks tell a class each on its own.
        shared = written(_parted(self.postings().join(regions, "class")).distinct(), "postings")
        extent = regions.groupBy("region").agg(F.max("radius").alias("radius"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("classes"))
        extent = written(extent, "extent")
        # Of two sets that can be linked, the smaller leads with a shingle they share; what else they share comes after it in both.
        heads = shared.groupBy("shingle", "many", "region", "component").agg(
            F.max("at").alias("at"), F.min("n").alias("low"), F.max("n").alias("n"), F.min(F.when(F.col("leads"), F.col("n"))).alias("lead_n"),
            (F.max("radius") == 0).alias("single"))
        outlines = (extent.select("region", F.col("radius").alias("around")).join(self._short(heads).withColumnRenamed("class", "region"), "region"))

        def met(rows: DataFrame) -> DataFrame:
            both = _side(rows, "a", "shingle").join(_side(rows, "b", "shingle"), "shingle")
            return both.where("a_region < b_region AND a_component <> b_component").where(
                "a_lead_n <= b_n OR b_lead_n <= a_n").where(
                f"a_low * {self.percent} <= b_n * 100 AND b_low * {self.percent} <= a_n * 100").where(
                ~(F.col("a_single") & F.col("b_single")) | self._place("a", "b"))

        rare, many = met(heads.where("NOT many")), met(heads.where("many").join(outlines, "region"))
        many = many.where(short_within("a", "b", F.col("a_around") + F.col("b_around") + self.reach))
        ends = [F.col("a_region").alias("a"), F.col("b_region").alias("b"), "a_at", "b_at"]
        one, two = (extent.select(F.col("region").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("radius", "low", "high", "classes")])
                    for x in "ab")
        pairs = _met_often(rare.select(*ends).unionByName(many.select(*ends))).join(one, "a").join(two, "b").where(
            f"a_low * {self.percent} <= b_high * 100 AND b_low * {self.percent} <= a_high * 100")
        pairs = pairs.where((F.col("a_radius") + F.col("b_radius") > 0) | self._room("a_low", "b_low"))
        between = self.measure(pairs.withColumn("reach", F.col("a_radius") + F.col("b_radius") + self.reach))
        found = found.unionByName(between.where("linked").select("a", "b"))
        open_pairs = between.where("NOT linked").join(one, "a").join(two, "b").where(
            F.col("distance") <= F.col("a_radius") + F.col("b_radius") + self.reach + SLACK).where("a_radius + b_radius > 0")
        # The region of fewer classes asks the other one.
        asks, other = (F.when(F.col("a_classes") <= F.col("b_classes"), F.struct(x, f"{x}_radius")).otherwise(F.struct(F.col(y).alias(x), F.col(f"{y}_radius").alias(f"{x}_radius")))
                       for x, y in ("ab", "ba"))
        open_pairs = written(open_pairs.select("distance", asks.alias("one"), other.alias("two")).select(
            F.col("one.a").alias("x_region"), F.col("two.b").alias("y_region"), "distance", F.col("two.b_radius").alias("around")), "open")
        if open_pairs.limit(1).count() == 0:
            return found
        members = written(_parted(self._joined(shared.drop("component", "many"), found)), "members")
        room = F.col("distance") - self.reach - SLACK
        short = self._short(members)

        def inside(rows: DataFrame) -> DataFrame:
            x = _side(rows, "x", "shingle").join(open_pairs, "x_region").where(F.col("x_radius") + F.col("around") >= room)
            near = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * self.percent
            leads = F.when(F.struct("x_n", "x_class") < F.struct("y_n", "y_class"), F.col("x_leads")).otherwise(F.col("y_leads"))
            return (x.join(_side(rows, "y", "shingle"), ["shingle", "y_region"]).where(leads & self._place("x", "y"))
                    .where((F.col("x_radius") + F.col("y_radius") >= room) & (F.col("x_component") != F.col("y_component")) & near))

        rare, many = inside(members.where("NOT many")), inside(members.where("many").join(short, "class"))
        many = many.where(short_within("x", "y", F.lit(self.reach)))
        ends = [F.col("x_class").alias("a"), F.col("y_class").alias("b"), F.col("x_at").alias("a_at"), F.col("y_at").alias("b_at"),
                F.col("x_n").alias("a_n"), F.col("y_n").alias("b_n")]
        inner = _met_often(rare.select(*ends).unionByName(many.select(*ends)), "a_n", "b_n").where(self._room("a_n", "b_n"))
        return found.unionByName(self.measure(inner.withColumn("reach", F.lit(self.reach))).where("linked").select("a", "b"))

    def _short(self, rows: DataFrame) -> DataFrame:
        """Short parities of the classes that have postings among ``rows`` where many others have one, or of the regions' pivots."""
        own = "class" if "class" in rows.columns else "region"
        wanted = written(rows.where("many").select(F.col(own).alias("class")).distinct(), "short")
        return written(short_parities(self.classes, id_set(wanted)), "short-parities").join(wanted, "class", "left_semi")


def ngram_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, class, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A document's set are its distinct runs of ``size`` words (A to Z read as lower case); with
    fewer words, the whole sequence as one. Two documents link when their sets share at least
    ``percent`` of their union; component_id is the smallest doc_id that links reach. All
    links between different sets are honoured. Equal sets are one class. Documents without
    words, or with null text, have no class and are their own component. Rows that repeat a
    doc_id are each joined by their own text. Null doc_ids take part and are never the
    smallest; where all are null, so is component_id. Shingles are compared as 64-bit hashes.
    No rows give no rows; other columns do not matter.
    """
    join = _Join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), size, percent)
    found = components(join.links()).withColumnRenamed("node", "class")
    known = written(join.classes.select("class", "first_id").join(found, "class", "left")
                    .withColumn("component", F.coalesce("component", "class")), "known")
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = known.join(least, "component").select("class", "component_id")
    return join.sketch.join(named, "class", "left").select(
        "doc_id", "class", F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def joined_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) with the default parameters."""
    return ngram_components(docs).drop("class")


# The same in DuckDB, from all pairs that share a shingle.
JOINED_DOCUMENTS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 75 * (na.n + nb.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
