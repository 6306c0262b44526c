"""Benchmark passages in documents, by SimHash of item-sized windows; DataFrame functions only."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.scratch import written
from logweir.llm.words import SPARK_SEPARATORS

SHINGLE = 5
PERCENT = 75
# Two bags of shingles at 75 % differ in 11 of 64 bits on average, and in more than 20 with a chance of about 0.002.
RADIUS = 20
BITS = 64
# Benchmark shingles (24 bytes each) up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-case words; null texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPARK_SEPARATORS), "")


def _held(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _shingles(words: Column, size: Column) -> Column:
    """Hash of every run of ``size`` words, in order; none when there are fewer words."""
    count = F.size(words) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(
        F.array().cast("array<bigint>"))


def _occurrences(shingles: Column) -> Column:
    """A bag as a set: the k-th occurrence of a shingle is a member of its own, so weights are counts."""
    return _held(F.array_sort(shingles), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def _simhash(members: Column) -> Column:
    """64 bits; each is the majority of that bit over the members."""
    def bit(b: Column) -> Column:
        votes = F.aggregate(members, F.lit(0), lambda n, h: n + F.when(F.call_function("getbit", h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda n, b: n.bitwiseOR(bit(b)))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 blocks of the bits: fingerprints within the radius agree in one of them at least."""
    edges = [k * BITS // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"),
                              F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
                     for k, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def _items(benchmark: DataFrame, size: int, id_column: str) -> DataFrame:
    """Items with words: shingle size, words, members, fingerprint."""
    words = benchmark.select(F.col(id_column).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = words.select("item_id", F.size("words").alias("length"), F.least(F.size("words"), F.lit(size)).alias("size"),
                        _held(F.col("words"), lambda w: _shingles(w, F.least(F.size(w), F.lit(size)))).alias("shingles"))
    rows = rows.withColumn("members", _occurrences(F.col("shingles")))
    return written(rows.withColumn("fingerprint", _simhash(F.col("members"))), "items")


def _doc_shingles(size: int) -> Column:
    return _held(F.col("words"), lambda w: _shingles(w, F.lit(size)))


def _candidates(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_key, length, size, start): windows of documents that may be at the threshold.

    A window at the threshold has ``percent`` of the item's shingles, so documents that have fewer of
    them anywhere have no such window. Of the others, the windows are those at each place where a
    shingle of both lines them up, and, as passages with words changed or put in may be most similar
    elsewhere, those at every start between two such places at most two item lengths apart. No other window is
    more similar than all of these: on moving it towards the places it only loses shingles that are not shared.
    """
    places = items.select("item_id", "length", "size", F.size("members").alias("weight"), F.posexplode("shingles").alias("at", "shingle"))
    places = written(places, "places")
    sizes = [row[0] for row in places.select("size").distinct().collect()]
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    all_shingles = [_doc_shingles(k) for k in sizes] or [F.array().cast("array<bigint>")]
    rows = docs.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    seeds = [rows.select("doc_id", "text_key", F.size("words").alias("n"), F.posexplode(column).alias("pos", "shingle"))
             for column in all_shingles]
    seeds = reduce(DataFrame.unionByName, seeds).join(places, "shingle")
    start = F.greatest(F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("length")), F.lit(0)).alias("start")
    seeds = (seeds.select("doc_id", "text_key", "item_id", "length", "size", "weight", "shingle", "at", start)
             .groupBy("doc_id", "text_key", "item_id", "length", "size", "weight")
             .agg(F.size(F.collect_set("at")).alias("found"), F.collect_set("start").alias("starts"))
             .where(F.col("found") * 100 >= F.col("weight") * percent))
    return seeds.select("doc_id", "text_key", "length", "size", F.explode(_between(F.col("starts"), F.col("length"))).alias("start")).distinct()


def _between(starts: Column, length: Column) -> Column:
    """The starts, and all numbers between two that follow each other at most twice ``length`` apart."""
    def filled(s: Column) -> Column:
        return F.flatten(F.transform(s, lambda x, i: _held(
            F.coalesce(F.get(s, i + 1), x), lambda after: F.when((after > x) & (after - x <= 2 * length), F.sequence(x, after - 1)).otherwise(F.array(x)))))
    return _held(F.array_sort(starts), filled)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS,
                 item_column: str = "item_id") -> DataFrame:
    """(doc_id, text_key, item_id, start, length, similarity) of benchmark items that ``docs`` (doc_id, text) contain.

    A document contains an item when a window of as many words as the item has (the whole
    document, where that is shorter) shares at least ``percent`` of the weight of the united
    shingles: runs of ``size`` words in lower case, weighed by their counts; items with fewer
    words are one shingle. Windows are those that a shared shingle
    lines up with the item, and all between two of these that are at most two item lengths apart. One row per document and item: the most similar window, and of these the first. ``text_key`` is xxhash64 of the text; rows that repeat doc_id and text
    give one row. Windows are fingerprinted by SimHash; different fingerprints, not windows, are
    matched with the items of their length by Hamming blocks that miss none within
    ``radius``; matches are verified exactly. Null and blank documents and items contain
    and are contained in nothing. Null ids are kept as null. Empty tables give no rows; other
    columns do not matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    items = _items(benchmark, size, item_column)
    candidates = written(_candidates(rows, items, percent), "candidates")
    by_doc = candidates.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("length", "size", "start")).alias("windows"))
    texts = rows.join(by_doc.withColumnsRenamed({"doc_id": "own_id", "text_key": "own_key"}),
                      F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    cut = _held(words_of(F.col("text")), lambda w: F.transform("windows", lambda x: F.struct(
        x["length"].alias("length"), x["size"].alias("size"), x["start"].alias("start"),
        F.slice(w, x["start"] + 1, x["length"]).alias("words"))))
    windows = texts.select("doc_id", "text_key", F.explode(cut).alias("w")).select("doc_id", "text_key", "w.*")
    windows = windows.withColumn("members", _occurrences(_shingles(F.col("words"), F.col("size")))).drop("words")
    windows = written(windows.withColumn("fingerprint", _simhash(F.col("members"))), "fingerprints")
    prints = windows.select("length", "fingerprint").distinct().select(
        "length", "fingerprint", F.explode(_blocks(F.col("fingerprint"), radius)).alias("b"))
    index = items.select("length", "item_id", F.col("fingerprint").alias("item_print"), "members",
                         F.explode(_blocks(F.col("fingerprint"), radius)).alias("b"))
    met = (prints.select("length", "fingerprint", "b.block", "b.value")
           .join(index.select("length", "item_id", "item_print", "b.block", "b.value"), ["length", "block", "value"])
           .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
           .select("length", "fingerprint", "item_id").distinct())
    met = written(met, "met")
    bags = items.select(F.col("item_id").alias("own_item"), "length", F.col("members").alias("item_members"))
    pairs = (windows.join(met, ["length", "fingerprint"])
             .join(bags.withColumnRenamed("length", "own_length"),
                   F.col("item_id").eqNullSafe(F.col("own_item")) & (F.col("length") == F.col("own_length"))))
    common = F.size(F.array_intersect("members", "item_members"))
    scored = pairs.select("doc_id", "text_key", "item_id", "start", "length", common.alias("common"),
                          (F.size("members") + F.size("item_members") - common).alias("union"))
    scored = scored.where(F.col("common") * 100 >= F.col("union") * percent)
    best = F.max(F.struct((F.col("common") / F.col("union")).alias("similarity"), (-F.col("start")).alias("back"), "length")).alias("best")
    return scored.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        F.col("best.similarity").alias("similarity"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item of ``benchmark``, with their columns, whatever these are called."""
    bad = contaminated(docs, benchmark).select(F.struct("doc_id", "text_key").alias("bad")).distinct().alias("leaks")
    own = F.struct(F.col("docs.doc_id").cast("long").alias("doc_id"), F.xxhash64("docs.text").alias("text_key"))
    return docs.alias("docs").join(bad, own.eqNullSafe(F.col("leaks.bad")), "left_anti")
