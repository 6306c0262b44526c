"""How the sources of a language differ in their words: exact sparse count vectors, group sums, and pairs evaluated sparsely."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.scratch import new_path, written

LEAST_DOCUMENTS = 10
MOST_TERMS = (1 << 31) - 1
TOP_TERMS = 10
SCALE = 1_000_000_000
# Kept terms of a language, and languages, up to which vectors and their vocabulary are used; beyond, terms are joined as rows.
VOCABULARY_LIMIT, LANGUAGE_LIMIT = 4_000_000, 200
# Cells of the group sums that a task holds before it passes them on, and least entries of a block of terms.
_CELLS, _ENTRIES = 1 << 23, 200_000
# Terms that a task counts before it passes them on.
_TASK_TERMS = 200_000


# Bytes of UTF-8: letters beyond ASCII stay, A-Z become lower case, all else becomes a space.
_CLEAN = bytes(k if k >= 128 or 97 <= k <= 122 else k + 32 if 65 <= k <= 90 else 32 for k in range(256))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as lower-case terms parted by spaces; the bytes of a whole batch change at once."""
    for batch in batches:
        text = batch.column("text").fill_null("")
        valid, offsets, data = text.buffers()
        clean = pa.py_buffer((data or pa.py_buffer(b"")).to_pybytes().translate(_CLEAN))
        text = pa.Array.from_buffers(text.type, len(text), [valid, offsets, clean], offset=text.offset)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), text], names=["lang", "source", "text"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents): how many of a task's cleaned texts have a term, passed on when there are many terms."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())],
                names=["lang", "term", "documents"])
        counts.clear()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if lang not in counts:
                counts[lang] = Counter()
            counts[lang].update(set((text or b"").split()))
        if sum(map(len, counts.values())) > _TASK_TERMS:
            yield from flush()
    yield from flush()


def _terms() -> Column:
    return F.array_remove(F.split("text", " "), "").alias("terms")


def _group_sums(batches: Iterator[pa.RecordBatch], size: int, cells: int) -> Iterator[pa.RecordBatch]:
    """(source, place, count) sums of sparse vectors with ``size`` places, as far as a task has them."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for source, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
                                             names=["source", "place", "count"])
        sums.clear()
    for batch in batches:
        vectors = batch.column("counts")
        indices, values = vectors.field("indices"), vectors.field("values")
        at, starts = indices.offsets.to_numpy(), values.offsets.to_numpy()
        places, counts = indices.values.to_numpy(), values.values.to_numpy().astype(np.int64)
        for k, source in enumerate(batch.column("source").to_pylist()):
            if source not in sums:
                if (len(sums) + 1) * size > cells:
                    yield from flush()
                sums[source] = np.zeros(size, np.int64)
            # The places of one vector differ, so that no count is lost.
            sums[source][places[at[k]: at[k + 1]]] += counts[starts[k]: starts[k] + at[k + 1] - at[k]]
    yield from flush()


def _named(batches: Iterator[pa.RecordBatch], vocabulary: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("source"), vocabulary.value.take(batch.column("place")), batch.column("count")],
                                         names=["source", "term", "count"])


def _vector_counts(rows: DataFrame, lang: str, kept: DataFrame) -> DataFrame:
    """(lang, source, term, count) of one language, by count vectors of its documents over its terms in ``kept``."""
    own = rows.where(F.col("lang_key") == F.md5(F.lit(lang))).select("source", _terms())
    terms = kept.where(F.col("lang") == lang).select(F.array("term").alias("terms"))
    model = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=MOST_TERMS).fit(terms)
    spark = rows.sparkSession
    vocabulary = spark.sparkContext.broadcast(pa.array(model.vocabulary, pa.string()))
    sums = (model.transform(own).select("source", "counts")
            .mapInArrow(partial(_group_sums, size=len(model.vocabulary), cells=_CELLS), "source string, place int, count long")
            .groupBy("source", "place").agg(F.sum("count").alias("count")))
    named = sums.mapInArrow(partial(_named, vocabulary=vocabulary), "source string, term string, count long")
    return named.select(F.lit(lang).alias("lang"), "source", "term", "count")


def _row_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, count) of all languages with terms as rows, for vocabularies of any size."""
    marked = F.transform(F.col("sorted"), lambda x, i: F.struct(x.alias("term"), (~F.get(F.col("sorted"), i - 1).eqNullSafe(x)).cast("long").alias("first")))
    each = rows.select("lang", "source", F.array_sort(_terms()).alias("sorted")).select("lang", "source", F.explode(marked).alias("t"))
    sums = each.groupBy("lang", "source", "t.term").agg(F.count("*").alias("count"), F.sum("t.first").alias("documents"))
    found = sums.withColumn("documents", F.sum("documents").over(Window.partitionBy("lang", "term")))
    return found.where(F.col("documents") >= least).select("lang", "source", "term", "count")


def source_term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS, vocabulary_limit: int = VOCABULARY_LIMIT) -> DataFrame:
    """(lang, source, term, count): occurrences in each source of the terms that ``least`` documents of the language have.

    How many documents have a term is counted first, for all languages at once. Where each language keeps at most ``vocabulary_limit`` terms, they get a
    CountVectorizer each, whose vocabulary the driver holds; its vectors are summed by source exactly. Otherwise terms stay rows. Both give the same counts.
    lang and source must not be null.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "texts")
    # A folder for each language, so that its counting reads no other.
    kept = "lang string, source string, text string"
    (docs.select("lang", "source", "text").mapInArrow(_cleaned, kept).withColumn("lang_key", F.md5("lang"))
     .write.partitionBy("lang_key").parquet(path))
    rows = spark.read.schema(f"{kept}, lang_key string").parquet(path)
    langs = [row["lang"] for row in rows.select("lang").distinct().limit(LANGUAGE_LIMIT + 1).collect()]
    if len(langs) > LANGUAGE_LIMIT:
        return written(_row_counts(rows, least), "counts")
    found = rows.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, documents long")
    terms = found.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least)
    kept = written(terms.select("lang", "term"), "terms")
    sizes = kept.groupBy("lang").count().collect()
    if any(row["count"] > vocabulary_limit for row in sizes):
        return written(_row_counts(rows, least), "counts")
    parts = [written(_vector_counts(rows, row["lang"], kept), "counts") for row in sorted(sizes, key=lambda row: row["lang"])]
    out = spark.createDataFrame([], "lang string, source string, term string, count long")
    for part in parts:
        out = out.unionByName(part)
    return out


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(18,0)") * (count + 2).cast("decimal(18,0)"), (total + 2 * terms).cast("decimal(20,0)"))


def divergence(p, q):
    """floor((p - q)^2 / (p + q)), of columns or of arrays of whole numbers."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, p + q) if isinstance(square, Column) else square // (p + q)


def _shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``_share`` of whole numbers; of any size, as Python's are."""
    if len(counts) and int(counts.max()) + 2 > (1 << 62) // SCALE:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 2) // (total + 2 * terms)).astype(np.int64)


def _block(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of a block of terms with all their sources: for each two sources the sums over the terms that both have (pair), and
    for each source its ``top`` terms beyond the language's share (term)."""
    place, names = pd.factorize(rows["source"], sort=True)
    order = np.argsort(place, kind="stable")
    place = place[order]
    term, terms = pd.factorize(rows["term"])
    count = np.zeros(len(terms), np.int64)
    np.add.at(count, term, rows["count"].to_numpy(np.int64))
    q = _shares(count, int(rows["lang_total"].iloc[0]), int(rows["terms"].iloc[0]))
    term, p, none = term[order], rows["p"].to_numpy(np.int64)[order], rows["none"].to_numpy(np.int64)[order]
    cuts = np.searchsorted(place, np.arange(len(names) + 1))
    out = []
    for a, name in enumerate(names):
        lo, hi = cuts[a], cuts[a + 1]
        more_than = lo + np.flatnonzero(p[lo:hi] > q[term[lo:hi]])
        value = divergence(p[more_than], q[term[more_than]])
        if len(value) > top:
            # All that tie with the last one stay, for the order of terms to decide.
            least = np.partition(value, len(value) - top)[len(value) - top]
            more_than, value = more_than[value >= least], value[value >= least]
        found = sorted(zip((-value).tolist(), (terms[term[k]] for k in more_than)), key=lambda x: (x[0], x[1].encode()))[:top]
        out.append(pd.DataFrame({"part": "term", "a": name, "b": [t for _, t in found], "value": [-v for v, _ in found], "common": 0}))
        mine = np.zeros(len(terms), np.int64)
        mine[term[lo:hi]] = p[lo:hi]
        ours = hi + np.flatnonzero(mine[term[hi:]])
        if len(ours):
            x, y = mine[term[ours]], p[ours]
            more = divergence(x, y) - divergence(x, none[ours]) - divergence(none[lo], y)
            first = np.flatnonzero(np.append(True, place[ours[1:]] != place[ours[:-1]]))
            out.append(pd.DataFrame({"part": "pair", "a": name, "b": names[place[ours[first]]], "value": np.add.reduceat(more, first),
                                     "common": np.diff(np.append(first, len(ours)))}))
    found = pd.concat(out)
    found.insert(0, "lang", rows["lang"].iloc[0])
    return found


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, vocabulary_limit: int = VOCABULARY_LIMIT) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of each language the other sources and its telling terms.

    ``docs`` has text, lang and source; nulls read as ''. Terms are runs of letters; a language keeps those that ``least`` of its
    rows have. A source gives each kept term the share p of ``_share``, and the language the share q, from all its rows.
    Part pair has each other source of the language and the sum of floor((p - q)^2 / (p + q)) over all kept terms, part term
    the first ``top`` terms that the source has more of than the language. Ranks go by value, then by item in code
    point order. A language without kept terms has pairs of value 0. No rows give no rows; other columns are ignored.

    A term that neither source has costs nothing: pairs are summed over the terms of either, from how many terms of a source have a
    share, and over the common ones, block by block; the rest is one value times their number. All sums are of whole numbers.
    """
    docs = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counts = source_term_counts(docs, least, vocabulary_limit)
    langs = counts.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    sizes = langs.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("count").alias("lang_total"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("own_terms"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(sums, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["terms", "lang_total", "total", "own_terms"])
    # Without kept terms there is no share of a term that does not occur; 1 stands for it and is multiplied by no terms.
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    groups = written(groups.withColumn("none", none), "groups")
    shares = counts.join(groups.select("lang", "source", "terms", "lang_total", "total", "none"), ["lang", "source"])
    shares = written(shares.withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms"))), "shares")

    blocks = groups.groupBy("lang").agg(F.sum("own_terms").alias("entries"), F.count("*").alias("sources"))
    blocks = blocks.select("lang", F.ceil(F.col("entries") / F.greatest(F.lit(_ENTRIES), F.col("sources") * F.col("sources"))).alias("blocks"))
    placed = shares.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    found = (placed.select("lang", "block", "source", "term", "count", "terms", "lang_total", "p", "none").groupBy("lang", "block")
             .applyInPandas(lambda rows: _block(rows, top), "lang string, part string, a string, b string, value long, common long"))
    found = written(found, "found")
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    telling = found.where("part = 'term'").select("lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), "value")
    telling = telling.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    both = found.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"), F.sum("common").alias("common"))
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "more", "common"))
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("b_none"), F.col("own_terms").alias("b_terms"))
    alone = (alike.withColumnRenamed("source", "a").join(other.select("lang", "b", "b_none"), "lang").where("a <> b")
             .groupBy("lang", "a", "b").agg(F.sum(F.col("n") * divergence(F.col("p"), F.col("b_none"))).alias("alone")))
    alone = written(alone, "alone")
    pairs = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("a_none"), F.col("own_terms").alias("a_terms"), "terms")
    pairs = (pairs.join(other, "lang").where("a <> b").join(alone, ["lang", "a", "b"], "left")
             .join(alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("alone").alias("alone_too")), ["lang", "a", "b"], "left")
             .join(both, ["lang", "a", "b"], "left").na.fill(0, ["alone", "alone_too", "more", "common"]))
    neither = F.col("terms") - F.col("a_terms") - F.col("b_terms") + F.col("common")
    value = F.col("alone") + F.col("alone_too") + F.col("more") + neither * divergence(F.col("a_none"), F.col("b_none"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(telling)


# The audit in DuckDB, over every term of every pair.
SOURCE_DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(terms) AS term FROM d
), v AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM v GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY t.lang, t.source, t.term
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (v.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
