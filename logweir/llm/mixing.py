"""Mixing sources to target weights by Pareto order sampling."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.scratch import written
from logweir.llm.words import SPARK_WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# Rank keys have 52 bits; their upper bits are the bins in which sizes are summed before ranks are compared.
KEY_BITS = 52
BIN_BITS = 16


def word_count(text: Column) -> Column:
    """Number of words of a text; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPARK_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from one row per source with its ``source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. A target stops at ``most`` times its source's size; what is above goes to the
    others by weight until none is above. One row per source passes here, never documents.

    The end of that loop is a threshold: with sources ordered by size per weight, the full
    ones come first, and the others get the rest in proportion. The first position at
    which the next source fits in its share is where the loop stops; later positions have lower rates.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(turn) - 1) % len(weights)
    weight = reduce(lambda rest, k: F.when(place == k, F.lit(float(weights[k]))).otherwise(rest),
                    range(len(weights)), F.lit(0.0))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (rows.withColumn("total", share * F.sum("source_size").over(everything))
            .withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("weight_before",
                        F.coalesce(F.sum("weight").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    rate = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    rows = rows.withColumn("rate", F.when(F.col("cap") > F.col("weight") * rate, rate))
    rows = rows.withColumn("rate", F.max("rate").over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("rate"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def _expected_copies(classes: DataFrame, most: int) -> DataFrame:
    """``classes`` and their expected ``copies``: proportional to ``favour``, at most ``most``.

    ``classes`` has one row per (source, favour) with words and target. Favours are few, so a source has few rows.
    The largest favours reach ``most`` first; the others share what is left of the target.
    """
    down = Window.partitionBy("source").orderBy(F.col("favour").desc())
    whole = Window.partitionBy("source")
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    rows = (classes.withColumn("load", F.col("words") * F.col("favour"))
            .withColumn("full", most * F.coalesce(F.sum("words").over(before), F.lit(0)))
            .withColumn("loads", F.sum("load").over(whole) - F.coalesce(F.sum("load").over(before), F.lit(0))))
    rate = F.when(F.col("loads") > 0, (F.col("target") - F.col("full")) / F.col("loads"))
    rows = rows.withColumn("rate", F.when(F.col("favour") * rate <= most, rate))
    rows = rows.withColumn("rate", F.max("rate").over(whole))
    copies = F.least(F.lit(float(most)), F.coalesce(F.col("favour") * F.col("rate"), F.lit(float(most))))
    return rows.withColumn("copies", copies)


def length_favour(size: Column) -> Column:
    """Long documents are favoured gently: one step for each doubling of the size."""
    return F.length(F.bin(size)).cast("long") + 4


def _rank_key(u: Column, p: Column) -> Column:
    """Pareto rank, (u / (1 - u)) / (p / (1 - p)), mapped in order to an integer of ``KEY_BITS`` bits."""
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.floor(odds / (1 + odds) * float(1 << KEY_BITS)).cast("long")


def _uniform(doc_id: Column) -> Column:
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, KEY_BITS // 4), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << KEY_BITS)


def _ranked(docs: DataFrame, plan: DataFrame, favour) -> DataFrame:
    """``docs`` with their plan, rank key (null where nothing is sampled) and bin."""
    rows = docs.withColumn("mix_favour", favour(F.col("mix_size")))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"]) & (F.col("mix_favour") == F.col("plan_favour")))
    key = F.when((F.col("plan_p") > 0) & (F.col("mix_size") > 0), _rank_key(_uniform(F.col("doc_id")), F.col("plan_p")))
    return rows.withColumn("mix_key", key).withColumn("mix_bin", F.shiftright(F.col("mix_key"), KEY_BITS - BIN_BITS))


def _plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, favour) -> DataFrame:
    """One row per source and favour: targets, certain copies, sampled fraction, words left to the sample."""
    classes = (rows.groupBy("source", favour(F.col("mix_size")).alias("favour"))
               .agg(F.sum("mix_size").alias("words")))
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "target_source")
    classes = classes.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    plan = _expected_copies(classes, most)
    certain = F.least(F.floor("copies"), F.lit(most)).cast("long")
    plan = plan.withColumn("certain", certain).withColumn("p", F.col("copies") - F.col("certain"))
    left = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("source"))
    return plan.select(F.col("source").alias("plan_source"), F.col("favour").alias("plan_favour"),
                       F.col("source_size").alias("plan_size"), F.col("target").alias("plan_target"),
                       F.col("certain").alias("plan_certain"), F.col("p").alias("plan_p"), left.alias("plan_open"))


def _sample_ends(ranked: DataFrame) -> DataFrame:
    """Per source whose sample ends before its last document: the bin of the end and the last row taken in it."""
    bins = ranked.groupBy("source", "mix_bin").agg(F.sum("mix_size").alias("bin_words"), F.first("plan_open").alias("open"))
    upto = Window.partitionBy("source").orderBy("mix_bin")
    bins = bins.withColumn("reached", F.sum("bin_words").over(upto)).where("reached > open")
    edge = (bins.groupBy("source")
            .agg(F.min_by(F.struct("mix_bin", F.expr("reached - bin_words").alias("before"), "open"), "mix_bin").alias("edge"))
            .select(F.col("source").alias("end_source"), F.col("edge.mix_bin").alias("end_bin"),
                    F.col("edge.before").alias("before"), F.col("edge.open").alias("open")))
    inside = ranked.join(edge, ranked["source"].eqNullSafe(F.col("end_source")) & (F.col("mix_bin") == F.col("end_bin")))
    order = Window.partitionBy("end_source").orderBy("mix_key", "doc_id", "mix_size")
    inside = (inside.groupBy("end_source", "end_bin", "before", "open", "mix_key", "doc_id", "mix_size")
              .agg(F.sum("mix_size").alias("words"))
              .withColumn("reached", F.col("before") + F.sum("words").over(order)))
    # A row is taken when that brings the words nearer to the target.
    last = F.max(F.when(F.col("reached") - F.col("words") / 2 <= F.col("open"), F.struct("mix_key", "doc_id", "mix_size")))
    return inside.groupBy("end_source", "end_bin").agg(last.alias("end_last"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                most: int = MOST_COPIES, favour=length_favour) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source and others) and what the mix takes of each row.

    Added: ``mix_size`` (words), ``mix_source_size``, ``mix_target``, ``mix_copies``. Columns of
    ``docs`` with names that begin with mix_, plan_ or end_ are not allowed and raise.

    Every document of a source expects copies in proportion to its favour, at most ``most``. The
    whole part of that number is certain. The fraction p is sampled: ranks are random odds
    u / (1 - u) over inclusion odds p / (1 - p), and documents are taken in rank order until
    the words of the source reach its target, to the nearest document. The size of the sample
    is so fixed in words, which is what targets are given in. Whole copies only are taken.
    u comes from md5 of the doc_id, so reruns agree.

    Rank keys are cut to bins whose words are summed per source (partial sums). Only the bin in
    which a source reaches its target is put in order, so a source is never one task's work.
    A null source is a source, after all others. A null doc_id ranks as the text 'null'. Null
    and blank texts have size 0 and are taken 0 times. Rows that share source, doc_id and size
    are taken alike. No rows give no rows.
    """
    if clash := [c for c in docs.columns if c.startswith(("mix_", "plan_", "end_"))]:
        raise ValueError(f"reserved column names: {clash}")
    size = word_count(F.col("text"))
    narrow = written(docs.select("doc_id", "source", size.alias("mix_size")), "sizes")
    plan = written(_plan(narrow, weights, share, most, favour), "plan")
    ends = written(_sample_ends(_ranked(narrow, plan, favour).where("mix_key IS NOT NULL")), "ends")
    rows = _ranked(docs.withColumn("mix_size", size), plan, favour)
    rows = rows.join(ends, rows["source"].eqNullSafe(F.col("end_source")), "left")
    place = F.struct("mix_key", "doc_id", "mix_size")
    sampled = (F.col("mix_key").isNotNull()
               & (F.col("end_bin").isNull() | (F.col("mix_bin") < F.col("end_bin"))
                  | ((F.col("mix_bin") == F.col("end_bin")) & F.coalesce(place <= F.col("end_last"), F.lit(False)))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size", F.col("plan_size").alias("mix_source_size"),
                       F.col("plan_target").alias("mix_target"),
                       (F.col("plan_certain") + sampled.cast("long")).alias("mix_copies"))


def mixed_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the mix, with the default weights."""
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


# The mix in DuckDB: the same plan and ranks, with one plain running sum per source.
MIXED_WORDS_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), c AS (
  SELECT source, length(bin(size)) + 4 AS favour, sum(size)::BIGINT AS words FROM d GROUP BY ALL
), s AS (
  SELECT source, sum(words)::BIGINT AS source_size FROM c GROUP BY ALL
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total
  FROM s
), s2 AS (
  SELECT *, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM s1
), s3 AS (
  SELECT *, (total - cap_before) / (all_w - w_before) AS rate0 FROM s2
), t AS (
  SELECT source, source_size, least(cap, coalesce(w * max(CASE WHEN cap > w * rate0 THEN rate0 END) OVER (), cap)) AS target FROM s3
), e AS (
  SELECT c.source, c.favour, c.words, t.source_size, t.target,
         2 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(words * favour) OVER (PARTITION BY c.source)
           - coalesce(sum(words * favour) OVER (PARTITION BY c.source ORDER BY favour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS loads
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), e1 AS (
  SELECT *, CASE WHEN loads > 0 THEN (target - filled::DOUBLE) / loads::DOUBLE END AS r FROM e
), e2 AS (
  SELECT *, max(CASE WHEN favour * r <= 2 THEN r END) OVER (PARTITION BY source) AS rate FROM e1
), e3 AS (
  SELECT *, least(2.0::DOUBLE, coalesce(favour * rate, 2.0::DOUBLE)) AS copies FROM e2
), e4 AS (
  SELECT *, floor(copies)::BIGINT AS certain, copies - floor(copies) AS p,
         target - sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source)::DOUBLE AS open
  FROM e3
), r AS (
  SELECT d.doc_id, d.source, d.size, e4.source_size, e4.target, e4.certain, e4.p, e4.open,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN e4 ON d.source IS NOT DISTINCT FROM e4.source AND length(bin(d.size)) + 4 = e4.favour
), q AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM r
), k AS (
  SELECT *, floor(odds / (1 + odds) * 4503599627370496.0::DOUBLE)::BIGINT AS key FROM q
), n AS (
  SELECT *, sum(size) OVER (PARTITION BY source, key IS NULL ORDER BY key, doc_id, size) AS reached,
         sum(size) OVER (PARTITION BY source, key, doc_id, size) AS alike
  FROM k
)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN key IS NOT NULL AND reached - alike / 2.0 <= open THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n
"""
