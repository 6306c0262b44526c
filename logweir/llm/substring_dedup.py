"""Removal of long word sequences that an earlier document has, by super-k-mer partitioning."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.scratch import written
from logweir.llm.words import mix, seeds, shingles, signed, small_batches, text_buffers, texts_as_words, word_hashes, word_starts

WINDOW = 50
MINIMISER = 5
# Buckets with more super-k-mers than this are counted by partial aggregates instead of one sort.
HOT_BUCKET = 4096

_RUN = "doc_id long, text_key long, n_words long, digest_a long, digest_b long, minimiser long, start int, windows int"
_SEGMENT = "minimiser long, hot boolean, doc_id long, text_key long, start int, packed string"
_RANGE = "doc_id long, text_key long, start int, windows int"
_RADIX = np.uint64(int(seeds(1, 77)[0]))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words from differences of one running sum."""
    powers = np.cumprod(np.full(len(words), _RADIX))
    inverse = np.cumprod(np.full(len(words), np.uint64(pow(int(_RADIX), -1, 1 << 64))))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    return mix((total[width:] - total[:-width]) * inverse[: len(words) - width + 1])


def _super_kmers(words: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each run of windows that share a minimiser."""
    least = _sliding_least(shingles(words, size), width - size + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.append(first, len(least)))


def _runs(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        parts = []
        ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k, words in enumerate(texts_as_words(batch.column(2), lower=False)):
            if len(words) < width:
                continue
            factor = seeds(len(words), 5)
            a, b = int(mix(np.add.reduce(words * factor, keepdims=True))[0]), int(np.add.reduce(mix(words) * factor))
            minimiser, first, windows = _super_kmers(words, width, size)
            n = len(first)
            parts.append((np.full(n, ids[k]), np.full(n, keys[k]), np.full(n, len(words)), np.full(n, np.uint64(a)).view(np.int64),
                          np.full(n, np.uint64(b)).view(np.int64), signed(minimiser), first.astype(np.int32),
                          windows.astype(np.int32)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                             names=["doc_id", "text_key", "n_words", "digest_a", "digest_b", "minimiser",
                                                    "start", "windows"])


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cuts each super-k-mer out of its text as one string of its words."""
    for batch in small_batches(batches):
        data, offsets = text_buffers(batch.column(2))
        begin, at = word_starts(data, offsets)
        raw = data.tobytes()
        out: list[list] = [[], [], [], [], [], []]
        for k, found in enumerate(batch.column(3)):
            doc_id, key, base, end = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), at[k], at[k + 1]
            runs = found.values
            for minimiser, hot, start, windows in zip(*(runs.field(x).to_pylist() for x in range(4))):
                last = base + start + windows + width - 1
                stop = begin[last] if last < end else offsets[k + 1]
                for column, value in zip(out, (minimiser, hot, doc_id, key, start,
                                               raw[begin[base + start]: stop].decode())):
                    column.append(value)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                         names=["minimiser", "hot", "doc_id", "text_key", "start", "packed"])


def _packed_windows(packed: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window hashes of packed strings, and how many each string has."""
    data, offsets = text_buffers(packed)
    begin, at = word_starts(data, offsets)
    words = word_hashes(data, begin, lower=False)
    each = [_window_hashes(words[lo:hi], width) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
    return (np.concatenate(each) if each else np.zeros(0, np.uint64)), np.array([len(x) for x in each], np.int64)


def _bucket_ranges(table: pa.Table, width: int) -> pa.RecordBatch:
    """Sorts the windows of whole buckets; returns those that a smaller doc_id has too, as ranges."""
    windows, count = _packed_windows(table.column("packed").combine_chunks(), width)
    row = np.repeat(np.arange(len(count)), count)
    doc = table.column("doc_id").to_numpy()
    bucket = table.column("minimiser").to_numpy()
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((doc[row], windows, bucket[row]))
    w, r = windows[order], row[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (bucket[r[1:]] != bucket[r[:-1]])]) if len(w) else np.zeros(0, bool)
    smallest = doc[r[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(w) else doc[:0]
    hit = np.zeros(len(row), bool)
    hit[order] = doc[r] > smallest
    # Neighbouring hits of one string become a range.
    at = np.flatnonzero(hit)
    opens = np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])]) if len(at) else np.zeros(0, bool)
    first = at[np.flatnonzero(opens)]
    length = np.diff(np.append(np.flatnonzero(opens), len(at)))
    start = table.column("start").to_numpy()[row[first]] + offset[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row[first]]), pa.array(table.column("text_key").to_numpy()[row[first]]),
         pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))],
        names=["doc_id", "text_key", "start", "windows"])


def _buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Buckets come in order of their minimiser; the last one of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if last or (held and held[-1].column(0)[0].as_py() != int(keys[0])):
            whole = [*held, batch.slice(0, last)] if last else held
            yield _bucket_ranges(pa.Table.from_batches(whole), width)
            held = []
        held.append(batch.slice(last))
    if held:
        yield _bucket_ranges(pa.Table.from_batches(held), width)


def _distinct_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row per different window of each different packed string."""
    for batch in batches:
        windows, count = _packed_windows(batch.column(3), width)
        each = [np.unique(w) for w in np.split(windows, np.cumsum(count)[:-1])] if len(count) else []
        row = np.repeat(np.arange(len(each)), [len(w) for w in each])
        columns = [batch.column(k).to_numpy(zero_copy_only=False)[row] for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), pa.array(columns[1]), pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *each]))),
             pa.array(columns[2])], names=["minimiser", "string_key", "window", "doc_id"])


def _known_ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Ranges of each packed string whose windows a smaller doc_id has, by the smallest doc_id of each window."""
    for batch in batches:
        windows, count = _packed_windows(batch.column(3), width)
        docs = batch.column(0).to_numpy()
        rows, starts, lengths = [], [], []
        for k, own in enumerate(np.split(signed(windows), np.cumsum(count)[:-1]) if len(count) else []):
            lows = batch.column(4)[k].values
            known, low = lows.field(0).to_numpy(), lows.field(1).to_numpy()
            order = np.argsort(known)
            at = order[np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)]
            hit = np.concatenate([[False], (known[at] == own) & (low[at] < docs[k]), [False]])
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            starts.extend(edge[::2]), lengths.extend(edge[1::2] - edge[::2]), rows.extend([k] * (len(edge) // 2))
        take = pa.array(rows, pa.int64())
        first = batch.column(2).take(take).to_numpy() + np.array(starts, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)),
                                          pa.array(lengths, pa.int32())], names=["doc_id", "text_key", "start", "windows"])


def _hot_ranges(segments: DataFrame, width: int) -> DataFrame:
    """The ranges of buckets with many super-k-mers, which no task may hold.

    Equal strings are reduced to their smallest doc_id, then the windows of different strings to
    theirs, both by partial aggregates; each string gets back the windows it shares.
    """
    strings = segments.withColumn("string_key", F.xxhash64("packed"))
    different = strings.groupBy("minimiser", "string_key").agg(F.min("doc_id").alias("doc_id"), F.first("packed").alias("packed"))
    windows = written(different.mapInArrow(partial(_distinct_windows, width=width),
                      "minimiser long, string_key long, window long, doc_id long"), "windows")
    smallest = windows.groupBy("minimiser", "window").agg(F.min("doc_id").alias("low"))
    lows = (windows.join(smallest, ["minimiser", "window"]).groupBy("minimiser", "string_key")
            .agg(F.collect_list(F.struct("window", "low")).alias("lows")))
    return (strings.join(lows, ["minimiser", "string_key"]).select("doc_id", "text_key", "start", "packed", "lows")
            .mapInArrow(partial(_known_ranges, width=width), _RANGE))


def repeated_ranges(docs: DataFrame, width: int = WINDOW, size: int = MINIMISER, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, text_key, start, windows): runs of word windows of ``docs`` (doc_id, text_key, text) that also start in a smaller doc_id.

    Windows in a row that share their minimiser (the least hash of ``size`` words in them) are a
    super-k-mer. Only super-k-mers whose minimiser occurs in several documents travel, each as
    one string, to the bucket of the minimiser, where sorted windows show the smallest doc_id
    of each. Texts with the same words are reduced to the smallest doc_id before.
    """
    runs = written(docs.where("doc_id IS NOT NULL").select("doc_id", "text_key", "text").mapInArrow(
        partial(_runs, width=width, size=size), _RUN), "runs")
    texts = runs.where("start = 0").select("doc_id", "text_key", "n_words", "digest_a", "digest_b")
    words = ["n_words", "digest_a", "digest_b"]
    first = texts.groupBy(words).agg(F.min("doc_id").alias("first_id"))
    copies = texts.join(first, words).where("doc_id > first_id").select("doc_id", "text_key", "n_words").distinct()
    copies = written(copies, "copies")
    own = runs.join(copies, ["doc_id", "text_key"], "left_anti").select("doc_id", "text_key", "minimiser", "start", "windows")
    shared = (own.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
              .where("low < high").select("minimiser", (F.col("n") > hot_bucket).alias("hot")))
    needed = (own.join(shared, "minimiser").groupBy("doc_id", "text_key")
              .agg(F.collect_set(F.struct("minimiser", "hot", "start", "windows")).alias("runs")))
    segments = written(docs.join(needed, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs").mapInArrow(
        partial(_segments, width=width), _SEGMENT), "segments")
    cold = segments.where("NOT hot").select("minimiser", "doc_id", "text_key", "start", "packed")
    cold = cold.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(partial(_buckets, width=width), _RANGE)
    hot = _hot_ranges(segments.where("hot"), width)
    whole = copies.select("doc_id", "text_key", F.lit(0).alias("start"), (F.col("n_words") - (width - 1)).cast("int").alias("windows"))
    return cold.unionByName(hot).unionByName(whole)


def _kept(batches: Iterator[pa.RecordBatch], width: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        data, offsets = text_buffers(batch.column(1))
        begin, at = word_starts(data, offsets)
        raw = data.tobytes()
        n_words, n_removed, digests, texts = [], [], [], []
        for k, found in enumerate(batch.column(2)):
            words = raw[offsets[k]: offsets[k + 1]].split()
            n = int(at[k + 1] - at[k])
            gone = np.zeros(n + 1, np.int32)
            if found.is_valid:
                start = found.values.field(0).to_numpy()
                np.add.at(gone, start, 1)
                np.add.at(gone, start + found.values.field(1).to_numpy() + width - 1, -1)
            keep = np.cumsum(gone[:n]) == 0
            left = b" ".join([w for w, k in zip(words, keep.tolist()) if k] if not keep.all() else words)
            n_words.append(n), n_removed.append(n - int(keep.sum()))
            digests.append(hashlib.sha256(left).hexdigest())
            texts.append(left.decode() if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()),
             pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def without_repeats(docs: DataFrame, width: int = WINDOW, size: int = MINIMISER, hot_bucket: int = HOT_BUCKET,
                    with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of ``docs`` (doc_id, text).

    Every word is removed that a window of ``width`` words covers whose words also start in a
    document with a smaller doc_id; windows are judged on the input. Kept words are joined by
    one space. Null, empty and short texts keep all words (none for null). A null doc_id is
    smaller than nothing and nothing is smaller than it: such rows stay whole. Rows that
    repeat a doc_id are one document in the comparison and remove nothing from each other.
    Equal windows are equal 64-bit hashes of 64-bit word hashes within a bucket. No rows give
    no rows; other columns do not matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    ranges = repeated_ranges(rows, width, size, hot_bucket)
    by_doc = ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "windows")).alias("ranges"))
    found = rows.join(by_doc, ["doc_id", "text_key"], "left").select("doc_id", "text", "ranges")
    return found.mapInArrow(partial(_kept, width=width, with_text=with_text),
                            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def kept_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) with the default parameters."""
    return without_repeats(docs, with_text=False).drop("kept_text")


# The same in DuckDB, window by window.
KEPT_WORDS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d
), h AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS x FROM p
), f AS (
  SELECT x, min(doc_id) AS low FROM h GROUP BY x
), g AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM h JOIN f USING (x) WHERE doc_id > low
), m AS (
  SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
         CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(gone, j)) END AS kept
  FROM d LEFT JOIN m USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
