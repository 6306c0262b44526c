"""Removal of lines that nearly repeat an earlier line, by MinHash banding and union-find."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.components import components
from logweir.llm.idset import id_set, in_set
from logweir.llm.parity import SLACK, near_pairs, parity
from logweir.llm.postings import several_items
from logweir.llm.scratch import written
from logweir.llm.words import mix, rolling, seeds, signed, small_batches

SHINGLE = 6
PERCENT = 80
# A pair of lines at the threshold shares at least one of the bands with a chance of 0.998, one at 90 % with 0.999997.
BANDS, BAND_ROWS = 12, 4
_BINS = BANDS * BAND_ROWS
# Shingles of a set from which on one hash function serves all values of its signature.
SMALL_SET = 512
# Lines, and characters, of a band from which on it is compared in parts.
PART_LINES, PART_CHARS = 1024, 4 << 20
# A sketch has two bits of each of so many values. Lines at the threshold have fewer than the least number of them in common with a chance of some 10^-7.
SKETCH, LEAST_COMMON = 32, 16
_EMPTY = np.uint64((1 << 64) - 1)
_BLOCK = 1 << 16

_LINE = "doc_id long, text_key long, no int, line long"


def _norm(line: str) -> str:
    """What is compared of a line: without white space at its ends, in lower case."""
    return line.strip().lower()


def _line_id(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _windows(line: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` code points; one hash of the whole when there are fewer."""
    width = min(size, len(line))
    if len(line) <= _BLOCK:
        return rolling(line, width)
    return np.concatenate([rolling(line[k: k + _BLOCK + width - 1], width) for k in range(0, len(line) - width + 1, _BLOCK)])


def _distinct(hashes: np.ndarray) -> np.ndarray:
    own = np.sort(hashes)
    return own[np.concatenate([[True], own[1:] != own[:-1]])]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _signatures(lines: list[str], size: int) -> list[np.ndarray]:
    """Band keys of each line."""
    return [bands for bands, _ in _sketched(lines, size)]


def _sketched(lines: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Band keys of each line, and with each the sketch of its signature, a block of text at a time."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    k = 0
    while k < len(lines):
        j, total = k, 0
        while j < len(lines) and (j == k or total + len(lines[j]) <= _BLOCK):
            total += len(lines[j])
            j += 1
        out += _block_signatures(lines[k:j], size)
        k = j
    return out


def _bands(values: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of ``BAND_ROWS`` values each, told apart by band and kind of signature."""
    bands = mix(values).reshape(len(values), BANDS, BAND_ROWS) * seeds(BAND_ROWS, 40)
    return mix(np.add.reduce(bands, axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(kind))


def _sketches(values: np.ndarray) -> np.ndarray:
    bits = mix(values[:, :SKETCH]) >> np.uint64(62)
    return np.bitwise_or.reduce(bits << np.arange(0, 2 * SKETCH, 2, dtype=np.uint64), axis=1)


def _block_signatures(lines: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Band keys and sketches by the size of each line's set.

    Small sets have one hash function per value: bins of a single one would mostly be empty, and then tell little.
    Large sets have one hash per shingle, the least of each bin. Sets within the similarity of the border have both.
    """
    length = np.array([len(x) for x in lines])
    short = np.flatnonzero(length < size)
    count = np.maximum(length - size + 1, 1)
    first = np.cumsum(count) - count
    values = np.empty(int(count.sum()), np.uint64)
    codes = _codes("".join(lines))
    if len(codes) >= size:
        every = _windows(codes, size)
        row = np.repeat(np.arange(len(lines)), length)
        inside = np.ones(len(values), bool)
        inside[first[short]] = False
        values[inside] = every[row[: len(every)] == row[size - 1:]]
    for k in short.tolist():
        values[first[k]] = _windows(_codes(lines[k]), size)[0]
    distinct = np.zeros(len(lines), np.int64)
    for k in np.flatnonzero(count >= SMALL_SET * PERCENT // 100).tolist():
        distinct[k] = len(_distinct(values[first[k]: first[k] + count[k]]))
    small = np.flatnonzero(distinct * PERCENT <= SMALL_SET * 100)
    large = np.flatnonzero(distinct * 100 >= SMALL_SET * PERCENT)
    out: list[list[tuple[np.ndarray, np.uint64]]] = [[] for _ in lines]
    if len(small):
        own = values if len(small) == len(lines) else np.concatenate([values[first[k]: first[k] + count[k]] for k in small])
        starts = np.cumsum(count[small]) - count[small]
        least = np.empty((len(small), _BINS), np.uint64)
        for k, factor in enumerate(seeds(_BINS // 2, 90)):
            spread = own * factor
            least[:, 2 * k] = np.minimum.reduceat((spread >> np.uint64(32)).astype(np.uint32), starts)
            least[:, 2 * k + 1] = np.minimum.reduceat(spread.astype(np.uint32), starts)
        for k, *made in zip(small.tolist(), _bands(least, 1), _sketches(least)):
            out[k].append(made)
    if len(large):
        least = np.full((len(large), _BINS), _EMPTY)
        for row, k in enumerate(large.tolist()):
            _lower(least[row], np.zeros(count[k], np.int64), values[first[k]: first[k] + count[k]])
        place = np.where(least != _EMPTY, np.arange(_BINS), 4 * _BINS)
        twice = np.concatenate([place, place + _BINS], axis=1)
        following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
        away = (following - np.arange(_BINS)).astype(np.uint64)
        filled = np.take_along_axis(least, following % _BINS, axis=1) + away * np.uint64(0x9E3779B97F4A7C15)
        for k, *made in zip(large.tolist(), _bands(filled, 2), _sketches(filled)):
            out[k].append(made)
    return [(np.concatenate([bands for bands, _ in x]), np.repeat(np.array([sketch for _, sketch in x], np.uint64), BANDS)) for x in out]


def _lower(flat: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> None:
    bins = ((hashes >> np.uint64(48)) * np.uint64(_BINS)) >> np.uint64(16)
    np.minimum.at(flat, row * _BINS + bins.astype(np.int64), hashes & np.uint64((1 << 48) - 1))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line that is not blank."""
    for batch in small_batches(batches):
        ids, keys, numbers, lines = [], [], [], []
        for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            for no, line in enumerate((text or "").split("\n")):
                if line := _norm(line):
                    ids.append(doc_id), keys.append(key), numbers.append(no), lines.append(_line_id(line))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(lines, pa.int64())],
            names=["doc_id", "text_key", "no", "line"])


def _line_bands(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row per band of a line that is not blank, once per task."""
    told: set[int] = set()
    for batch in small_batches(batches):
        lines, texts = [], []
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                if (line := _norm(line)) and (own := _line_id(line)) not in told:
                    told.add(own)
                    lines.append(own), texts.append(line)
        if made := _sketched(texts, size):
            bands, sketches = (signed(np.concatenate(x)) for x in zip(*made))
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(np.repeat(np.array(lines, np.int64), [len(x) for x, _ in made])), pa.array(sketches)],
                                             names=["band", "line", "sketch"])


def _near_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings in order of their band, those with another line of it that can be similar by their sketches, and all of a long band."""
    for rows, end in _cells(several_items(batches), 1):
        line, sketch = rows.column("line").to_numpy(), rows.column("sketch").to_numpy().view(np.uint64)
        lines = np.unique(end, return_counts=True)[1]
        keep = np.repeat(lines > PART_LINES, lines)
        for a, b in _pairs(np.where(keep, np.arange(len(end)) + 1, end)):
            apart = sketch[a] ^ sketch[b]
            apart = (apart | apart >> np.uint64(1)) & np.uint64(0x5555555555555555)
            near = (np.bitwise_count(apart) <= SKETCH - LEAST_COMMON) & (line[a] != line[b])
            keep[a[near]] = keep[b[near]] = True
        yield from rows.select(["band", "line"]).filter(pa.array(keep)).combine_chunks().to_batches()


def _line_texts(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    told: set[int] = set()
    for batch in small_batches(batches):
        lines, texts = [], []
        for text in batch.column(0).to_pylist():
            for line in (text or "").split("\n"):
                if (line := _norm(line)) and (own := _line_id(line)) not in told:
                    told.add(own)
                    lines.append(own), texts.append(line)
        keep = np.flatnonzero(in_set(wanted.value, np.array(lines, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(lines, np.int64)[keep]), pa.array([texts[k] for k in keep], pa.string())],
                                         names=["line", "text"])


def _with_parities(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = batch.column(1).to_pylist()
        sets = [_distinct(_windows(_codes(text), size)) for text in texts]
        own = pa.array([signed(parity(x, 1)) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in texts], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), own],
                                         names=["line", "text", "chars", "n", "parity"])


def _wanted_texts(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(in_set(wanted.value, batch.column(0).to_numpy())))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _linked(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        made: dict[int, np.ndarray] = {}
        keep = []
        for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
            for own, text in ((a, x), (b, y)):
                if own not in made:
                    made[own] = _distinct(_windows(_codes(text), size))
            keep.append(_alike(made[a], made[b], percent))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of their cell (the first ``keys`` columns) as tables of whole cells, with the end of each row's cell."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        at = _cell_starts(rows, keys)
        held = rows.slice(at[-1])
        if at[-1]:
            yield rows.slice(0, at[-1]), np.repeat(at[1:], np.diff(at))
    if held is not None:
        yield held, np.full(held.num_rows, held.num_rows)


def _cell_starts(rows: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in range(keys):
        key = rows.column(k).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _pairs(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row and a later one before its end, some at a time."""
    after = end - np.arange(len(end)) - 1
    upto = np.cumsum(after)
    k = 0
    while k < len(end):
        j = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + _BLOCK, side="right")))
        first = np.cumsum(after[k:j]) - after[k:j]
        a = np.repeat(np.arange(k, j), after[k:j])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(first, after[k:j])
        k = j


def _parity_words(lists: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The words of each row's parity, and for each number of words all parities of as many or more, folded to it."""
    own = [x.values.to_numpy().view(np.uint64) for x in lists]
    words = np.array([len(x) for x in own])
    folds = {}
    for count in np.unique(words).tolist():
        folds[count] = np.zeros((len(own), count), np.uint64)
        for more in np.unique(words[words >= count]).tolist():
            rows = np.flatnonzero(words == more)
            folds[count][rows] = np.bitwise_xor.reduce(np.stack([own[k] for k in rows]).reshape(len(rows), more // count, count), axis=1)
    return words, folds


def _near_in_cells(rows: pa.Table, end: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of a cell that are of different components and can be similar by their sizes and parities."""
    low, high, part, component, n = (rows.column(k).to_numpy() for k in ("low", "high", "part", "component", "n"))
    words, folds = _parity_words(rows.column("parity"))
    reach = 1 - percent / 100 + SLACK
    for a, b in _pairs(end):
        meet = (component[a] != component[b]) & ((low[a] == high[a]) | (part[a] != part[b]))
        meet &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[meet], b[meet]
        least = np.minimum(words[a], words[b])
        for count, fold in folds.items():
            x, y = a[least == count], b[least == count]
            apart = np.bitwise_count(fold[x] ^ fold[y]).sum(axis=1, dtype=np.int64)
            near = 2 * apart <= reach * (n[x] + n[y] + apart)
            yield from zip(x[near].tolist(), y[near].tolist())


def _linked_in_cells(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between similar rows of a cell that are of different components; none between components that the task has linked already."""
    for rows, end in _cells(batches, 3):
        top: dict[int, int] = {}
        made: dict[int, np.ndarray] = {}

        def root(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = x = top.get(up, up)
            return x

        line, text, component = rows.column("line").to_numpy(), rows.column("text"), rows.column("component").to_numpy()
        links = []
        for a, b in _near_in_cells(rows, end, percent):
            one, two = root(int(component[a])), root(int(component[b]))
            if one == two:
                continue
            for k in (a, b):
                if line[k] not in made:
                    made[line[k]] = _distinct(_windows(_codes(text[k].as_py()), size))
            if _alike(made[line[a]], made[line[b]], percent):
                top[one] = two
                links.append((line[a], line[b]))
        found = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def line_components(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(line, component) of lines of ``texts`` that are similar to others.

    Lines that share a band are first compared with the band's leader only, which joins groups of
    any size by as many pairs as they have lines; texts are fetched for pairs only that can be similar
    by the parities of their sets. Then all pairs of a band that are still in different components are
    compared where its lines meet, so no pair that shares a band is left out and no pair is written that
    is not a link. Bands of many lines are cut into parts, and each two parts meet in a cell of their own.
    """
    bands = texts.mapInArrow(partial(_line_bands, size=size), "band long, line long, sketch long")
    near = bands.repartition("band").sortWithinPartitions("band").mapInArrow(_near_postings, "band long, line long")
    shared = written(near.distinct(), "shared")
    wanted = written(shared.select("line").distinct(), "wanted")
    told = (texts.mapInArrow(partial(_line_texts, wanted=id_set(wanted)), "line long, text string").join(wanted, "line", "left_semi")
            .groupBy("line").agg(F.min("text").alias("text")))
    known = written(told.mapInArrow(partial(_with_parities, size=size), "line long, text string, chars long, n long, parity array<long>"), "line-texts")
    own = known.select(F.col("line").alias("class"), "n", "parity")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(near_pairs(own, pairs.withColumn("reach", F.lit(1 - percent / 100))), "near")
        needed = written(pairs.select("a").union(pairs.select("b")).distinct(), "near-lines")
        known_texts = known.select("line", "text")
        near = written(known_texts.mapInArrow(partial(_wanted_texts, wanted=id_set(needed)), known_texts.schema), "near-texts")
        one = near.select(F.col("line").alias("a"), F.col("text").alias("x"))
        two = near.select(F.col("line").alias("b"), F.col("text").alias("y"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
        return both.mapInArrow(partial(_linked, size=size, percent=percent), "a long, b long")

    leaders = shared.groupBy("band").agg(F.min("line").alias("b"))
    first = shared.join(leaders, "band").where("line <> b").select(F.col("line").alias("a"), "b").distinct()
    found = written(linked(first), "links")
    joined = components(found).withColumnRenamed("node", "line")
    members = written(shared.join(joined, "line", "left").join(known.select("line", "chars"), "line")
                      .select("band", "line", F.coalesce("component", "line").alias("component"), "chars"), "members")
    split = (members.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("lines"), F.sum("chars").alias("chars"))
             .where("least <> most")
             .select("band", F.greatest(F.ceil(F.col("lines") / PART_LINES), F.ceil(F.col("chars") / PART_CHARS)).cast("int").alias("parts")))
    rows = (members.select("band", "line", "component").join(split, "band")
            .withColumn("part", F.expr("cast(pmod(xxhash64(line), parts) as int)"))
            .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            .select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "line", "component")
            .join(known.select("line", "text", "n", "parity"), "line")
            .select("band", "low", "high", "part", "line", "component", "n", "parity", "text"))
    rows = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    more = written(rows.mapInArrow(partial(_linked_in_cells, size=size, percent=percent), "a long, b long"), "links")
    return components(found.unionByName(more)).withColumnRenamed("node", "line")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts, counts, gone = [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist()):
            lines = [] if text is None else text.split("\n")
            drop = set(removed or ())
            texts.append(None if text is None else "\n".join([x for k, x in enumerate(lines) if k not in drop]))
            counts.append(len(lines)), gone.append(len(drop))
        rest = [k for k, name in enumerate(batch.schema.names) if name != "removed"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in rest), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())],
            names=[*(batch.schema.names[k] for k in rest), "kept_text", "n_lines", "n_removed"])


def without_near_lines(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and others), and kept_text, n_lines and n_removed, for every row.

    Lines end at a newline. Two lines are similar when their sets of ``size``-character shingles
    (of the line in lower case without white space at its ends; a shorter line is one
    shingle) share at least ``percent`` of their union. Of the lines that similarity joins, the first by
    doc_id and line number stays, whatever the number of repeats. Blank lines stay. Null texts
    stay null and have no lines. Null doc_ids come last. Rows that repeat doc_id and text are
    one document. No rows give no rows. Columns of ``docs`` that are named like a new one raise.
    """
    if clash := [c for c in docs.columns if c in ("kept_text", "n_lines", "n_removed", "removed") or c.startswith("line_dedup_")]:
        raise ValueError(f"reserved column names: {clash}")
    key = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text")
    joined = line_components(rows.select("text"), size, percent)
    lines = written(rows.mapInArrow(_lines, _LINE), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "no", "text_key")
    placed = lines.join(joined, "line", "left").select(
        F.coalesce("component", "line").alias("component"), "doc_id", "text_key", "no", place.alias("place"))
    first = placed.groupBy("component").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    gone = (placed.join(first, "component").where("place <> first")
            .groupBy(F.col("doc_id").alias("line_dedup_id"), F.col("text_key").alias("line_dedup_key"))
            .agg(F.collect_set("no").alias("removed")))
    gone = written(gone, "gone")
    found = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("line_dedup_id")) & (key == F.col("line_dedup_key")), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns], "removed")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.mapInArrow(_kept, f"{fields}, kept_text string, n_lines long, n_removed long")


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) with the default parameters; null texts count as empty."""
    return without_near_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
