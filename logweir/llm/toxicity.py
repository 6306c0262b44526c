"""Toxic texts by a factorization machine over hashed terms."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.words import mix, small_batches, text_buffers, word_hashes, word_starts

# Bound of the labelled sample: texts, and hashed terms of each (of a text with more, those with the least hashes).
TRAIN_TEXTS = 8000
TRAIN_TERMS = 8192
# A term has a weight when this many training texts have it, and toxic ones so often, or so seldom, that chance
# would be this many standard deviations off.
LEAST_TEXTS, LEAST_DEVIATIONS = 5, 4.0
TABLE_BITS = 18
FACTORS = 6
EPOCHS, BATCH, STEP, DECAY = 30, 64, 0.3, 1e-4
THRESHOLD = 0.7

# Bytes at the beginning of a word that are terms of their own, beside the whole word.
_HEADS = (4, 5, 6, 7, 8)
_REPEATS = (2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of weights + half of (sum of factors)^2 - sum of factors^2), over a text's distinct terms."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with all but letters blanked, word starts, where each text's words begin)."""
    data, offsets = text_buffers(column)
    clean = np.where(_LETTER[data], _LOWER[data], np.uint8(32))
    begin, at = word_starts(clean, offsets)
    return clean, begin, at


def _length_class(words: np.ndarray) -> np.ndarray:
    """A term for each doubling of a text's number of words."""
    return mix(np.uint64(977) + np.frexp(words.astype(np.float64))[1].astype(np.uint64)) >> np.uint64(64 - TABLE_BITS)


def text_terms(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed terms of each text, ascending; none without letters.

    Terms are its words, the heads of longer words, for what comes 2, 3 and 4 times a further one each, and the class of its length.
    """
    clean, begin, at = _words(column)
    if len(begin) == 0:
        yield from (np.zeros(0, np.int64) for _ in range(len(at) - 1))
        return
    _, offsets = text_buffers(column)
    gaps = np.append(np.flatnonzero(clean == 32), len(clean))
    stop = np.minimum(gaps[np.searchsorted(gaps, begin)], np.repeat(offsets[1:], np.diff(at)))
    terms, owners = [word_hashes(clean, begin, lower=True)], [np.arange(len(begin))]
    for size in _HEADS:
        own = np.flatnonzero(stop - begin > size)
        total = np.full(len(own), size, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x100000001B3) + clean[begin[own] + k]
        terms.append(mix(total))
        owners.append(own)
    bits, low = np.uint64(TABLE_BITS), np.uint64((1 << TABLE_BITS) - 1)
    text_of = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    both, times = np.unique((text_of[np.concatenate(owners)] << bits) | (np.concatenate(terms) >> np.uint64(64 - TABLE_BITS)),
                            return_counts=True)
    words = np.diff(at)
    full = np.flatnonzero(words)
    parts = [both, (full.astype(np.uint64) << bits) | _length_class(words[full])]
    for level in _REPEATS:
        often = both[times >= level]
        parts.append((often >> bits << bits) | (mix((often & low) + np.uint64(level << 40)) >> np.uint64(64 - TABLE_BITS)))
    both = np.unique(np.concatenate(parts))
    cuts = np.searchsorted(both, np.arange(len(at), dtype=np.uint64) << bits)
    both = (both & low).astype(np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield both[lo:hi]


def _sums(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Sums by owner; owners are ascending."""
    out = np.zeros((count, *values.shape[1:]))
    if len(values):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] = np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out


def margins(machine: Machine, texts: list[np.ndarray]) -> np.ndarray:
    """Log odds of each text, with all pairs of its terms, in time linear in them."""
    rows = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    mine = machine.factors[rows]
    inner = _sums(mine, owner, len(texts))
    squares = _sums((mine ** 2).sum(axis=1), owner, len(texts))
    return machine.bias + _sums(machine.weights[rows], owner, len(texts)) + ((inner ** 2).sum(axis=1) - squares) / 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _telling(texts: list[np.ndarray], truth: np.ndarray, deviations: float) -> np.ndarray:
    """For each term whether enough texts have it, and toxic ones far more or less often than chance would give."""
    none = np.zeros(0, np.int64)
    seen = np.bincount(np.concatenate([none, *texts]), minlength=1 << TABLE_BITS)
    with_toxic = np.bincount(np.concatenate([none, *(x for x, y in zip(texts, truth) if y)]), minlength=1 << TABLE_BITS)
    share = (truth.sum() + 0.5) / (len(truth) + 1)
    return (seen >= LEAST_TEXTS) & (np.abs(with_toxic - seen * share) >= deviations * np.sqrt(seen * share * (1 - share)))


def train(texts: list[np.ndarray], toxic: list[int], factors: int = FACTORS, deviations: float = LEAST_DEVIATIONS,
          seed: int = 3) -> Machine:
    """Fits a machine to distinct terms of texts and their labels, by gradient steps on the logistic loss.

    Weights are given to terms that tell toxic texts (``LEAST_TEXTS``, ``deviations``), and to those that tell them
    among the texts that have one of the first, such as whom an insult names; the rest stay 0. Without texts all is 0.
    """
    truth = np.array(toxic, float)
    share = (truth.sum() + 0.5) / (len(truth) + 1)
    used = _telling(texts, truth, deviations)
    among = np.array([bool(used[x].any()) for x in texts], bool)
    used = np.flatnonzero((used | _telling([x for x, y in zip(texts, among) if y], truth[among], deviations)))
    column = np.full(1 << TABLE_BITS, -1)
    column[used] = np.arange(len(used))
    texts = [c[c >= 0] for c in (column[x] for x in texts)]
    rng = np.random.default_rng(seed)
    # One row per term: its weight and its factors.
    table = np.concatenate([np.zeros((len(used), 1)), rng.normal(0, 0.01, (len(used), factors))], axis=1)
    squares = np.full_like(table, 0.1)
    bias, bias_square = float(np.log(share / (1 - share))), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            own = order[lo: lo + BATCH]
            rows = np.concatenate([texts[k] for k in own])
            owner = np.repeat(np.arange(len(own)), [len(texts[k]) for k in own])
            part = table[rows]
            sums = _sums(part, owner, len(own))
            bent = ((sums[:, 1:] ** 2).sum(axis=1) - _sums((part[:, 1:] ** 2).sum(axis=1), owner, len(own))) / 2
            slope = (_sigmoid(bias + sums[:, 0] + bent) - truth[own]) / len(own)
            pull = np.concatenate([np.ones((len(own), 1)), sums[:, 1:]], axis=1)[owner]
            pull[:, 1:] -= part[:, 1:]
            pull *= slope[owner][:, None]
            by_term = np.argsort(rows, kind="stable")
            touched, first = np.unique(rows[by_term], return_index=True)
            if len(touched):
                change = np.add.reduceat(pull[by_term], first, axis=0) + DECAY * table[touched]
                squares[touched] += change ** 2
                table[touched] -= STEP * change / np.sqrt(squares[touched])
            bias_square += slope.sum() ** 2
            bias -= STEP * slope.sum() / np.sqrt(bias_square)
    weights, mine = np.zeros(1 << TABLE_BITS, np.float32), np.zeros((1 << TABLE_BITS, factors), np.float32)
    weights[used], mine[used] = table[:, 0], table[:, 1:]
    return Machine(float(bias), weights, mine)


def _terms(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        terms = [np.sort(x[np.argsort(mix(x.astype(np.uint64)))[:most]]) for x in text_terms(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int32()))],
                                         names=["text_key", "toxic", "terms"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, texts: int = TRAIN_TEXTS, terms: int = TRAIN_TERMS) -> Machine:
    """A machine from at most ``texts`` different labelled texts of ``docs`` (doc_id, text), those with the least hash of doc_id.

    ``labels`` has doc_id and toxic (0 or 1). Only rows where ``usable`` holds and doc_id and text are not
    null are learned from; a doc_id that is labelled both ways is not. Copies of a text count once. Hashed
    terms, not texts, go to the driver, at most ``terms`` of each text. Without labels every text gets an even score.
    """
    own = docs.where(usable & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = own.select("doc_id", F.xxhash64("text").alias("text_key")).distinct()
    marks = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.min("toxic").alias("least"), F.max("toxic").alias("toxic")).where("least = toxic").drop("least"))
    least = F.min(F.struct(F.xxhash64("doc_id").alias("turn"), "doc_id", "toxic")).alias("least")
    chosen = (rows.join(marks, "doc_id").groupBy("text_key").agg(least)
              .orderBy("least.turn", "text_key").limit(texts).select("least.doc_id", "text_key", "least.toxic").collect())
    if not chosen:
        return train([], [])
    known = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, text_key long, toxic int"))
    found = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found = (found.join(known, ["doc_id", "text_key"]).select("text", "text_key", "toxic")
             .mapInArrow(partial(_terms, most=terms), "text_key long, toxic int, terms array<int>")
             .groupBy("text_key").agg(F.first("toxic").alias("toxic"), F.first("terms").alias("terms")))
    table = found.toArrow().sort_by("text_key")
    lists = table.column("terms").combine_chunks()
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy().astype(np.int64)
    return train([values[lo:hi] for lo, hi in zip(at[:-1], at[1:])], table.column("toxic").to_pylist())


def _scored(batches: Iterator[pa.RecordBatch], model: Broadcast, column: str) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        scores = _sigmoid(margins(model.value, list(text_terms(batch.column("text")))))
        names = [n for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores)], names=[*names, column])


def with_toxicity(docs: DataFrame, machine: Machine, column: str = "toxicity") -> DataFrame:
    """``docs`` (with a text column) and ``column``: the probability that the text is toxic, read from the whole text alone.

    Null texts and texts without letters get the score of no terms, the bias. Texts of any length are scored in
    time linear in them; equal texts get equal scores. Columns of ``docs`` are kept, but one named ``column``
    is replaced. Each row is scored by itself, so repeated rows repeat, and no rows give no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != column]
    return docs.mapInArrow(partial(_scored, model=model, column=column), ", ".join([*kept, f"`{column}` double"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from the labelled documents that are not held out."""
    machine = fit(docs, labels, ~held_out(F.col("doc_id")))
    found = with_toxicity(docs.select("doc_id", "text"), machine, "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
