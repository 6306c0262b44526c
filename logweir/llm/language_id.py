"""Languages of words and texts by a linear-chain conditional random field."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.words import small_batches, text_buffers, word_hashes, word_starts

# Documents per language, and runs of words of each, that the field is trained on.
TRAIN_DOCUMENTS = 150
TRAIN_RUNS, RUN_WORDS = 8, 24
EPOCHS, BATCH, STEP = 6, 96, 0.4
# Longest chain; longer texts are several chains.
CHAIN = 64
TABLE_BITS = 18
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[32, *range(9, 14)]] = 0
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Field:
    """Languages, feature weights (rows of a hashed table), and transitions, all learned."""

    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray


def _hashed(*parts: np.ndarray) -> np.ndarray:
    """Table rows of byte n-grams; the number of parts tells n-grams of different length apart."""
    total = np.full(len(parts[0]), len(parts) * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k, part in enumerate(parts):
        total += part * np.uint32((0x85EBCA6B * (2 * k + 1) | 1) & 0xFFFFFFFF)
        total *= np.uint32(0xC2B2AE35)
        total ^= total >> np.uint32(15)
    return total >> np.uint32(32 - TABLE_BITS)


def _features(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram rows per byte, affix and lexicon rows per word)."""
    low = np.concatenate([np.zeros(2, np.uint32), _LOWER[data], np.zeros(3, np.uint32)])
    n = len(data)
    at = [low[k: k + n] for k in range(5)]
    grams = np.stack([_hashed(at[1], at[2], at[3]), _hashed(at[0], at[1], at[2], at[3])])
    nonzero = np.flatnonzero(at[2])
    stop = nonzero[np.searchsorted(nonzero, np.append(begin[1:], n)) - 1] if len(begin) else begin
    first = [low[begin + 2 + k] for k in range(3)]
    last = [low[np.maximum(stop - k, begin - 1) + 2] for k in range(3)]
    salt = np.full(len(begin), 77, np.uint32)
    lexicon = (word_hashes(data, begin, lower=True) >> np.uint64(64 - TABLE_BITS)).astype(np.uint32)
    affixes = np.stack([_hashed(*first[:2], salt, salt), _hashed(*first, salt, salt), _hashed(*last[:2], salt, salt, salt),
                        _hashed(*last, salt, salt, salt), lexicon])
    return grams, affixes


def _emissions(field: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Score of each language for each word."""
    grams, affixes = _features(data, begin)
    per_byte = field.take(grams[0], axis=0)
    per_byte += field.take(grams[1], axis=0)
    per_byte[_LOWER[data] == 0] = 0
    scores = np.add.reduceat(per_byte, begin, axis=0)
    for rows in affixes:
        scores += field.take(rows, axis=0)
    return scores


def chain_marginals(scores: np.ndarray, chain: np.ndarray, steps: np.ndarray, transitions: np.ndarray):
    """Forward-backward over padded chains: probabilities of each word's languages, and the summed pair probabilities.

    ``chain`` and ``steps`` are each word's chain and place in it.
    """
    width, count, kinds = int(steps.max()) + 1, int(chain.max()) + 1, scores.shape[1]
    local = np.ones((width, count, kinds), np.float32)
    there = np.zeros((width, count), bool)
    local[steps, chain] = np.exp(scores - scores.max(axis=1, keepdims=True))
    there[steps, chain] = True
    move = np.exp(transitions).astype(np.float32)
    ahead = np.empty_like(local)
    ahead[0] = local[0] / local[0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        ahead[t] = (ahead[t - 1] @ move) * local[t]
        ahead[t] /= ahead[t].sum(axis=1, keepdims=True)
    back = np.ones((count, kinds), np.float32)
    both = np.empty_like(local)
    both[width - 1] = ahead[width - 1]
    pairs = np.zeros((kinds, kinds))
    for t in range(width - 2, -1, -1):
        seen = there[t + 1][:, None]
        onward = local[t + 1] * back
        each = ahead[t][:, :, None] * move[None] * onward[:, None, :]
        total = each.sum(axis=(1, 2), keepdims=True)
        pairs += (each / total * seen[:, :, None]).sum(axis=0)
        back = np.where(seen, onward @ move.T, 1)
        back /= back.sum(axis=1, keepdims=True)
        both[t] = ahead[t] * back
        both[t] /= both[t].sum(axis=1, keepdims=True)
    return both[steps, chain], pairs


def _word_marginals(scores: np.ndarray, chain: np.ndarray, steps: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """As ``chain_marginals`` without pairs, for labelling."""
    width, count, kinds = int(steps.max()) + 1, int(chain.max()) + 1, scores.shape[1]
    local = np.ones((width, count, kinds), np.float32)
    there = np.zeros((width, count, 1), bool)
    local[steps, chain] = np.exp(scores - scores.max(axis=1, keepdims=True))
    there[steps, chain] = True
    move = np.exp(transitions).astype(np.float32)
    ahead = local
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    own = [local[0].copy()]
    for t in range(1, width):
        own.append(local[t].copy())
        ahead[t] *= ahead[t - 1] @ move
        ahead[t] /= ahead[t].sum(axis=1, keepdims=True)
    back = np.ones((count, kinds), np.float32)
    for t in range(width - 1, -1, -1):
        onward = (own[t] * back) @ move.T
        ahead[t] *= back
        back = np.where(there[t], onward / onward.sum(axis=1, keepdims=True), 1)
    found = ahead[steps, chain]
    return found / found.sum(axis=1, keepdims=True)


def _training_chains(texts: list[str], labels: list[int], rng: np.random.Generator) -> tuple[list[bytes], list[list[int]]]:
    """Runs of words from all over each text; every other chain changes to a run of another text in its middle."""
    runs = []
    for text, label in zip(texts, labels):
        words = text.encode().split()
        for k in np.unique(np.linspace(0, max(len(words) - RUN_WORDS, 0), TRAIN_RUNS).astype(int)):
            if part := words[k: k + RUN_WORDS]:
                runs.append((part, label))
    order = rng.permutation(len(runs))
    chains, marks = [], []
    for place, k in enumerate(order):
        (words, label), (other, other_label) = runs[k], runs[order[place - 1]]
        half = len(words) // 2 if place % 2 else len(words)
        mixed = words[:half] + (other[half:] if place % 2 else [])
        chains.append(b" ".join(mixed))
        marks.append([label] * half + [other_label] * (len(mixed) - half))
    return chains, marks


def train(texts: list[str], languages: list[str]) -> Field | None:
    """Fits the field to labelled texts by gradient steps on the likelihood; None without any words."""
    names = tuple(sorted(set(languages)))
    rng = np.random.default_rng(5)
    chains, marks = _training_chains(texts, [names.index(x) for x in languages], rng)
    if not chains:
        return None
    kinds = len(names)
    weights = np.zeros((1 << TABLE_BITS, kinds), np.float32)
    squares = np.full_like(weights, 1e-2)
    transitions, move_squares = np.zeros((kinds, kinds)), np.full((kinds, kinds), 1.0)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), BATCH):
            own = order[lo: lo + BATCH]
            data = np.frombuffer(b" ".join(chains[k] for k in own), np.uint8)
            length = np.array([len(marks[k]) for k in own])
            begin, _ = word_starts(data, np.array([0, len(data)]))
            chain = np.repeat(np.arange(len(own)), length)
            steps = np.arange(len(chain)) - np.repeat(np.cumsum(length) - length, length)
            truth = np.concatenate([marks[k] for k in own])
            found, pairs = chain_marginals(_emissions(weights, data, begin), chain, steps, transitions)
            slope = -found / len(own)
            slope[np.arange(len(truth)), truth] += 1 / len(own)
            seen = np.zeros((kinds, kinds))
            inside = chain[1:] == chain[:-1]
            np.add.at(seen, (truth[:-1][inside], truth[1:][inside]), 1)
            change = (seen - pairs) / len(own)
            move_squares += change ** 2
            transitions += STEP * change / np.sqrt(move_squares)
            grams, affixes = _features(data, begin)
            word_of = np.searchsorted(begin, np.arange(len(data)), side="right") - 1
            real = _LOWER[data] != 0
            rows = np.concatenate([grams[0][real], grams[1][real], *affixes])
            owner = np.concatenate([word_of[real], word_of[real], *[np.arange(len(begin))] * len(affixes)])
            touched, at = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(at, slope[owner, k], len(touched)) for k in range(kinds)], axis=1).astype(np.float32)
            squares[touched] += total ** 2
            weights[touched] += STEP * total / np.sqrt(squares[touched])
    return Field(names, weights, transitions)


def fit(docs: DataFrame, usable: Column, documents: int = TRAIN_DOCUMENTS) -> Field | None:
    """A field from at most ``documents`` labelled rows of each language, those with the least hash of doc_id.

    Only rows where ``usable`` holds and text, lang and doc_id are not null are learned from. None
    where there are none.
    """
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (rows.select("lang", "doc_id").withColumn("turn", F.row_number().over(order))
              .where(F.col("turn") <= documents).select("lang", "doc_id").collect())
    ids = sorted({row["doc_id"] for row in chosen})
    sample = rows.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", "text").collect() if ids else []
    sample = sorted(sample, key=lambda row: (row["lang"], row["doc_id"], row["text"]))
    return train([row["text"] for row in sample], [row["lang"] for row in sample])


def _labelled(batches: Iterator[pa.RecordBatch], model: Broadcast, with_runs: bool) -> Iterator[pa.RecordBatch]:
    field: Field | None = model.value
    for batch in small_batches(batches):
        column = batch.column("text")
        letters = np.array([bool(x and _LETTER.search(x)) for x in column.to_pylist()], bool)
        # Two spaces part each text from the next, so that no n-gram reaches into another text.
        data, offsets = text_buffers(pc.binary_join_element_wise(column.fill_null(""), pa.scalar("  "), pa.scalar("")))
        begin, at = word_starts(data, offsets)
        languages = np.full(batch.num_rows, UNKNOWN, dtype=object)
        scores = np.zeros(batch.num_rows)
        runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        if field is not None and len(begin):
            count = np.diff(at)
            doc = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(begin)) - np.repeat(at[:-1], count)
            chains = -(-count // CHAIN)
            chain = np.repeat(np.cumsum(chains) - chains, count) + place // CHAIN
            found = _word_marginals(_emissions(field.weights, data, begin), chain, place % CHAIN, field.transitions)
            lettered = np.add.reduceat(_IS_LETTER[data].astype(np.int32), begin) > 0
            sums = np.stack([np.bincount(doc, found[:, k] * lettered, len(count)) for k in range(len(field.languages))], axis=1)
            total = np.maximum(np.bincount(doc, lettered, len(count)), 1)
            best = sums.argmax(axis=1)
            languages[letters] = np.array(field.languages, dtype=object)[best[letters]]
            scores[letters] = np.clip(sums[np.arange(len(count)), best] / total, 0, 1)[letters]
            if with_runs:
                label = found.argmax(axis=1)
                new = np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])
                first = np.flatnonzero(new)
                for k, n in zip(first.tolist(), np.diff(np.append(first, len(label))).tolist()):
                    runs[doc[k]].append({"lang": field.languages[label[k]], "first": int(place[k]), "words": n})
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(languages, pa.string()), pa.array(scores), pa.array(runs, kind)],
            names=[*batch.schema.names, "lang_pred", "score", "lang_runs"])


def with_languages(docs: DataFrame, field: Field | None, with_runs: bool = True) -> DataFrame:
    """``docs`` (with a text column) and lang_pred, score and lang_runs.

    Words are labelled by their marginal probabilities; lang_pred is the language with the highest
    mean over the words that have letters, score that mean. lang_runs are the runs of words
    with one most probable language: lang, first word, number of words. lang_pred is
    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Prediction reads the text alone. Columns of ``docs`` are kept; one that is named like a
    new one raises. No rows give no rows.
    """
    if clash := {"lang_pred", "score", "lang_runs"} & set(docs.columns):
        raise ValueError(f"reserved column names: {sorted(clash)}")
    model = docs.sparkSession.sparkContext.broadcast(field)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_labelled, model=model, with_runs=with_runs),
                           f"{fields}, lang_pred string, score double, lang_runs array<struct<lang: string, first: int, words: int>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents that are not held out."""
    field = fit(docs, ~held_out(F.col("doc_id")))
    found = with_languages(docs.select("doc_id", "text"), field, with_runs=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
