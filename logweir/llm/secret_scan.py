"""Secrets in texts: patterns, and a character convolutional network over every candidate and its context."""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from logweir.llm.scratch import written
from logweir.llm.spans import Span, apart, digest, in_order, joined
from logweir.llm.words import small_batches

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "model")
# A third of the texts is kept for calibration; the threshold keeps this share of their findings.
LEAST_RECALL = 0.98
# Examples a task learns from in a round. Rounds are repeated until so many examples were seen, within bounds.
TASK_EXAMPLES = 50_000
SEEN_EXAMPLES, LEAST_ROUNDS, MOST_ROUNDS = 100_000, 2, 12
# Logits are counted in steps of this part of 1, up to a greatest one.
_LOGIT_STEPS, _MOST_LOGIT = 100, 40

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Tokens with a digit, from their first character on.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{12,}+")
# Values of any length: after a name and : or =, after a word for secrets, and in or after quotation marks.
_VALUES = (
    re.compile(r"""(?<=[A-Za-z0-9_"'`\])])\x20?[:=](?!//)[=>]?\x20*+["'`]?([^\s"'`,;]++)"""),
    re.compile(r"""(?i)\b(?:pass(?:word|wd|phrase|code)s?|pwd|secrets?|tokens?|(?:api[_-]?)?keys?|bearer|credentials?|pin)\x20(?:(?:is|was)\x20)?["'`]?([^\s"'`,;]++)"""),
    re.compile(r"""(?<![A-Za-z0-9])["'`](?:([^\s"'`][^\n"'`]*+)(?=["'`])|([^\s"'`]++))["'`]?"""),
)

BEFORE, HEAD, TAIL, AFTER = 20, 28, 8, 8
_WIDTH = BEFORE + HEAD + TAIL + AFTER
_REGIONS = (slice(0, BEFORE - 3), slice(BEFORE, BEFORE + HEAD + TAIL - 3), slice(BEFORE + HEAD + TAIL - 3, _WIDTH - 3))
_CODES, _EMBED, _TAPS, _FILTERS = 97, 8, 4, 16
_WEIGHTS = ("embed", "filters", "bias", "dense", "offset")
_WORD = re.compile(r"(?<!\S)\S{6,}+")


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(found, KINDS)


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens and values that the network judges; a token and a value in it are both."""
    values = {m.span(m.lastindex) for pattern in _VALUES for m in pattern.finditer(text)}
    return sorted(values.union(m.span() for m in _CANDIDATE.finditer(text)))


def _code(text: str) -> list[int]:
    return [ord(c) - 31 if " " <= c <= "~" else 96 for c in text]


def _view(text: str, start: int, end: int) -> list[int]:
    """Codes of the context before, the head and tail of the candidate, and the context after; 0 pads."""
    before, after = _code(text[max(0, start - BEFORE): start]), _code(text[end: end + AFTER])
    own = _code(text[start: min(end, start + HEAD)]), _code(text[max(start + HEAD, end - TAIL): end])
    return ([0] * (BEFORE - len(before)) + before + own[0] + [0] * (HEAD - len(own[0])) + own[1] + [0] * (TAIL - len(own[1]))
            + after + [0] * (AFTER - len(after)))


def _pieces(start: int, end: int) -> list[tuple[int, int]]:
    """What a candidate is judged by: the whole and, where that is longer than a view, overlapping stretches of it."""
    width = HEAD + TAIL
    if end - start <= width:
        return [(start, end)]
    return [(start, end), *((k, k + width) for k in range(start, end - width, width // 2)), (end - width, end)]


@dataclass
class Network:
    """Embedding, one convolution, the greatest answer of each filter in each region, one logistic unit; calibration."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0
    # Share of the calibration part's findings at the threshold.
    recall: float = 0.0

    def forward(self, codes: np.ndarray):
        seen = self.embed[codes]
        patches = np.concatenate([seen[:, k: _WIDTH - _TAPS + 1 + k] for k in range(_TAPS)], axis=2)
        answers = np.maximum(patches @ self.filters + self.bias, 0)
        pooled = np.concatenate([answers[:, r].max(axis=1) for r in _REGIONS], axis=1)
        return patches, answers, pooled, pooled @ self.dense + self.offset[0]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        logits = np.concatenate([self.forward(codes[k: k + 512])[3] for k in range(0, len(codes), 512)] or [np.zeros(0)])
        return self.calibrated(logits)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def span_scores(net: Network, asked: list[tuple[str, tuple[int, int]]]) -> np.ndarray:
    """The highest score of the views of each candidate (text, span)."""
    out = np.zeros(len(asked))
    views: list[list[int]] = []
    owners: list[int] = []

    def judge() -> None:
        np.maximum.at(out, np.array(owners, int), net.scores(np.array(views, np.int64).reshape(-1, _WIDTH)))
        views.clear(), owners.clear()

    for k, (text, span) in enumerate(asked):
        for piece in _pieces(*span):
            views.append(_view(text, *piece)), owners.append(k)
            if len(views) == 4096:
                judge()
    judge()
    return out


def _initial() -> Network:
    rng = np.random.default_rng(3)
    return Network(rng.normal(0, 0.3, (_CODES, _EMBED)), rng.normal(0, 0.2, (_TAPS * _EMBED, _FILTERS)), np.zeros(_FILTERS),
                   rng.normal(0, 0.2, 3 * _FILTERS), np.zeros(1))


class _Descent:
    """Steps of Adam from a network, a batch of examples at a time."""

    def __init__(self, net: Network):
        self.net, self.rng, self.step = net, np.random.default_rng(4), 0
        self.first, self.second = {n: 0.0 for n in _WEIGHTS}, {n: 0.0 for n in _WEIGHTS}

    def learn(self, codes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """One step for each 64 of the examples, in random order."""
        net = self.net
        order = self.rng.permutation(len(codes))
        for lo in range(0, len(order), 64):
            own = order[lo: lo + 64]
            patches, answers, pooled, logit = net.forward(codes[own])
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) * weight[own] / len(own)
            back = np.zeros_like(answers)
            for k, region in enumerate(_REGIONS):
                best = answers[:, region].argmax(axis=1) + region.start
                rows, columns = np.ogrid[:len(own), :_FILTERS]
                live = answers[rows, best, columns] > 0
                back[rows, best, columns] += slope[:, None] * net.dense[k * _FILTERS:(k + 1) * _FILTERS] * live
            by_patch = back @ net.filters.T
            embed = np.zeros_like(net.embed)
            for k in range(_TAPS):
                np.add.at(embed, codes[own][:, k: _WIDTH - _TAPS + 1 + k], by_patch[:, :, k * _EMBED:(k + 1) * _EMBED])
            grads = {"embed": embed, "filters": np.tensordot(patches, back, ((0, 1), (0, 1))), "bias": back.sum(axis=(0, 1)),
                     "dense": slope @ pooled, "offset": slope.sum(keepdims=True)}
            self.step += 1
            for n in _WEIGHTS:
                self.first[n] = 0.9 * self.first[n] + 0.1 * grads[n]
                self.second[n] = 0.999 * self.second[n] + 0.001 * grads[n] ** 2
                move = self.first[n] / (1 - 0.9 ** self.step) / (np.sqrt(self.second[n] / (1 - 0.999 ** self.step)) + 1e-8)
                setattr(net, n, getattr(net, n) - 5e-3 * move)


def _balance(labels: np.ndarray, findings: float, others: float) -> np.ndarray:
    """Weights by which findings and others count alike."""
    return np.where(labels == 1, 0.5 / max(findings, 1), 0.5 / max(others, 1)) * (findings + others)


def _fit_network(codes: np.ndarray, labels: np.ndarray, epochs: int = 12) -> Network:
    descent = _Descent(_initial())
    for _ in range(epochs):
        descent.learn(codes, labels, _balance(labels, labels.sum(), (1 - labels).sum()))
    return descent.net


def _calibrate(net: Network, codes: np.ndarray, labels: np.ndarray, least_recall: float, least_score: float = 0.0) -> None:
    """``_calibrate_counts`` from the examples themselves."""
    _calibrate_counts(net, net.forward(codes)[3], labels, np.ones(len(codes)), least_recall, least_score)


def _calibrate_counts(net: Network, logits: np.ndarray, labels: np.ndarray, counts: np.ndarray, least_recall: float, least_score: float) -> None:
    """Fits scale and shift of the logits, then takes the highest threshold that keeps ``least_recall`` of the findings.

    A ``least_score`` above that threshold gives up recall for precision; ``net.recall`` is what is reached.
    """
    scale, shift, part = 1.0, 0.0, counts / counts.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -30, 30)))
        gap = (p - (labels * 0.98 + 0.01)) * part
        scale, shift = scale - 0.05 * float(np.sum(gap * logits)), shift - 0.05 * float(np.sum(gap))
    net.scale, net.shift = max(scale, 1e-3), shift
    scores, own = net.calibrated(logits[labels == 1]), counts[labels == 1]
    order = np.argsort(scores)
    scores, below = scores[order], np.cumsum(own[order])
    if len(scores) == 0:
        net.threshold, net.recall = 1.0, 0.0
        return
    at = int(np.searchsorted(below, int((1 - least_recall) * below[-1]), side="right"))
    net.threshold = float(max(scores[at], least_score))
    net.recall = float(own[order][scores >= net.threshold].sum() / below[-1])


def _text_examples(text: str, rng: np.random.Generator) -> Iterator[tuple[list[int], int]]:
    """(view, label) of all findings and all other candidates of a text, and of some of its words."""
    base = base_spans(text)

    def views(text: str, start: int, end: int, label: int) -> Iterator[tuple[list[int], int]]:
        """The whole, and at most four of the other views."""
        first, *more = _pieces(start, end)
        for piece in [first, *(more[k] for k in rng.permutation(len(more))[:4])]:
            yield _view(text, *piece), label

    for start, end, kind in base:
        value = text[start:end] if kind != "assign" else re.search(r"[A-Za-z0-9+/_.=-]+$", text[start:end])[0]
        yield from views(text, end - len(value), end, 1)
        # The value alone, elsewhere: what it looks like must tell.
        if len(text) > BEFORE + AFTER and any(c.isdigit() for c in value) and len(value) >= 12:
            at = int(rng.integers(len(text)))
            near, past = text[max(0, at - BEFORE): at] + " ", " " + text[at: at + AFTER]
            yield from views(near + value + past, len(near), len(near) + len(value), 1)
            # In the middle of a path, cut as the views over it fall; and the path without it.
            at = int(rng.integers(len(text)))
            path = "/".join(re.findall(r"[A-Za-z0-9]+", text[at: at + 400])[:40]) + "/"
            shift = max(0, len(path) + int(rng.integers(-8, 9)))
            yield _view(path + value + "/" + path, shift, shift + HEAD + TAIL), 1
            yield from views(path, 0, len(path), 0)
    for span in candidates(text):
        if apart(span, base):
            yield from views(text, *span, 0)
    # Words are no candidates; a text without findings shows one, for there are many such texts.
    for _ in range(4 if base else 1):
        if text and (word := _WORD.search(text, int(rng.integers(len(text))))) and apart(word.span(), base):
            yield _view(text, *word.span()), 0


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Views with labels from every text; a third of the texts, by their hash, is kept for calibration."""
    for batch in small_batches(batches):
        views, labels, checked = [], [], []
        for text in batch.column(0).to_pylist():
            turn = zlib.crc32(text.encode("utf-8", "surrogatepass"))
            for view, label in _text_examples(text, np.random.default_rng(turn)):
                views.append(bytes(view)), labels.append(label), checked.append(turn % 3 == 2)
        yield pa.RecordBatch.from_arrays([pa.array(views, pa.binary()), pa.array(labels, pa.int32()), pa.array(checked, pa.bool_())],
                                         names=["view", "label", "checked"])


def _codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _WIDTH)


def _descend(batches: Iterator[pa.RecordBatch], model: Broadcast, findings: int, others: int) -> Iterator[pa.RecordBatch]:
    """(n, weights): the network after one pass over the examples of a task."""
    descent, n = _Descent(model.value), 0
    for batch in batches:
        labels = batch.column(1).to_numpy().astype(np.float64)
        descent.learn(_codes_of(batch.column(0)), labels, _balance(labels, findings, others))
        n += len(labels)
    if n:
        flat = np.concatenate([getattr(descent.net, name).ravel() for name in _WEIGHTS])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], names=["n", "weights"])


def _logit_counts(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = _codes_of(batch.column(0))
        logits = np.concatenate([model.value.forward(codes[k: k + 512])[3] for k in range(0, len(codes), 512)] or [np.zeros(0)])
        steps = np.floor(np.clip(logits, -_MOST_LOGIT, _MOST_LOGIT) * _LOGIT_STEPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(steps)], names=["label", "step"])


def _averaged(rows: list[Row]) -> Network:
    """The network whose weights are the mean of those found, by how many examples each has seen."""
    net, at = _initial(), 0
    mean = np.average([row["weights"] for row in rows], axis=0, weights=[row["n"] for row in rows])
    for name in _WEIGHTS:
        like = getattr(net, name)
        setattr(net, name, mean[at: at + like.size].reshape(like.shape))
        at += like.size
    return net


def fit(docs: DataFrame, least_recall: float = LEAST_RECALL, least_score: float = 0.0, task_examples: int = TASK_EXAMPLES) -> Network | None:
    """A network from all texts of ``docs``: their findings, and what is none; None without one of the two.

    Every text's examples are written and dealt out. In a round each task goes over its examples once from the same network, and
    the mean of what the tasks find begins the next round. Few examples are gone over more often. All logits of the calibration
    part are counted by steps of ``1 / _LOGIT_STEPS``, and the threshold is the lower edge of a step; see ``_calibrate_counts``.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.where("text IS NOT NULL").select("text").mapInArrow(_examples, "view binary, label int, checked boolean")
    found = written(rows, "examples")
    counts = {(row["label"], row["checked"]): row["count"] for row in found.groupBy("label", "checked").count().collect()}
    known = {label: sum(n for (own, _), n in counts.items() if own == label) for label in (0, 1)}
    if not known[0] or not known[1]:
        return None
    learned, checked = found.where("NOT checked"), found.where("checked")
    if not all((1, part) in counts and (0, part) in counts for part in (False, True)):
        learned = checked = found
    else:
        known = {label: counts[label, False] for label in (0, 1)}
    n = sum(known.values())
    dealt = written(learned.select("view", "label").repartition(-(-n // task_examples)), "dealt")
    net = _initial()
    for _ in range(min(max(-(-SEEN_EXAMPLES // n), LEAST_ROUNDS), MOST_ROUNDS)):
        step = partial(_descend, model=context.broadcast(net), findings=known[1], others=known[0])
        net = _averaged(dealt.mapInArrow(step, "n long, weights array<double>").collect())
    judged = checked.select("view", "label").mapInArrow(partial(_logit_counts, model=context.broadcast(net)), "label int, step long")
    steps = judged.groupBy("label", "step").count().orderBy("label", "step").toPandas()
    _calibrate_counts(net, steps["step"].to_numpy() / _LOGIT_STEPS, steps["label"].to_numpy(), steps["count"].to_numpy(np.float64),
                      least_recall, least_score)
    return net


def _scanned(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    net: Network | None = model.value
    for batch in small_batches(batches):
        texts = [text or "" for text in batch.column("text").to_pylist()]
        base = [base_spans(text) for text in texts]
        spans = [list(found) for found in base]
        if net is not None:
            asked = [(k, span) for k, text in enumerate(texts) for span in candidates(text) if apart(span, base[k])]
            if asked:
                scores = span_scores(net, [(texts[k], span) for k, span in asked])
                for (k, (start, end)), score in zip(asked, scores):
                    if score >= net.threshold:
                        spans[k].append((start, end, "model"))
        counts = [[sum(s[2] == kind for s in found) for found in base] for kind in BASE_KINDS]
        kept = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([digest(found) for found in base]), pa.array([joined(in_order(found, KINDS)) for found in spans])],
            names=[*(batch.schema.names[k] for k in kept), "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secrets(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    Base spans are found by pattern in the whole text, in code points. Every other token of 12
    or more characters with a digit, and every value after a name and : or =, after a word for
    secrets or in quotation marks, is a candidate, which the network judges with its surroundings,
    long ones by overlapping views; those at its threshold are spans of kind ``model``. Null texts read as empty.
    spans lists kind:start:end by start, then kind. No rows give no rows; other columns do not matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_scanned, model=model),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def found_secrets(docs: DataFrame) -> DataFrame:
    return secrets(docs, fit(docs))
