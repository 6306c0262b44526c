"""Personal data in texts: patterns, and a character-level bidirectional LSTM with CRF transitions."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.language_id import chain_marginals
from logweir.llm.spans import Span, apart, digest, in_order, joined
from logweir.llm.words import small_batches

KINDS = ("email", "ip", "card", "phone")
# Documents with findings, and as many with digits but none, that the network is trained on.
TRAIN_DOCUMENTS = 200
WINDOW, STRIDE, REACH = 64, 32, 24
HIDDEN, EPOCHS = 16, 10
# A span of the network is kept when its mean probability is at least this.
LEAST_SCORE = 0.9
LEAST_LENGTH = 7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits is read from its first digit; from a later one nothing else could match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_HINT = r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|[0-9]([ -]?[0-9]){11}"

# Classes of characters: 0 pads, then digit, lower, upper, other letter, other, and these one by one.
_OWN = "@.-+() %_:,\n/\"'"
_CLASSES = 6 + len(_OWN)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in one pass: the run of local characters before each at sign, then the domain after it."""
    done, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    found = [(*span, "email") for span in _emails(text)]
    if _TRIGGER.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), "card"))
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return in_order(found, KINDS)


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(128, 5, np.int64)
    table[48:58], table[97:123], table[65:91] = 1, 2, 3
    for k, c in enumerate(_OWN):
        table[ord(c)] = 6 + k
    return np.where(codes < 128, table[np.minimum(codes, 127)], 4)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around every digit and at sign: what is sought has one of them."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _windows(length: int) -> list[int]:
    return [0] if length <= WINDOW else [*range(0, length - WINDOW, STRIDE), length - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Lstm:
    """One direction: weights of the character classes, of the state, and the bias, gates i, f, o, g."""

    def __init__(self, rng: np.random.Generator):
        self.inputs = rng.normal(0, 0.3, (_CLASSES, 4 * HIDDEN)).astype(np.float32)
        self.state = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros(4 * HIDDEN, np.float32)
        self.bias[HIDDEN:2 * HIDDEN] = 1

    def run(self, x: np.ndarray, keep: bool = False):
        """Outputs (time, rows, hidden) of classes (time, rows); with what training needs."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, tape = np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(len(x)):
            z = self.inputs[x[t]] + h @ self.state + self.bias
            gates, g = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                tape.append((h, c, i, f, o, g, squashed))
            h, c = o * squashed, new
            out[t] = h
        return out, tape

    def slopes(self, x: np.ndarray, tape: list, back: np.ndarray) -> list[np.ndarray]:
        inputs, state, bias = np.zeros_like(self.inputs), np.zeros_like(self.state), np.zeros_like(self.bias)
        dh = dc = np.zeros_like(back[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, squashed = tape[t]
            dh = dh + back[t]
            dc = dc + dh * o * (1 - squashed ** 2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
            np.add.at(inputs, x[t], dz)
            state += h.T @ dz
            bias += dz.sum(axis=0)
            dh, dc = dz @ self.state.T, dc * f
        return [inputs, state, bias]


@dataclass
class Tagger:
    ahead: _Lstm
    back: _Lstm
    output: np.ndarray
    offset: np.ndarray
    transitions: np.ndarray

    def emissions(self, x: np.ndarray, keep: bool = False):
        one, tape = self.ahead.run(x, keep)
        two, other = self.back.run(x[::-1], keep)
        both = np.concatenate([one, two[::-1]], axis=2)
        return both @ self.output + self.offset, both, tape, other


def _chains(width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.arange(rows), width), np.repeat(np.arange(width), rows)


def fit_windows(x: np.ndarray, y: np.ndarray) -> Tagger:
    """Gradient steps on the likelihood of the tags ``y`` of windows ``x`` (rows, time)."""
    rng = np.random.default_rng(11)
    kinds = len(KINDS) + 1
    net = Tagger(_Lstm(rng), _Lstm(rng), rng.normal(0, 0.2, (2 * HIDDEN, kinds)).astype(np.float32), np.zeros(kinds, np.float32),
                 np.zeros((kinds, kinds)))
    held = [net.ahead.inputs, net.ahead.state, net.ahead.bias, net.back.inputs, net.back.state, net.back.bias, net.output, net.offset,
            net.transitions]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), 64):
            own = order[lo: lo + 64]
            codes, tags = x[own].T, y[own].T
            scores, both, tape, other = net.emissions(codes, keep=True)
            found, pairs = chain_marginals(scores.reshape(-1, kinds), *_chains(WINDOW, len(own)), net.transitions)
            slope = found.reshape(scores.shape)
            slope[np.arange(WINDOW)[:, None], np.arange(len(own)), tags] -= 1
            slope = (slope / len(own)).astype(np.float32)
            seen = np.zeros_like(net.transitions)
            np.add.at(seen, (tags[:-1].ravel(), tags[1:].ravel()), 1)
            into = slope @ net.output.T
            grads = [*net.ahead.slopes(codes, tape, into[:, :, :HIDDEN]), *net.back.slopes(codes[::-1], other, into[::-1, :, HIDDEN:]),
                     np.einsum("tbh,tbk->hk", both, slope), slope.sum(axis=(0, 1)), (pairs - seen) / len(own)]
            step += 1
            for p, g, m, v in zip(held, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (1e-2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(p.dtype)
    return net


def _variants(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The text, and each of its spans written as people also write it."""
    yield text, spans
    for start, end, kind in spans:
        own = text[start:end]
        digits = re.sub(r"\D", "", own)
        other = {"email": own.replace("@", " @ "), "card": "-".join(digits[k: k + 4] for k in range(0, len(digits), 4)),
                 "phone": own.split(" ", 1)[-1].replace("+", ""), "ip": own}[kind]
        left, right = max(0, start - 2 * REACH), min(len(text), end + 2 * REACH)
        yield text[left:start] + other + text[end:right], [(start - left, start - left + len(other), kind)]


def train(texts: list[str]) -> Tagger | None:
    """A tagger from the base spans of ``texts``; None where there are none."""
    x, y = [], []
    for text in texts:
        spans = base_spans(text)
        for version, marked in _variants(text, spans):
            codes = _classes(version)
            tags = np.zeros(len(version), np.int64)
            for start, end, kind in reversed(marked):
                tags[start:end] = 1 + KINDS.index(kind)
            for start, end in regions(version):
                for at in _windows(end - start):
                    piece = slice(start + at, min(end, start + at + WINDOW))
                    fill = WINDOW - len(codes[piece])
                    x.append(np.pad(codes[piece], (0, fill))), y.append(np.pad(tags[piece], (0, fill)))
    if not x or not np.any(y):
        return None
    return fit_windows(np.array(x), np.array(y))


def fit(docs: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Tagger | None:
    """Trains on at most ``documents`` texts with findings and as many with digits but none, those with the least hash."""
    rows = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("turn"))
    hint, digits = F.col("text").rlike(_HINT), F.col("text").rlike("[0-9]")
    sample = [rows.where(c).orderBy("turn", "text").limit(documents).select("text").collect() for c in (hint, digits & ~hint)]
    return train([row["text"] for part in sample for row in part])


def model_spans(net: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans per text: overlapping windows are tagged, positions in several of them are averaged with more weight to a
    window's middle, and each region is decoded as a whole by its most probable path."""
    places = [(k, start, end, at) for k, text in enumerate(texts) for start, end in regions(text) for at in _windows(end - start)]
    out: list[list[Span]] = [[] for _ in texts]
    if not places:
        return out
    codes = {k: _classes(texts[k]) for k in {p[0] for p in places}}
    kinds = len(KINDS) + 1
    edge = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float64)
    sums: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    for lo in range(0, len(places), 2048):
        own = places[lo: lo + 2048]
        pieces = [codes[k][start + at: min(end, start + at + WINDOW)] for k, start, end, at in own]
        x = np.array([np.pad(p, (0, WINDOW - len(p))) for p in pieces]).T
        scores = net.emissions(x)[0]
        found, _ = chain_marginals(scores.reshape(-1, kinds), *_chains(WINDOW, len(own)), net.transitions)
        found = found.reshape(scores.shape)
        for row, ((k, start, end, at), piece) in enumerate(zip(own, pieces)):
            total, weight = sums.setdefault((k, start, end), (np.zeros((end - start, kinds)), np.zeros(end - start)))
            n = len(piece)
            total[at: at + n] += found[:n, row] * edge[:n, None]
            weight[at: at + n] += edge[:n]
    move = net.transitions - np.log(np.exp(net.transitions).sum(axis=1, keepdims=True))
    for (k, start, end), (total, weight) in sums.items():
        mean = total / weight[:, None]
        path = _best_path(np.log(mean + 1e-9), 0.2 * move)
        change = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
        for a, b in zip(change[:-1], change[1:]):
            tag = path[a]
            if tag and b - a >= LEAST_LENGTH and mean[a:b, tag].mean() >= LEAST_SCORE:
                own_text = texts[k][start + a: start + b]
                lead = len(own_text) - len(own_text.lstrip())
                tail = len(own_text) - len(own_text.rstrip())
                out[k].append((int(start + a + lead), int(start + b - tail), KINDS[tag - 1]))
    return out


def _best_path(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    best, came = scores[0], []
    for t in range(1, len(scores)):
        ways = best[:, None] + move
        came.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + scores[t]
    path = [int(best.argmax())]
    for step in reversed(came):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def _scanned(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    net: Tagger | None = model.value
    for batch in small_batches(batches):
        texts = [text or "" for text in batch.column("text").to_pylist()]
        base = [base_spans(text) for text in texts]
        spans = [list(found) for found in base]
        if net is not None:
            for own, known, more in zip(spans, base, model_spans(net, texts)):
                own += [span for span in more if apart(span[:2], known)]
        counts = [[sum(s[2] == kind for s in found) for found in base] for kind in KINDS]
        kept = [k for k, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([digest(found) for found in base]), pa.array([joined(in_order(found, KINDS)) for found in spans])],
            names=[*(batch.schema.names[k] for k in kept), *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    Base spans are found by pattern in the whole text, in code points. The tagger reads every
    stretch around a digit or an at sign and adds spans of the same kinds that overlap no base
    span. Null texts read as empty. spans lists kind:start:end by start, then kind. No rows give
    no rows; other columns do not matter.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_scanned, model=model), f"doc_id long, {counts}, base_sha256 string, spans string")


def found_personal_data(docs: DataFrame) -> DataFrame:
    return personal_data(docs, fit(docs))
