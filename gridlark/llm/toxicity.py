"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read in overlapping windows of words. A word enters the network twice: by an embedding of
the word itself, where the training texts have it often enough, and by the mean embedding of its
character triples, which also covers words never seen. Two gated recurrent layers read the window
forwards and backwards, attention weighs the words, and a logistic output scores the window. A text's
score is its most toxic window's, calibrated on the training texts and moved from the sample's to the
labels' shares of the classes. Windows of ``WINDOW`` words start at every ``STRIDE``-th word: together they
cover all words, but a passage of more than ``WINDOW - STRIDE + 1`` words need not lie whole in one.

Labels are learnt from a sample of at most ``PER_CLASS`` documents of each class, of at most
``LONGEST`` characters, drawn from the rows that are not held out; training runs on the driver.

Defined results: a null text counts as empty; a text without words is one window of padding; without
labels of both classes every score is 0.5; every row gets one row; an empty table gives none; other
columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.hashing import hashes, slices, text_bytes
from gridlark.llm.labelled import remainder, sample

MODULUS, HELD = 4, 2
THRESHOLD = 0.3
PER_CLASS = 1000
LONGEST = 10_000
WINDOW, STRIDE = 32, 16
# Sizes: word and character embeddings, hidden units of each direction, attention.
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTEND = 8, 8, 8, 8
TRIPLES = 4096
MOST_WORDS = 20_000
LEAST_DOCS = 3
CHUNK_BYTES = 2 << 20
LANES = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Words:
    """The words of some texts: distinct ones with their character triples, and where each stands."""

    keys: np.ndarray  # hash of each distinct word
    triples: np.ndarray  # triples of all distinct words in a row
    triple_counts: np.ndarray
    which: np.ndarray  # distinct word at every place of the texts
    counts: np.ndarray  # words per text


def read_words(texts: pa.Array) -> Words:
    data, bounds = text_bytes(texts)
    if not len(data):
        return Words(np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int), np.empty(0, int), np.zeros(len(texts), int))
    data = _LOWER[data]
    inside = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    found = hashes(data, starts, ends)
    order = np.argsort(found, kind="stable")
    new = np.ones(len(found), bool)
    new[1:] = found[order][1:] != found[order][:-1]
    which = np.empty(len(found), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    lengths = (ends - starts)[first]
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    here = np.repeat(starts[first], lengths) + place
    last = np.repeat(lengths, lengths) - 1
    before = np.where(place > 0, data[np.maximum(here - 1, 0)], 0).astype(np.int64)
    after = np.where(place < last, data[np.minimum(here + 1, len(data) - 1)], 0).astype(np.int64)
    triples = (before * 7919 + data[here].astype(np.int64) * 104729 + after * 1299709) % TRIPLES
    return Words(found[first], triples, lengths, which, counts)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows: the place of the first word, how many words, and the text."""
    number = 1 + -(-np.maximum(0, counts - WINDOW) // STRIDE)
    text = np.repeat(np.arange(len(counts)), number)
    step = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = np.repeat(np.cumsum(counts) - counts, number) + step * STRIDE
    return start, np.minimum(WINDOW, counts[text] - step * STRIDE), text


def _group_sums(rows: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(groups, rows[:, i], n) for i in range(rows.shape[1])]).astype(np.float32)


def _inputs(p: Params, known: np.ndarray, triples: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Both embeddings of words, side by side; ``known`` is the word's row, 0 for an unknown one."""
    if not len(known):
        return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32)
    sums = np.add.reduceat(p["chars"][triples], np.cumsum(counts) - counts)
    return np.concatenate([p["words"][known], sums / counts[:, None]], axis=1).astype(np.float32)


def _gru(p: Params, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states by step, [steps, lanes, HIDDEN]; ``x`` holds the three gates' inputs."""
    u, h = p[f"u{side}"], np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
    steps = range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1)
    for t in steps:
        hu = h @ u
        gates = sigmoid(x[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = h + mask[t][:, None] * ((1 - z) * (n - h))
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out


def _gru_back(p: Params, side: str, keep: list, mask: np.ndarray, d_out: np.ndarray, grad: Params) -> np.ndarray:
    """Gradient of the gates' inputs; adds the recurrent weights' own."""
    u, du = p[f"u{side}"], np.zeros_like(p[f"u{side}"])
    dx = np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    dh = np.zeros(d_out.shape[1:], np.float32)
    for t, h, z, r, n, hn in reversed(keep):
        m = mask[t][:, None]
        d = dh + d_out[t]
        dn = d * m * (1 - z) * (1 - n * n)
        dz = -d * m * (n - h) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        du += h.T @ dhu
        dh = d * (1 - m * (1 - z)) + dhu @ u.T
    grad[f"u{side}"] = du
    return dx


def _window_logits(p: Params, gates: np.ndarray, place: np.ndarray, mask: np.ndarray, keep: dict | None = None):
    """Logits of windows; ``gates`` holds each distinct word's gate inputs, ``place`` [steps, lanes]."""
    states = []
    for i, side in enumerate("fb"):
        x = gates[:, i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN][place]
        tape = [] if keep is not None else None
        states.append(_gru(p, side, x, mask, tape))
        if keep is not None:
            keep[side] = tape
    h = np.concatenate(states, axis=2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    e = a @ p["va"] + (mask - 1) * 30
    e = np.exp(e - e.max(axis=0))
    weight = e / e.sum(axis=0)
    pooled = (weight[:, :, None] * h).sum(axis=0)
    if keep is not None:
        keep |= {"h": h, "a": a, "weight": weight, "pooled": pooled}
    return pooled @ p["wo"] + p["bo"]


def _gradients(p: Params, known, triples, counts, place, mask, labels, weights) -> Params:
    """Gradients of the weighted cross entropy of some windows."""
    x = _inputs(p, known, triples, counts)
    gates = x @ p["wx"] + p["bx"]
    keep: dict = {}
    d = ((sigmoid(_window_logits(p, gates, place, mask, keep)) - labels) * weights / len(labels)).astype(np.float32)
    g: Params = {"wo": keep["pooled"].T @ d, "bo": d.sum(keepdims=True)}
    d_pooled = d[:, None] * p["wo"]
    h, a, weight = keep["h"], keep["a"], keep["weight"]
    d_weight = (h * d_pooled).sum(axis=2)
    de = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["va"] = np.tensordot(a, de, ([0, 1], [0, 1]))
    da = de[:, :, None] * p["va"] * (1 - a * a)
    flat = da.reshape(-1, ATTEND)
    g["wa"], g["ba"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
    dh = weight[:, :, None] * d_pooled + da @ p["wa"].T
    sides = [_gru_back(p, s, keep[s], mask, dh[:, :, i * HIDDEN : (i + 1) * HIDDEN], g) for i, s in enumerate("fb")]
    d_gates = _group_sums(np.concatenate(sides, axis=2).reshape(-1, 6 * HIDDEN), place.ravel(), len(known))
    g["wx"], g["bx"] = x.T @ d_gates, d_gates.sum(axis=0)
    dx = d_gates @ p["wx"].T
    g["words"] = _group_sums(dx[:, :WORD_SIZE], known, len(p["words"]))
    spread = np.repeat(dx[:, WORD_SIZE:] / counts[:, None], counts, axis=0)
    g["chars"] = _group_sums(spread, triples, TRIPLES)
    return g


def _some(words: Words, known: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Inputs of the chosen windows alone: their distinct words, and places among these."""
    step = np.arange(WINDOW)[:, None]
    mask = step < size
    which = words.which[np.minimum(start + step, len(words.which) - 1)] if len(words.which) else np.zeros_like(step + start)
    used, place = np.unique(np.where(mask, which, which[:1]), return_inverse=True)
    ends = np.cumsum(words.triple_counts)
    counts = words.triple_counts[used]
    at = np.repeat(ends[used] - counts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return known[used], words.triples[at], counts, place.reshape(which.shape), mask.astype(np.float32)


@dataclass
class ToxicityModel:
    params: Params
    vocabulary: np.ndarray  # sorted hashes of the known words; the word in place i has row i + 1
    slope: float = 1.0
    shift: float = 0.0
    trained: bool = field(default=True)

    def known(self, words: Words) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(words.keys), np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, words.keys), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == words.keys, place + 1, 0)

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of every window."""
        start, size, text = windows_of(words.counts)
        p = self.params
        gates = _inputs(p, self.known(words), words.triples, words.triple_counts) @ p["wx"] + p["bx"]
        if not len(gates):
            gates = np.zeros((1, 6 * HIDDEN), np.float32)
            words = Words(words.keys, words.triples, words.triple_counts, np.zeros(1, np.int64), words.counts)
        out = np.empty(len(start), np.float32)
        step = np.arange(WINDOW)[:, None]
        for i in range(0, len(start), LANES):
            s, n = start[i : i + LANES], size[i : i + LANES]
            place = words.which[np.minimum(s + step, len(words.which) - 1)]
            out[i : i + LANES] = _window_logits(p, gates, place, (step < n).astype(np.float32))
        return out, text

    def text_logits(self, texts: pa.Array) -> np.ndarray:
        """The logit of each text's strongest window."""
        logits, text = self.window_logits(read_words(texts))
        return np.maximum.reduceat(logits, np.flatnonzero(np.diff(text, prepend=-1))).astype(np.float64)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.trained or not len(texts):
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.text_logits(texts) + self.shift, -30, 30)))


def _calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one number, by damped Newton steps.

    Labels are drawn in by one row of either class, so that separable texts give no infinite slope.
    """
    centre, scale = x.mean(), x.std() + 1e-6
    x, ones = (x - centre) / scale, y.sum()
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    w = np.zeros(2)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        v = q * (1 - q) + 1e-6
        hessian = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, [((goal - q) * x).sum(), (goal - q).sum()] - 0.01 * w)
        w += np.clip(step, -1, 1)
    slope = max(w[0], 0.1) / scale
    return float(slope), float(w[1] - slope * centre)


def train(rows: list[tuple[int, str, int]], epochs: int = 6, batch: int = 256, rate: float = 0.01) -> ToxicityModel:
    """Two passes over windows drawn from all texts, then passes over each text's strongest window.

    A toxic text need not be toxic in every window; after the first passes the network itself says
    which window carries its label. Of a harmless text the strongest windows are shown as harmless.
    """
    rng = np.random.default_rng(17)
    # Every fourth text is kept for the calibration; a network is too sure of the texts it has learnt.
    check, rows = rows[::4], [r for i, r in enumerate(rows) if i % 4]
    texts, labels = pa.array([t for _, t, _ in rows], pa.string()), np.array([y for _, _, y in rows], np.float32)
    words = read_words(texts)
    owner = np.repeat(np.arange(len(rows)), words.counts)
    seen, where = np.unique(np.stack([words.which, owner]), axis=1)
    docs = np.bincount(seen, minlength=len(words.keys))
    toxic = np.bincount(seen, labels[where], minlength=len(words.keys))
    often = np.flatnonzero(docs >= LEAST_DOCS)
    often = often[np.argsort(-docs[often], kind="stable")][:MOST_WORDS]
    vocabulary = np.sort(words.keys[often])
    size = WORD_SIZE + CHAR_SIZE
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p: Params = {
        "words": 0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_SIZE)).astype(np.float32),
        "chars": 0.3 * rng.standard_normal((TRIPLES, CHAR_SIZE)).astype(np.float32),
        "wx": normal(size, 6 * HIDDEN),
        "bx": np.zeros(6 * HIDDEN, np.float32),
        "uf": normal(HIDDEN, 3 * HIDDEN),
        "ub": normal(HIDDEN, 3 * HIDDEN),
        "wa": normal(2 * HIDDEN, ATTEND),
        "ba": np.zeros(ATTEND, np.float32),
        "va": normal(ATTEND),
        "wo": normal(2 * HIDDEN),
        "bo": np.zeros(1, np.float32),
    }
    # The first number of a word's embedding starts as its log odds, from the documents that have it.
    ones = labels.sum()
    odds = np.log((toxic + 0.5) / (ones + 1)) - np.log((docs - toxic + 0.5) / (len(labels) - ones + 1))
    p["words"][1:, 0] = 0.5 * odds[often][np.argsort(words.keys[often])]
    model = ToxicityModel(p, vocabulary)
    if len(set(labels.tolist())) < 2 or not len(words.which):
        model.trained = False
        return model
    known = model.known(words)
    start, length, text = windows_of(words.counts)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0
    for epoch in range(epochs):
        if epoch < 2:
            chosen = rng.permutation(len(start))[: 24 * len(rows)]
        else:
            logits, _ = model.window_logits(words)
            # Strongest first within each text: one window of a toxic text, three of a harmless one.
            order = np.lexsort((-logits, text))
            rank = np.arange(len(order)) - np.searchsorted(text, text[order])
            chosen = rng.permutation(order[rank < np.where(labels[text[order]] == 1, 1, 3)])
            chosen = np.concatenate([chosen, rng.permutation(chosen)])
        for i in range(0, len(chosen), batch):
            some, step = chosen[i : i + batch], step + 1
            y, w = labels[text[some]], weight[text[some]]
            g = _gradients(p, *_some(words, known, start[some], length[some]), y, w)
            speed = rate * min(1.0, step / 20) * (1 - 0.8 * epoch / epochs)
            for k, d in g.items():
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.01 * (d * d - second[k])
                hat = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
                p[k] -= speed * (first[k] / (1 - 0.9**step)) / hat
    if len({y for _, _, y in check}) == 2:
        logits = model.text_logits(pa.array([t for _, t, _ in check], pa.string()))
        model.slope, model.shift = _calibration(logits, np.array([y for _, _, y in check], float))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    drawn = sample(docs, labels, "toxic", MODULUS, HELD, per_class, LONGEST)
    model = train(drawn.rows)
    if model.trained:
        ones = sum(y for _, _, y in drawn.rows)
        odds = np.log(drawn.ones / drawn.zeros) - np.log(ones / (len(drawn.rows) - ones))
        model.shift += float(odds)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(text_bytes(batch.column(1))[1], CHUNK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.scores(part.column(1)))], names=["doc_id", "score"]
                )

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (remainder("doc_id", MODULUS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
