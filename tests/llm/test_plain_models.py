"""The classifiers' scores against plain versions that go word by word and piece by piece."""

import re

import numpy as np
import pyarrow as pa
import zstandard

from gridlark.llm import hashing, quality, toxicity
from test_models_and_files import area, labelled_rows

ODD = ["", " ", "one", "Word " * 31, "a b " * 16, "x" * 500, "É ü 日本 A9-b_c", "many words here " * 300]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_toxicity(model, text):
    """The network read off its definition: a loop over windows, words and bytes."""
    p, size, hidden = model.params, toxicity.WORD_SIZE, toxicity.HIDDEN
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    rows = {int(h): i + 1 for i, h in enumerate(model.vocabulary)}

    def inputs(word):
        data = np.frombuffer(word, np.uint8)
        known = rows.get(int(hashing.hashes(data, np.array([0]), np.array([len(data)]))[0]), 0)
        around = [0, *word, 0]
        triples = [
            (around[i - 1] * 7919 + around[i] * 104729 + around[i + 1] * 1299709) % toxicity.TRIPLES
            for i in range(1, len(word) + 1)
        ]
        return np.concatenate([p["words"][known], np.mean([p["chars"][t] for t in triples], axis=0)]).astype(float)

    def states(gates, side):
        h, out = np.zeros(hidden), []
        for x in gates if side == "f" else gates[::-1]:
            z = sigmoid(x[:hidden] + h @ p[f"u{side}"][:, :hidden])
            r = sigmoid(x[hidden : 2 * hidden] + h @ p[f"u{side}"][:, hidden : 2 * hidden])
            n = np.tanh(x[2 * hidden :] + r * (h @ p[f"u{side}"][:, 2 * hidden :]))
            h = h + (1 - z) * (n - h)
            out.append(h)
        return out if side == "f" else out[::-1]

    logits, start = [], 0
    while True:
        window = words[start : start + toxicity.WINDOW]
        if window:
            gates = [inputs(w) @ p["wx"] + p["bx"] for w in window]
            both = [np.concatenate(s) for s in zip(states([g[: 3 * hidden] for g in gates], "f"), states([g[3 * hidden :] for g in gates], "b"))]
            weight = np.exp([np.tanh(h @ p["wa"] + p["ba"]) @ p["va"] for h in both])
            pooled = sum(w * h for w, h in zip(weight / weight.sum(), both))
            logits.append(float(pooled @ p["wo"] + p["bo"][0]))
        if start + toxicity.WINDOW >= len(words):
            break
        start += toxicity.STRIDE
    assert size + toxicity.CHAR_SIZE == len(p["wx"])
    return sigmoid(np.clip(model.slope * max(logits) + model.shift, -30, 30)) if logits else None


def test_toxicity_is_the_plain_network():
    rows, held = labelled_rows("toxic", 4, 2, 60)
    model = toxicity.train(rows, epochs=2)
    texts = [r[1] for r in held[:25]] + ODD
    got = model.scores(pa.array(texts, pa.string()))
    for text, score in zip(texts, got):
        plain = plain_toxicity(model, text)
        assert plain is None or abs(plain - score) < 2e-3, text[:60]
    # A text without words gets one score, whatever else it holds.
    assert len({round(float(s), 6) for t, s in zip(texts, got) if plain_toxicity(model, t) is None}) == 1


def plain_quality(model, text):
    data = text.encode()
    number = max(1, round(len(data) / 4000))
    parts = [data[len(data) * i // number : len(data) * (i + 1) // number] for i in range(number)]

    def size(dictionary):
        total = 0
        for part in parts:
            if dictionary is None:
                total += len(zstandard.ZstdCompressor(level=3).compress(part))
            else:
                made = zstandard.ZstdCompressionDict(dictionary)
                total += len(zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=False).compress(part))
        return total

    good, bad, plain = size(model.good), size(model.bad), size(None)
    mean = len(data) / number + 16
    x = [(bad - good) / (bad + good), good / (mean * number), bad / (mean * number), plain / (mean * number), np.log(min(mean, 4000))]
    x += [x[i] * x[j] for i in range(5) for j in range(i, 5)]
    z = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.centre, model.scale))
    return sigmoid(np.clip(z, -30, 30))


def test_quality_is_the_plain_formula():
    rows, held = labelled_rows("quality", 5, 0, 200)
    model = quality.train(rows)
    texts = [r[1] for r in held[:25]] + ODD + ["long " + held[0][1] * 40]
    for text, score in zip(texts, model.scores(texts)):
        assert abs(plain_quality(model, text) - score) < 1e-6, text[:60]


def test_the_size_difference_alone_tells_good_from_bad():
    """How much of the calibrated score is in the difference itself."""
    rows, held = labelled_rows("quality", 5, 0, 400)
    model = quality.train(rows)
    labels = [r[2] for r in held]

    alone = area([model.difference(r[1])[0] for r in held], labels)
    whole = area(model.scores([r[1] for r in held]), labels)
    print(f"area under the curve: difference alone {alone:.3f}, calibrated {whole:.3f}")
    assert alone > 0.8 and whole > 0.95
