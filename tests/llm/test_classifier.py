"""The classifier's features and descent against plain loops and finite differences."""

import math

import numpy as np
import pytest

from gridpulse.llm import classifier as C

TEXTS = ["one two two two", "ä 日本 😀x", "The the THE end", "a", "word " * 30 + "other", "   ", ""]
U64 = (1 << 64) - 1


def plain_bucket(h, salt):
    h = (h + salt) * 0x9E3779B97F4A7C15 & U64
    return (((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 & U64) >> 40) % C.BUCKETS


def plain_word(word):
    """Buckets of a word: its n-grams between < and >, and the whole."""
    points, out = [ord(c) for c in f"<{word}>"], []
    for n in C.GRAMS:
        for i in range(len(points) - n + 1):
            h = 0
            for p in points[i:i + n]:
                h = (h * 0x100000001B3 + p) & U64
            out.append(plain_bucket(h, n))
    total = 0
    for i, p in enumerate(points):
        weight = (2 * i + 1) * 0x9E3779B97F4A7C15 & U64
        total = (total + p * (weight ^ (weight >> 31))) & U64
    return [*out, plain_bucket(total, 99)]


def plain_features(text):
    words = text.split()
    words = [w + C.REPEAT if i and words[i - 1] == w else w for i, w in enumerate(words)]
    out = {}
    for w in words:
        own = plain_word(w)
        for b in own:
            out[b] = out.get(b, 0) + 1 / len(own) / len(words)
    return out


def plain_score(model, text):
    vector = np.zeros(C.DIMENSION)
    for bucket, weight in plain_features(text).items():
        vector += weight * model.vectors[bucket]
    a, b = vector @ model.layer + model.bias
    return 1 / (1 + math.exp(a - b))


def test_features_match_plain_loops():
    for text in TEXTS:
        buckets, weights = C.text_features(text)
        want = plain_features(text)
        assert dict(zip(buckets.tolist(), weights.tolist())) == pytest.approx(want)


def test_scores_match_plain_loops():
    rng = np.random.default_rng(3)
    model = C.Model(rng.normal(size=(C.BUCKETS, C.DIMENSION)), rng.normal(size=(C.DIMENSION, 2)), rng.normal(size=2))
    assert C.score(model, TEXTS).tolist() == pytest.approx([plain_score(model, t) for t in TEXTS])


def loss(vectors, layer, bias, features, label):
    buckets, weights = features
    out = (vectors[buckets] * weights[:, None]).sum(0) @ layer + bias
    return math.log(np.exp(out).sum()) - out[label]


@pytest.mark.parametrize("label", [0, 1])
def test_a_step_follows_the_gradient(monkeypatch, label):
    for name, value in (("BUCKETS", 40), ("EPOCHS", 1), ("BATCH", 1), ("LEAST_STEPS", 1), ("RATE", 1e-3)):
        monkeypatch.setattr(C, name, value)
    buckets, weights = C.text_features("some words of one text")
    features = (buckets, weights.astype(float))
    rng = np.random.default_rng(C.SEED)
    vectors = rng.uniform(-1, 1, (40, C.DIMENSION)) / C.DIMENSION
    layer, bias = rng.normal(0, 0.5, (C.DIMENSION, 2)), np.zeros(2)
    model = C.train([features], np.array([label]))

    def slope(part, at, step=1e-6):
        moved = [vectors.copy(), layer.copy(), bias.copy()]
        moved[part][at] += step
        up = loss(*moved, features, label)
        moved[part][at] -= 2 * step
        return (up - loss(*moved, features, label)) / (2 * step)

    for at in [(int(b), d) for b in buckets[:5] for d in (0, 3, 7)]:
        assert (vectors[at] - model.vectors[at]) / C.RATE == pytest.approx(slope(0, at), abs=1e-6)
    for at in [(0, 0), (3, 1), (7, 0)]:
        assert (layer[at] - model.layer[at]) / (0.05 * C.RATE) == pytest.approx(slope(1, at), abs=1e-6)
    assert (bias - model.bias) / (0.05 * C.RATE) == pytest.approx([slope(2, (i,)) for i in (0, 1)], abs=1e-6)
    untouched = np.setdiff1d(np.arange(40), buckets)
    assert np.array_equal(model.vectors[untouched], vectors[untouched])


def test_training_is_the_descent_of_a_plain_loop(monkeypatch):
    for name, value in (("EPOCHS", 2), ("BATCH", 3), ("LEAST_STEPS", 1), ("RATE", 2.0)):
        monkeypatch.setattr(C, name, value)
    texts, labels = [f"good text {i} of words" for i in range(5)] + ["bad bad bad"] * 2, np.array([1] * 5 + [0] * 2)
    features = [C.text_features(t) for t in texts]
    got = C.train(features, labels)
    rng = np.random.default_rng(C.SEED)
    vectors = rng.uniform(-1, 1, (C.BUCKETS, C.DIMENSION)) / C.DIMENSION
    layer, bias, done, steps = rng.normal(0, 0.5, (C.DIMENSION, 2)), np.zeros(2), 0, 6
    for _ in range(2):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), 3):
            rate, some = 2.0 * (1 - done / steps), order[at:at + 3]
            done += 1
            g_vectors, g_layer, g_bias = {}, np.zeros_like(layer), np.zeros(2)
            for r in some:
                text = sum(w * vectors[b] for b, w in zip(*features[r]))
                out = np.exp(text @ layer + bias)
                error = out / out.sum() - np.eye(2)[labels[r]]
                g_layer += np.outer(text, error) / len(some)
                g_bias += error / len(some)
                for b, w in zip(*features[r]):
                    g_vectors[b] = g_vectors.get(b, 0) + w * (layer @ error) / len(some)
            layer -= rate * 0.05 * g_layer
            bias -= rate * 0.05 * g_bias
            for b, g in g_vectors.items():
                vectors[b] -= rate * g
    assert np.allclose(got.layer, layer, atol=1e-9) and np.allclose(got.bias, bias, atol=1e-9) and np.allclose(got.vectors, vectors, atol=1e-6)
