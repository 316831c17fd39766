"""Supervised subword embeddings: a document is the average of learned vectors of its words and character n-grams.

Words and n-grams are hashed into one table of vectors. The vector of a text is the mean over its words of the
mean over each word's features; a softmax layer gives the class. Table and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.texts import map_texts

SAMPLE_ROWS = 4000           # labelled documents that are fitted on, at most
BUCKETS = 1 << 15
DIMENSION = 8
GRAMS = (2, 3, 4)
EPOCHS, BATCH, RATE = 10, 48, 20.0
LEAST_STEPS = 800            # a small sample is gone through more often
REPEAT = "\u21bb"
SEED = 7


@dataclass
class Model:
    vectors: np.ndarray      # BUCKETS x DIMENSION
    layer: np.ndarray        # DIMENSION x 2
    bias: np.ndarray         # 2


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, its word's place): each word's hash and those of its n-grams between < and >."""
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    prime, mix = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    buckets, owners = [], []

    def settle(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h + np.uint64(salt)) * mix
        return ((h ^ (h >> np.uint64(29))) * mix >> np.uint64(40)) % np.uint64(BUCKETS)

    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[:len(points) - n + 1] * prime + points[n - 1:]
        if n in GRAMS:
            whole = word[:len(word) - n + 1] == word[n - 1:]
            buckets.append(settle(h[whole], n))
            owners.append(word[:len(word) - n + 1][whole])
    # Of the whole word: a position-weighted sum.
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * mix
    total = np.add.reduceat(points * (weight ^ (weight >> np.uint64(31))), np.cumsum(sizes) - sizes)
    buckets.append(settle(total, 99))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _coded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, the word of each place, the text of each place).

    A word that repeats the one before it is a word of its own, with ``REPEAT`` at its end: the n-grams at that
    end are the same for all words, so that stuttering texts share features.
    """
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.array([w for s in split for w in s], object)
    codes, words = pd.factorize(flat)
    owner, words = np.repeat(np.arange(len(texts)), sizes), list(words)
    again = np.r_[False, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])] if len(codes) else np.zeros(0, bool)
    if again.any():
        repeated, place = np.unique(codes[again], return_inverse=True)
        codes[again] = len(words) + place
        words += [words[c] + REPEAT for c in repeated]
    return words, codes, owner


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights): a text's vector is the weighted sum of the table's rows. Empty for a text without words."""
    words, codes, _ = _coded([text])
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    bucket, owner = word_features(words)
    each = np.bincount(codes, minlength=len(words)) / len(codes) / np.bincount(owner, minlength=len(words))
    weight = np.bincount(bucket, each[owner], minlength=BUCKETS)
    used = np.flatnonzero(weight)
    return used.astype(np.int32), weight[used].astype(np.float32)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over mini-batches with a falling rate."""
    rng = np.random.default_rng(SEED)
    model = Model(rng.uniform(-1, 1, (BUCKETS, DIMENSION)) / DIMENSION, np.zeros((DIMENSION, 2)), np.zeros(2))
    labels = np.asarray(labels, np.int64)
    if not len(labels):
        return model
    model.layer = rng.normal(0, 0.5, (DIMENSION, 2))
    batches = -(-len(labels) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            sizes = [len(features[r][0]) for r in rows]
            bucket = np.concatenate([features[r][0] for r in rows]).astype(np.int64)
            weight = np.concatenate([features[r][1] for r in rows]).astype(np.float64)
            owner = np.repeat(np.arange(len(rows)), sizes)
            taken = model.vectors[bucket] * weight[:, None]
            text = np.stack([np.bincount(owner, taken[:, d], minlength=len(rows)) for d in range(DIMENSION)], axis=1)
            error = softmax(text @ model.layer + model.bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ model.layer.T
            model.layer -= rate * 0.05 * text.T @ error
            model.bias -= rate * 0.05 * error.sum(0)
            for d in range(DIMENSION):
                model.vectors[:, d] -= np.bincount(bucket, rate * back[owner, d] * weight, minlength=BUCKETS)
    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for each text."""
    words, codes, owner = _coded(texts)
    total = np.zeros((len(texts), DIMENSION))
    if words:
        # Vectors of the different words first, in blocks: memory follows the words of a block.
        table = np.empty((len(words), DIMENSION))
        vectors = model.vectors
        for at in range(0, len(words), 20_000):
            bucket, place = word_features(words[at:at + 20_000])
            size = min(20_000, len(words) - at)
            count = np.bincount(place, minlength=size)
            for d in range(DIMENSION):
                table[at:at + size, d] = np.bincount(place, vectors[bucket, d], minlength=size) / count
        for d in range(DIMENSION):
            total[:, d] = np.bincount(owner, table[codes, d], minlength=len(texts))
        total /= np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
    return softmax(total @ model.layer + model.bias)[:, 1]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                label: str = "quality", most: int = SAMPLE_ROWS, held_out: int = 1) -> Model:
    """Model fitted on at most ``most`` labelled documents outside the held-out fold, the first by a hash of the id.

    Labels other than 0 and 1 (null too) are no labels; several labels of one id count by their majority, a tie as
    1. Without labels every score is 0.5. The sample's ids are broadcast (``most`` rows at most); features are made
    where the texts lie.
    """
    key = F.col(f"`{doc_id}`")
    chosen = labels.select(key.alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & (fold(F.col("doc_id")) != held_out)) \
        .groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label")) \
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id")

    def make():
        def work(texts):
            both = [text_features(t) for t in texts]
            return [[b for b, _ in both], [w for _, w in both]]
        return work

    found = map_texts(rows, ["doc_id", "label"], "text", "buckets array<int>, weights array<float>", make) \
        .orderBy("doc_id", F.hash("buckets")).limit(most).toArrow().combine_chunks()
    # Arrow lists, not Python ones: the sample stays a few dozen megabytes.
    buckets, weights = (_arrays(found.column(c)) for c in ("buckets", "weights"))
    return train(list(zip(buckets, weights)), found.column("label").to_numpy())


def _arrays(column) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return out


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, score and predicted for every row; a null or empty text gets the score of no words."""
    def make():
        return lambda texts: [score(model, texts)]
    return map_texts(docs, keep, text, "score double", make).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted as label 1, all columns unchanged whatever their names."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return score_documents(held, model, ["row"]).where("predicted = 1").select("row.*")
