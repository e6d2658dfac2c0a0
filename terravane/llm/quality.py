"""A quality classifier of learned subword embeddings.

A document is the mean of the learned vectors of its words, word-pair echoes and character n-grams, hashed into ``2**bits`` buckets; a softmax
layer turns it into the probability of label 1. Both are trained together by stochastic gradient descent in numpy on a
bounded sample of the labelled rows. As the score is linear in the features, a trained model is one number a bucket.

Edge cases: null and empty texts have no features and get the score of the bias alone; labels that are null or other than 0
and 1 and labels of absent documents are passed over; a document labelled more than once counts with its least label; with no
labels of both kinds every score is the share of label 1, or 0.5; texts are read whole; repeated rows score alike; an empty
table gives no rows. Other columns do not matter, and none but the text is a feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, id_hash, mix, prefix_hash, span_hash, text_bytes, words

BITS, GRAMS, DIM, ECHOES = 18, (2, 4), 8, 32
LEAD = (np.arange(256) & 0xC0) != 0x80


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS, grams: tuple[int, ...] = GRAMS):
    """Yield (bucket of each feature, where each row's features start).

    Features are words, a name for each distance at which a pair of words comes again, and n-grams of characters by size.
    """
    n = len(offs) - 1
    prefix = prefix_hash(data)
    start, end, row = words(data, offs)
    word = span_hash(prefix, start, end)
    yield (word >> U64(64 - bits)).astype(np.int64), np.searchsorted(row, np.arange(n + 1))
    pair = mix(word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:])
    for back in range(1, ECHOES + 1):
        if len(pair) > back:
            at = np.flatnonzero((pair[back:] == pair[:-back]) & (row[:-1][:-back] == row[1:][back:]))
            slot = int(mix(np.array([back], np.uint64))[0] >> U64(64 - bits))
            yield np.full(len(at), slot, np.int64), np.searchsorted(row[at], np.arange(n + 1))
    lead = np.flatnonzero(LEAD[data])  # where characters start
    first = np.searchsorted(lead, offs)
    bounds = np.append(lead, len(data))
    home = np.repeat(np.arange(n), np.diff(first))
    for size in grams:
        a = np.arange(max(0, len(lead) - size + 1))
        a = a[home[a] == home[a + size - 1]]
        h = mix(span_hash(prefix, bounds[a], bounds[a + size]) + U64(size))
        yield (h >> U64(64 - bits)).astype(np.int64), np.searchsorted(home[a], np.arange(n + 1))


def bag(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of one text and their shares of its features."""
    ids = np.concatenate([f for f, _ in features(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64), bits)])
    at, count = np.unique(ids, return_counts=True)
    return at.astype(np.int32), (count / max(1, len(ids))).astype(np.float32)


def train(bags: list, labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 8, rate: float = 0.3, seed: int = 1) -> tuple[np.ndarray, float]:
    """(log-odds that a feature's share adds, bias) after ``epochs`` of descent over documents in a seeded order."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return np.zeros(1 << bits, np.float32), float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -7, 7))
    vectors = (rng.random((1 << bits, dim), np.float32) - 0.5) / dim
    out = np.zeros((2, dim), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - steps / total)
            steps += 1
            at, weight = bags[i]
            if not len(at):
                continue
            mine = vectors[at]
            hidden = weight @ mine
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1.0
            back = p @ out
            out -= lr * p[:, None] * hidden
            bias -= 0.1 * lr * p
            # A feature's own rate: shares are small in long texts, so steps go by the root of the share.
            vectors[at] = mine - lr * np.sqrt(weight)[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 4000, label: str = "quality", **options) -> tuple[np.ndarray, float]:
    """Train on the ``sample`` labelled documents of least hash that are not held out; the bound keeps the driver's share small."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.min(label).alias("_label"))
    picked = known.orderBy(id_hash("quality", "doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), docs["doc_id"] == F.col("_id"))  # sample rows at most
    id_type, bits = docs.schema["doc_id"].dataType.simpleString(), options.get("bits", BITS)

    def bags(batches):
        for batch in batches:
            found = [bag(x.as_py(), bits) for x in batch["b"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], *[pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]], names=["doc_id", "label", "at", "weight"])

    # The driver is sent bags alone: 2**bits places at most, however long the text.
    got = rows.select("doc_id", F.col("_label").cast("int").alias("label"), text_bytes().alias("b")).mapInArrow(bags, f"doc_id {id_type}, label int, at binary, weight binary")
    seen = sorted((r.doc_id, bytes(r.at), bytes(r.weight), r.label) for r in got.toLocalIterator())
    return train([(np.frombuffer(at, np.int32), np.frombuffer(w, np.float32)) for _, at, w, _ in seen], np.array([s[3] for s in seen], np.float64), **options)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score: the model's probability of label 1 for every whole text."""
    table, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2**bits numbers
    bits = int(len(table)).bit_length() - 1
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        value = shared.value
        for batch in batches:
            for a, b, data, offs in blocks(batch["b"]):
                total, count = np.zeros(b - a), np.zeros(b - a)
                for ids, starts in features(data, offs, bits):
                    sums = np.concatenate([[0.0], np.cumsum(value[ids], dtype=np.float64)])
                    total += sums[starts[1:]] - sums[starts[:-1]]
                    count += np.diff(starts)
                z = bias + total / np.maximum(1, count)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.select("doc_id", text_bytes().alias("b")).mapInArrow(run, f"doc_id {id_type}, score double")


def remainder(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out documents are not read."""
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    scored = score(docs, fit(docs, labels, held_out, **options))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
