"""Quality classifier: random-indexing word vectors pooled by document, and a two-layer network.

Every word bucket has a sparse random index vector of +1 and -1. A word's vector is the sum of the
index vectors of its neighbours over all documents of the corpus (no label is seen), scaled to
length 1. A document is the mean and the root mean square of its words' vectors; a network with one
hidden layer, in numpy, gives a logit, and a temperature fitted on rows set aside turns it into a
probability. Words are runs of letters, of digits or of other signs; words of capitals only have
buckets of their own.

A null or empty text has a zero vector and is scored like any other. Without labelled rows the
score is 0.5. The network is fitted on at most ``SAMPLE`` labelled rows, taken in the order of a
hash of doc_id; the word vectors cover all rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_CODE, LOWER, U64, Hashes, counts_of, map_texts, mix, rows_of, slices, small_batches, text_bytes

#: Buckets of words; the upper half is for words of capitals.
BUCKETS = 1 << 15
DIMENSIONS = 32
#: Entries of an index vector that are not 0.
NONZERO = 4
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 30
#: Buckets in a row of the shuffle, and rows into which the tasks' sums are first combined.
ROWS, SALTS = 512, 64

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[[*range(0x30, 0x3A)]] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1

_h = mix(np.arange(BUCKETS * NONZERO, dtype=U64) + U64(77)).reshape(BUCKETS, NONZERO)
INDEX = (_h % U64(DIMENSIONS)).astype(np.int64)
SIGN = np.where((_h >> U64(40)) & U64(1), 1.0, -1.0)


def tokens(column):
    """(bucket, row) of the words of each text."""
    data, offsets = text_bytes(column)
    kind = _CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(change)
    end = np.concatenate((start[1:], [len(data)])) if len(start) else start
    word = kind[start] > 0
    start, end = start[word], end[word]
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    all_caps = (capitals[end] - capitals[start] == end - start) & (end - start > 1)
    bucket = Hashes(BYTE_CODE[LOWER[data]]).of(start, end) % U64(BUCKETS // 2)
    bucket = bucket.astype(np.int64) + all_caps * (BUCKETS // 2)
    return bucket, rows_of(start, offsets)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Vectors of all buckets from all texts: as large as ``BUCKETS`` and no larger with the corpus."""

    def sums(batches):
        total = np.zeros(BUCKETS * DIMENSIONS)
        for part in slices(batches):
            bucket, row = tokens(part.column(0))
            near = np.flatnonzero(row[1:] == row[:-1])
            for a, b in ((bucket[near], bucket[near + 1]), (bucket[near + 1], bucket[near])):
                for k in range(NONZERO):
                    total += np.bincount(a * DIMENSIONS + INDEX[b, k], SIGN[b, k], len(total))
        yield from rows(total)

    def rows(total):
        full = total.astype(np.float32).reshape(BUCKETS // ROWS, -1)
        at = np.flatnonzero(full.any(axis=1))
        arrays = [pa.array(at.astype(np.int32)), pa.array([full[i].tobytes() for i in at], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "sums"])

    def added(key, table):
        total = sum(np.frombuffer(s.as_buffer(), np.float32).astype(np.float64) for s in table.column("sums"))
        arrays = [pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())]
        return pa.Table.from_arrays(arrays, names=["part", "sums"])

    schema = "part int, sums binary"
    parts = small_batches(texts).select("text").mapInArrow(sums, schema)
    parts = parts.withColumn("salt", F.spark_partition_id() % SALTS)
    parts = parts.groupBy("part", "salt").applyInArrow(added, schema).groupBy("part").applyInArrow(added, schema)
    vectors = np.zeros((BUCKETS // ROWS, ROWS * DIMENSIONS), np.float32)
    for r in parts.collect():  # BUCKETS / ROWS at most
        vectors[r["part"]] = np.frombuffer(r["sums"], np.float32)
    vectors = vectors.reshape(BUCKETS, DIMENSIONS)
    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return vectors / np.maximum(length, 1e-9)


def pooled(column, vectors):
    """Mean and root mean square of the word vectors of each text."""
    bucket, row = tokens(column)
    out = np.zeros((len(column), 2 * DIMENSIONS), np.float32)
    if len(bucket):
        own = vectors[bucket]
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        many = counts_of(row, len(column))[row[start]][:, None]
        out[row[start], :DIMENSIONS] = np.add.reduceat(own, start) / many
        np.multiply(own, own, out=own)
        out[row[start], DIMENSIONS:] = np.sqrt(np.add.reduceat(own, start) / many)
    return out


class Network:
    """Two layers; the output is a calibrated probability of class 1."""

    def __init__(self, x, y, seed=5):
        rng = np.random.default_rng(seed)
        self.ready = len(y) > 0
        if not self.ready:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        order = rng.permutation(len(y))
        aside = order[: len(y) // 5]
        fit = order[len(y) // 5 :]
        x = (x - self.mean) / self.scale
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)]
        self.w += [rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))]
        self.temperature = 1.0
        self._train(x[fit], y[fit].astype(float), rng)
        if len(aside):
            logit = self._logit(x[aside])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            self.temperature = min(grid, key=lambda t: self._loss(logit / t, y[aside]))

    @staticmethod
    def _loss(logit, y):
        return np.mean(np.logaddexp(0, logit) - y * logit)

    def _logit(self, x):
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def _train(self, x, y, rng):
        first = [np.zeros_like(w) for w in self.w]
        second = [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(max(EPOCHS, 3000 // max(len(y) // 128, 1))):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
                step += 1
                hidden = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w[2] + self.w[3], -40, 40))) - y[at]) / len(at)
                back = np.outer(error, self.w[2]) * (hidden > 0)
                slope = [x[at].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.w[2], error.sum()]
                for i, g in enumerate(slope):  # Adam
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    fair = first[i] / (1 - 0.9**step), second[i] / (1 - 0.999**step)
                    self.w[i] = self.w[i] - 0.003 * fair[0] / (np.sqrt(fair[1]) + 1e-8)

    def score(self, x):
        if not self.ready:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, label="quality"):
    """(word vectors, network) from all texts and the labelled rows (doc_id, label)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(SAMPLE)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def features(part):
        x = pooled(part.column(part.num_columns - 1), shared.value)
        return [pa.array([v.tobytes() for v in x], pa.binary())]

    rows = map_texts(rows, features, "features binary", ["doc_id", label]).select("doc_id", label, "features").distinct()
    # one doc_id may stand at any number of rows: the same order bounds them once more
    rows = rows.orderBy(F.xxhash64("doc_id", "features"), label, "features").limit(SAMPLE).collect()
    rows.sort(key=lambda r: (r["doc_id"], r[label], bytes(r["features"])))
    x = np.array([np.frombuffer(r["features"], np.float32) for r in rows], np.float64).reshape(len(rows), 2 * DIMENSIONS)
    return vectors, Network(x, np.array([r[label] for r in rows], np.int64))


def classify(docs: DataFrame, model, keep=None) -> DataFrame:
    """Rows of ``docs`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(part):
        vectors, network = shared.value
        score = network.score(pooled(part.column(part.num_columns - 1), vectors))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return map_texts(docs, scores, "score double, predicted int", keep)
