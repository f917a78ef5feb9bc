"""Document quality from random-indexing word vectors and a small network.

Every word and every word shape (case, digits, signs, length) has a fixed sparse index vector. A word's vector is the sum
of its neighbours' index vectors over the whole corpus: whole numbers, so partial sums of any split add up to the same.
A document is the mean and spread of its vectors. A two-layer numpy network is fitted on a bounded sample of labelled
documents, its temperature on a part of the sample kept aside. What is sent to tasks is bounded by the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import hash_words, mix, split_words, text_slices, whole

BUCKETS = 1 << 14
DIMS = 24
# Labelled documents the network is fitted on, at most.
SAMPLE_ROWS = 16_000
HIDDEN = 32
SEED = 11
THRESHOLD = 0.7


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs for every bucket."""
    r = np.random.default_rng(SEED)
    return r.integers(0, DIMS, (BUCKETS, 2)), r.choice([-1.0, 1.0], (BUCKETS, 2))


def _classes() -> np.ndarray:
    out = np.full(256, 4, np.int64)  # beyond ASCII
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    return out


_CLASS = _classes()


def word_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for every word's letters and one for its shape."""
    h = hash_words(data, starts, ends, lower=False)
    first, second = _CLASS[data[starts]], _CLASS[data[np.minimum(starts + 1, ends - 1)]]
    last, before = _CLASS[data[ends - 1]], _CLASS[data[np.maximum(ends - 2, starts)]]
    shape = (((first * 5 + second) * 5 + before) * 5 + last) * 8 + np.minimum((ends - starts) // 2, 7)
    return (h % np.uint64(BUCKETS)).astype(np.int64), (mix(shape.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, sign = _index()
    sums = np.zeros(BUCKETS * DIMS)
    seen = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for _, _, data, offsets in text_slices(b.column("text")):
            starts, ends, bounds = split_words(data, offsets)
            if len(starts) == 0:
                continue
            both = word_buckets(data, starts, ends)
            doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            near = np.flatnonzero(doc[1:] == doc[:-1])
            for own in both:
                seen += np.bincount(own, minlength=BUCKETS)
                for ctx in both:
                    for a, c in ((own[near], ctx[near + 1]), (own[near + 1], ctx[near])):
                        for k in (0, 1):
                            sums += np.bincount(a * DIMS + place[c, k], sign[c, k], minlength=BUCKETS * DIMS)
    used = np.flatnonzero(seen)
    table = sums.reshape(BUCKETS, DIMS).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *[pa.array(table[used, d]) for d in range(DIMS)]], ["bucket", "n", *[f"v{d}" for d in range(DIMS)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The buckets' vectors, of length 1 (0 where unseen), from all texts."""
    names = [f"v{d}" for d in range(DIMS)]
    parts = docs.select(whole(text_col).alias("text")).mapInArrow(_gather, "bucket long, n long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((BUCKETS, DIMS))
    # One row per bucket reaches the driver.
    for r in parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r["bucket"]] = [r[n] for n in names]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def pooled(column, vectors: np.ndarray) -> Iterator[np.ndarray]:
    """Per text: mean and spread of its words' vectors, mean of its shapes' vectors. Zeros without words."""
    for _, _, data, offsets in text_slices(column):
        starts, ends, bounds = split_words(data, offsets)
        counts = np.diff(bounds)
        out = np.zeros((len(counts), 3 * DIMS))
        full = np.flatnonzero(counts)
        if len(full):
            words, shapes = word_buckets(data, starts, ends)
            n = counts[full][:, None]
            total = lambda m: np.add.reduceat(m, bounds[:-1][full], axis=0) / n
            v = vectors[words]
            mean = total(v)
            out[full] = np.hstack([mean, np.sqrt(np.maximum(total(v * v) - mean**2, 0)), total(vectors[shapes])])
        yield out


class Network:
    """Two layers, fitted by Adam on the log loss, with a temperature for its scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60):
        r = np.random.default_rng(SEED)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.layers = None
        if len(y) < 20 or y.min() == y.max():
            return
        order = r.permutation(len(y))
        x, y = x[order], y[order].astype(float)
        kept = max(1, len(y) // 5)
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.shift) / self.scale
        fit, aside = slice(kept, None), slice(0, kept)
        w = [r.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        zf, yf = z[fit], y[fit]
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(yf)), max(1, len(yf) // 128)):
                a, b = zf[rows], yf[rows]
                h = np.tanh(a @ w[0] + w[1])
                g = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - b) / len(rows)
                back = np.outer(g, w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ g + 1e-4 * w[2], np.array([g.sum()])]
                t += 1
                for i, d in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * d
                    second[i] = 0.999 * second[i] + 0.001 * d * d
                    w[i] = w[i] - 0.005 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = w
        self.temperature = 1.0
        logit, truth = self._logit(x[aside]), y[aside]
        loss = lambda s: np.mean(np.logaddexp(0, logit / s) - truth * logit / s)
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return (np.tanh((x - self.shift) / self.scale @ w[0] + w[1]) @ w[2] + w[3]) / self.temperature

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x), -700, 700)))


def held_out(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents and a network fitted on `rows` labelled ones at most, those with the least id hash.

    Held-out ids, null labels and null ids are never learnt from. With fewer than 20 labelled rows, or one class only,
    every score is the share of label 1 (0.5 without labels).
    """
    vectors = word_vectors(docs, text_col)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [m for m in pooled(b.column("text"), shared.value)]
            flat = np.vstack(x) if x else np.zeros((0, 3 * DIMS))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([v.astype(np.float32).tobytes() for v in flat], pa.binary())], ["id", "y", "x"])

    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).join(F.broadcast(sample), "id")
    # Only `rows` pooled vectors reach the driver.
    got = sorted((r["id"], r["x"], r["y"]) for r in texts.mapInArrow(pool, f"id {dict(texts.dtypes)['id']}, y int, x binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, v, _ in got], float).reshape(len(got), 3 * DIMS)
    return vectors, Network(x, np.array([y for _, _, y in got]))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns with `out`, 0 to 1. Null or empty text: the score of no words. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != out]
    kept = docs.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for b in batches:
            got = [network.score(m) for m in pooled(b.column(text_col), vectors)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], [*rest, out])

    return kept.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + f", `{out}` double")
