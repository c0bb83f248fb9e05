"""Quality by ordinal cumulative-link regression.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector over hashed text
features is shared by all grades, only the ordered thresholds differ.  x are the
shares of a document's words with a feature: the word itself, the shape of its
first and last characters, and whether it repeats one of the two words before.
The fit takes a bounded number of rated documents (``TRAIN_DOCS``), chosen by a
hash of doc_id; scoring reads every whole text.

The expected grade and the probability of reaching a grade (the tail) are there
for selection.  A null or empty text has x = 0, so it gets the thresholds'
probabilities.  Null ratings don't count; of repeated ones the largest does.
With fewer than two grades the one grade (or 0) is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common

#: Weights are 2 ** BITS; rated documents to fit on, at most; tail probability from which a document is kept.
BITS, TRAIN_DOCS, KEEP = 16, 8_000, 0.5
STEPS, RATE, L2 = 300, 0.2, 1e-6
#: Letters and digits stand for their class in a shape; other bytes for themselves.
_SHAPE = np.array([65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 0x80 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint8)


def features(values: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The document of each word, and the word's features, one row each (-1: none)."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in values]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    start, end, word = common.word_hashes(data)
    size = np.array([len(x) for x in raw], np.int64)
    first = np.cumsum(size + 1) - size - 1
    doc = np.searchsorted(first, start, "right") - 1
    sums = common.running_hash(_SHAPE[data])
    head = common.mix(common.span_hash(sums, start, np.minimum(start + 2, end)) + np.uint64(1))
    tail = common.mix(common.span_hash(sums, np.maximum(end - 4, start), end) + np.uint64(2))
    repeat = np.zeros(len(word), bool)
    for back in (1, 2):
        repeat[back:] |= (word[back:] == word[:-back]) & (doc[back:] == doc[:-back])
    rows = (np.stack([word, head, tail], axis=1) >> np.uint64(64 - bits)).astype(np.int32) if len(word) else np.zeros((0, 3), np.int32)
    return doc, np.column_stack([rows, np.where(repeat, 0, -1).astype(np.int32)])


def linear(values: list[str | None], weights: np.ndarray) -> np.ndarray:
    """w.x of each text."""
    doc, f = features(values, len(weights).bit_length() - 1)
    each = np.where(f >= 0, weights[f], 0).sum(axis=1)
    return np.bincount(doc, each, len(values)) / np.maximum(1, np.bincount(doc, minlength=len(values)))


def pack(values: list[str | None], bits: int = BITS) -> list[tuple[bytes, bytes]]:
    """Of each text the distinct features and their shares."""
    doc, f = features(values, bits)
    cut, out = np.searchsorted(doc, np.arange(len(values) + 1)), []
    for a, b in zip(cut, cut[1:], strict=False):
        flat = f[a:b].reshape(-1)
        kind, n = np.unique(flat[flat >= 0], return_counts=True)
        out.append((kind.astype(np.int32).tobytes(), (n / max(1, b - a)).astype(np.float32).tobytes()))
    return out


def probabilities(z: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """One row of grade probabilities for each z."""
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - z[:, None], -500, 500)))
    edge = np.ones((len(z), 1))
    return np.diff(np.hstack([edge * 0, below, edge]), axis=1)


def fit(packed: list[tuple[int, bytes, bytes]], bits: int = BITS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, thresholds and the grades, from (grade, features, shares) of each document: Adam on the likelihood.

    The thresholds are a first value and positive steps, so they stay ordered.
    """
    grades, y = np.unique(np.array([x[0] for x in packed], np.int64), return_inverse=True)
    w = np.zeros(1 << bits, np.float32)
    if len(grades) < 2:
        return w, np.zeros(0), grades if len(grades) else np.zeros(1, np.int64)
    n, k = len(packed), len(grades)
    row = np.repeat(np.arange(n), [len(x[1]) // 4 for x in packed])
    used, column = np.unique(np.frombuffer(b"".join(x[1] for x in packed), np.int32), return_inverse=True)
    share = np.frombuffer(b"".join(x[2] for x in packed), np.float32).astype(float)
    reach = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    start = np.log(reach / (1 - reach))
    theta = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, s = np.zeros_like(theta), np.zeros_like(theta)

    def parts(theta):
        v, raw = theta[: len(used)], theta[len(used) :]
        return v, np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))

    for t in range(1, steps + 1):
        v, cut = parts(theta)
        z = np.bincount(row, v[column] * share, n)
        below = 1 / (1 + np.exp(-np.clip(np.hstack([np.full((n, 1), -np.inf), cut[None, :] - z[:, None], np.full((n, 1), np.inf)]), -500, 500)))
        below[:, 0], below[:, -1] = 0, 1
        lo, hi = below[np.arange(n), y], below[np.arange(n), y + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_lo, d_hi = lo * (1 - lo) / p, hi * (1 - hi) / p
        g_cut = (np.bincount(y, d_hi, k)[:-1] - np.bincount(y, d_lo, k)[1:]) / n
        g = np.bincount(column, (d_lo - d_hi)[row] * share, len(used)) / n - L2 * v
        tail = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate((g, tail[:1], tail[1:] * np.exp(theta[len(used) + 1 :])))
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        theta = theta + RATE / (1 - 0.9**t) * np.sqrt(1 - 0.999**t) * m / (np.sqrt(s) + 1e-8)
    v, cut = parts(theta)
    w[used] = v
    return w, cut, grades


def train(docs: DataFrame, ratings: DataFrame, grade: str = "quality", most: int = TRAIN_DOCS, bits: int = BITS, held: int | None = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit on rated rows whose crc32(doc_id) mod 4 is not ``held``; at most ``most``, by a hash of doc_id."""
    known = ratings.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("rated_id")).agg(F.max(grade).cast("int").alias("grade"))
    if held is not None:
        known = known.where(common.remainder(F.col("rated_id"), 4) != held)
    known = known.orderBy(F.xxhash64("rated_id"), "rated_id").limit(most)

    def packing(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in common.chunked(texts):
                got = pack(texts[lo:hi], bits)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())], names=["grade", "features", "shares"])

    rows = common.texts(docs).join(F.broadcast(known), F.col("doc_id") == F.col("rated_id")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("grade").alias("grade"))
    packed = rows.select("text", "grade").mapInArrow(packing, "grade int, features binary, shares binary").collect()  # at most ``most`` documents
    return fit(sorted((r[0], bytes(r[1]), bytes(r[2])) for r in packed), bits)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade), probabilities (by grade), keep."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        common.held("quality", None, int)
        w, cut, grades = held.value
        for batch in batches:
            values = batch.column(1).to_pylist()
            for lo, hi in common.chunked(values):
                p = probabilities(linear(values[lo:hi], w), cut)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p @ grades), pa.array(p[:, -1]), pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, -1] >= keep)], names=["doc_id", "expected_grade", "tail_probability", "probabilities", "keep"])

    return common.texts(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, probabilities array<double>, keep boolean")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "expected_grade", "tail_probability", "keep")
