"""Toxicity by multiple-instance learning.

Labels are given to documents, offence sits in sentences.  A sentence's
probability is logistic in its hashed words; a document is toxic if at least
one sentence is: 1 - prod(1 - p), the noisy-or.  Its likelihood is maximised
over document labels alone, after which the sentence probabilities locate the
offending sentences.  Training takes a bounded number of labelled documents
(``TRAIN_DOCS``), chosen by a hash of doc_id; scoring reads every whole text.

Labels, lang, source and doc_id are no features.  A null or empty text has one
empty sentence, scored from the bias alone.  Labels that are null, repeated or
of documents that don't exist are harmless; without any label, or without both
classes, every score is the (smoothed) share of toxic labels.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common

#: Bytes of the prefixes that are features besides the word.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Weights; labelled documents to fit on, at most; share from which a document is rejected.
BITS, TRAIN_DOCS, CUT = 18, 12_000, 0.3
#: Steps, step size, L1 term and first bias of the fit.
FIT_STEPS, RATE, L1, START_BIAS = 200, 0.05, 3e-5, -6.0
#: Toxic documents that hold a feature, at least; log of how much commoner it is there, at least.
LEAST_HOLDERS, LEAST_LIFT = 3, 0.7
_BLOCK = 1 << 16
#: Bytes that end a word: everything but letters, digits, apostrophe and bytes from 0x80 on.
_BREAK = np.array([not (c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 39) for c in range(256)])
_END = np.zeros(256, bool)
_END[[*b".!?\n\r"]] = True
_MARK = re.compile(r"(?<=[.!?\n\r])")


def features(values: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, sentence (from 0 in each document) and features of each word, in text order.

    A word has ``len(PREFIXES) + 1`` features: itself and its first bytes, so
    that rare inflections share what their stems have shown.
    """
    raw = [(x or "").encode("utf-8", "surrogatepass").lower() for x in values]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    start, end, whole = common.word_hashes(data, _BREAK)
    size = np.array([len(x) for x in raw], np.int64)
    first = np.cumsum(size + 1) - size - 1
    doc = np.searchsorted(first, start, "right") - 1
    ended = np.concatenate(([0], np.cumsum(_END[data])))
    sentence = ended[start] - ended[first[doc]] if len(start) else np.zeros(0, np.int64)
    sums = common.running_hash(data)
    columns = [whole] + [common.mix(common.span_hash(sums, start, np.minimum(start + n, end)) + np.uint64(n)) for n in PREFIXES]
    return doc, sentence, (np.stack(columns, axis=1) >> np.uint64(64 - bits)).astype(np.int32)


def noisy_or(values: list[str | None], weights: np.ndarray, bias: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The documents' scores, and (document, sentence, probability) of each sentence that has words."""
    doc, sentence, feature = features(values, int(len(weights)).bit_length() - 1)
    scores = np.full(len(values), -np.logaddexp(0, bias))
    if not len(doc):
        return 1 - np.exp(scores), (doc, sentence, np.zeros(0))
    start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1]))))
    z = np.add.reduceat(weights[feature].sum(axis=1, dtype=np.float64), start) + bias
    quiet = -np.logaddexp(0, z)  # log(1 - p)
    owner = doc[start]
    total = np.zeros(len(values))
    np.add.at(total, owner, quiet)
    scores[owner] = total[owner]
    return 1 - np.exp(scores), (owner, sentence[start], np.exp(z + quiet))


def holders(values: list[str | None], marks: list[int], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic, and how many other, of the documents hold each feature."""
    doc, _, feature = features(values, bits)
    pairs = np.unique((doc[:, None] << bits | feature).reshape(-1))
    toxic = np.array(marks, bool)[pairs >> bits]
    count = lambda x: np.bincount(x & (1 << bits) - 1, minlength=1 << bits)
    return count(pairs[toxic]), count(pairs[~toxic])


def evidence(pos: np.ndarray, neg: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Which features may get weight, and their log lift.

    Evidence only adds up (weights are not negative), so a feature that is no
    commoner in toxic documents would end at zero anyway.
    """
    lift = np.log((pos + 0.1) / (n_toxic + 1)) - np.log((neg + 0.1) / (n_other + 1))
    return (pos >= LEAST_HOLDERS) & (lift > LEAST_LIFT), lift


def pack(values: list[str | None], kept: np.ndarray, bits: int = BITS) -> list[tuple[int, bytes, bytes]]:
    """Of each document: how many distinct sentences have no kept feature, and sizes and features of the others."""
    doc, sentence, feature = features(values, bits)
    cut, out = np.searchsorted(doc, np.arange(len(values) + 1)), []
    for a, b in zip(cut, cut[1:], strict=False):
        starts = np.append(common.run_starts(sentence[a:b]), b - a) + a
        each = [np.sort(x[kept[x]]).tobytes() for x in (feature[s:e].reshape(-1) for s, e in zip(starts, starts[1:], strict=False))]
        full = sorted({x for x in each if x})  # equal sentences of a document say the same
        out.append((each.count(b"") or int(not each), np.array([len(x) // 4 for x in full], np.int32).tobytes(), b"".join(full)))
    return out


def fit(packed: list[tuple[int, int, bytes, bytes]], lift: np.ndarray, bits: int = BITS, steps: int = FIT_STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, *pack()) of each document: proximal Adam on the noisy-or likelihood, all documents a step."""
    labels, n = np.array([x[0] for x in packed], float), len(packed)
    rate = (labels.sum() + 0.5) / (n + 1)
    w = np.zeros(1 << bits)
    if not 0 < labels.sum() < n:
        return w.astype(np.float32), float(np.log(rate / (1 - rate)))
    plain = np.array([x[1] for x in packed], float)
    sizes = [np.frombuffer(x[2], np.int32) for x in packed]
    feature = np.frombuffer(b"".join(x[3] for x in packed), np.int32)
    place = np.zeros(1 << bits, np.int64)
    for lo in range(0, len(feature), _BLOCK):  # by blocks and places: sorting them all takes several times their size
        place[feature[lo : lo + _BLOCK]] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    column = place[feature]
    del feature, place
    per = np.concatenate(sizes).astype(np.int64)
    row = np.repeat(np.arange(len(per)), per)
    docs = np.repeat(np.arange(n), [len(x) for x in sizes])
    v, bias = 0.2 * lift[used], START_BIAS
    m, s, mb, sb = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, v[column], len(per)) + bias
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        quiet = np.bincount(docs, -np.logaddexp(0, z), n) - plain * np.logaddexp(0, bias)
        odds = np.clip(np.where(labels > 0, np.exp(quiet) / np.maximum(1e-9, -np.expm1(quiet)), -1.0), -1, 1e3)  # d loglik / d z = odds * p
        g = odds[docs] * p
        grad, gb = np.bincount(column, g[row], len(used)) / n, (g.sum() + (odds * plain).sum() * p0) / n
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        a = RATE / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        scale = a / (np.sqrt(s) + 1e-8)
        v = np.maximum(0, v + scale * (m - L1))
        bias += a * mb / (np.sqrt(sb) + 1e-8)
    w[used] = v
    return w.astype(np.float32), float(bias)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, bits: int = BITS, held: int | None = 2) -> tuple[np.ndarray, float]:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not ``held``; at most ``most``, by a hash of doc_id."""
    common.shared_dir(docs.sparkSession, "toxicity")
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if held is not None:
        known = known.where(common.remainder(F.col("label_id"), 4) != held)
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = common.texts(docs).join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.select("text", "toxic").checkpoint()

    def screen(batches):
        common.held("toxicity", None, int)
        pos, neg = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        sums = np.zeros(2, np.int64)
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in common.chunked(texts):
                a, b = holders(texts[lo:hi], marks[lo:hi], bits)
                pos, neg = pos + a, neg + b
            sums += (sum(map(bool, marks)), len(marks) - sum(map(bool, marks)))
        at = np.flatnonzero(pos)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(pos[at], sums[0])), pa.array(np.append(neg[at], sums[1]))], names=["feature", "pos", "neg"])

    counts = rows.mapInArrow(screen, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = np.array(counts.where(f"feature < 0 or pos >= {LEAST_HOLDERS}").collect(), np.int64).reshape(-1, 3)  # at most 2 ** bits + 1 rows
    totals = found[found[:, 0] < 0].sum(axis=0)
    pos, neg = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    found = found[found[:, 0] >= 0]
    pos[found[:, 0]], neg[found[:, 0]] = found[:, 1], found[:, 2]
    kept, lift = evidence(pos, neg, int(totals[1]), int(totals[2]))
    held_kept = docs.sparkSession.sparkContext.broadcast(kept)

    def packing(batches):
        for batch in batches:
            texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in common.chunked(texts):
                got = pack(texts[lo:hi], held_kept.value, bits)
                yield pa.RecordBatch.from_arrays([pa.array(marks[lo:hi], pa.int32()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary()), pa.array([x[2] for x in got], pa.binary())], names=["toxic", "plain", "sizes", "features"])

    packed = rows.mapInArrow(packing, "toxic int, plain long, sizes binary, features binary").collect()  # at most ``most`` documents
    packed = [(int(r[0] > 0), r[1], bytes(r[2]), bytes(r[3])) for r in packed]
    packed.sort()
    model = fit(packed, lift, bits)
    del packed
    common.give_back()  # the driver's Python keeps it otherwise
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (the text of the sentence with the highest probability; null below the cut)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        common.held("toxicity", None, int)
        w, bias = held.value
        for part, some in common.slices(batches, 1):
            s, (doc, sentence, p) = noisy_or(some, w, bias)
            worst: list[str | None] = [None] * len(some)
            for d in np.flatnonzero(s >= cut).tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                if a < b:
                    worst[d] = sentences(some[d])[int(sentence[a + p[a:b].argmax()])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(worst, pa.string())], names=["doc_id", "score", "predicted", "offending"])

    scored = common.texts(docs).mapInArrow(run, "doc_id long, score double, predicted int, offending string")
    return scored.select("doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "offending")


def sentences(text: str) -> list[str]:
    """The text cut after every end mark, so that sentence k follows k marks."""
    return _MARK.split(text)


def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose score is below the cut; same columns."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        common.held("toxicity", None, int)
        w, bias = held.value
        for part, values in common.slices(batches, at):
            s, _ = noisy_or(values, w, bias)
            yield part.filter(pa.array(s < cut))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
