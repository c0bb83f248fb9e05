"""Interpolated modified Kneser-Ney bigram model.

Counting: each task reduces its texts to distinct (context, word) pairs with
counts and sends them, packed, to the shard of the context's hash.  A shard
merges what all tasks sent, so a context's statistics are complete there, and
writes two sorted hash arrays to the shared folder: its pairs and its contexts.
What it learned about predicted words goes, packed, to the shard of the word's
hash, which writes the word array (count, number of distinct contexts).  Shards
are cut by the top bits of the hash, so the files together are one sorted array.
Scoring maps all files into memory and looks words up by binary search in
sorted blocks; nothing of the model is in the workers' own memory.

Words and pairs are known by 64-bit hashes: of a thousand million words, the
chance that any two are equal is 3%.

A null or empty text is one end token.  Repeated rows count as often as they
occur.  Without training texts every token is unknown: both scores then follow
from N = 0 and V = 0.  A null doc_id has the remainder of the empty string.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandex.llm import common

#: Tokens a task reduces at once; bytes of text scored at once.
BLOCK_TOKENS, BLOCK_BYTES = 1_500_000, 4 << 20
#: The context before the first word and the token after the last one.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and the text each belongs to."""
    sizes = np.array([len(x) for x in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw).lower(), np.uint8)
    start, _, h = common.word_hashes(data)
    first = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(first, start, "right") - 1
    last = np.searchsorted(doc, np.arange(len(raw)), "right")  # an end goes after the text's words
    return np.insert(h, last, END), np.insert(doc, last, np.arange(len(raw)))


def contexts(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    before = np.empty_like(word)
    before[1:] = word[:-1]
    if len(word):
        before[common.run_starts(doc)] = BEGIN
    return before


def pair_key(context: np.ndarray, word: np.ndarray, shard_bits: int) -> np.ndarray:
    """One number for context and word; its top bits are those of the context."""
    mixed = common.mix(context ^ common.mix(word + np.uint64(0x9E37)))
    if not shard_bits:
        return mixed
    keep = np.uint64(64 - shard_bits)
    return (context >> keep << keep) | (mixed >> np.uint64(shard_bits))


def shard_of(h: np.ndarray, shard_bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(h), np.int64)


def _pack_counts(n: np.ndarray) -> bytes:
    """A byte each, and the ones that don't fit apart."""
    big = np.flatnonzero(n >= 255)
    return np.minimum(n, 255).astype(np.uint8).tobytes() + big.astype("<u4").tobytes() + n[big].astype("<u8").tobytes()


def _unpack_counts(raw: memoryview, n: int) -> np.ndarray:
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    k = (len(raw) - n) // 12
    out[np.frombuffer(raw[n : n + 4 * k], "<u4")] = np.frombuffer(raw[n + 4 * k :], "<u8")
    return out


def _counted(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of context, word and their counts."""
    kinds, flat = np.unique(np.concatenate((context, word)), return_inverse=True)
    pair, n = np.unique(flat[: len(context)] * np.int64(len(kinds)) + flat[len(context) :], return_counts=True)
    return kinds[pair // len(kinds)], kinds[pair % len(kinds)], n


def _merged(columns: list[np.ndarray], keys: int) -> list[np.ndarray]:
    """Rows with equal keys (the first columns) summed in the others."""
    order = np.lexsort(columns[:keys][::-1])
    columns = [x[order] for x in columns]
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for x in columns[:keys]:
            new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return [x[at] for x in columns[:keys]] + [np.add.reduceat(x, at) if len(at) else x for x in columns[keys:]]


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums that all tokens share."""

    folder: str
    shard_bits: int
    tokens: int
    words: int
    pairs: int
    discounts: tuple[tuple[float, float, float], tuple[float, float, float]]
    #: What the discounts take from the words' share, which goes evenly to all words and one unknown.
    lower_mass: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney's from the numbers of entries that occur one to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.0
    found = [k - (k + 1) * y * b / a if a else float(k) / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.0), float(k)) for k, x in zip((1, 2, 3), found, strict=True))


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, shard_bits: int | None = None) -> Model:
    """Count ``docs`` (doc_id, text) and write the model to a new shared folder."""
    spark = docs.sparkSession
    bits = shard_bits if shard_bits is not None else common.shards(spark).bit_length() - 1
    folder = common.shared_dir(spark, "kneser-ney")

    def count(batches):
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            context, word, n = _counted(np.concatenate([a for a, _ in waiting]), np.concatenate([b for _, b in waiting]))
            shard = shard_of(context, bits)
            cut = np.append(common.run_starts(shard), len(shard))
            blobs = []
            for a, b in zip(cut, cut[1:], strict=False):
                starts = np.append(common.run_starts(context[a:b]), b - a)
                head = np.array([b - a, len(starts) - 1], "<u8").tobytes()
                blobs.append(head + context[a:b][starts[:-1]].tobytes() + np.diff(starts).astype("<u4").tobytes() + word[a:b].tobytes() + _pack_counts(n[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            raw = [x.encode("utf-8", "surrogatepass") for x in batch.column(0).to_pylist()]
            for lo, hi in common.chunked(raw):
                word, doc = tokens(raw[lo:hi])
                waiting.append((contexts(word, doc), word))
                size += len(word)
                if size >= BLOCK_TOKENS:
                    yield out()
                    waiting, size = [], 0
        if waiting:
            yield out()

    def blob_parts(blob: bytes):
        raw = memoryview(blob)
        n, k = (int(x) for x in np.frombuffer(raw[:16], "<u8"))
        context = np.repeat(np.frombuffer(raw[16 : 16 + 8 * k], np.uint64), np.frombuffer(raw[16 + 8 * k : 16 + 12 * k], "<u4"))
        at = 16 + 12 * k
        return context, np.frombuffer(raw[at : at + 8 * n], np.uint64), _unpack_counts(raw[at + 8 * n :], n)

    def pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        got = [blob_parts(x.as_buffer()) for x in table.column("blob")]
        context, word, n = _merged([np.concatenate([x[i] for x in got]) for i in range(3)], 2)
        key = pair_key(context, word, bits)
        order = np.argsort(key, kind="stable")
        common.put_file(folder, f"pairs-{shard:06d}", {"key": key[order], "n": np.minimum(n[order], 0xFFFFFFFF).astype(np.uint32)})
        at = common.run_starts(context)
        ones = [np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)]
        common.put_file(folder, f"contexts-{shard:06d}", {"key": context[at], "sum": ones[0].astype(np.uint64), **{f"n{i}": ones[i].astype(np.uint32) for i in (1, 2, 3)}})
        word, n_sum, kinds = _merged([word, n, np.ones(len(n), np.int64)], 1)
        to = shard_of(word, bits)
        cut = np.append(common.run_starts(to), len(to))
        blobs = [int(b - a).to_bytes(8, "little") + word[a:b].tobytes() + len(c := _pack_counts(n_sum[a:b])).to_bytes(8, "little") + c + _pack_counts(kinds[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        blobs.append(np.array(_of_counts(n), "<u8").tobytes())
        return pa.table({"shard": pa.array(np.append(to[cut[:-1]], -1)), "blob": pa.array(blobs, pa.binary())})

    def words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        got = []
        for x in table.column("blob"):
            raw = memoryview(x.as_buffer())
            n = int.from_bytes(raw[:8], "little")
            at = 8 + 8 * n
            size = int.from_bytes(raw[at : at + 8], "little")
            got.append((np.frombuffer(raw[8:at], np.uint64), _unpack_counts(raw[at + 8 : at + 8 + size], n), _unpack_counts(raw[at + 8 + size :], n)))
        word, n, kinds = _merged([np.concatenate([x[i] for x in got]) for i in range(3)], 1)
        common.put_file(folder, f"words-{shard:06d}", {"key": word, "n": n.astype(np.uint64), "kinds": kinds.astype(np.uint32)})
        return pa.table({"sums": pa.array([[int(n.sum()), len(n), int(kinds.sum()), *_of_counts(kinds)]], pa.list_(pa.int64()))})

    blobs = common.texts(docs).select("text").mapInArrow(count, "shard long, blob binary")
    found = blobs.groupBy("shard").applyInArrow(pairs, "shard long, blob binary").checkpoint()
    sums = found.where("shard >= 0").groupBy("shard").applyInArrow(words, "sums array<long>")
    total = np.array([r[0] for r in sums.collect()], np.int64).reshape(-1, 7).sum(axis=0).tolist()  # a row for each shard
    pair_counts = np.frombuffer(b"".join(bytes(r[0]) for r in found.where("shard < 0").select("blob").collect()), "<u8").reshape(-1, 4).sum(axis=0).tolist()
    lower = discounts(total[3:])
    taken = lower[0] * total[3] + lower[1] * total[4] + lower[2] * (total[1] - total[3] - total[4])
    return Model(folder, bits, total[0], total[1], total[2], (lower, discounts(pair_counts)), taken / total[2] if total[2] else 1.0)


class Tables:
    """The arrays of a model; a file is memory-mapped when a key of its shard is first looked up."""

    def __init__(self, model: Model):
        self.folder, self.bits = model.folder, model.shard_bits
        self.names = set(common.list_files(model.folder))
        self.files: dict[str, dict[str, np.ndarray]] = {}

    def file(self, name: str) -> dict[str, np.ndarray] | None:
        if name in self.names and name not in self.files:
            self.files[name] = common.map_file(self.folder, name)
        return self.files.get(name)

    def look(self, kind: str, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """The columns at sorted keys; 0 for those that aren't there."""
        out = [np.zeros(len(keys), np.float64) for _ in columns]
        cut = np.searchsorted(shard_of(keys, self.bits), np.arange((1 << self.bits) + 1))
        for shard, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if a == b or (file := self.file(f"{kind}-{shard:06d}")) is None:
                continue
            at = np.minimum(np.searchsorted(file["key"], keys[a:b]), len(file["key"]) - 1)
            hit = file["key"][at] == keys[a:b]
            for x, c in zip(out, columns, strict=True):
                x[a:b][hit] = file[c][at[hit]]
        return out


def probabilities(model: Model, tables: Tables, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token | token before) and the training count of each token."""
    context = contexts(word, doc)
    kinds, w = np.unique(word, return_inverse=True)
    n, spread = tables.look("words", kinds, ("n", "kinds"))
    (d1, d2, d3), (e1, e2, e3) = model.discounts
    total = max(1, model.pairs)
    lower = np.maximum(spread - np.select([spread == 1, spread == 2, spread >= 3], [d1, d2, d3], 0), 0) / total
    lower = lower + model.lower_mass / (model.words + 1)
    before, c = np.unique(context, return_inverse=True)
    of, n1, n2, n3 = tables.look("contexts", before, ("sum", "n1", "n2", "n3"))
    weight = np.where(of > 0, (e1 * n1 + e2 * n2 + e3 * n3) / np.maximum(of, 1), 1.0)
    pair, p = np.unique(pair_key(context, word, model.shard_bits), return_inverse=True)
    (count,) = tables.look("pairs", pair, ("n",))
    high = np.maximum(count - np.select([count == 1, count == 2, count >= 3], [e1, e2, e3], 0), 0)[p] / np.maximum(of, 1)[c]
    return high + weight[c] * lower[w], n[w]


def tables_of(model: Model) -> Tables:
    return common.held("kneser-ney", model.folder, lambda: Tables(model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probabilities of the text), perplexity."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        tables = tables_of(model)
        floor = model.tokens + 0.5 * (model.words + 1)
        for batch in batches:
            raw = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            for lo, hi in common.chunked(raw, BLOCK_BYTES):
                word, doc = tokens(raw[lo:hi])
                p, n = probabilities(model, tables, word, doc)
                sums = [np.bincount(doc, x, hi - lo) for x in (np.log10((n + 0.5) / floor), np.log10(p))]
                counts = [np.bincount(doc, minlength=hi - lo), np.bincount(doc, n > 0, hi - lo).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, counts), *map(pa.array, sums)], names=names)

    scored = common.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.remainder(F.col("doc_id"), 5) == 1
    model = train(docs.where(~held))
    return score(docs, model).select("doc_id", (common.remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
