"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Of fingerprints that differ in at
most two bits one half differs in at most one, so the halves share a variant in
which one bit is a wildcard.  Each *distinct* fingerprint is indexed under its
64 one-wildcard variants; fingerprints that meet under a variant are verified,
and what meets in one task is first reduced to stars, so no list of all pairs
arises.  A bucket of more than ``HOT`` distinct fingerprints is not compared in
place: its members are joined through two-wildcard variants of the whole
fingerprint, all of whose holders are linked to each other, so a star to the
smallest holder says everything.  Components of fingerprints then reach the
documents, copies included.

Null texts count as empty; a text without words has fingerprint zero and links
like any other.  Repeated rows are linked.  No documents: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex.llm import common
from strandex.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Distinct fingerprints of one bucket that are compared in place.
HOT = 2048
_ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    count = np.zeros(64, np.int64)
    joined = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    for at in range(0, n, 1 << 16):  # very long texts by blocks
        h = np.fromiter((digest(x, SEED) for x in joined[at : at + (1 << 16)]), np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        common.held("simhash", None, int)
        for batch, values in common.slices(batches, 1):
            fp = np.array([fingerprint(x) for x in values], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.texts(docs).mapInArrow(run, "doc_id long, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """The 64 one-wildcard keys of each fingerprint, one row each: half, wildcard and the other 31 bits in one number."""
    out = np.empty((len(fp), 64), np.uint64)
    for half in (0, 1):
        part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        for j in range(32):
            out[:, 32 * half + j] = (np.uint64(32 * half + j) << np.uint64(32)) | (part & ~(_ONE << np.uint64(j)))
    return common.mix(out)


def near(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges reduced to stars around each component's least member."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        left = label[x] != label[y]
        x, y = x[left], y[left]
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def bucket_stars(key: np.ndarray, fp: np.ndarray, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links within buckets as stars, and the members of hot buckets.  Rows are sorted by key."""
    start = common.run_starts(key)
    size = np.diff(np.append(start, len(key)))
    big = size > hot
    members = fp[np.repeat(big, size)]
    left = np.repeat(np.where(big, 0, np.arange(len(size)) * 0 + size), size) - (np.arange(len(key)) - np.repeat(start, size)) - 1  # rows that follow in the bucket
    rows = np.flatnonzero(left > 0)
    found_a, found_b, step = [], [], 1
    while len(rows):
        hit = rows[near(fp[rows], fp[rows + step])]
        if len(hit):
            found_a.append(fp[hit])
            found_b.append(fp[hit + step])
            if sum(map(len, found_a)) > 1 << 21:
                a, b = stars(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [a], [b]
        step += 1
        rows = rows[left[rows] >= step]
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), members
    return *stars(np.concatenate(found_a), np.concatenate(found_b)), members


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges src, dst between distinct fingerprints (column fp) such that components are those of all pairs within the distance."""
    spark = distinct.sparkSession

    def index(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 4096):
                some = fp[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(variants(some).reshape(-1).view(np.int64)), pa.array(np.repeat(some, 64).view(np.int64))], names=["key", "fp"])

    def compare(batches):
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(key, fp):
            a, b, members = bucket_stars(key, fp, hot)
            members = np.unique(members)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, members)).view(np.int64)), pa.array(np.concatenate((b, members)).view(np.int64)), pa.array(np.arange(len(a) + len(members)) >= len(a))], names=["src", "dst", "hot"])

        for batch in batches:
            key = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            start = common.run_starts(key)
            last = int(start[-1]) if len(start) else 0  # the last bucket may go on in the next batch
            if last >= 1 << 18:
                yield out(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
            elif len(key) - last > hot + (1 << 18):
                # a hot bucket: enough of its members stay to know it as hot, the others are only reported
                yield out(key[:last], fp[:last])
                many = np.unique(fp[last + hot + 1 :]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(many), pa.array(many), pa.array(np.ones(len(many), bool))], names=["src", "dst", "hot"])
                key, fp = key[last : last + hot + 1], fp[last : last + hot + 1]
            held_key, held_fp = key, fp
        if len(held_key):
            yield out(held_key, held_fp)

    n = common.parts(spark)
    keyed = distinct.mapInArrow(index, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    found = keyed.mapInArrow(compare, "src long, dst long, hot boolean").checkpoint()
    bits = F.array(*[F.lit(i) for i in range(64)])
    crowded = found.where("hot").select(F.col("src").alias("fp")).distinct()
    # two wildcards: i < j; the holders of one key differ in these bits alone
    two = crowded.select("fp", F.explode(bits).alias("i")).select("fp", "i", F.explode(F.filter(bits, lambda j: j > F.col("i"))).alias("j"))
    two = two.select("fp", "i", "j", F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("rest"))
    least = two.groupBy("i", "j", "rest").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
    more = two.join(least, ["i", "j", "rest"]).select(F.col("fp").alias("src"), "dst").where("src <> dst").distinct()
    return found.where("not hot").select("src", "dst").union(more)


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for every row of ``docs``."""
    common.shared_dir(docs.sparkSession, "simhash")
    marked = fingerprints(docs).checkpoint()
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    class_of = components(links(least.select("fp"), hot)).withColumnRenamed("node", "fp")
    joined = least.join(class_of, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_fp = joined.join(smallest, "component").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with one of each component of ``found``: the row with the smallest doc_id, one of equal rows.

    Rows without a doc_id stay.  Columns are those of ``docs``.
    """
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    known = docs.where("doc_id is not null")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.col("text"))
    one = known.join(kept, known["doc_id"] == kept["kept_id"], "left_semi").withColumn("strandex_rank", F.row_number().over(first)).where("strandex_rank = 1").drop("strandex_rank")
    return one.unionByName(docs.where("doc_id is null"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``keep_one`` by fingerprints alone."""
    return keep_one(docs, near_duplicates(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
