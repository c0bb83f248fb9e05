"""Near-duplicates by five-word Jaccard similarity beside the SimHash links.

Two texts are linked if the sets of their shingles have a Jaccard similarity of
at least ``SIMILARITY``, or if ``simhash`` links their fingerprints.  The pairs
are complete: in any one order of all shingles, sets of that similarity share
one of the first n - ceil(n * similarity) + 1 of each (prefix filter).
Shingles go by hash, those found often in a sample of the texts last: the
sample decides what is compared for nothing, not what is found.

What shares a prefix shingle is first compared with one member of its bucket,
chosen anew in each of ``ROUNDS`` rounds; what a round links is one component in
the next, and only members of different components are compared.  So a group of
near copies doesn't make all its pairs.  What is left in the end is compared
within its bucket, in blocks of ``HOT`` members that spread a large bucket over
tasks: places of the common shingle bound what both can have in common, and
parities of the sets in ``BITS`` bits bound the symmetric difference from below;
only pairs that can be similar leave the task.  Pairs are counted on their whole
sets of 64-bit hashes.

Null texts count as empty; a text of fewer words than a shingle has one, of all
its words.  Texts with equal sets are linked.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex.llm import common, simhash
from strandex.llm.components import components

SHINGLE, SIMILARITY, BITS, ROUNDS, HOT = 5, 0.8, 1024, 2, 8192
#: One of so many texts is sampled for common shingles; more texts of the sample than these make one common; that many at most are told apart.
SAMPLE, COMMON, CROWDED = 16, 4, 1 << 16
#: Bits, as a power of two, of the filter that says which texts are compared; bits of a block of it.
FILTER_BITS, BLOCK_BITS = 26, 16
#: Distinct edges whose components one task finds; more go by star operations.
FEW = 1 << 18
_LONGS = pa.list_(pa.int64())
_ID = f"coalesce(doc_id, {-(2**63 - 1)}L - 1L)"


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = zip(*(words[i:] for i in range(min(size, len(words)))), strict=False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x)) for x in joined), np.uint64))


def parity(of: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of BITS bits, as 64-bit numbers."""
    odd = np.bincount((of % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix(of: np.ndarray, crowded: np.ndarray, p: int, q: int) -> np.ndarray:
    """The hashes of which similar sets share one; ``crowded`` (sorted) come last in the order."""
    if not len(of):
        return of
    last = crowded[np.minimum(np.searchsorted(crowded, of), len(crowded) - 1)] == of if len(crowded) else np.zeros(len(of), bool)
    return of[np.lexsort((of, last))[: len(of) + (-p * len(of)) // q + 1]]


def _sets(frame: DataFrame, size: int, wanted=None) -> DataFrame:
    """id, t, items: the shingles of a table id, t, text; of those alone whose t the filter has, if there is one."""

    def run(batches):
        common.held("similar", None, int)
        for batch in batches:
            if wanted is not None:
                place = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                batch = batch.filter(pa.array((wanted.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))
            for some, values in common.slices([batch], 2):
                items = [shingles(x, size).view(np.int64) for x in values]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(items, _LONGS)], names=["id", "t", "items"])

    return frame.mapInArrow(run, "id long, t long, items array<long>")


def _filter(at: DataFrame) -> np.ndarray:
    """A bit for each t: blocks are made by the executors, so the driver gets 2 ** FILTER_BITS bits at most, whatever the input."""
    place = f"t & {(1 << FILTER_BITS) - 1}L"

    def block(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    places = at.selectExpr(f"shiftright({place}, {BLOCK_BITS}) as block", f"{place} & {(1 << BLOCK_BITS) - 1}L as bit").distinct()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    wide = 1 << (BLOCK_BITS - 3)
    for r in places.groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator():
        out[r.block * wide : (r.block + 1) * wide] = np.frombuffer(r.bits, np.uint8)
    return out


def _common(texts: DataFrame, size: int) -> np.ndarray:
    """The shingles met most often in a sample, ``CROWDED`` at most: only the order of shingles depends on them."""
    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("t"), "text")
    often = _sets(some, size).select(F.explode("items").alias("h")).groupBy("h").count().where(F.col("count") > COMMON).orderBy(F.desc("count"), "h").limit(CROWDED)
    return np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))


def _marked(texts: DataFrame, size: int, p: int, q: int) -> DataFrame:
    """doc_id, t (hash of the text), fp, sig (of the set), n (its size), parity, prefix."""
    crowded = texts.sparkSession.sparkContext.broadcast(_common(texts, size))

    def run(batches):
        common.held("similar", None, int)
        for batch, values in common.slices(batches, 1):
            sets = [shingles(x, size) for x in values]
            fp = np.array([simhash.fingerprint(x) for x in values], np.uint64).view(np.int64)
            sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(fp), pa.array(sig), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], _LONGS), pa.array([prefix(s, crowded.value, p, q).view(np.int64) for s in sets], _LONGS)],
                names=["doc_id", "t", "fp", "sig", "n", "parity", "prefix"],
            )

    return texts.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, fp long, sig long, n long, parity array<long>, prefix array<long>")


class _Steps:
    """Tables of the steps in the shared folder; shuffle files of each step are given back when it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def keep(self, frame: DataFrame, what: str) -> DataFrame:
        frame, self.folders[what] = common.stored(frame, f"similar-{what}")
        common.release(self.spark)
        return frame

    def drop(self, *names: str) -> None:
        for what in names or list(self.folders):
            common.drop(self.spark, self.folders.pop(what))


def _verified(steps: _Steps, pairs: DataFrame, info: DataFrame, texts: DataFrame, size: int, p: int, q: int, name: str) -> DataFrame:
    """Those of the pairs a, b whose sets are similar, as edges src, dst.  info: sig, n, parity and the id, t of a text with that set."""
    side = lambda s: info.select(F.col("sig").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"p_{s}"))
    fit = pairs.join(side("b"), "b").join(side("a"), "a")
    differ = "aggregate(zip_with(p_a, p_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    fit = steps.keep(fit.where(f"{p + q} * {differ} <= {q - p} * (n_a + n_b)").select("a", "b", "n_a", "n_b"), f"fit-{name}")
    at = steps.keep(info.join(fit.select(F.col("a").alias("sig")).union(fit.select("b")).distinct(), "sig", "left_semi").select("sig", "id", "t"), f"at-{name}")
    # what is compared is little beside the texts, which therefore aren't shuffled
    keyed = texts.select(F.expr(_ID).alias("id"), F.xxhash64("text").alias("t"), "text")
    wanted = texts.sparkSession.sparkContext.broadcast(_filter(at))
    sets = steps.keep(_sets(keyed, size, wanted).join(at, ["id", "t"]).select(F.col("sig").alias("key"), "items").dropDuplicates(["key"]), f"sets-{name}")
    whole = fit.join(sets.select(F.col("key").alias("b"), F.col("items").alias("i_b")), "b").join(sets.select(F.col("key").alias("a"), F.col("items").alias("i_a")), "a")
    found = steps.keep(whole.where(f"{p + q} * size(array_intersect(i_a, i_b)) >= {p} * (n_a + n_b)").select(F.col("a").alias("src"), F.col("b").alias("dst")), f"similar-{name}")
    steps.drop(f"fit-{name}", f"at-{name}", f"sets-{name}")
    wanted.unpersist()
    return found


def _shared(marked: DataFrame, bucket) -> DataFrame:
    """h, sig, n, i: the members of buckets with several sets."""
    rows = marked.select("sig", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "h"))
    return rows.withColumn("least", F.min("sig").over(bucket)).withColumn("most", F.max("sig").over(bucket)).where("least < most").select("h", "sig", "n", "i").distinct()


def _by_bits(marked: DataFrame) -> DataFrame:
    """The links of the fingerprints, carried over to the sets."""
    of_fp = marked.select("fp", "sig").distinct()
    holder = of_fp.groupBy("fp").agg(F.min("sig").alias("holder"))
    ends = [holder.select(F.col("fp").alias(x), F.col("holder").alias(f"{x}_sig")) for x in ("src", "dst")]
    linked = simhash.links(holder.select("fp")).join(ends[0], "src").join(ends[1], "dst").select(F.col("src_sig").alias("src"), F.col("dst_sig").alias("dst"))
    return linked.union(of_fp.join(holder, "fp").select(F.col("sig").alias("src"), F.col("holder").alias("dst"))).where("src <> dst").distinct()


def _pairs(c: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Pairs (two rows of sigs) that can be similar.  Rows h, x, y, block, sig, label, n, i, parity are sorted by h, x, y, n."""
    h, x, y, block, sig, label, n, i, bits = c
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(h)))
    left = np.repeat(start + size, size) - np.arange(len(h)) - 1  # rows that follow in the bucket
    rows, step, found = np.flatnonzero(left > 0), 1, [np.zeros((2, 0), np.int64)]
    while len(rows):
        rows = rows[n[rows] * q >= n[rows + step] * p]  # sizes ascend: what is too long now stays so
        other = rows + step
        can = (label[rows] != label[other]) & ((x[rows] == y[rows]) | (block[rows] != block[other])) & ((p + q) * np.minimum(n[rows] - i[rows], n[other] - i[other]) >= p * (n[rows] + n[other]))
        a, b = rows[can], other[can]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        near = (p + q) * differ <= (q - p) * (n[a] + n[b])
        if near.any():
            found.append(np.stack((np.minimum(sig[a], sig[b]), np.maximum(sig[a], sig[b])))[:, near])
        step += 1
        rows = rows[left[rows] >= step]
    return np.unique(np.concatenate(found, axis=1), axis=1)


def _within(mixed: DataFrame, info: DataFrame, bucket, p: int, q: int) -> DataFrame:
    """Pairs a, b of different labels in one bucket that can be similar."""
    n = common.parts(mixed.sparkSession)
    dealt = mixed.withColumn("blocks", F.ceil(F.count("*").over(bucket) / F.lit(HOT)).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(sig, 7L), blocks) as int)"))
    dealt = dealt.select("h", "sig", "label", "n", "i", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("with"))
    dealt = dealt.select("h", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "sig", "label", "n", "i").join(info.select("sig", "parity"), "sig")
    dealt = dealt.select("h", "x", "y", "block", "sig", "label", "n", "i", "parity").repartition(n, "h", "x", "y").sortWithinPartitions("h", "x", "y", "n")

    def run(batches):
        common.held("similar", None, int)
        held: list[np.ndarray] | None = None
        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(8)] + [batch.column(8).flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            differs = (c[0] != c[0][-1]) | (c[1] != c[1][-1]) | (c[2] != c[2][-1]) if len(c[0]) else np.zeros(0, bool)
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # the last bucket may go on in the next batch
            yield out([x[:last] for x in c])
            held = [x[last:] for x in c]
        if held is not None:
            yield out(held)

    def out(c):
        a, b = _pairs(c, p, q)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable) for every row of ``docs``."""
    share = Fraction(similarity).limit_denominator(1000)
    p, q = share.numerator, share.denominator
    steps = _Steps(docs.sparkSession)
    texts = common.texts(docs)
    whole = steps.keep(_marked(texts, size, p, q).withColumn("id", F.expr(_ID)), "whole")
    # two members of a bucket can be similar if it is their first common shingle: i, j shingles come before it
    can = f"{p + q} * least(n - i, n_b - j) >= {p} * (n + n_b)"
    pair = F.least("sig", "sig_b").alias("a"), F.greatest("sig", "sig_b").alias("b")
    bucket = Window.partitionBy("h")
    shared = steps.keep(_shared(whole, bucket), "shared")
    marked = steps.keep(whole.drop("prefix"), "marked")
    steps.drop("whole")
    # one text for each set
    info = steps.keep(marked.groupBy("sig").agg(F.min(F.struct("id", "t", "n", "parity")).alias("one")).select("sig", "one.*"), "info")
    edges = steps.keep(_by_bits(marked), "edges")
    tested, last = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).limit(0), "shared"
    for k in range(ROUNDS + 1):
        label = steps.keep(components(edges, few=FEW).withColumnRenamed("node", "sig"), f"label-{k}")
        named = shared.join(label, "sig", "left").select("h", "sig", "n", "i", F.coalesce("component", "sig").alias("label"))
        mixed = named.withColumn("low", F.min("label").over(bucket)).withColumn("high", F.max("label").over(bucket)).where("low < high").drop("low", "high")
        mixed = steps.keep(mixed, f"mixed-{k}")
        steps.drop(last, f"label-{k}")
        shared, last = mixed.drop("label"), f"mixed-{k}"
        if k < ROUNDS:
            one = F.min(F.struct(F.xxhash64("sig", F.lit(k)), "sig", "n", "i", "label")).over(bucket)
            met = mixed.withColumn("one", one).where("one.label <> label").selectExpr("sig", "n", "i", "one.sig as sig_b", "one.n as n_b", "one.i as j").where(can).select(*pair).distinct()
        else:
            met = _within(mixed, info, bucket, p, q)
        met = steps.keep(met.join(tested, ["a", "b"], "left_anti"), f"met-{k}")
        edges = steps.keep(edges.union(_verified(steps, met, info, texts, size, p, q, str(k))), f"edges-{k}")
        tested = tested.union(met)
    label = components(edges, few=FEW).withColumnRenamed("node", "sig")
    named = marked.select("doc_id", "sig").join(label, "sig", "left").select("doc_id", F.coalesce("component", "sig").alias("label"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found, _ = common.stored(named.join(smallest, "label").select("doc_id", "component_id"), "similar-classes")
    del whole, shared, marked, info, edges, label, named, mixed, met, tested, smallest
    steps.drop()
    common.release(docs.sparkSession)
    return found


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """The documents with one of each component, as ``simhash.deduplicate`` keeps them."""
    return simhash.keep_one(docs, near_duplicates(docs, similarity, size))
