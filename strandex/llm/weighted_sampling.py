"""Document fingerprints by consistent weighted sampling, in SQL functions alone.

A document's terms are its five-word shingles, weighted by how often they
occur.  For each of ``SAMPLES`` samples every term draws, from hashes of itself,
two Gamma(2, 1) values r, c and a uniform b; with t = floor(ln w / r + b) the
term of least ln c - r (t + 1 - b) is sampled, together with t.  Two texts then
agree in a sample with probability sum(min w) / sum(max w), the generalised
Jaccard similarity of their weighted terms.  As the least value determines term
and t, it stands for them.

Documents meet their successor by blocks of ids: a block holds the first
document of the next one as a guest, so one shuffle by block brings every
document to its successor, the last one to the first.

Null texts count as empty.  A text of fewer than five words has one term, one
without words none; texts without terms have equal fingerprints.  Rows with the
same doc_id follow each other by the hashes of their texts; a null doc_id comes
before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex.llm import common

SHINGLE, SAMPLES = 5, 24
#: doc_ids of one block: 2 ** BLOCK_BITS.
BLOCK_BITS = 10
#: Blocks, and groups of blocks, that are ordered together: at most 2 ** GROUP_BITS.
GROUP_BITS = 18


def terms(text: str) -> list[tuple[str, str]]:
    """SQL steps (name, expression) from a text column to ``terms``: array of (h: hash of the shingle, w: its count)."""
    return [
        ("words", f"transform(array_remove(split(lower({text}), '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), ''), x -> xxhash64(x))"),
        ("hashes", f"if(size(words) = 0, cast(array() as array<bigint>), sort_array(transform(sequence(1, greatest(size(words) - {SHINGLE - 1}, 1)), i -> xxhash64(slice(words, i, {SHINGLE})))))"),
        ("starts", "if(size(hashes) = 0, cast(array() as array<int>), filter(sequence(0, size(hashes) - 1), i -> i = 0 or hashes[i] <> hashes[greatest(i - 1, 0)]))"),
        ("terms", "transform(starts, (x, j) -> named_struct('h', hashes[x], 'w', if(j + 1 < size(starts), starts[least(j + 1, size(starts) - 1)], size(hashes)) - x))"),
    ]


def sample(k: int) -> str:
    """The value of term h with weight w (its logarithm: lw) in sample k."""
    one, two = f"xxhash64(h, {2 * k}L)", f"xxhash64(h, {2 * k + 1}L)"
    uniform = lambda g, at: f"((shiftrightunsigned({g}, {at}) & 16777215L) + 0.5D) * {2.0**-24!r}D"
    r, c = f"(-ln({uniform(one, 40)} * {uniform(one, 16)}))", f"(-ln({uniform(two, 40)} * {uniform(two, 16)}))"
    b = f"((({one}) & 65535L) + 0.5D) * {2.0**-16!r}D"
    return f"ln({c}) - {r} * ((if(w = 1, 0D, floor(lw / {r} + {b})) + 1D) - {b})"


def fingerprint_rows(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """One row for each distinct ``keys`` with columns m0, m1, ...; all null without terms."""
    for name, expression in terms(text):
        rows = rows.select(*keys, *{"words": (), "hashes": (), "starts": ("hashes",), "terms": ()}[name], F.expr(expression).alias(name))
    each = rows.select(*keys, F.explode_outer("terms").alias("term")).select(*keys, F.col("term.h").alias("h"), F.col("term.w").alias("w"), F.expr("if(term.w = 1, 0D, ln(term.w))").alias("lw"))
    return each.groupBy(*keys).agg(*(F.min(F.expr(sample(k))).alias(f"m{k}") for k in range(samples)))


def signature(samples: int, prefix: str = "m"):
    """Eight hex digits for each sample."""
    return F.concat(*(F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.coalesce(F.xxhash64(f"{prefix}{k}"), F.lit(0)), 32)), 8, "0")) for k in range(samples)))


def likeness(samples: int, a: str, b: str):
    """The share of samples in which both agree: an unbiased estimate of the similarity."""
    return sum((F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")).cast("int") for k in range(samples)), F.lit(0)) / F.lit(float(samples))


def hosts(blocks: DataFrame, bits: int = GROUP_BITS) -> DataFrame:
    """first_id and host of each block (block, first_id): the block before it, the last one for the first.

    Blocks are ordered within groups of 2 ** ``bits`` neighbouring numbers,
    groups within groups of groups, those among each other: no task orders more
    than 2 ** ``bits`` rows (of 64 - 10 bits), however sparse the ids are.
    """
    near = Window.partitionBy("group").orderBy("block")
    blocks = blocks.select("first_id", "block", F.shiftright("block", bits).alias("group"))
    groups = blocks.groupBy("group").agg(F.max("block").alias("last")).select("group", "last", F.shiftright("group", bits).alias("upper"))
    uppers = groups.groupBy("upper").agg(F.max("last").alias("last"))
    top = uppers.select("upper", F.coalesce(F.lag("last").over(Window.orderBy("upper")), F.max("last").over(Window.partitionBy())).alias("before_upper"))
    between = groups.select("group", "upper", F.lag("last").over(Window.partitionBy("upper").orderBy("group")).alias("before_group"))
    within = blocks.select("first_id", "group", F.lag("block").over(near).alias("before"))
    return within.join(between, "group").join(top, "upper").select("first_id", F.coalesce("before", "before_group", "before_upper").alias("host"))


def with_successor(docs: DataFrame) -> DataFrame:
    """block, place, guest, doc_id, text, next_text: documents in ascending order in their blocks, with the next document's text.

    A guest is the first row of the next block, there for its predecessor only.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"))
    guests = hosts(ids.groupBy(F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.min("id").alias("first_id")))
    rows = common.texts(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = rows.join(guests, rows["id"] == guests["first_id"], "left")
    placed = rows.select("id", "doc_id", "text", F.explode(F.expr("filter(array(named_struct('block', shiftright(id, %d), 'guest', false), named_struct('block', host, 'guest', true)), x -> x.block is not null)" % BLOCK_BITS)).alias("at"))
    line = Window.partitionBy("block").orderBy("guest", "id", "t1", "t2")
    placed = placed.select(F.col("at.block").alias("block"), F.col("at.guest").alias("guest"), "id", "doc_id", "text", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"))
    return placed.select("block", "guest", "doc_id", "text", F.row_number().over(line).alias("place"), F.coalesce(F.lead("text").over(line), F.lit("")).alias("next_text"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_successor(docs)
    half = "cast(floor(char_length(text) / 2) as int)"
    both = rows.select(
        "block", "place", "guest", "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text",
        F.expr(f"concat(substring(text, 1, char_length(text) - {half}), substring(next_text, 1, {half}))").alias("edited"),
    )
    keys = ["block", "place", "guest", "doc_id", "n_chars", "edited_sha256", "kind"]
    texts = both.select("block", "place", "guest", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    found = fingerprint_rows(texts, keys, "text", samples)
    line = Window.partitionBy("block").orderBy("place", "kind")
    ms = [f"m{k}" for k in range(samples)]
    sides = found.select(*keys[:-1], "kind", *ms, *(F.lead(m, 1).over(line).alias(f"e_{m}") for m in ms), *(F.lead(m, 2).over(line).alias(f"n_{m}") for m in ms)).where("kind = 0 and not guest")
    return sides.select("doc_id", "n_chars", "edited_sha256", signature(samples).alias("fingerprint"), signature(samples, "e_m").alias("edited_fingerprint"), likeness(samples, "m", "e_m").alias("near_edited"), likeness(samples, "m", "n_m").alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
