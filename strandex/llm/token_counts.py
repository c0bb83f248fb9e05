"""Exact length histogram of encoded documents.

``length_histogram`` counts documents by encoded length.  Each task counts the
lengths it sees before anything is shuffled, so what moves is one row for each
length and task, not one for each document.  ``context_report`` turns the
histogram into suffix sums, with which totals, quantiles and truncated totals
of *every* context limit are read off without another pass over the texts.

Null and empty texts have length 0.  No documents: an empty report.  Ties and
repeated rows count once each.
"""

from __future__ import annotations

import base64
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandex.llm import common

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that one window of the suffix sums holds.
BLOCK = 1024


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The tiktoken encoding of a rank file; made once for each worker."""
    import tiktoken

    def make():
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return common.held("tokens", path, make)


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Columns n_tokens, n_docs: how many documents encode to so many tokens."""
    path = vocabulary or default_ranks()

    def count(batches):
        encode = encoding(path).encode_ordinary
        seen: Counter = Counter()
        for batch in batches:
            seen.update(len(encode(x)) for x in batch.column(0).to_pylist())
        if seen:
            yield pa.RecordBatch.from_pydict({"n_tokens": list(seen), "n_docs": list(seen.values())}, pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

    part = common.texts(docs).select("text").mapInArrow(count, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_report(histogram: DataFrame) -> DataFrame:
    """For every occurring length L, taken as a context limit.

    n_tokens (L), n_docs, docs_at_least, tokens_at_least (suffix sums, L
    included), truncated_total (tokens left when each document is cut to L),
    full_total (all tokens), quantile (share of documents of at most L tokens).
    Sums go in blocks of lengths: windows within a block, and one short window
    over the blocks' totals.
    """
    common.shared_dir(histogram.sparkSession, "histogram")
    blocks = histogram.checkpoint().withColumn("block", F.expr(f"n_tokens div {BLOCK}"))  # it is read twice; a row for each length
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = (
        blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
        .select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("full_total"))
    )
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    at_least = blocks.join(totals, "block").select(
        "n_tokens", "n_docs", "all_docs", "full_total",
        (F.col("later_docs") + F.sum("n_docs").over(here)).alias("docs_at_least"),
        (F.col("later_tokens") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(here)).alias("tokens_at_least"),
    )
    return at_least.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("full_total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
        "full_total",
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_report(length_histogram(common.table(spark, sf_dir, "documents")))
