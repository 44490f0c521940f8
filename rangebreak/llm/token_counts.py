"""Exact token counts for every context limit, from one histogram of encoded lengths.

Each whole text is encoded and only its length is kept; documents are summed by length, and sums over the
suffix of longer lengths then answer, for any limit, how many documents are cut, how many tokens stay
and which share of documents fits. No further pass over the texts is needed for another limit.

The histogram has at most as many rows as the longest text has tokens. Its running sums are taken in two
steps: over blocks of neighbouring lengths, then inside a block, so no task holds all lengths.

Null and empty texts have length zero and count as documents. Repeated rows count each. An empty table has an
empty histogram, and limits asked of it get zeros. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage
from rangebreak.llm.byte_bpe import encoded_batches

#: Neighbouring lengths whose running sums are taken together.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row."""

    def run(batches):
        for ids, encoded in encoded_batches(batches, path, pattern):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(e) for e in encoded], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, documents``: each task sums its own documents before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("documents"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """Per length that occurs, taken as a context limit: what fits, what is longer, and totals.

    ``context_limit, documents`` (of this length), ``documents_within, documents_longer, tokens_within``
    (of documents that fit), ``truncated_tokens`` (sum of lengths cut at the limit), ``total_documents,
    total_tokens`` and ``share_within``.
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("documents")).withColumn(
        "block", F.floor(F.col("n_tokens") / BLOCK)
    )
    blocks = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    # One row per block of lengths.
    later = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_documents"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(everything).alias("total_documents"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    longer = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    summed = (
        rows.withColumn("own_documents", F.coalesce(F.sum("documents").over(longer), F.lit(0)))
        .withColumn("own_tokens", F.coalesce(F.sum("tokens").over(longer), F.lit(0)))
        .join(blocks, "block")
        .withColumn("documents_longer", F.col("own_documents") + F.col("later_documents"))
        .withColumn("tokens_within", F.col("total_tokens") - F.col("own_tokens") - F.col("later_tokens"))
    )
    within = F.col("total_documents") - F.col("documents_longer")
    return summed.select(
        F.col("n_tokens").alias("context_limit"),
        "documents",
        within.alias("documents_within"),
        "documents_longer",
        "tokens_within",
        (F.col("tokens_within") + F.col("n_tokens") * F.col("documents_longer")).alias("truncated_tokens"),
        "total_documents",
        "total_tokens",
        (within / F.col("total_documents")).alias("share_within"),
    )


def at_limits(histogram: DataFrame, limits: Iterable[int]) -> DataFrame:
    """``context_limit, documents_longer, truncated_tokens`` for given limits, which need not occur as lengths."""
    sums = []
    for c in sorted({int(c) for c in limits}):
        cut = F.least(F.col("n_tokens"), F.lit(c)) * F.col("documents")
        sums.append(
            histogram.agg(
                F.lit(c).cast("long").alias("context_limit"),
                F.coalesce(F.sum(F.when(F.col("n_tokens") > c, F.col("documents"))), F.lit(0)).alias("documents_longer"),
                F.coalesce(F.sum(cut), F.lit(0)).alias("truncated_tokens"),
            )
        )
    return reduce(DataFrame.unionByName, sums)


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the smallest length that at least ``share`` of the documents do not exceed."""
    cells = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return (
        table.select("context_limit", "documents_within", "total_documents", cells)
        .where(F.col("documents_within") >= F.ceil(F.col("share") * F.col("total_documents")))
        .groupBy("share")
        .agg(F.min("context_limit").alias("n_tokens"))
    )


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The limit table of a corpus. The histogram is written, so texts are encoded once."""
    return limit_table(write_stage(length_histogram(encoded_lengths(docs, path, pattern)), "token-lengths"))
