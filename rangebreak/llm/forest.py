"""Nearest neighbours by inner product: a forest of sorted hash strings with prefix descent.

Every vector has a long hash string per tree: signs of projections on fixed random directions, of the
vector with one more component that brings all to the same norm, so that the angle orders as the inner
product does. A tree is the array of these strings, sorted. A query descends each tree to its longest
prefix match; then all trees ascend together, one bit at a time, until the vectors that share a prefix of
the current length with the query in any tree are ``share`` of the block. These candidates are
compared exactly, in double precision.

Rows lie in blocks of bounded size, each with its own trees, and queries in blocks of their own; every
pair of blocks is a task group of bounded size, so no vector, however frequent, makes one large. The
share of a block that is compared, and with it recall, does not depend on the number of blocks.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id.
Vectors of different lengths are not compared. Rows with equal ids are one row (with the smallest of
their vectors). A query with fewer candidates than asked for gets those there are. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage

TREES = 48
BITS = 64
#: Rows and queries of a block at most, up to the spread of hashing.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048
#: A block of so many rows or fewer is all candidates.
WHOLE_BLOCK = 2000
#: Vectors under the current prefixes, as a share of the block and counted once per tree, that end the ascent.
SHARE = 0.9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hash_strings(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A string of ``BITS`` bits per tree and vector, first bit highest."""
    signs = (vectors @ directions > 0).reshape(len(vectors), TREES, BITS)
    packed = np.packbits(signs, axis=2)
    return packed.reshape(len(vectors), TREES, 8).view(">u8").reshape(len(vectors), TREES).astype(np.uint64).T


def _ranges(tree: np.ndarray, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array, the part that shares the first ``length`` bits with each string."""
    low = np.where(length > 0, np.uint64(2**64 - 1) >> np.minimum(length, 63).astype(np.uint64), np.uint64(2**64 - 1))
    low = np.where(length >= BITS, np.uint64(0), low)
    first = np.searchsorted(tree, strings & ~low, "left")
    return first, np.searchsorted(tree, strings | low, "right")


def candidates(rows: np.ndarray, queries: np.ndarray, share: float) -> np.ndarray:
    """Which rows each query compares: by synchronous ascent from the longest prefix matches."""
    directions = np.random.default_rng(11).standard_normal((rows.shape[1] + 1, TREES * BITS)).astype(np.float32)
    norms = np.linalg.norm(rows, axis=1)
    top = norms.max()
    lifted = np.column_stack([rows / top, np.sqrt(np.maximum(0, 1 - (norms / top) ** 2))])
    asked = np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))])
    row_strings = hash_strings(lifted.astype(np.float32), directions)
    query_strings = hash_strings(asked.astype(np.float32), directions)
    orders = [np.argsort(s, kind="stable") for s in row_strings]
    trees = [s[o] for s, o in zip(row_strings, orders, strict=True)]
    # A query meets itself once in every tree; a small block is compared whole.
    want = share * len(rows) + TREES if len(rows) > WHOLE_BLOCK else TREES * len(rows)
    # The longest common length at which the trees together hold enough: a binary search for each query.
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), BITS)
    while (low < high).any():
        middle = (low + high + 1) // 2
        held = np.zeros(len(queries), np.int64)
        for tree, strings in zip(trees, query_strings, strict=True):
            first, last = _ranges(tree, strings, middle)
            held += last - first
        enough = held >= want
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    chosen = np.zeros((len(queries), len(rows)), bool)
    for order, tree, strings in zip(orders, trees, query_strings, strict=True):
        first, last = _ranges(tree, strings, low)
        for q in range(len(queries)):
            chosen[q, order[first[q] : last[q]]] = True
    return chosen


def nearest_in_block(ids, rows, query_ids, queries, k: int, share: float):
    """``(query, row, score)`` of the ``k`` nearest candidates of each query, ties to the smaller id."""
    chosen = candidates(rows, queries, share)
    scores = queries @ rows.T
    scores[~chosen | (query_ids[:, None] == ids[None, :])] = -np.inf
    out = []
    for q in range(len(queries)):
        own = scores[q]
        if len(own) > k:
            # What rounding may move across the boundary is ordered by the exact measure below.
            edge = np.partition(own, len(own) - k)[len(own) - k]
            near = np.flatnonzero((own >= edge - 1e-9 * (1 + abs(edge))) & (own > -np.inf)) if edge > -np.inf else np.flatnonzero(own > -np.inf)
        else:
            near = np.flatnonzero(own > -np.inf)
        exact = (rows[near] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[near], -exact))[:k]
        out.append((np.full(len(best), query_ids[q]), ids[near[best]], exact[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("vector").combine_chunks()
    ids = table.column("vec_id").to_numpy()
    return ids, column.flatten().to_numpy().reshape(len(ids), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row that ``is_query`` marks."""
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
        .withColumn("asks", F.coalesce(is_query, F.lit(False)))
        .withColumn("size", F.size("vector"))
    )
    rows = write_stage(rows, "forest-rows")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts["n"] // BLOCK_ROWS)), max(1, -(-counts["q"] // BLOCK_QUERIES))
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = rows.select("vec_id", "vector", "size", own(row_blocks).alias("i"), every(query_blocks).alias("j"))
    asked = rows.where("asks").select("vec_id", "vector", "size", own(query_blocks).alias("j"), every(row_blocks).alias("i"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            found = nearest_in_block(*_vectors(left), *_vectors(right), k, share)
        return pa.table(found, names=["query_id", "vec_id", "score"])

    keys = ("size", "i", "j")
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
