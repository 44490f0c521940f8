"""Hard negatives by exact integer scores: a matrix product in residues, then selection in score windows.

Components become integers, and the score of a row is its integer inner product with an anchor. Float32
matrix products are fast but exact only below 2^24, so both matrices are reduced modulo several small
primes, to residues around zero; one product per prime stays exact (wider vectors are summed in pieces), and
Chinese remaindering gives back the signed score. A block takes as many primes as its largest possible score
needs.

1. For each anchor, the ``positives`` best other rows of its label.
2. For each anchor and positive, of the rows of another label the ``negatives`` best whose score lies
   between ``low`` and ``high`` percent of the positive's, both included. A negative positive score leaves
   an empty window.

Higher scores come first, ties go to the smaller id. Anchors are a stated set of queries against all rows,
in blocks of bounded size by a hash of the id: neither a frequent label nor a frequent vector makes one
large. Each block hands on no more rows than an anchor may return.

Rows with a null id or label, a null vector, or a null or non-finite component take no part. Rows with equal
ids are one row (with the smallest label, then vector). Vectors of different lengths are not compared.
Integers saturate where a score could otherwise reach 2^51, which for 64 components is beyond four million.
Empty vectors score zero. An anchor without positives, or a positive without negatives, gives no row. Extra
columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage

#: Rows and anchors of a block at most, up to the spread of hashing.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 8192
#: Anchors whose scores a task holds at once.
ANCHORS_AT_ONCE = 256
#: Primes lie below this; residues then lie within half of it, and products of 64 components below 2^24.
PRIMES_BELOW = 1024
_EXACT_FLOAT32 = 1 << 24
_LARGEST_SCORE = (1 << 51) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its components are there and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


@cache
def _primes() -> tuple[int, ...]:
    """The primes below ``PRIMES_BELOW``, largest first."""
    sieve = np.ones(PRIMES_BELOW, bool)
    sieve[:2] = False
    for n in range(2, isqrt(PRIMES_BELOW) + 1):
        sieve[n * n :: n] = False
    return tuple(np.flatnonzero(sieve)[::-1].tolist())


def moduli(bound: int) -> list[int]:
    """The fewest primes, largest first, whose product tells apart all integers from -bound to bound."""
    chosen, product = [], 1
    for p in _primes():
        if product > 2 * bound:
            return chosen
        chosen.append(p)
        product *= p
    raise OverflowError(f"scores up to {bound} need larger primes")


def to_integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integral doubles, saturated where scores could leave the range of longs."""
    most = isqrt(_LARGEST_SCORE // max(1, vectors.shape[1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), -most, most)


def _residues(values: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo ``p`` between -p/2 and p/2."""
    rest = np.mod(values, p)
    return np.where(rest > p // 2, rest - p, rest).astype(np.float32)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner products of the rows of two matrices of integral doubles, as 64-bit integers."""
    width = a.shape[1]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli(width * int(np.abs(a).max()) * int(np.abs(b).max())):
        left, right = _residues(a, p), _residues(b, p)
        piece = _EXACT_FLOAT32 // (p // 2 or 1) ** 2
        rest = np.zeros(value.shape, np.int64)
        for at in range(0, width, piece):
            rest += (left[:, at : at + piece] @ right[:, at : at + piece].T).astype(np.int64)
        # The next digit in mixed radix: what is missing of the residue, over the product so far.
        value += (rest - value) % p * pow(product, -1, p) % p * product
        product *= p
    return np.where(value > product // 2, value - product, value)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    places = np.arange(len(ids))
    if len(ids) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def positives_in_block(ids, labels, rows, anchor_ids, anchor_labels, anchors, k: int):
    """``(anchor, row, score)`` of each anchor's ``k`` best other rows of its label within the block."""
    out = [(anchor_ids[:0], ids[:0], np.zeros(0, np.int64))]
    for at in range(0, len(anchors), ANCHORS_AT_ONCE):
        scores = exact_products(anchors[at : at + ANCHORS_AT_ONCE], rows)
        for own, anchor, label in zip(scores, anchor_ids[at:], anchor_labels[at:], strict=False):
            same = np.flatnonzero((labels == label) & (ids != anchor))
            best = same[_best(ids[same], own[same], k)]
            out.append((np.full(len(best), anchor), ids[best], own[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def negatives_in_block(ids, labels, rows, anchor_ids, anchor_labels, anchors, found, k: int, low: int, high: int):
    """``(anchor, positive, positive score, row, score)`` for the ``k`` best rows of each positive's window.

    ``found`` holds each anchor's positives as ``(id, score)``.
    """
    order = np.argsort(ids, kind="stable")
    ids, labels, rows = ids[order], labels[order], rows[order]
    none = np.zeros(0, np.int64)
    out = [(none,) * 5]
    for at in range(0, len(anchors), ANCHORS_AT_ONCE):
        scores = exact_products(anchors[at : at + ANCHORS_AT_ONCE], rows)
        for own, anchor, label, positives in zip(scores, anchor_ids[at:], anchor_labels[at:], found[at:], strict=False):
            bounds = np.array([(low * s, high * s) for _, s in positives], np.int64)
            hundredfold = 100 * own
            inside = (labels != label) & (hundredfold >= bounds[:, 0].min()) & (hundredfold <= bounds[:, 1].max())
            places = np.flatnonzero(inside)
            # Rows ascend by id, so a stable order by falling score breaks ties as wanted.
            places = places[np.argsort(-own[places], kind="stable")]
            falling = -hundredfold[places]
            for (positive, score), (least, most) in zip(positives, bounds, strict=True):
                first, last = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                best = places[first : min(last, first + k)]
                ends = np.full((3, len(best)), [[anchor], [positive], [score]])
                out.append((*ends, ids[best], own[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _matrix(table: pa.Table, scale: int):
    column = table.column("vector").combine_chunks()
    vectors = column.flatten().to_numpy().reshape(table.num_rows, -1)
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), to_integers(vectors, scale)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``vectors(vec_id, embedding, label)`` that ``is_anchor`` marks; ``label`` may replace the column."""
    label = F.col("label") if label is None else label
    one = F.min(F.struct("label", "vector")).alias("one")
    rows = (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            label.cast("long").alias("label"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
        .groupBy("vec_id")
        .agg(one)
        .select("vec_id", "one.*")
        .withColumn("asks", F.coalesce(is_anchor, F.lit(False)))
        .withColumn("size", F.size("vector"))
    )
    rows = write_stage(rows, "negatives-rows")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    row_blocks, anchor_blocks = max(1, -(-counts["n"] // BLOCK_ROWS)), max(1, -(-counts["q"] // BLOCK_ANCHORS))
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    columns, keys = ("vec_id", "label", "vector", "size"), ("size", "i", "j")
    data = rows.select(*columns, own(row_blocks).alias("i"), every(anchor_blocks).alias("j")).groupBy(*keys)

    def blocks_of(anchors: DataFrame, *more: str):
        # Under new names for Spark, as these rows meet those of the same table.
        placed = anchors.select(*[F.col(c).alias(c) for c in (*columns, *more)], own(anchor_blocks).alias("j"))
        return placed.select("*", every(row_blocks).alias("i")).groupBy(*keys)

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = positives_in_block(*_matrix(left, scale), *_matrix(right, scale), positives) if left.num_rows and right.num_rows else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["anchor_id", "positive_id", "positive_score"])

    asked = rows.where("asks")
    met = data.cogroup(blocks_of(asked)).applyInArrow(best_positives, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    met = write_stage(met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"), "negatives-positives")

    # At most ``positives`` of each anchor.
    own_positives = met.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("found")
    )

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[]] * 5
        if left.num_rows and right.num_rows:
            given = [[(p["positive_id"], p["positive_score"]) for p in own] for own in right.column("found").to_pylist()]
            found = negatives_in_block(*_matrix(left, scale), *_matrix(right, scale), given, negatives, low, high)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=names)

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    scored = data.cogroup(blocks_of(asked.join(own_positives, "vec_id"), "found")).applyInArrow(
        best_negatives, ", ".join(f"{c} long" for c in names)
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
