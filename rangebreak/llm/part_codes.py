"""Vector code compression: codes by parts, with the nearest entries found along a trie of distinct parts.

A vector of integers is cut into parts; each part position has a codebook of a few entries, refined by
rounds of assignment and averaging in exact integer arithmetic. A vector's code names the nearest entry of
each of its parts.

* Equal parts of a position are one row with a count, so a vector that stands very often costs one row.
  The distinct parts are written once, in lexicographic order over all tasks: a range of them is a trie.
* A trie is traversed depth first. A node carries one number per entry, the squared distance over the
  components so far, which all parts below it share. Siblings go in bundles of bounded size, so
  memory follows the depth times the bundle and not the number of parts.
* At a leaf the smallest number gives the entry (ties to the lower index); the part's components and one, times
  its count, go to that entry's sums. A task hands on one row per position and entry, Spark sums those,
  and only codebooks pass through the driver: entries times components, whatever the number of vectors.

A codebook starts as the parts of the first rows by id (null ids last, equal ids by vector); with fewer rows
than entries it is as short. An entry that no part is nearest to stays. Parts begin at ``k * length //
parts``, which is an equal cut if the length allows one; vectors of each length have codebooks of their own.
Vectors that are null or hold null or non-finite components are left out, rows with a null id or label
are not; null labels are one label. Repeated rows and ids are rows of their own. Integers saturate at 2^26.
Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage
from rangebreak.llm.hard_negatives import finite

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Nodes that a traversal expands at once.
BUNDLE = 4096
#: Integers saturate here, so squared distances of up to 500 components fit in a long.
LARGEST = 1 << 26
#: Ways in which the rows of one label are dealt when its total is joined back.
SALTS = 32


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Begin and end of each part of a vector."""
    return [(k * length // parts, (k + 1) * length // parts) for k in range(parts)]


def first_difference(parts: np.ndarray) -> np.ndarray:
    """For each row of a sorted matrix, the first component in which it differs from the row before.

    Zero for the first row, and the number of components for a repeated one.
    """
    depth = np.full(len(parts), parts.shape[1])
    depth[:1] = 0
    differs = parts[1:] != parts[:-1]
    depth[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1) if parts.shape[1] else 0, parts.shape[1])
    return depth


def along_trie(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, and the squared distance to it, by depth-first traversal.

    ``parts`` is sorted and without repeats; row by row it lists the leaves of the trie from left to right.
    """
    rows, width = parts.shape
    nearest, distance = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if not width or not rows:
        return nearest, distance
    depth = first_difference(parts)
    # A bundle: its depth, the first leaf of each of its nodes, the leaf that follows, the nodes' numbers.
    stack = [(0, np.zeros(1, np.int64), rows, np.zeros((1, len(entries)), np.int64))]
    while stack:
        level, nodes, stop, shared = stack.pop()
        begin = nodes[0]
        children = begin + np.flatnonzero(depth[begin:stop] <= level)
        parents = np.searchsorted(nodes, children, "right") - 1
        own = shared[parents] + np.square(parts[children, level][:, None] - entries[None, :, level])
        if level + 1 == width:
            nearest[children] = own.argmin(axis=1)
            distance[children] = own[np.arange(len(children)), nearest[children]]
            continue
        for at in range((len(children) - 1) // BUNDLE * BUNDLE, -1, -BUNDLE):
            end = int(children[at + BUNDLE]) if at + BUNDLE < len(children) else stop
            stack.append((level + 1, children[at : at + BUNDLE], end, own[at : at + BUNDLE]))
    return nearest, distance


def _in_order(parts: np.ndarray) -> np.ndarray:
    return np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``along_trie`` for parts in any order, repeats included."""
    order = _in_order(parts)
    ordered = parts[order]
    new = first_difference(ordered) < parts.shape[1]
    new[:1] = True
    nearest, distance = along_trie(ordered[new], entries)
    leaf = np.cumsum(new) - 1
    back = np.empty(len(parts), np.int64)
    back[order] = leaf
    return nearest[back], distance[back]


def _integers(vector: Column) -> Column:
    whole = lambda x: F.least(F.greatest(F.floor(SCALE * x), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, whole).cast("array<long>")


def _kept(vectors: DataFrame) -> DataFrame:
    double = F.col("embedding").cast("array<double>")
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), double.alias("vector"))
        .where(finite(F.col("vector")))
        .select("vec_id", "label", _integers(F.col("vector")).alias("v"), F.size("vector").alias("size"))
    )


def distinct_parts(kept: DataFrame) -> DataFrame:
    """``size, place, part, n``: the parts of each position, in lexicographic order over all tasks."""
    begin = lambda k: F.floor(F.col("size") * k / PARTS).cast("int")
    part = lambda k: F.slice("v", begin(k) + 1, begin(k + 1) - begin(k))
    keys = ("size", "place", "part")
    return (
        kept.select("size", F.posexplode(F.array(*[part(k) for k in range(PARTS)])).alias("place", "part"))
        .groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )


def first_codebooks(kept: DataFrame) -> dict[int, list[np.ndarray]]:
    """The entries of each position, by length of vector."""
    order = W.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "v")
    first = kept.withColumn("k", F.row_number().over(order)).where(F.col("k") <= ENTRIES).select("size", "k", "v")
    found: dict[int, list] = {}
    for r in sorted(first.collect()):  # ENTRIES vectors of each length
        found.setdefault(r["size"], []).append(r["v"])
    return {
        size: [np.array(rows, np.int64).reshape(len(rows), size)[:, a:b] for a, b in cuts(size, PARTS)]
        for size, rows in found.items()
    }


def _runs(batch: pa.RecordBatch):
    """``(size, place, first row, next row)`` of the runs of one trie in a batch."""
    size, place = batch.column("size").to_numpy(), batch.column("place").to_numpy()
    edges = np.flatnonzero((np.diff(size) != 0) | (np.diff(place) != 0)) + 1
    for at, to in zip([0, *edges.tolist()], [*edges.tolist(), len(size)], strict=True):
        if to > at:
            yield int(size[at]), int(place[at]), at, to


def _matrix(column: pa.Array, at: int, to: int) -> np.ndarray:
    return column.slice(at, to - at).flatten().to_numpy().reshape(to - at, -1)


def _entry_sums(batches, codebooks):
    """One row ``(size, place, entry, n, sums)`` for each entry that parts of this task are nearest to."""
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        counts = batch.column("n").to_numpy()
        for size, place, at, to in _runs(batch):
            entries = codebooks[size][place]
            parts, weight = _matrix(batch.column("part"), at, to), counts[at:to]
            own = sums.setdefault((size, place), (np.zeros(len(entries), np.int64), np.zeros_like(entries)))
            nearest, _ = nearest_entries(parts, entries)
            np.add.at(own[0], nearest, weight)
            np.add.at(own[1], nearest, parts * weight[:, None])
    rows = [
        (size, place, k, int(count), total[k].tolist())
        for (size, place), (n, total) in sums.items()
        for k, count in enumerate(n)
        if count
    ]
    names = ["size", "place", "entry", "n", "sums"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    columns = zip(*rows, strict=True) if rows else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def refine(parts: DataFrame, codebooks: dict[int, list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """One round: every part to its nearest entry, every entry to the mean of its parts, rounded down."""
    given = codebooks
    found = parts.mapInArrow(
        lambda batches: _entry_sums(batches, given), "size int, place int, entry int, n long, sums array<long>"
    )
    keys = ("size", "place", "entry")
    means = (
        found.select(*keys, "n", F.posexplode_outer("sums").alias("at", "value"))
        .groupBy(*keys, "at")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        .where("at is not null")
    )
    moved = {size: [entries.copy() for entries in places] for size, places in codebooks.items()}
    for r in means.collect():  # a row per entry and component
        moved[r["size"]][r["place"]][r["entry"], r["at"]] = r["value"] // r["n"]
    return moved


def digest(places: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place within the part."""
    numbers = ",".join(str(x) for entries in places for x in entries.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def _codes(batches, codebooks, digests):
    for batch in batches:
        size = batch.column("size").to_numpy()
        for own in np.unique(size).tolist():
            some = batch.filter(pa.array(size == own))
            vectors = _matrix(some.column("v"), 0, len(some))
            code, error = np.zeros((len(some), PARTS), np.uint8), np.zeros(len(some), np.int64)
            for k, (a, b) in enumerate(cuts(own, PARTS)):
                nearest, distance = nearest_entries(vectors[:, a:b], codebooks[own][k])
                code[:, k] = nearest
                error += distance
            columns = [
                some.column("vec_id"),
                some.column("label"),
                pa.array([c.tobytes().hex() for c in code], pa.string()),
                pa.array(error),
                pa.array([digests[own]] * len(some), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256"])


def encode(kept: DataFrame, codebooks: dict[int, list[np.ndarray]]) -> DataFrame:
    """``vec_id, label, code, error, codebooks_sha256`` of every vector, in one pass without a shuffle."""
    digests = {size: digest(places) for size, places in codebooks.items()}
    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "v", "size").mapInArrow(
        lambda batches: _codes(batches, codebooks, digests),
        f"vec_id long, label {label}, code string, error long, codebooks_sha256 string",
    )


def decode(code: str, places: list[np.ndarray]) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([entries[k] for entries, k in zip(places, bytes.fromhex(code), strict=True)])


def train(kept: DataFrame) -> dict[int, list[np.ndarray]]:
    """Codebooks by length of vector, after all rounds."""
    parts = write_stage(distinct_parts(kept), "codes-parts")
    codebooks = first_codebooks(kept)
    for _ in range(ROUNDS):
        codebooks = refine(parts, codebooks)
    return codebooks


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vectors(vec_id, embedding, label)``."""
    kept = _kept(vectors)
    coded = write_stage(encode(kept, train(kept)), "codes-rows")
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = coded.groupBy("label").agg(F.least(exact, most).cast("long").alias("label_error"))
    # A label may hold a third of all rows: they are dealt over several keys.
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    right = totals.select(
        F.col("label").alias("total_of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("total_salt")
    )
    same = left["label"].eqNullSafe(right["total_of"]) & (left["salt"] == right["total_salt"])
    return left.join(right, same).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
