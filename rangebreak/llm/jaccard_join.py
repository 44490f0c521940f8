"""N-gram Jaccard self-join of texts: enumeration of subsets for small sets, inverted lists for large ones.

A text's set holds its distinct shingles of ``width`` words (letters A-Z lowered; with fewer words the
whole sequence is one shingle). Two texts link when ``100 * |A & B| >= percent * |A | B|``, that is when
they share at least ``overlap(|A|, |B|)`` shingles. The result is one row per document with the class of
documents that links connect.

* Equal sets are one node; only nodes are compared.
* *Light* nodes, smaller than a boundary, write every subset of the size that a link with a partner of
  a given size needs; partners meet in an equal subset. The boundary is the size at which the rows that
  this writes, summed over the sizes present, together with the rows of the other way cost least.
* *Heavy* nodes are scanned through inverted lists from shingle to nodes. First nodes without a partner go:
  a node stays if enough of a prefix of its shingles in hash order stands in other nodes' prefixes.
  Those that stay enter the lists of their rarest shingles, as many as a partner may lack and one; each
  entry tells its place in that order. Any one order of all shingles gives right results, so rarity
  may be rough: it is the count of the slot, of a fixed number, that a shingle hashes to. A frequent
  passage falls out of these prefixes, and two places bound what two sets can share.
* Within a list one node, the one that the list's shingle comes first in, is compared with all others: of
  near copies it has the fewest shingles of its own. Then the pairs of a list follow whose places allow
  a link and which are not yet in one class; a group of near copies is one class by then.
* A pair that meets is first held against sketches: the parity of the number of elements in each of 512
  slots. Every slot in which two sketches differ holds an element that one set has alone, so a pair with too
  many of those cannot link. The others are verified on their whole sets, so links are exact up to equal
  64-bit hashes, and whole sets move for few pairs only.
* Copies and classes may be large: the smallest id is found per node, then per class over its nodes, and both
  are joined back by salted keys.

Texts without words (and null texts) have an empty set and link with nothing. A row whose document id is
null takes part; its class id is the smallest id in the class, null if there is none. Repeated rows and
repeated ids are rows of their own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.functions.frames import bucketed, write_stage
from rangebreak.llm.components import components
from rangebreak.llm.text import Words, chunks, let_go, mix, shingle_hashes

#: Sets above this size never count as light: subsets would drop three elements and more.
LIGHT_LIMIT = 40
#: Slots of the counts that order shingles by rarity.
SLOTS = 1 << 18
#: A prefix is longer by one element for so many elements of a set, and asks for as many more in common.
SPARE_EVERY = 20
#: Bits of a sketch, and how many of its words of 64 bits a row carries.
SKETCH_BITS = 512
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
#: Bytes of text shingled at once.
CHUNK = 1_000_000
#: Ways in which the rows of one node or class are dealt when its id is joined back.
SALTS = 16


def overlap(a: int, b: int, percent: int) -> int:
    """Shared elements that sets of sizes ``a`` and ``b`` need to link."""
    return -(-percent * (a + b) // (100 + percent))


def smallest_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def largest_partner(n: int, percent: int) -> int:
    return 100 * n // percent


def spare(n: int) -> int:
    """Elements in common that the prefixes of two sets of at least ``n`` elements show."""
    return 1 + n // SPARE_EVERY


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - smallest_partner(n, percent) + spare(n))


def _partner_sizes(n: int, percent: int):
    """``(smaller, larger, needed)`` of the pairs of sizes that a set of ``n`` elements belongs to."""
    for a in range(smallest_partner(n, percent), n + 1):
        yield a, n, overlap(a, n, percent)
    for b in range(n + 1, largest_partner(n, percent) + 1):
        yield n, b, overlap(n, b, percent)


def subset_rows(n: int, percent: int) -> int:
    """Subsets that a light set of ``n`` elements writes."""
    return sum(comb(n, c) for a, b, c in _partner_sizes(n, percent) if not a == b == c)


def light_boundary(sizes: dict[int, int], percent: int, heavy_cost: int = 3) -> int:
    """The boundary at which subsets of smaller sets and prefix entries of larger ones cost least.

    ``sizes`` counts the sets by size, up to ``LIGHT_LIMIT``. A prefix entry is written, counted and read
    back, hence ``heavy_cost``.
    """

    def cost(boundary: int) -> int:
        light = sum(c * subset_rows(n, percent) for n, c in sizes.items() if n < boundary)
        heavy = sum(
            c * prefix_length(n, percent) for n, c in sizes.items() if n >= smallest_partner(boundary, percent)
        )
        return light + heavy_cost * heavy

    return min(range(1, LIGHT_LIMIT + 2), key=lambda b: (cost(b), -b))


def _hash_prefix(elements: np.ndarray, percent: int) -> np.ndarray:
    return elements[: prefix_length(len(elements), percent)]


def _sets(batches, width: int, part):
    """Rows of ``(doc_id, text_key, node, n, elements)``, elements in hash order as far as ``part`` takes them."""
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key")
        for at, to, data, offsets in chunks(batch.column("text"), CHUNK):
            words = Words(data, offsets)
            nodes, sizes, starts, parts = [], [], [0], []
            for i in range(to - at):
                own = np.unique(shingle_hashes(words.hashes[words.first[i] : words.first[i + 1]], width))
                digest = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
                nodes.append(int.from_bytes(digest, "little", signed=True) if len(own) else None)
                sizes.append(len(own))
                parts.append(part(own))
                starts.append(starts[-1] + len(parts[-1]))
            values = pa.array(np.concatenate(parts).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, to - at),
                    keys.slice(at, to - at),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values),
                ],
                names=["doc_id", "text_key", "node", "n", "elements"],
            )
    let_go()


def shingle_sets(docs: DataFrame, width: int, part=lambda elements: elements) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text).alias("text_key")).mapInArrow(
        lambda batches: _sets(batches, width, part),
        "doc_id long, text_key long, node long, n long, elements array<long>",
    )


def _subsets(batches, percent: int):
    for batch in batches:
        keys, nodes, sizes = [], [], []
        for node, n, elements in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "elements")), strict=True):
            own = mix(np.array(elements, dtype=np.int64).view(np.uint64))
            total = own.sum(dtype=np.uint64)
            for a, b, c in _partner_sizes(n, percent):
                if a == b == c:
                    continue
                left_out = np.array(list(combinations(range(n), n - c)), dtype=np.int64)
                sums = total - own[left_out].sum(axis=1, dtype=np.uint64) if n > c else np.array([total])
                found = np.unique(mix(sums * np.uint64(2 * b + 1) + np.uint64(a)))
                keys.append(found)
                nodes.append(np.full(len(found), node))
                sizes.append(np.full(len(found), n))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(nodes)),
                    pa.array(np.concatenate(sizes)),
                ],
                names=["key", "node", "n"],
            )


def light_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """``(key, node, n)`` for the subsets of light nodes."""
    return nodes.select("node", "n", "elements").mapInArrow(
        lambda batches: _subsets(batches, percent), "key long, node long, n long"
    )


def with_partners(docs: DataFrame, rows: DataFrame, width: int, percent: int, boundary: int) -> DataFrame:
    """``node`` of the heavy nodes whose hash-order prefix shares as many elements as any link shows."""
    n = F.col("n")
    smallest = smallest_partner(boundary, percent)
    prefixes = shingle_sets(docs, width, lambda e: _hash_prefix(e, percent) if len(e) >= smallest else e[:0])
    # A key counts when two rows hold it, so nodes of equal texts stay as well; they cost no pair.
    entries = prefixes.select("node", F.explode("elements").alias("key"))
    two = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    hits = entries.join(two, "key", "left_semi").groupBy("node").agg(F.count("*").alias("hits"))
    sizes = rows.where(n >= smallest).groupBy("node", "n").agg(F.count("*").alias("rows"))
    least = 1 + F.floor(F.ceil(n * percent / 100) / SPARE_EVERY)
    return sizes.join(hits, "node").where(F.col("hits") >= least * F.col("rows")).select("node")


def _rare_prefixes(batches, counts, percent: int):
    for batch in batches:
        keys, nodes, sizes, places = [], [], [], []
        for node, n, elements in zip(
            batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("elements"), strict=True
        ):
            own = elements.values.to_numpy()
            length = n - smallest_partner(n, percent) + 1
            keys.append(own[np.lexsort((own, counts[own % len(counts)]))[:length]])
            nodes.append(np.full(length, node))
            sizes.append(np.full(length, n))
            places.append(np.arange(length))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in (keys, nodes, sizes, places)],
                names=["key", "node", "n", "place"],
            )


def heavy_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``(key, node, n, place)``: each node's prefix under the order of slot counts, with places from 0."""
    slot = F.pmod("key", F.lit(SLOTS)).cast("int").alias("slot")
    counted = sets.select(F.explode("elements").alias("key")).select(slot).groupBy("slot").agg(F.count("*").alias("c"))
    found = counted.toArrow()  # SLOTS rows at most
    counts = np.zeros(SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("c").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    entries = sets.mapInArrow(
        lambda batches: _rare_prefixes(batches, shared.value, percent), "key long, node long, n long, place long"
    )
    two = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return entries.join(two, "key", "left_semi")


def _may_link(a: str, b: str, percent: int):
    """Whether two entries of a list, as far as their sizes and places tell, belong to a pair that links.

    If the list's element is the first that both share, each side has only what follows it to share.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return most * (100 + percent) >= (n + m) * percent


def _first_against_all(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of the node that a list's shingle comes first in with the others of the list."""
    first = lists.groupBy("key").agg(F.min(F.struct("place", "node", "n")).alias("p")).select("key", "p.*")
    a, b = lists.alias("a"), first.alias("b")
    return (
        a.join(b, "key")
        .where((F.col("a.node") != F.col("b.node")) & _may_link("a", "b", percent))
        .select(F.col("b.node").alias("u"), F.col("a.node").alias("v"))
        .distinct()
    )


def _parities(batches):
    for batch in batches:
        out = np.zeros((len(batch), SKETCH_BITS // 8), np.uint8)
        for k, elements in enumerate(batch.column("elements")):
            slots = elements.values.to_numpy().view(np.uint64) % np.uint64(SKETCH_BITS)
            out[k] = np.packbits(np.bincount(slots.astype(np.int64), minlength=SKETCH_BITS) & 1)
        words = out.view(np.int64)
        columns = [batch.column("node"), batch.column("n"), *[pa.array(words[:, k]) for k in range(len(SKETCH))]]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "n", *SKETCH])


def sketches(sets: DataFrame) -> DataFrame:
    """``node, n`` and the sketch of every set."""
    schema = ", ".join(f"{c} long" for c in ("node", "n", *SKETCH))
    return write_stage(sets.select("node", "n", "elements").mapInArrow(_parities, schema), "jaccard-sketches")


def _possible(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""

    def side(node: str, mark: str) -> DataFrame:
        return sketch.select(F.col("node").alias(node), *[F.col(c).alias(f"{mark}{c}") for c in ("n", *SKETCH)])

    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in SKETCH), F.lit(0))
    both = F.col("an") + F.col("bn")
    # With at least ``apart`` elements in one set alone, at most (both - apart) / 2 are in common.
    enough = (both - apart) * (100 + percent) >= 2 * percent * both
    return pairs.join(side("v", "b"), "v").join(side("u", "a"), "u").where(enough).select("u", "v")


def _links(pairs: DataFrame, sets: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets meet the threshold.

    ``sets`` lies in buckets of its node, so the first join moves pairs alone. Of the first sides, often
    one node of very many pairs, only the sets asked for move, and Spark can split their pairs.
    """
    pairs = write_stage(_possible(pairs, sketch, percent), "jaccard-possible")
    right = sets.select(F.col("node").alias("v"), F.col("elements").alias("b"))
    asked = sets.join(pairs.select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    left = asked.select(F.col("node").alias("u"), F.col("elements").alias("a"))
    common = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(right, "v")
        .join(left, "u")
        .where(common * (100 + percent) >= percent * (F.size("a") + F.size("b")))
        .select("u", "v")
    )


def _labelled(frame: DataFrame, labels: DataFrame) -> DataFrame:
    return frame.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _pairs_between_classes(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list in two classes whose places allow a link."""
    entries = _labelled(lists, labels)
    mixed = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rest = entries.join(mixed.select("key"), "key", "left_semi")
    a, b = rest.alias("a"), rest.alias("b")
    return (
        a.join(b, "key")
        .where((F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _may_link("a", "b", percent))
        .select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
        .distinct()
    )


def _salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on a key that very many rows of the left side may have; the right side has it once."""
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [key, "salt"], "left").drop("salt")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the first row of each one's class: ``component_id`` and ``component_key``.

    First is the smallest id, nulls last, then the smallest key of a text.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    nodes = rows.where("node is not null").groupBy("node").agg(first, F.count("*").alias("c"))
    linked = _labelled(nodes.where("c > 1").select("node", "first"), labels).unionByName(
        labels.join(nodes.select("node", "first", "c").where("c = 1"), "node").select("node", "first", "root")
    )
    linked = write_stage(linked, "jaccard-linked")
    own = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = _salted(linked.select("node", "root"), own, "root").select("node", "component")
    return _salted(rows, named, "node").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component.doc_id")).alias("component_id"),
        F.coalesce("component.text_key", "text_key").alias("component_key"),
    )


def jaccard_rows(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, component_key`` for every row of ``docs``.

    ``text_key`` is ``xxhash64`` of the text; id and key name a row where ids repeat or are null.
    """
    rows = write_stage(shingle_sets(docs, width, lambda e: e[:0]).drop("elements"), "jaccard-rows")
    counted = rows.where(f"node is not null and n <= {LIGHT_LIMIT}").groupBy("n").agg(F.countDistinct("node").alias("c"))
    boundary = light_boundary({r["n"]: r["c"] for r in counted.collect()}, percent)
    small = shingle_sets(docs, width, lambda e: e if len(e) < boundary else e[:0]).where((F.col("n") > 0) & (F.col("n") < boundary))
    light = write_stage(light_lists(small.dropDuplicates(["node"]), percent), "jaccard-light")
    met = light.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    light = light.join(met, "key", "left_semi")
    wanted = light.select("node").unionByName(with_partners(docs, rows, width, percent, boundary)).distinct()
    # The whole sets of these nodes: from one text of each.
    texts = rows.where("node is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = texts.select(F.col("doc_id").alias("chosen_id")).distinct()
    read = docs.select(F.col("doc_id").cast("long"), "text")
    chosen = read.join(ids, read.doc_id.eqNullSafe(ids.chosen_id), "left_semi")
    whole = shingle_sets(chosen, width).where("node is not null").select("node", "n", "elements")
    # A node comes twice only if an id does.
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    whole = whole.dropDuplicates(["node"]) if repeated else whole
    with bucketed(whole, "node", "whole") as whole:
        sketch = sketches(whole)
        heavy = heavy_lists(whole.where(F.col("n") >= smallest_partner(boundary, percent)), percent)
        lists = write_stage(heavy.unionByName(light.withColumn("place", F.lit(0).cast("long"))), "jaccard-lists")
        links = write_stage(_links(_first_against_all(lists, percent), whole, sketch, percent), "jaccard-links")
        pairs = _pairs_between_classes(lists, components(links), percent)
        more = write_stage(_links(pairs, whole, sketch, percent), "jaccard-links")
    return _named(rows, components(links.unionByName(more)))


def jaccard_classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (see the module's docstring)."""
    return jaccard_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id")
