"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

*Targets.* Sources by code point (null last) weigh ``weights`` in turn and share all words. A source's
target stops at ``most`` times its own words; the excess goes to the others by weight until none is above.
Ordered by cap over weight, the capped sources are a prefix of that order, so one running sum over the
sources gives the level at which the rest stands.

*Taken.* A source's documents stand in the order of a digest of their ids. The mix reads this order round
and round until it has the target's words: whole rounds, then a part of one. The last document read
may be taken in part.

*Positions.* Each weight class has a schedule: its relative weight in equal phases of the training run. The
integral of the schedule, scaled to the target, is the demand for the source's words up to a time; the
copy of a document that begins at some word of the source's sequence is due when demand reaches this
word. Inverting the integral (linear inside a phase) gives its position in the run, from 0 to 1, and the
result is range-sorted by position.

No window spans a source: a document's place is the sum of the digest buckets before its own, plus its
place inside its (source, bucket). Buckets are summed before anything is shuffled.

Null and empty texts have no words and are never taken. A null source is a source. Repeated rows are
documents of their own; where ids are equal too, they follow each other by text. Null ids have an
empty digest key. Empty tables give empty results; extra columns with clashing names are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage

SEPARATORS = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Per weight class, the relative weight in each equal phase: the first class fades, the last one rises.
SCHEDULE = ((3, 2, 1), (2, 2, 2), (1, 2, 3))
#: Hex digits of the digest that name a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source, source_size, class, target`` from ``source, source_size``; one row per source throughout."""
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    named = sizes.withColumn("class", (rank % len(weights)).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("long")
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = named.withColumn("level", rest.cast("double") / shares.cast("double")).withColumn(
        "free", F.col("level") < F.col("cap").cast("double") / F.col("weight")
    )
    # The first free source in this order fixes the level for itself and all after it.
    first_level = F.max(F.when(F.col("free"), F.col("level"))).over(everything)
    target = F.when(F.col("free"), first_level * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return levelled.select("source", "source_size", "class", target.alias("target"))


def _inverse(share: Column, schedule: Sequence[Sequence[float]]) -> Column:
    """Time at which a class's integrated schedule reaches ``share`` of its whole."""
    out = None
    for k, phases in enumerate(schedule):
        total, done, time = float(sum(phases)), 0.0, None
        for i, w in enumerate(phases):
            if w > 0:
                inside = (i + (share * total - done) / w) / len(phases)
                time = F.when(share * total < done + w, inside) if time is None else time.when(share * total < done + w, inside)
            done += w
        time = time.otherwise(F.lit(1.0))
        out = F.when(F.col("class") == k, time) if out is None else out.when(F.col("class") == k, time)
    return out


def mix_sources(
    docs: DataFrame,
    carry: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    most: int = 3,
    schedule: Sequence[Sequence[float]] = SCHEDULE,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, begin, goal, class`` and ``carry`` per row.

    ``begin`` is the document's first word in its source's sequence, ``goal`` the words the mix takes of
    the source. ``position_of`` turns them into positions.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        key.alias("key"),
        F.xxhash64("text").alias("tie"),
        *(F.col(f"`{c}`") for c in carry),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = write_stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    places = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    t, s = targets.alias("t"), places.alias("s")
    places = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.source_size", "t.class", "t.target")
    places = places.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    r, p = placed.alias("r"), places.alias("p")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    begin = F.col("ahead") + F.col("inside")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(
        F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - F.col("rounds") * F.col("source_size") - F.col("begin"))
    )
    return (
        joined.withColumn("begin", begin)
        .withColumn("rounds", rounds)
        .select(
            "doc_id",
            F.col("r.source").alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("rounds") * F.col("size") + part).alias("taken"),
            "begin",
            "goal",
            "class",
            *(F.col(f"r.{c}") for c in carry),
        )
    )


def position_of(first_word: Column, schedule: Sequence[Sequence[float]] = SCHEDULE) -> Column:
    """Position in the run of the copy that begins at a word of its source's repeated sequence."""
    return _inverse(first_word.cast("double") / F.col("goal").cast("double"), schedule)


def curriculum(mixed: DataFrame, schedule: Sequence[Sequence[float]] = SCHEDULE) -> DataFrame:
    """``mixed`` with the position of each document's first copy, range-sorted by it; untaken ones last."""
    return (
        mixed.withColumn("position", F.when(F.col("taken") > 0, position_of(F.col("begin"), schedule)))
        .repartitionByRange(F.col("position").asc_nulls_last(), "doc_id")
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    )


def copies(mixed: DataFrame, schedule: Sequence[Sequence[float]] = SCHEDULE) -> DataFrame:
    """One row per copy that the mix takes, with ``position``, in training order.

    ``mixed`` carries ``text``. A copy taken in part keeps the text up to the end of its last word.
    """
    last = F.ceil(F.col("taken") / F.col("size")).cast("int") - 1
    each = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")).cast("int")
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), words), "")
    return (
        each.withColumn("position", position_of(F.col("begin") + F.col("copy") * F.col("source_size"), schedule))
        .withColumn("text", F.when(words < F.col("size"), cut).otherwise(F.col("text")))
        .repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
    )
