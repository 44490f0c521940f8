"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams between two multinomials.

The *target* multinomial is counted over all trusted texts, the *raw* one over all texts. A text's features
are its words and pairs of neighbouring words, each hashed to one of ``buckets`` slots. With add-one
counts, a slot's weight is ``log(target share) - log(raw share)``; a text's verdict is the mean weight of
its features against a threshold. Nothing is drawn at random: equal texts get equal verdicts.

Only DataFrame functions are used. A task sums its own slots before the shuffle; the table of weights has
one number per slot whatever the corpus and is a constant of the plan that scores.

Texts without words have no features and a ratio of zero; the base rules fail them. Null texts count as
empty. Without trusted texts all weights are zero. Trusted ids may repeat or be absent from the texts.
Repeated rows count as often as they stand. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
#: Mean log ratio from which a text is kept.
THRESHOLD = -0.07
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(hashes: Column, width: int) -> Column:
    """Hash of every run of ``width`` neighbours."""
    last = F.size(hashes) - width + 1
    return F.when(
        last > 0,
        F.transform(
            F.sequence(F.lit(1), last), lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(width)))
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _slots(frame: DataFrame, buckets: int) -> DataFrame:
    """``frame`` with ``hashes``, a column, gets ``slots``: from 1, of every word and every pair of neighbours.

    Lambdas read ``hashes`` by index, so it has to be a column: an expression would be evaluated anew for
    every element.
    """
    both = F.concat("hashes", _runs(F.col("hashes"), 2))
    return frame.withColumn("slots", F.transform(both, lambda h: (F.pmod(h, F.lit(buckets)) + 1).cast("int")))


def _repeat_places(frame: DataFrame) -> DataFrame:
    """``frame`` gets ``places``: of the windows whose hash stands twice or more, in order; null if none does."""

    def same(k: Column, other: Column) -> Column:
        return F.coalesce(F.get("pairs", k)["h"] == F.get("pairs", other)["h"], F.lit(False))

    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.transform("pairs", lambda p, k: F.when(same(k, k - 1) | same(k, k + 1), p["i"]))
    return (
        frame.withColumn("pairs", F.when(repeats, pairs))
        .withColumn("again", again)
        .withColumn("places", F.array_sort(F.filter("again", lambda i: i.isNotNull())))
        .drop("pairs", "again")
    )


def covered_words(places: Column) -> Column:
    """Words in windows that begin at ``places``, each counted once."""
    spans = F.transform(
        places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))).cast("long")
    )
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, span: total + span)


def base_counts(texts: DataFrame) -> DataFrame:
    """``texts`` with a column ``words`` and ``text`` gets the counts and ``base_failed``; ``hashes`` is kept."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = (
        texts.withColumn("hashes", _hashes(F.col("words")))
        .withColumn("windows", _runs(F.col("hashes"), WINDOW))
        .withColumn("lines", lines)
        .select(
            "*",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        )
    )
    counted = _repeat_places(counted)
    counted = counted.withColumn("n_repeat_words", F.coalesce(covered_words(F.col("places")), F.lit(0).cast("long")))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return counted.withColumn("base_failed", failed)


def slot_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Per slot the log ratio of its add-one shares in trusted and in all texts: ``buckets`` numbers."""
    good = trusted.select(F.col("doc_id").cast("long").alias("good_id")).where("good_id is not null").distinct()
    # Whole texts move, which are smaller than their words, and are not sorted: the ids of a task are few and distinct.
    # Rows without an id are trusted by nothing, and are spread by their texts so that no task gets all of them.
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    read = read.withColumn("spread", F.coalesce("doc_id", F.xxhash64("text")))
    met = (F.col("spread") == F.col("good_id")) & F.col("doc_id").isNotNull()
    marked = read.join(good.hint("shuffle_hash"), met, "left").withColumn("words", words_of(F.col("text")))
    marked = _slots(marked.withColumn("hashes", _hashes(F.col("words"))), buckets)
    # The outer form: Spark would put a filter of the plain one below the projections, where the lambdas
    # of the expressions would be evaluated for every element again.
    counts = (
        marked.select(F.col("good_id").isNotNull().cast("long").alias("good"), F.explode_outer("slots").alias("slot"))
        .groupBy("slot")
        .agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
        .collect()  # one row per slot: a fixed number
    )
    raw, trust = [1] * buckets, [1] * buckets
    for row in counts:
        if row["slot"] is None:
            continue
        raw[row["slot"] - 1] += row["raw"]
        trust[row["slot"] - 1] += row["good"]
    if sum(trust) == buckets:
        return [0.0] * buckets
    shift = math.log(sum(raw) / sum(trust))
    return [math.log(t / r) + shift for t, r in zip(trust, raw, strict=True)]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def quality_verdicts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``ratio`` (mean log ratio of the features) and ``kept``."""
    weights = slot_weights(docs, trusted, buckets)
    # A constant of fixed size in the plan, so that no row carries it.
    constant = F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")
    texts = docs.select(F.col("doc_id").cast("long"), _text().alias("text")).withColumn("words", words_of(F.col("text")))
    counted = _slots(base_counts(texts), buckets)
    total = F.aggregate("slots", F.lit(0.0), lambda total, slot: total + F.element_at(constant, slot))
    features = F.when(F.col("n_words") > 1, 2 * F.col("n_words") - 1).otherwise(F.col("n_words"))
    ratio = F.when(F.col("n_words") > 0, total / features).otherwise(F.lit(0.0))
    return (
        counted.withColumn("ratio", ratio)
        .withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
    )
