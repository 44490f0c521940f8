"""Slot weights and the verdict of the quality rules, held against plain counts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rangebreak.llm import quality

SHAPE = "doc_id long, text string, lang string"


def features(spark, texts):
    """Slots of every text, from the operator's own hash of words and pairs."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    words = docs.select("i", quality.words_of(F.coalesce("text", F.lit(""))).alias("words"))
    slots = quality._slots(words.withColumn("hashes", quality._hashes(F.col("words"))), 64)
    return {r.i: r.slots for r in slots.collect()}


def test_weights_count_all_trusted_texts(spark):
    texts = ["alpha beta gamma " * 4, "alpha beta", "junk # junk", None, "", "delta epsilon zeta eta theta iota kappa lambda mu nu", "alpha beta"]
    ids = [0, 1, 2, 3, None, None, 1]  # an id that repeats, rows without one
    docs = spark.createDataFrame([(d, t, "x") for d, t in zip(ids, texts, strict=True)], SHAPE)
    trusted = spark.createDataFrame([(0,), (1,), (1,), (None,), (99,)], "doc_id long")
    slots = features(spark, texts)
    raw, good = Counter(), Counter()
    for i, d in enumerate(ids):
        raw.update(slots[i])
        if d in (0, 1):
            good.update(slots[i])
    n_raw, n_good = sum(raw.values()) + 64, sum(good.values()) + 64
    expected = [math.log((good[k] + 1) / n_good) - math.log((raw[k] + 1) / n_raw) for k in range(1, 65)]
    for limit in ("10MB", "-1"):  # the trusted ids sent to every task, and met by a shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = quality.slot_weights(docs, trusted, 64)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found == pytest.approx(expected)
    assert quality.slot_weights(docs, trusted.limit(0), 64) == [0.0] * 64
    rows = quality.quality_verdicts(docs, trusted, 64, -0.05).collect()
    assert len(rows) == len(texts)
    plain = {}
    for i, d in enumerate(ids):
        values = [expected[k - 1] for k in slots[i]]
        plain.setdefault(d, []).append(sum(values) / len(values) if values else 0.0)
    for d in set(ids):
        mine = sorted(r.ratio for r in rows if r.doc_id == d)
        assert mine == pytest.approx(sorted(plain[d]), abs=1e-6)
    assert all(r.kept == (not r.base_failed and r.ratio >= -0.05) for r in rows)
