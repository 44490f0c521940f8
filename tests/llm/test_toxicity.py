"""Toxicity: words and their values in bulk against one by one, and what its plans read and move."""

import random
import re
import zlib

import numpy as np
import pytest

from rangebreak.llm import queries, toxicity
from tests.llm.test_operators import documents, toxic_corpus

LABELS = "doc_id long, quality int, toxic int"


def odd_words():
    r = random.Random(4)
    letters = "abcxyzéßçñжщ中文字𝒜𐐷½²Ⅷª"
    # Lengths around the shortest n-grams, around numpy's change of summation order, and beyond the bulk's longest.
    lengths = [1, 2, 3, 4, 5, 8, 13, toxicity.LONG_WORD - 1, toxicity.LONG_WORD, toxicity.LONG_WORD + 1, 300]
    return {"".join(r.choices(letters[:3] if i % 2 else letters, k=n)) for n in lengths for i in range(60)} | {"lone" * 7}


@pytest.mark.parametrize("at_once", [7, 100_000])
def test_words_valued_together_have_the_values_of_each_alone(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
    table = np.random.default_rng(3).normal(0, 3, toxicity.SLOTS).astype(np.float32)
    words = odd_words()
    plain = {}
    for w in words:
        m = f"<{w}>"
        parts = [m] + [m[i : i + n] for n in (3, 4, 5) for i in range(len(m) - n + 1)]
        plain[w] = float(table[[zlib.crc32(p.encode()) % (1 << 17) for p in parts]].mean())
    assert toxicity.word_values(words, table) == plain
    assert toxicity.word_values([], table) == {}


def test_words_valued_together_hash_a_shared_subword_once(monkeypatch):
    words = [f"{a}{b}banana" for a in "cdefgh" for b in "cdefgh"]
    hashed, real = [], zlib.crc32
    table = np.random.default_rng(3).normal(size=toxicity.SLOTS).astype(np.float32)
    monkeypatch.setattr(toxicity.zlib, "crc32", lambda s: hashed.append(s) or real(s))
    toxicity.word_values(set(words), table)
    assert len(hashed) == len(set(hashed))


def test_words_of_a_text_are_runs_of_letters():
    every = "".join(chr(c) + ("B" if c % 3 else "") for c in range(0x11000) if not 0xD800 <= c < 0xE000)
    texts = ["", " ", "One, two_three4five\x00six\x1cseven\x85eight", "ＡB İi ΑΣ. K½ ²x Ⅷ", "".join(map(chr, range(128))) * 2, every]
    for text in texts:
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", text.lower())


def test_scores_are_those_of_each_word_alone_whatever_columns_are_kept(spark):
    texts, labels = toxic_corpus()
    docs = documents(spark, texts + [(9000, None), (9001, ""), (9002, "x" * 5000 + " vexnored"), (None, "vexnored ñandú")], extra=True)
    frame = spark.createDataFrame(labels, LABELS)
    both = toxicity.score_toxicity(docs, frame)
    assert both.columns == ["doc_id", "text", "score"]
    whole = sorted((str(x.doc_id), x.score) for x in both.collect())
    table, bias, none = toxicity.fitted(toxicity.labelled_sample(docs, frame, 4000, 50_000))
    plain = []
    for x in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\W\d_]+", (x.text or "").lower())
        odds = bias + sum(float(table[toxicity.subwords(w)].mean()) for w in words) / len(words) if words else none
        plain.append((str(x.doc_id), float(1 / (1 + np.exp(-np.float64(odds))))))
    assert whole == sorted(plain)
    only = toxicity.score_toxicity(docs, frame, keep=("doc_id",))
    assert only.columns == ["doc_id", "score"]
    assert sorted((str(x.doc_id), x.score) for x in only.collect()) == whole


@pytest.mark.parametrize("mark, score", [(1, 1.0), (0, 0.0)])
def test_one_class_alone_is_the_score_of_every_text(spark, mark, score):
    docs = documents(spark, [(i, "some text") for i in range(20)] + [(None, None)])
    frame = spark.createDataFrame([(i, 1, mark) for i in range(20)], LABELS)
    assert {x.score for x in toxicity.score_toxicity(docs, frame).collect()} == {score}


def test_the_sample_reads_texts_twice_and_scoring_sends_none_back(spark, tmp_path):
    texts, labels = toxic_corpus()
    folder = str(tmp_path)
    documents(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, frame = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")

    sample = toxicity.labelled_sample(docs, frame, 50, 50_000)
    rows = sample.collect()
    fit = [y for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert {(x.toxic, x.size) for x in rows} == {(k, fit.count(k)) for k in (0, 1)} and len(rows) == 100
    final = sample._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line]
    assert sum("text#" in line for line in scans) == 2 and len(scans) == 3

    # What comes back from Python: the id and the score.
    plan = queries.op4_toxicity(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    (back,) = (line for line in plan.splitlines() if "MapInArrow" in line)
    assert re.findall(r"(\w+)#", back.split(", [", 1)[1].split("]")[0]) == ["doc_id", "score"]
