"""The pipeline's stages and queries, against the registered SQL and plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from rangebreak.llm import queries
from tests.llm.test_operators import WORD, brute_classes, documents, odd_texts, reference_tokenizer, toxic_corpus
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(queries.SQL))
def test_query_agrees_with_sql(spark, key):
    problems, _, _ = compare(spark, connect(SF), SF, key, queries.QUERIES[key], queries.SQL[key])
    assert not problems


def test_registration():
    numbers = [int(m[1]) for k in entry.queries() if (m := re.match(r"op(\d+)_", k))]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(pipeline.STAGES) == 5


def test_stages_against_plain_python(spark, tmp_path):
    texts, labels = toxic_corpus()
    texts = [t for t in texts if t[0] < 400] + [(1000 + i, t) for i, t in odd_texts() if i is not None]
    texts += [(9000, "river token = abcdefgh1234 bread garden"), (9001, None), (None, "story of no id")]
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = documents(spark, texts, extra=True)

    def step(k, docs):
        path = f"{folder}/{k}"
        pipeline.STAGES[k][1](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    kept = step(0, docs)
    assert tuple(kept.columns) == pipeline.COLUMNS
    bad, given = {i for i, _, y in labels if y and i < 400}, {i for i, _ in texts}
    ids = {r.doc_id for r in kept.collect()}
    lost = given - bad - ids
    # The odd texts are of words that the classifier has never seen.
    assert len(ids & bad) <= 0.05 * len(bad) and len(lost) <= 2 and not any(i < 400 for i in lost)

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = step(1, kept)
    assert tuple(single.columns) == pipeline.COLUMNS
    want = {i for i, _, c in brute_classes(rows, 5, 80) if i == c and i is not None}
    got = Counter(r.doc_id for r in single.collect())
    assert set(got) - {None} == want and max(n for i, n in got.items() if i is not None) == 1

    clean = step(2, single)
    assert tuple(clean.columns) == pipeline.COLUMNS and clean.count() == single.count()
    assert clean.where("doc_id = 9000").first().text == "river [assign] bread garden"

    mixed = step(3, clean)
    assert tuple(mixed.columns) == pipeline.COLUMNS
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in clean.collect()}
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert abs(sum(taken.values()) - sum(size.values())) < 5 and all(n <= 3 * size[i] for i, n in taken.items())

    last = step(4, mixed)
    _, _, library = reference_tokenizer()
    want = Counter(hashlib.sha256(",".join(map(str, library.encode_ordinary(r.text))).encode()).hexdigest() for r in mixed.collect())
    assert Counter(r.ids_sha256 for r in last.collect()) == want


def test_near_copies_between_the_two_rules_go(spark):
    """Copies that five words and 0.8 link and three words and 0.9 do not; one below both stays."""
    r = random.Random(12)
    base = [f"w{r.randrange(100_000)}" for _ in range(200)]

    def copy(places):
        return " ".join(f"x{k}" if k in places else w for k, w in enumerate(base))

    runs = [set(range(60, 60 + n)) for n in (10, 16)]
    texts = [(0, " ".join(base)), (1, copy(runs[0])), (2, copy(runs[1])), (3, copy({20, 70, 120, 170})), (4, copy(set(range(100, 130))))]
    for i in (1, 2, 3):
        pair = [texts[0], texts[i]]
        assert (i, 0) not in {(d, c) for d, _, c in brute_classes(pair)} and (i, 0) in {(d, c) for d, _, c in brute_classes(pair, 5, 80)}
    got = pipeline.drop_near_duplicates(spark, documents(spark, texts), SF).collect()
    assert Counter(x.doc_id for x in got) == Counter([0, 4])

    rows = [t for t in odd_texts() if t[0] is not None]
    got = pipeline.drop_near_duplicates(spark, documents(spark, rows), SF).collect()
    assert Counter(x.doc_id for x in got) == Counter({i for i, _, c in brute_classes(rows, 5, 80) if i == c})


def test_one_row_of_a_class_stays_without_ids_and_under_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(60))
    near, other = long.replace("w7 ", "x7 "), " ".join(f"v{k}" for k in range(30))
    texts = [(1, long), (None, long), (None, long), (None, near), (5, near), (5, long), (5, other), (5, other), (None, other)]
    texts += [(None, "alone of all"), (7, None), (None, ""), (8, "")]
    got = pipeline.drop_near_duplicates(spark, documents(spark, texts, extra=True), SF).collect()
    want = [(1, long), (5, other), (None, "alone of all"), (7, None), (None, ""), (8, "")]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want) and tuple(got[0].asDict()) == pipeline.COLUMNS


def test_no_table_stays_in_the_catalog(spark):
    before = {d.name for d in spark.catalog.listDatabases()}
    queries.QUERIES["op1_ngram_jaccard_join"](spark, SF).count()
    assert {d.name for d in spark.catalog.listDatabases()} == before and not spark.catalog.listTables()
