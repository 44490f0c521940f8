"""The training-data pipeline: stages over documents, each written and read by the next one.

1. ``toxicity``: documents that the classifier predicts toxic (score of 0.3 or more) go.
2. ``ngram_jaccard_join``: of each class of near duplicates (texts whose sets of five-word shingles have a
   similarity of 0.8 or more) the document with the smallest id stays, once.
3. ``secret_scans``: every secret span is replaced by its kind in brackets; no document goes.
4. ``mixing``: documents become the copies that the mix takes, in training order; a copy that is taken in
   part is cut after its last word. Documents without words, or beyond their source's target, go.
5. ``byte_bpe``: token ids and digests of every copy.

Stages 1 to 4 return the columns of ``documents`` and no others. In stage 2 a row is named by its id and its
text, so one row of a class stays where ids are null or repeat (null ids count as largest).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangebreak.functions.frames import stage_root
from rangebreak.llm import byte_bpe, jaccard_join, mixing, secrets, toxicity
from rangebreak.llm.queries import table
from rangebreak.llm.ship import ship_code

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_FROM = 0.3
#: Words in a shingle, and the least similarity in percent; those of op1 hold for its query alone.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    classes = jaccard_join.jaccard_rows(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    read = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64(F.col("text").cast("string")))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    # Rows that do not stay: few beside all, and Spark moves texts only if they are many.
    gone = classes.where(~first).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    same = read["doc_id"].eqNullSafe(gone["gone_id"]) & (read["text_key"] == gone["gone_key"])
    found = read.join(gone, same, "left_anti")
    # Of rows with an equal id (or none) and an equal text, one.
    several = read.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).where("rows > 1").select("text_key").distinct()
    if not several.limit(1).count():
        return found.select(*COLUMNS)
    twice = found.join(several, "text_key", "left_semi").dropDuplicates(["doc_id", "text"])
    return found.join(several, "text_key", "left_anti").unionByName(twice).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    others = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    found = secrets.scan_secrets(docs.select(*COLUMNS), redact=True, keep=others)
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.copies(mixing.mix_sources(docs, carry=("text", "lang")))
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return byte_bpe.encode_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: The classifier, the merges and the text cuts have no SQL form; tests hold stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{stage_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
