"""Toxicity of whole texts: bags of subword vectors, averaged, into a linear softmax.

A word is a run of letters, lowered. Its subwords are itself and its character n-grams with marks at
both ends; each is hashed to one row of a table of small vectors. A word's vector is the mean of its
subwords, a text's the mean of its words, and a softmax over two classes reads the text's vector. Vectors
and softmax are trained jointly, in numpy. A misspelt or derived word that was never seen has most of its
n-grams in common with words that were, and so most of its vector.

Two classes need only the difference of the softmax' rows: a word adds ``mean of vectors . difference``,
so scoring is one number per word and one pass over the texts, with no shuffle. New words are valued
together: those of one length have n-grams at the same places, cut as columns, and each distinct n-gram of
these is hashed once.

The fit reads a bounded sample of labelled rows: ``per_class`` rows of each class, those with the
smallest hash of the id, from texts up to ``longest`` characters; classes are weighted back to their
share. The trained table has a fixed size and is broadcast. Rows of the held-out fold are never read.

Null texts and texts without letters get the share of toxic training rows. If the training rows lack a class, every score is
the share of toxic rows (0 if there is none). Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from itertools import batched, chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.llm.text import chunks, let_go, plain_strings

WORD = re.compile(r"[^\W\d_]+")
SLOTS = 1 << 17
NGRAMS = (3, 4, 5)
WIDTH = 4
STEPS = 80
RATE = 0.1
DECAY = 1e-6
#: Texts of the sample that a word must stand in to be fitted.
FEWEST_TEXTS = 5
#: Words whose value a task keeps; beyond that the dictionary starts anew.
KEPT_WORDS = 250_000
#: New words valued at once.
WORDS_AT_ONCE = 100_000
#: Longer words are valued one by one: they are few of a length, and cutting them as columns takes the square of it.
LONG_WORD = 40
#: ASCII letters as they are, blanks in place of all else: `WORD` for ASCII texts, as a translation.
_LETTERS = "".join(c if WORD.match(c) else " " for c in map(chr, range(128)))


def words_of(text: str) -> list[str]:
    text = text.lower()
    return text.translate(_LETTERS).split() if text.isascii() else WORD.findall(text)


def subwords(word: str) -> list[int]:
    marked = f"<{word}>"
    data = [marked]
    for n in NGRAMS:
        data += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return [zlib.crc32(s.encode()) % SLOTS for s in data]


def word_values(words: Iterable[str], table: np.ndarray) -> dict[str, float]:
    """The mean of the table over each word's ``subwords``, bit for bit as word by word."""
    found = {}
    for some in batched(sorted(words, key=len), WORDS_AT_ONCE):
        for size, same in groupby(some, key=len):
            if size > LONG_WORD:
                found.update((w, float(table[subwords(w)].mean())) for w in same)
                continue
            same = list(same)
            marked = pa.array([f"<{w}>" for w in same])
            cuts = [pc.utf8_slice_codeunits(marked, i, i + n) for n in NGRAMS for i in range(size + 3 - n)]
            parts = pa.concat_arrays([marked, *cuts]).dictionary_encode()
            distinct = parts.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            values = table[[zlib.crc32(s) % SLOTS for s in distinct]][parts.indices.to_numpy()]
            # Rows in one piece, as numpy adds up other layouts in another order.
            by_word = np.ascontiguousarray(values.reshape(-1, len(same)).T)
            found.update(zip(same, by_word.mean(axis=1).tolist(), strict=True))
    return found


def _weighted_sums(x: np.ndarray, places: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    taken = x.take(places, axis=0)
    taken *= weights
    return np.add.reduceat(taken, starts, axis=0)


class _Sparse:
    """Rows of weighted columns, as sums by row and, transposed, by column."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray):
        def ordered(by: np.ndarray):
            order = np.argsort(by, kind="stable")
            names, starts = np.unique(by[order], return_index=True)
            return order, names, starts

        self.by_row, self.rows, self.row_starts = ordered(rows)
        self.by_col, self.cols, self.col_starts = ordered(cols)
        # Places as numpy's own integers: `take` would convert others at every step.
        self.row_cols, self.row_weights = cols[self.by_row].astype(np.intp), weights[self.by_row, None]
        self.col_rows, self.col_weights = rows[self.by_col].astype(np.intp), weights[self.by_col, None]

    def times(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, x.shape[1]), np.float32)
        out[self.rows] = _weighted_sums(x, self.row_cols, self.row_weights, self.row_starts)
        return out

    def transposed_times(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, x.shape[1]), np.float32)
        out[self.cols] = _weighted_sums(x, self.col_rows, self.col_weights, self.col_starts)
        return out


def train(texts: list[str], toxic: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Value of every slot, the bias, and the log odds of class 1 without evidence."""
    none = float(np.log(weights[toxic == 1].sum() / weights[toxic == 0].sum()))
    place: dict[str, int] = {}
    rows, cols, counts = array("i"), array("i"), array("f")
    for i, text in enumerate(texts):
        words = words_of(text)
        for w, c in Counter(words).items():
            rows.append(i)
            cols.append(place.setdefault(w, len(place)))
            counts.append(c / len(words))
    random = np.random.default_rng(7)
    rows, cols, counts = np.array(rows), np.array(cols), np.array(counts)
    # A word of one or two texts teaches their topic; it counts in a text's length alone.
    common = np.bincount(cols, minlength=len(place)) >= FEWEST_TEXTS
    slots = [subwords(w) for w, fit in zip(place, common, strict=True) if fit]
    if not slots:
        return np.zeros(SLOTS, np.float32), none, none
    renamed, fit = np.cumsum(common) - 1, common[cols]
    word_of = np.repeat(np.arange(len(slots), dtype=np.int32), [len(s) for s in slots])
    slot_of = np.fromiter(chain.from_iterable(slots), np.int32)
    used, slot_of = np.unique(slot_of, return_inverse=True)
    per_word = np.bincount(word_of, minlength=len(slots))
    in_text = _Sparse(rows[fit], renamed[cols[fit]], counts[fit])
    in_word = _Sparse(word_of, slot_of, (1 / per_word[word_of]).astype(np.float32))
    y = np.stack([1 - toxic, toxic], axis=1).astype(np.float32)
    share = (weights / weights.sum()).astype(np.float32)[:, None]
    vectors = random.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32)
    softmax = random.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    prior = (share * y).sum(0)
    # The bias stays at the share of the classes: words that were never seen move a text nowhere else.
    bias = np.log(prior / prior.sum()).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax)]
    for step in range(1, steps + 1):
        words = in_word.times(vectors, len(slots))
        means = in_text.times(words, len(texts))
        logits = means @ softmax + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        error = (p - y) * share
        d_means = error @ softmax.T
        d_vectors = in_word.transposed_times(in_text.transposed_times(d_means, len(slots)), len(used))
        for k, (value, grad) in enumerate(
            ((vectors, d_vectors + DECAY * vectors), (softmax, means.T @ error + DECAY * softmax))
        ):
            m, v = state[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    table = np.zeros(SLOTS, np.float32)
    table[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    return table, float(bias[1] - bias[0]), none


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> DataFrame:
    """The sample's rows ``(doc_id, toxic, size, text)``; ``size`` is how many training rows the class has."""
    marks = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where("toxic in (0, 1) and doc_id is not null")
        .where(fold(F.col("doc_id")) != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    fit = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    present = fit.where(F.length("text") <= longest).select("doc_id").distinct().join(marks, "doc_id")
    sizes = present.groupBy("toxic").agg(F.count("*").alias("size"))
    ids = None
    for k in (0, 1):
        own = present.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        # Under names of their own, or the two branches of the union differ by an alias and each reads the texts.
        own = own.select(F.col("doc_id").alias("id"), F.col("toxic").alias("class"))
        ids = own if ids is None else ids.unionByName(own)
    # At most 2 sizes and 2 * per_class ids: a proven bound for the broadcasts and for the rows that one task fits.
    # The sizes come from the shuffle that finds the ids and travel with the rows, in place of a job of their own.
    return (
        fit.where(F.length("text") <= longest)
        .join(F.broadcast(ids.join(F.broadcast(sizes), F.col("class") == F.col("toxic"))), F.col("doc_id") == F.col("id"))
        .groupBy("doc_id", "toxic", "size")
        .agg(F.min("text").alias("text"))
    )


def fitted(sample: DataFrame) -> tuple[np.ndarray | None, float, float]:
    """The model of a bounded sample, trained by one task; only the table of fixed size comes back.

    If the sample lacks a class there is no table, and the odds without evidence are infinite.
    """

    def run(batches):
        batches = list(batches)
        toxic = np.concatenate([np.zeros(0, np.int32), *(b.column("toxic").to_numpy() for b in batches)])
        if len(np.unique(toxic)) < 2:
            table, bias, none = None, 0.0, np.inf if toxic.any() else -np.inf
        else:
            rows = pa.Table.from_batches(batches).sort_by("doc_id")
            toxic, size = rows.column("toxic").to_numpy(), rows.column("size").to_numpy()
            table, bias, none = train(rows.column("text").to_pylist(), toxic, size / np.bincount(toxic)[toxic])
            table = table.tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([table], pa.binary()), pa.array([bias]), pa.array([none])], names=["table", "bias", "none"]
        )

    row = sample.repartition(1).mapInArrow(run, "table binary, bias double, none double").first()
    if row is None or row["table"] is None:
        return None, 0.0, row["none"] if row else -np.inf
    return np.frombuffer(row["table"], np.float32), row["bias"], row["none"]


def _scores(batches, model, keep):
    table, bias, none = model.value
    values = {}
    for batch in batches:
        out = []
        texts = plain_strings(batch.column("text"))
        for at, to, _, _ in chunks(texts):
            found = [words_of(text) for text in texts.slice(at, to - at).to_pylist()]
            values |= word_values(set().union(*found).difference(values), table)
            out += [bias + sum(map(values.__getitem__, words)) / len(words) if words else none for words in found]
            if len(values) > KEPT_WORDS:
                values.clear()
        odds = np.clip(np.array(out), -700, 700)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-odds)))], names=[*keep, "score"]
        )
    values.clear()
    let_go()


def score_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = 4000, longest: int = 50_000, keep: tuple[str, ...] = ("doc_id", "text")
) -> DataFrame:
    """The ``keep`` columns and ``score``, for every row of ``docs``. A text that is not kept does not come back from Python."""
    spark = docs.sparkSession
    read = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((*keep, "text")))).withColumn("text", F.col("text").cast("string"))
    table, bias, none = fitted(labelled_sample(docs, labels, per_class, longest))
    if table is None:
        return read.select(*(F.col(f"`{c}`") for c in keep), F.lit(1.0 if none > 0 else 0.0).alias("score"))
    model = spark.sparkContext.broadcast((table, bias, none))
    types = dict(read.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double"
    return read.mapInArrow(lambda batches: _scores(batches, model, keep), schema)
