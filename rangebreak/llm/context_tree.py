"""Language-model scores of texts: context-tree weighting over whole bytes, and a unigram base score.

*The tree model.* A text is its UTF-8 bytes with A-Z lowered, and an end mark; before it stand end marks. A byte
is coded by eight binary decisions from its high bit down. Each decision has a context tree over the last
``depth`` bytes: every node on the path estimates the bit by Krichevsky and Trofimov's rule, and weighting mixes
all depths: ``P(s) = KT(s) / 2 + product of P(children) / 2``. After training, the probability of a bit is the
mixture of the nodes' estimates with the posterior weights that this recursion gives to each depth, so the score
is the code length under the weighted trees. A node that no training text reaches has its parent's mixture.

Trees are sparse and grow with the corpus: one row per gram (a context and the byte after it) that stands in any
text, with its count in the training texts. Rows are grouped by the two bytes before the gram's last one; a group
folds its part of the trees from the farthest byte on. What remains above, one row per pair of bytes and
decision, is bounded by the alphabet and folded at once: it turns each group's mixtures into those at the root.

*The base score.* Tokens are words and one end per text, estimated by add-one counts over all training tokens.

Words and grams that stand often are looked up in broadcast tables of at most ``TABLE_WORDS`` and
``TABLE_GRAMS`` rows; all others go through a join, so no vocabulary and no tree is too large.

Null texts count as empty: an end alone. Rows without an id belong to the training fold. Without training
texts every decision is a half and base estimates are one. Repeated rows count and are scored each.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage
from rangebreak.llm.text import Words, chunks, let_go

#: Bytes of context; at most 6, as a gram and a flag stand in one number.
DEPTH = 5
#: Stands before and after a text: no byte of UTF-8.
END = 255
#: Bytes of context that name a group, and the levels that are folded at once.
TOP = 2
BITS = 8
#: Words and grams in the broadcast tables at most.
TABLE_WORDS, TABLE_GRAMS = 1 << 20, 1 << 21
#: Words of training texts, and distinct grams, that a task holds before it gives their counts out.
PENDING_WORDS, PENDING_GRAMS = 4_000_000, 4_000_000


def fold(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7, F.lit(0))


# --- counts -----------------------------------------------------------------------------------------


def _word_counts(batches):
    """``(key, count)`` of word hashes, and with a null key the numbers of texts and words in ``count`` and ``words``."""
    texts, words_seen, pending, waiting = 0, 0, [], 0

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(counts, pa.int64()), pa.array(np.zeros(len(keys), np.int64))],
            names=["key", "count", "words"],
        )

    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            hashes = Words(data, offsets).hashes
            texts += len(offsets) - 1
            words_seen += len(hashes)
            pending.append(hashes)
            waiting += len(hashes)
            if waiting >= PENDING_WORDS:
                yield rows(*np.unique(np.concatenate(pending), return_counts=True))
                pending, waiting = [], 0
    if waiting:
        yield rows(*np.unique(np.concatenate(pending), return_counts=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array([None], pa.int64()), pa.array([texts]), pa.array([words_seen])], names=["key", "count", "words"]
    )


def grams_of(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram of every byte and end mark of a run of texts, and where each text's grams begin.

    The nearest byte of the context stands highest, the byte that follows it lowest.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    line = np.full(len(data) + n * (depth + 1), END, np.uint8)
    line[np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, lengths)] = data
    place = np.arange(len(data) + n) + np.repeat(np.arange(n) * depth + depth, lengths + 1)
    wide = line.astype(np.int64)
    gram = wide[place]
    for k in range(1, depth + 1):
        gram |= wide[place - k] << (8 * (depth + 1 - k))
    return gram, offsets[:-1] + np.arange(n)


def _gram_counts(batches, depth: int):
    """``(gram, train, total)``: counts in the training texts and in all."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    pending, waiting = [], 0

    def merged():
        every = np.concatenate([keys, *(k for k, _ in pending)])
        order = np.argsort(every, kind="stable")
        every = every[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        summed = np.concatenate([counts, *(c for _, c in pending)])[order]
        return every[starts], np.add.reduceat(summed, starts) if len(starts) else summed

    def rows():
        for at in range(0, len(keys), 1 << 18):
            key, count = keys[at : at + (1 << 18)], counts[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key >> 1), pa.array(np.where(key & 1, 0, count)), pa.array(count)], names=["gram", "train", "total"]
            )

    for batch in batches:
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
        for at, to, data, offsets in chunks(batch.column("text")):
            grams, _ = grams_of(Words(data, offsets).bytes, offsets, depth)
            flags = np.repeat(held[at:to], np.diff(offsets) + 1)
            pending.append(np.unique(grams << 1 | flags, return_counts=True))
            waiting += len(pending[-1][0])
            if waiting >= PENDING_GRAMS:
                keys, counts = merged()
                pending, waiting = [], 0
                if len(keys) >= PENDING_GRAMS:
                    yield from rows()
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    yield from rows()
    let_go()


# --- weighting --------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


#: Logarithms of the gamma function at small counts plus a half, and plus one.
_SMALL = np.arange(4096)
_HALVES, _WHOLES = log_gamma(_SMALL + 0.5), log_gamma(_SMALL + 1.0)


def _log_gamma_of(counts: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(counts, len(table) - 1)]
    large = counts >= len(table)
    if large.any():
        out[large] = log_gamma(counts[large] + shift)
    return out


def block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a block of so many zeros and ones, by Krichevsky and Trofimov."""
    return (
        _log_gamma_of(zeros, _HALVES, 0.5) + _log_gamma_of(ones, _HALVES, 0.5) - _log_gamma_of(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)
    )


class Level:
    """Nodes of one depth, in order of ``keys``: their counts, weighted log probabilities and weights of their own estimate."""

    def __init__(self, keys, zeros, ones, below=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.seen = zeros + ones
        block = block_log(zeros, ones)
        self.log = block if below is None else np.logaddexp(block, below) - np.log(2)
        self.stop = np.exp(np.minimum(block - np.log(2) - self.log, 0.0))

    def parents(self) -> tuple[Level, np.ndarray]:
        """The level above, and the parent of every node: its key without the farthest byte."""
        keys = self.keys >> 8
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts = np.flatnonzero(first)
        above = Level(keys[starts], *(np.add.reduceat(x, starts) for x in (self.zeros, self.ones, self.log)))
        return above, np.cumsum(first) - 1


def decision(symbol: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the k-th decision about a byte, and the bit taken there."""
    return (1 << k) | symbol >> (BITS - k), symbol >> (BITS - 1 - k) & 1


def weigh_grams(grams: np.ndarray, train: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, list[Level]]:
    """Mixture of depths ``top`` and more for the bit that each gram takes at each decision (-1 where depth ``top``
    has no training counts), and the nodes of that depth for each of the decisions of a byte.
    """
    shares, tops = np.empty((len(grams), BITS)), []
    for k in range(BITS):
        node, bit = decision(grams & 255, k)
        keys = node << (8 * depth) | grams >> 8
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        starts, leaf = np.flatnonzero(first), np.cumsum(first) - 1
        bit, count = bit[order], train[order]
        level = Level(keys[starts], np.add.reduceat(np.where(bit, 0, count), starts), np.add.reduceat(np.where(bit, count, 0), starts))
        at = np.arange(len(starts))
        one, zero = (level.ones + 0.5) / (level.seen + 1), (level.zeros + 0.5) / (level.seen + 1)
        for _ in range(depth - top):
            above, parent = level.parents()
            known, at = level.seen[at] > 0, parent[at]
            stop = np.where(known, above.stop[at], 1.0)
            one = stop * (above.ones[at] + 0.5) / (above.seen[at] + 1) + (1 - stop) * one
            zero = stop * (above.zeros[at] + 0.5) / (above.seen[at] + 1) + (1 - stop) * zero
            level = above
        known = level.seen[at] > 0
        one, zero = np.where(known, one, -1.0), np.where(known, zero, -1.0)
        shares[order, k] = np.where(bit, one[leaf], zero[leaf])
        tops.append(level)
    return shares, tops


_WEIGHED = "gram long, total long, shares binary"


def _weigh_group(group: pa.Table, depth: int) -> pa.Table:
    """Grams of one pair of last bytes with the mixtures of their bits, and one row without gram with the nodes of the pair."""
    grams, train = group.column("gram").to_numpy(), group.column("train").to_numpy()
    shares, tops = weigh_grams(grams, train, depth, TOP)
    raw = pa.py_buffer(np.ascontiguousarray(shares, np.float32).tobytes())
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * BITS), len(grams), [None, raw]).cast(pa.binary())
    nodes = b"".join(
        np.concatenate([getattr(t, x) for t in tops]).astype(kind).tobytes()
        for x, kind in (("keys", np.int64), ("zeros", np.int64), ("ones", np.int64), ("log", np.float64))
    )
    return pa.table(
        {
            "gram": pa.chunked_array([pa.array(grams), pa.array([None], pa.int64())]),
            "total": pa.chunked_array([group.column("total").combine_chunks(), pa.array([None], pa.int64())]),
            "shares": pa.chunked_array([packed, pa.array([nodes], pa.binary())]),
        }
    )


class Top:
    """The trees above the groups: a bit's mixture at the root is ``base + rest * mixture at depth TOP``."""

    def __init__(self, nodes: list[bytes]):
        parts = [np.frombuffer(x, np.int64).reshape(4, -1) for x in nodes]
        keys, zeros, ones, logs = np.concatenate([np.zeros((4, 0), np.int64), *parts], axis=1)
        order = np.argsort(keys)
        level = Level(keys[order], zeros[order], ones[order])
        level.log = np.ascontiguousarray(logs).view(np.float64)[order]
        self.keys = level.keys
        at = np.arange(len(self.keys))
        self.one, self.zero, self.rest = np.zeros(len(at)), np.zeros(len(at)), np.ones(len(at))
        for _ in range(TOP if len(at) else 0):
            above, parent = level.parents()
            known, at = level.seen[at] > 0, parent[at]
            stop = np.where(known, above.stop[at], 1.0)
            self.one = stop * (above.ones[at] + 0.5) / (above.seen[at] + 1) + (1 - stop) * self.one
            self.zero = stop * (above.zeros[at] + 0.5) / (above.seen[at] + 1) + (1 - stop) * self.zero
            self.rest = (1 - stop) * self.rest
            level = above

    def scores(self, grams: np.ndarray, shares: np.ndarray, depth: int) -> np.ndarray:
        """Log10 probability of each gram's last byte."""
        out = np.zeros(len(grams))
        for k in range(BITS):
            node, bit = decision(grams & 255, k)
            at = np.searchsorted(self.keys, node << (8 * TOP) | grams >> (8 * (depth + 1 - TOP)))
            out += np.log10(np.where(bit, self.one[at], self.zero[at]) + self.rest[at] * np.maximum(shares[:, k], 0.0))
        return out


def _gram_scores(batches, model, depth: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        grams = batch.column("gram").to_numpy()
        shares = np.frombuffer(b"".join(batch.column("shares").to_pylist()), np.float32).reshape(-1, BITS).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("gram"), batch.column("total"), pa.array(model.value.scores(grams, shares, depth))],
            names=["key", "count", "log"],
        )


def gram_table(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, count, log``: every gram of ``text``, how often it stands, and its log10 probability after the training rows."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(lambda batches: _gram_counts(batches, depth), "gram long, train long, total long")
    weighed = (
        counted.groupBy("gram")
        .agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
        .withColumn("pair", F.shiftright("gram", 8 * (depth + 1 - TOP)))
        # A number of its own: groups are few bytes and much work, so they are not put together by size.
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pair")
        .groupBy("pair")
        .applyInArrow(lambda group: _weigh_group(group, depth), _WEIGHED)
    )
    weighed = write_stage(weighed, "lm-weighed")
    # One row for each pair of bytes that stands in a text, with its decisions: bounded by the alphabet.
    nodes = [bytes(r["shares"]) for r in weighed.where("gram is null").select("shares").collect()]
    model = spark.sparkContext.broadcast(Top(nodes))
    scored = weighed.where("gram is not null").mapInArrow(
        lambda batches: _gram_scores(batches, model, depth), "key long, count long, log double"
    )
    return write_stage(scored, "lm-grams")


# --- scores -----------------------------------------------------------------------------------------


def often(counted: DataFrame, most: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Least count, sorted keys and values of the rows of ``key, count, log`` that stand most often, ``most`` rows at most.

    The rest are the rows below that count.
    """
    powers = counted.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count("*").alias("rows")).collect()
    power, taken = 64, 0
    for r in sorted(powers, key=lambda r: -r["power"]):
        if taken + r["rows"] > most:
            break
        power, taken = r["power"], taken + r["rows"]
    rows = counted.where(F.col("count") >= 2.0**power).select("key", "log").toArrow()  # ``most`` rows at most
    keys = rows.column("key").to_numpy()
    order = np.argsort(keys)
    return 2.0**power, keys[order], rows.column("log").to_numpy()[order]


def _look_up(keys: np.ndarray, known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and their values (zero for others)."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    different, back = np.unique(keys, return_inverse=True)
    place = np.minimum(np.searchsorted(known, different), len(known) - 1)
    hit = known[place] == different
    return hit[back], np.where(hit, logs[place], 0.0)[back]


def _lists(values: np.ndarray, owners: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n + 1)), pa.int32()), pa.array(values))


def _score(batches, model, depth: int):
    (_, words_known, word_logs), (_, grams_known, gram_logs) = model.value
    serial = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at, to, data, offsets in chunks(batch.column("text")):
            n = to - at
            words = Words(data, offsets)
            hit, logs = _look_up(words.hashes.view(np.int64), words_known, word_logs)
            base = np.bincount(words.text, weights=logs, minlength=n).astype(np.float64)
            known = np.bincount(words.text[hit], minlength=n)
            grams, begins = grams_of(words.bytes, offsets, depth)
            met, values = _look_up(grams, grams_known, gram_logs)
            owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(serial + np.arange(n)),
                    batch.column("doc_id").slice(at, n),
                    batch.column("held_out").slice(at, n),
                    pa.array(words.counts.astype(np.int64) + 1),
                    pa.array(known.astype(np.int64)),
                    pa.array(base),
                    pa.array(np.add.reduceat(values, begins)),
                    _lists(words.hashes[~hit].view(np.int64), words.text[~hit], n),
                    _lists(grams[~met], owner[~met], n),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "grams"],
            )
            serial += n
    let_go()


def _rest(scored: DataFrame, column: str, counted: DataFrame, below: float) -> DataFrame:
    """Per row what the table of ``column`` did not have: rows found and sum of their values."""
    keys = scored.select("row", F.explode(column).alias("key"))
    rare = counted.where(F.col("count") < below).select("key", "log")
    return keys.join(rare, "key").groupBy("row").agg(F.count("*").alias(f"{column}_found"), F.sum("log").alias(f"{column}_log"))


def language_scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``."""
    if not TOP < depth <= 6:
        raise ValueError(f"depth must be from {TOP + 1} to 6, not {depth}")
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold(F.col("doc_id")) == 2).alias("held_out"))
    fit = read.where(~F.col("held_out")).select("text")
    counts = fit.mapInArrow(_word_counts, "key long, count long, words long")
    counts = counts.groupBy("key").agg(F.sum("count").alias("count"), F.sum("words").alias("words"))
    counts = write_stage(counts, "lm-counts")
    totals = counts.where("key is null").collect()  # one row at most
    texts, train_words = (totals[0]["count"], totals[0]["words"]) if totals else (0, 0)
    vocabulary = counts.where("key is not null").select("key", "count", F.log10(F.col("count") + 1.0).alias("log"))
    distinct = vocabulary.count() + (texts > 0)
    grams = gram_table(read.select("text", "held_out"), depth)
    words_table, grams_table = often(vocabulary, TABLE_WORDS), often(grams, TABLE_GRAMS)
    model = spark.sparkContext.broadcast((words_table, grams_table))
    scored = read.mapInArrow(
        lambda batches: _score(batches, model, depth),
        "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double,"
        " words array<long>, grams array<long>",
    )
    scored = write_stage(scored, "lm-scored")
    tokens = train_words + texts
    end, size = float(np.log10(texts + 1)), float(np.log10(tokens + distinct + 1))
    nothing = F.lit(0.0)
    base = F.col("base") + F.coalesce("words_log", nothing) + end - F.col("n_tokens") * size
    return (
        scored.drop("words", "grams")
        .join(_rest(scored, "words", vocabulary, words_table[0]), "row", "left")
        .join(_rest(scored, "grams", grams, grams_table[0]), "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("words_found", F.lit(0)) + int(texts > 0)).alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("score") + F.coalesce("grams_log", nothing)).alias("score"),
        )
    )
