"""Byte-level BPE by given ranks, with a hierarchical-bitmap queue of merge ranks.

Each match of the split pattern is encoded alone: a match that is a token as a whole is that token;
otherwise the neighbouring pair of lowest rank (the leftmost on ties) merges until no pair has a rank.

The pieces of many matches lie in one doubly linked list with no link across matches, and one queue
serves them all: a bucket per rank holds the positions of pairs with that rank, two levels of bitmaps
tell which buckets are filled, and find-first-set picks the next rank. An entry whose pair has changed
since is stale and skipped. A match of n bytes costs O(n) queue operations whatever its length, so one
very long match is no special case. Matches of different texts do not interact, so the order in which the
queue serves them does not matter.

Null texts count as empty: no tokens, and the digests of empty strings. The vocabulary's path is a
parameter; executors read it from their own installation of the tokenizer files. Encoded matches are
kept from text to text in two dictionaries of bounded size, as long as a task runs.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.llm.text import let_go, plain_strings

#: Estimated bytes of encoded matches in one of the two dictionaries that a task keeps.
KEPT_BYTES = 30_000_000
#: Characters of text whose matches are encoded together.
GROUP_CHARS = 1_500_000
#: Matches that share one queue.
MATCHES_AT_ONCE = 1_000
_WORD = 64


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = (line.split() for line in f)
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        # merges[left].get(right): rank of the token that two neighbours make, for every cut of every token.
        none: dict[int, int] = {}
        self.merges = [none] * (max(self.tokens) + 1)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    if self.merges[left] is none:
                        self.merges[left] = {}
                    self.merges[left][right] = rank
        self.byte_tokens = np.array(self.byte, dtype=np.int32)
        self.byte_pairs = np.array([self.merges[x].get(y, -1) for x in self.byte for y in self.byte], dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        """Matches met since the last turn, and those met before it."""
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.kept_bytes = 0

    def encode_matches(self, matches: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each of several matches, by one queue over all their bytes."""
        if not matches:
            return []
        data = np.frombuffer(b"".join(matches), dtype=np.uint8)
        ends = np.cumsum([len(m) for m in matches])
        first = np.full(len(data), -1, dtype=np.int32)
        first[:-1] = self.byte_pairs[data[:-1].astype(np.int32) * 256 + data[1:]]
        first[ends - 1] = -1
        links = np.arange(1, len(data) + 1)
        links[ends - 1] = -1
        after = links.tolist()
        links = np.arange(-1, len(data) - 1)
        links[ends[:-1]] = -1
        before = links.tolist()
        token, rank_at, merges = self.byte_tokens[data].tolist(), first.tolist(), self.merges

        # The queue: positions by rank, each bucket a heap; bits of filled buckets; bits of filled words.
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        filled, starts = np.unique(first[order], return_index=True)
        positions = order.tolist()
        bounds = [*starts.tolist(), len(positions)]
        buckets = {r: positions[a:b] for r, a, b in zip(filled.tolist(), bounds, bounds[1:], strict=False)}
        words = [0] * (len(merges) // _WORD + 1)
        top = 0
        for r in buckets:
            words[r // _WORD] |= 1 << (r % _WORD)
            top |= 1 << (r // _WORD)

        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word * _WORD + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            lower = False
            while bucket and not lower:
                i = heappop(bucket)
                if rank_at[i] != rank:
                    continue
                j = after[i]
                k = after[i] = after[j]
                token[i] = rank
                token[j] = rank_at[j] = -1
                found = -1
                if k >= 0:
                    before[k] = i
                    found = merges[rank].get(token[k], -1)
                rank_at[i] = found
                h = before[i]
                behind = -1
                if h >= 0:
                    behind = merges[token[h]].get(rank, -1)
                    if behind == rank_at[h]:
                        behind = -1
                    else:
                        rank_at[h] = behind
                for r, at in ((found, i), (behind, h)):
                    if r >= 0:
                        if r in buckets:
                            heappush(buckets[r], at)
                        else:
                            buckets[r] = [at]
                        word_of = r // _WORD
                        words[word_of] |= 1 << (r % _WORD)
                        top |= 1 << word_of
                        lower = lower or r < rank
            if not bucket:
                words[word] &= ~(1 << (rank % _WORD))
                if not words[word]:
                    top &= ~(1 << word)
        out, at = [], 0
        for end in ends.tolist():
            out.append(tuple([t for t in token[at:end] if t >= 0]))
            at = end
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        if self.kept_bytes > KEPT_BYTES:
            # What is met again moves over from the older dictionary, so frequent matches stay.
            self.known, self.older, self.kept_bytes = {}, self.known, 0
        known, older = self.known, self.older
        unmet = set(chain.from_iterable(split)).difference(known)
        again = unmet.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        fresh = []
        for match in unmet - again:
            whole = self.ranks.get(match.encode())
            if whole is None:
                fresh.append(match)
            else:
                known[match] = (whole,)
        for at in range(0, len(fresh), MATCHES_AT_ONCE):
            some = fresh[at : at + MATCHES_AT_ONCE]
            known.update(zip(some, self.encode_matches([m.encode() for m in some]), strict=True))
        self.kept_bytes += sum(200 + 4 * len(m) + 8 * len(known[m]) for m in unmet)
        return [list(chain.from_iterable(map(known.__getitem__, matches))) for matches in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One tokenizer per Python worker."""
    return ByteBPE(path, pattern)


def _groups(texts: list[str]):
    at = 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) <= GROUP_CHARS):
            chars += len(texts[to])
            to += 1
        yield at, to
        at = to


def _resolve(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers as public

    return path or public.path("byte_bpe_multi_50k.tiktoken"), pattern or public.PATTERN


def encoded_batches(batches, path: str | None = None, pattern: str | None = None):
    """``(ids, tokens of each text)`` of some rows at a time: Python strings of a whole batch are many."""
    bpe = tokenizer(*_resolve(path, pattern))
    for batch in batches:
        for row in range(0, len(batch), 500):
            texts = plain_strings(batch.column("text").slice(row, 500)).to_pylist()
            for at, to in _groups(texts):
                yield batch.column("doc_id").slice(row + at, to - at), bpe.encode(texts[at:to])
    bpe.forget()
    let_go()


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Every row of ``docs`` with its token ids, its decoded bytes' digest and the ids' digest.

    Columns: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``token_ids``.
    One pass without a shuffle; memory follows the longest text.
    """

    def run(batches):
        bpe = tokenizer(*_resolve(path, pattern))
        for doc_ids, encoded in encoded_batches(batches, path, pattern):
            counts = [len(ids) for ids in encoded]
            named = [hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest() for ids in encoded]
            decoded = [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded]
            columns = [doc_ids, pa.array(counts, pa.int64()), pa.array(named, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                tokens = pa.array(np.fromiter(chain.from_iterable(encoded), np.int32, sum(counts)))
                columns.append(pa.ListArray.from_arrays(offsets, tokens))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, schema + ", token_ids array<int>" * keep_ids
    )
