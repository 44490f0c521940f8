"""BPE by ordered merges: tokens are guessed by longest match, the guess is verified, failures are merged.

A match of the split pattern (a word) is first cut greedily into the longest tokens. The result is what the
merges give exactly if every two neighbours are *compatible*: no merge ever joins pieces across their
boundary. Merges run by rank, and every merge comes after those that make its parts, so the pieces on both
sides of a boundary at any time are known without running anything: they are the right edge of the
left token and the left edge of the right one, undone merge by merge. A pair of pieces x, y with a merge
of rank m is joined if x is not yet part of a larger piece when rank m is served, and y not before it
(on equal ranks the merge further left comes first). All pairs of many words are tested together as arrays.
Only words with a failing pair are merged exactly, with a heap over a linked list: O(n log n) for n bytes.

A token that the merges do not give for its own bytes is never guessed. If a file's merges are not in such
an order, all words are merged exactly.

Strings of added tokens stand for themselves wherever they occur in a text, and the text between them is
encoded on its own. Null texts count as empty. Decoding joins the tokens' bytes; bytes that are no UTF-8 become
U+FFFD. The file's path is a parameter; executors read their own copy. A file with other settings than
the above (a normaliser, dropout, word ends, added tokens that take spaces, ...) is refused. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangebreak.llm.text import let_go, plain_strings

# Fixed value: the split pattern that byte-level files imply.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text whose words are encoded together, and rows looked at for them.
GROUP_CHARS, GROUP_ROWS = 1_000_000, 500
#: Estimated bytes of encoded words in one of the two dictionaries that a task keeps.
KEPT_BYTES = 30_000_000
_NEVER = np.int64(1 << 40)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a token's name stands for.

    Printable bytes stand for themselves; the others, in order, are the characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _refuse_other_settings(spec: dict) -> None:
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    if not (plain and byte_level and added and spec.get("normalizer") is None):
        raise ValueError("the tokenizer file has settings that this encoder does not support")


class GuessedBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_other_settings(spec)
        byte_of, vocabulary = byte_characters(), spec["model"]["vocab"]
        self.bytes = {i: bytes(byte_of[c] for c in name) for name, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        self.bytes |= {i: text.encode() for text, i in self.added.items()}
        by_bytes = {token: i for i, token in self.bytes.items() if i not in set(self.added.values())}
        self.byte = [by_bytes[bytes([b])] for b in range(256)]
        names = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in names]
        size = max(self.bytes) + 1
        # By pair, as one number, the rank of its merge; by rank, what it makes.
        self.rank_of = {a * size + b: rank for rank, (a, b, _) in reversed([*enumerate(merges)])}
        self.wholes = [whole for _, _, whole in merges]
        # The rank that makes a token (-1: a byte), and its two parts.
        self.made, self.left, self.right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        a, b, whole = np.array(merges, np.int64).reshape(-1, 3).T
        rank = np.arange(len(merges))
        self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        self.pairs, order = np.unique(a * size + b, return_index=True)
        self.pair_rank = order
        self.size = size
        self.ordered = len(np.unique(whole)) == len(merges) and bool((np.maximum(self.made[a], self.made[b]) < rank).all())

        stable = np.ones(size, bool)
        stable[whole] = self.compatible(a, b, rank)
        for k in range(len(merges)):  # a token needs parts that come out as well
            stable[whole[k]] &= stable[a[k]] & stable[b[k]]
        self.token_of = {token: i for token, i in by_bytes.items() if stable[i]}
        # Lengths, longest first, of the tokens with the same first three bytes.
        lengths: dict[bytes, set[int]] = {}
        for token in self.token_of:
            if len(token) > 2:
                lengths.setdefault(token[:3], set()).add(len(token))
        self.lengths = {start: sorted(found, reverse=True) for start, found in lengths.items()}
        self.split = regex.compile(SPLIT).findall
        strings = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, strings))) if strings else None

    def _rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, ``_NEVER`` if there is none."""
        if not len(self.pairs):
            return np.full(len(x), _NEVER)
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.pair_rank[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (of a rank below ``until``) joins pieces across the boundary of x and y."""
        good = np.ones(len(x), bool)
        active = np.arange(len(x))
        x, y = x.copy(), y.copy()
        x_ends = np.full(len(x), _NEVER - 1) if until is None else until.astype(np.int64)
        y_ends = x_ends - (until is not None)
        while len(active):
            rank = self._rank(x, y)
            good[active[(rank < x_ends) & (rank <= y_ends)]] = False
            # Undo the later of the two merges that made these pieces.
            made_x, made_y = self.made[x], self.made[y]
            undo_x = made_x > made_y
            x_ends, y_ends = np.where(undo_x, made_x, x_ends), np.where(undo_x, y_ends, made_y)
            more = good[active] & (np.maximum(made_x, made_y) >= 0)
            x, y = np.where(undo_x, self.right[x], x)[more], np.where(undo_x, y, self.left[y])[more]
            active, x_ends, y_ends = active[more], x_ends[more], y_ends[more]
        return good

    def guess(self, word: bytes) -> list[int]:
        """The longest tokens from the left."""
        tokens, lengths, byte, at, end, out = self.token_of, self.lengths, self.byte, 0, len(word), []
        while at < end:
            for n in lengths.get(word[at : at + 3], ()):
                found = tokens.get(word[at : at + n])
                if found is not None and at + n <= end:
                    break
            else:
                n = 2 if at + 2 <= end else 1
                found = tokens.get(word[at : at + n])
                if found is None:
                    found, n = byte[word[at]], 1
            out.append(found)
            at += n
        return out

    def merge(self, word: bytes) -> list[int]:
        """What the merges give: lowest rank first, the leftmost on ties."""
        n, size, rank_of, wholes = len(word), self.size, self.rank_of, self.wholes
        token = [self.byte[b] for b in word]
        rank_at = [rank_of.get(x * size + y, -1) for x, y in zip(token, token[1:], strict=False)] + [-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # Entries are rank and place in one number; one whose pair has changed since is skipped.
        heap = [rank * n + i for i, rank in enumerate(rank_at) if rank >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            if rank_at[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            whole = token[i] = wholes[rank]
            token[j] = rank_at[j] = -1
            if k < n:
                before[k] = i
                found = rank_at[i] = rank_of.get(whole * size + token[k], -1)
                if found >= 0:
                    heappush(heap, found * n + i)
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                found = rank_at[h] = rank_of.get(token[h] * size + whole, -1)
                if found >= 0:
                    heappush(heap, found * n + h)
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: the guess where it holds, exact merges elsewhere."""
        if not self.ordered:
            return [self.merge(w) for w in words]
        guessed = [self.guess(w) for w in words]
        counts = np.fromiter(map(len, guessed), np.int64, len(guessed))
        tokens = np.fromiter(chain.from_iterable(guessed), np.int64, int(counts.sum()))
        word = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, place = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fails = ~self.compatible(keys // self.size, keys % self.size)
        for k in np.unique(word[inner[fails[place]]]).tolist():
            guessed[k] = self.merge(words[k])
        return guessed

    def pieces(self, text: str) -> list[str]:
        """Words and strings of added tokens, in order."""
        if self.cut is None:
            return self.split(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += self.split(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self.split(text[at:]) if at else self.split(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts and keeps encoded words, up to twice ``KEPT_BYTES``, as long as one task runs.

    Words that are met again move over from the older dictionary to the newer one, so frequent words stay.
    """

    def __init__(self, bpe: GuessedBPE):
        self.bpe, self.older = bpe, {}
        # A word never equals the string of an added token: pieces are cut there.
        self.known: dict[str, tuple[int, ...]] = {text: (i,) for text, i in bpe.added.items()}
        self.bytes = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.bpe.pieces(t) for t in texts]
        if self.bytes > KEPT_BYTES:
            self.known, self.older, self.bytes = {text: (i,) for text, i in self.bpe.added.items()}, self.known, 0
        known, older = self.known, self.older
        unmet = set(chain.from_iterable(split)).difference(known)
        again = unmet.intersection(older)
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        fresh = list(unmet - again)
        found = self.bpe.encode_words([w.encode() for w in fresh])
        known.update(zip(fresh, map(tuple, found), strict=True))
        self.bytes += sum(200 + 4 * len(w) + 8 * len(known[w]) for w in unmet)
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]


@cache
def tables(path: str) -> GuessedBPE:
    """The tables of a file, once per Python worker."""
    return GuessedBPE(path)


def _resolve(path: str | None) -> str:
    if path is None:
        import public_tokenizers as public

        path = public.path("byte_bpe_50k.json")
    return path


def _encoded(batches, bpe: GuessedBPE):
    """``(rows, their ids, tokens of each text)`` for some texts at a time."""
    encoder = Encoder(bpe)
    for batch in batches:
        for row in range(0, len(batch), GROUP_ROWS):
            texts = plain_strings(batch.column("text").slice(row, GROUP_ROWS)).to_pylist()
            ends = list(accumulate(map(len, texts)))
            at = 0
            while at < len(texts):
                start = ends[at] - len(texts[at])
                to = max(at + 1, int(np.searchsorted(ends, start + GROUP_CHARS, "right")))
                yield batch.column("doc_id").slice(row + at, to - at), encoder.encode(texts[at:to])
                at = to
    del encoder
    let_go()


def encode_decode(docs: DataFrame, path: str | None = None, keep: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep``, ``token_ids, decoded`` of every row.

    One pass without a shuffle; memory follows the longest text. ``ids_sha256`` is the digest of the ids as
    little-endian unsigned 32-bit integers.
    """

    def run(batches):
        bpe = tables(_resolve(path))
        for doc_ids, encoded in _encoded(batches, bpe):
            raw = [np.array(ids, "<u4") for ids in encoded]
            decoded = [bpe.decode(ids) for ids in encoded]
            columns = [
                doc_ids,
                pa.array([len(ids) for ids in encoded], pa.int64()),
                pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids in raw], pa.string()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                offsets = pa.array([0, *accumulate(map(len, raw))], pa.int32())
                values = np.concatenate([*raw, np.zeros(0, "<u4")]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(decoded, pa.string())]
                names += ["token_ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, schema + ", token_ids array<int>, decoded string" * keep
    )
