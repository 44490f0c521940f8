"""Hard negatives, guessed BPE and part codes: brute force, the tokenizer's library, odd rows."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangebreak.llm import guessed_bpe, hard_negatives, part_codes
from rangebreak.llm.ship import ship_code
from tests.llm.test_operators import documents, odd_texts

VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    ship_code(spark)


def odd_vectors(n=700, width=24, seed=3):
    """Vectors with a hot label, many copies of one vector, null and non-finite components, repeated rows."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)).round(2)
    x[: n // 3] = x[0]
    rows = [(i, v.tolist(), int(r.integers(4)) if i % 3 else 1) for i, v in enumerate(x)]
    bad = [(5000, None, 1), (5100, [1.0] * (width - 1) + [None], 1), (5200, [float("nan")] * width, 2), (5300, [float("-inf")] * width, 2)]
    return rows, bad


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, VECTORS)
    return df.withColumns({c: F.lit("x") for c in ("score", "rank", "size", "vector", "code", "i", "place", "n", "v")}) if extra else df


# Hard negatives


@pytest.mark.parametrize("width,most", [(1, 3), (16, 300), (64, 40_000), (130, 700_000), (64, 5_000_000)])
def test_products_by_residues_are_exact(width, most):
    r = np.random.default_rng(width)
    a, b = (r.integers(-most, most + 1, (n, width)).astype(float) for n in (30, 50))
    a[0], b[0], a[1], b[1] = most, most, -most, most  # the ends of the range
    assert (hard_negatives.exact_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    assert hard_negatives.exact_products(a * 0, b).sum() == 0


def test_moduli_grow_with_the_bound_and_integers_saturate():
    assert [len(hard_negatives.moduli(10**k)) for k in (0, 2, 5, 8, 15)] == [1, 1, 2, 3, 6]
    huge = hard_negatives.to_integers(np.array([[1e300, -1e308], [0.5, -0.001]]), 256)
    assert huge[0, 0] == -huge[0, 1] and 2 * huge[0, 0] ** 2 < 2**51 and huge[1].tolist() == [128, -1]
    assert hard_negatives.exact_products(huge, huge)[0, 0] == int(huge[0, 0]) ** 2 * 2


def brute_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90):
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e, _ in rows}
    label = {i: y for i, _, y in rows}
    out = []
    for a in anchors:
        score = {i: sum(x * y for x, y in zip(v[a], v[i], strict=True)) for i in v if i != a and len(v[i]) == len(v[a])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            found = [i for i in order if label[i] != label[a] and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(found[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 8192), (90, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", blocks[1])
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 2)
    rows, bad = odd_vectors()
    short = [(7000, [1.0, 2.0], 1), (7001, [2.0, 2.0], 1), (7002, [1.0, 1.0], 3), (7003, [], 2), (7100, [], 2)]
    alone = [(8000, rows[3][1], 9)]  # an anchor without positives
    given = rows + short + alone
    repeated = [rows[5], (100, [9.0] * 24, 3)]  # the smaller (label, vector) of an id counts
    more = [(None, rows[0][1], 1), (6000, rows[0][1], None)]
    kept = {}
    for i, e, y in given + repeated:
        kept[i] = min(kept.get(i, (y, e)), (y, e))
    plain = [(i, e, y) for i, (y, e) in kept.items()]
    got = hard_negatives.hard_negatives(frame(spark, given + repeated + bad + more), F.col("vec_id") % 100 == 0).collect()
    want = brute_negatives(plain, [i for i in kept if i % 100 == 0])
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_negative_positive_scores_and_other_windows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 2), (3, [0.0, 1.0], 2), (5, [0.0, 0.0], 1)]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0).collect()
    # The second positive scores below zero and has an empty window, the first scores zero and finds equal ones.
    assert sorted(map(tuple, got)) == brute_negatives(rows, [0]) == [(0, 5, 1, 3, 0, 0)]
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") == 0, low=-100, high=100, negatives=1).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, [0], negatives=1, low=-100, high=100)
    assert hard_negatives.hard_negatives(frame(spark, []), F.col("vec_id") == 0).collect() == []


# Guessed BPE


def library():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return path, tokenizer


def hard_texts(seed=5):
    r = random.Random(seed)
    hard = ["a" * 5000, "ab" * 3000, "aab" * 999, " " * 3001, "\n" * 2000 + "x", "-" * 777, "=" * 1000, "\x00\x1c\x85\xa0 ​ x"]
    hard += ["<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>'s", "😀é́", "it's We'LL"]
    hard += ["".join(r.choices("abcdeé", k=9000)), "".join(r.choices("ab c'sre\n dé", k=20_000))]
    return odd_texts() + [(900 + k, t) for k, t in enumerate(hard)]


def test_guessed_bpe_equals_the_library(spark):
    path, tokenizer = library()
    texts = hard_texts()
    rows = guessed_bpe.encode_decode(documents(spark, texts, extra=True), path).collect()
    want = Counter()
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        raw = b"".join(k.to_bytes(4, "little") for k in ids)
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text] += 1
    got = Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, tuple(x.token_ids), x.decoded) for x in rows)
    assert got == want
    assert guessed_bpe.encode_decode(documents(spark, [])).collect() == []


def test_verified_guesses_and_exact_merges_agree():
    path, tokenizer = library()
    bpe = guessed_bpe.tables(path)
    r = random.Random(8)
    words = sorted({"".join(r.choices("aeinrstlo ", k=r.randrange(1, 14))).encode() for _ in range(6000)})
    guessed, exact = [bpe.guess(w) for w in words], [bpe.merge(w) for w in words]
    assert bpe.encode_words(words) == exact
    pairs = np.array([(a, b) for t in guessed for a, b in zip(t, t[1:], strict=False)], np.int64)
    verdict = dict(zip(map(tuple, pairs.tolist()), bpe.compatible(pairs[:, 0], pairs[:, 1]).tolist(), strict=True))
    # A verdict says what merging the two tokens' bytes gives, and all verdicts together decide a word.
    for (a, b), good in list(verdict.items())[:3000]:
        assert good == (bpe.merge(bpe.bytes[a] + bpe.bytes[b]) == [a, b])
    for g, e in zip(guessed, exact, strict=True):
        assert all(verdict[p] for p in zip(g, g[1:], strict=False)) == (g == e)
    assert 0.05 < sum(g != e for g, e in zip(guessed, exact, strict=True)) / len(words) < 0.95


def small_file(tmp_path, merges, extra=(), **settings):
    characters = {b: c for c, b in guessed_bpe.byte_characters().items()}
    names = [characters[b] for b in range(256)] + list(extra)
    for a, b in merges:
        if a + b not in names:
            names.append(a + b)
    model = {"type": "BPE", "vocab": {n: i for i, n in enumerate(names)}, "merges": [list(m) for m in merges]}
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": split}
    spec |= {"post_processor": None, "decoder": split, "model": model} | settings
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_repeated_letters_unreachable_tokens_and_other_orders(tmp_path):
    from tokenizers import Tokenizer

    orders = [
        [("a", "a"), ("aa", "a"), ("aa", "aa"), ("a", "b")],
        [("b", "c"), ("a", "b"), ("ab", "c"), ("a", "bc")],  # "abc" comes out of a + bc alone
        [("ab", "c"), ("a", "b"), ("b", "c"), ("c", "a")],  # a merge before the one that makes its part
        [("a", "b"), ("b", "a"), ("ab", "a"), ("ba", "b"), ("aba", "b")],
    ]
    r = random.Random(2)
    words = ["".join(r.choices("abc", k=r.randrange(1, 12))) for _ in range(800)] + ["a" * n for n in range(1, 40)]
    for merges in orders:
        path = small_file(tmp_path, merges)
        bpe, tokenizer = guessed_bpe.GuessedBPE(path), Tokenizer.from_file(path)
        got = bpe.encode_words([w.encode() for w in words])
        assert got == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert not guessed_bpe.GuessedBPE(small_file(tmp_path, orders[2])).ordered
    with pytest.raises(ValueError):
        guessed_bpe.GuessedBPE(small_file(tmp_path, orders[0], normalizer={"type": "Lowercase"}))


def test_kept_words_stay_within_their_bound(monkeypatch):
    path, tokenizer = library()
    monkeypatch.setattr(guessed_bpe, "KEPT_BYTES", 20_000)
    encoder = guessed_bpe.Encoder(guessed_bpe.tables(path))
    r = random.Random(4)
    for _ in range(30):
        texts = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(40))]
        assert encoder.encode(texts) == [tokenizer.encode(texts[0], add_special_tokens=False).ids]
        assert len(encoder.known) + len(encoder.older) < 300


# Part codes


def brute_codes(rows):
    """Codes of rows of one length that 8 divides, by plain Python."""
    v = [[int(np.floor(4096 * x)) for x in e] for _, e, _ in rows]
    w = len(v[0]) // 8
    parts = [[tuple(x[k * w : (k + 1) * w]) for x in v] for k in range(8)]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, v[k]))[:16]
    books = [[list(own[i]) for i in first] for own in parts]

    def nearest(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)) for entry in book]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(6):
        for own, book in zip(parts, books, strict=True):
            groups = defaultdict(list)
            for part in own:
                groups[nearest(part, book)[0]].append(part)
            for k, members in groups.items():
                book[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[nearest(own[i], book) for own, book in zip(parts, books, strict=True)] for i in range(len(rows))]
    code = ["".join(f"{k:02x}" for k, _ in f) for f in found]
    error = [sum(d for _, d in f) for f in found]
    label = Counter()
    for (_, _, y), e in zip(rows, error, strict=True):
        label[y] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return Counter((i, c, e, label[y], digest) for (i, _, y), c, e in zip(rows, code, error, strict=True))


@pytest.mark.parametrize("bundle", [4096, 3])
def test_trie_finds_the_nearest_entry(monkeypatch, bundle):
    monkeypatch.setattr(part_codes, "BUNDLE", bundle)
    r = np.random.default_rng(bundle)
    for rows, width, k in ((1, 1, 1), (200, 1, 5), (400, 3, 16), (300, 8, 16), (50, 0, 4)):
        parts, entries = r.integers(-4, 5, (rows, width)), r.integers(-4, 5, (k, width))
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        nearest, distance = part_codes.nearest_entries(parts, entries)
        assert (nearest == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_part_codes_equal_brute_force(spark):
    rows, bad = odd_vectors(400, 16)
    rows += [rows[7], (7, rows[9][1], None), (None, rows[20][1], 3), (9000, [0.0] * 16, None), (9001, [-0.0001] * 16, 2)]
    got = part_codes.compress(frame(spark, rows + bad)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows)


def test_few_vectors_other_lengths_and_none(spark):
    rows = [(k, [float(k), 1.0, -2.5, 0.0, 3.0, k / 7, 0.1, 9.0], k % 2) for k in range(5)]
    got = part_codes.compress(frame(spark, rows)).collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows)
    mixed = rows + [(50, [1.0, 2.0, 3.0], 1), (51, [], 1), (52, [1e300] * 8, None), (53, [-1e300] * 8, None)]
    got = {r.vec_id: r for r in part_codes.compress(frame(spark, mixed)).collect()}
    assert len(got) == 9 and got[50].error == got[51].error == 0 and got[50].codebooks_sha256 != got[0].codebooks_sha256
    assert got[52].label_error == got[52].error + got[53].error
    assert part_codes.compress(frame(spark, [])).collect() == []


def test_codes_decode_to_their_entries(spark):
    rows, _ = odd_vectors(200, 16)
    kept = part_codes._kept(frame(spark, rows))
    books = part_codes.train(kept)
    v = {r.vec_id: np.array(r.v) for r in kept.collect()}
    for r in part_codes.encode(kept, books).collect():
        assert ((v[r.vec_id] - part_codes.decode(r.code, books[16])) ** 2).sum() == r.error
