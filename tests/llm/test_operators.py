"""Each operator on small crafted inputs: odd rows, ties, repeats, empty tables, and brute force."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangebreak.llm import byte_bpe, context_tree, forest, jaccard_join, mixing, quality, secrets, token_counts, toxicity, warc
from rangebreak.llm.components import components
from rangebreak.llm.ship import ship_code
from rangebreak.llm.text import Words, chunks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def code(spark):
    ship_code(spark)


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", f"src{(i or 0) % 4}" if i != 3 else None, len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    # Columns with the names of results must do no harm.
    return df.withColumns({c: F.lit("x") for c in ("score", "node", "size", "n_tokens", "spans")}) if extra else df


def odd_texts(seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "the", "THE", "日本"]
    base = [" ".join(r.choices(words, k=n)) for n in (5, 11, 19, 38, 60, 150)]
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (None, "no id here at all"), (None, None)]
    k = 6
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.3:
                w += r.choices(words, k=1)
            texts.append((k, " ".join(w)))
            k += 1
    texts += [texts[10], texts[10], (k, "long " * 30_000), (k + 1, " ".join(r.choices(words, k=9_000)))]
    return texts


def test_words_are_cut_on_bytes_as_the_pattern_does():
    texts = ["", "  a\tB  É\x0bz ", "x" * 10, "\n", "日本 語"]
    for at, to, data, offsets in chunks(pa.array([None, *texts]), most=8):
        words = Words(data, offsets)
        for i in range(to - at):
            text = ([""] + texts)[at + i]
            own = words.bytes[offsets[i] : offsets[i + 1]]
            assert bytes(own).decode() == text.translate(LOWER)
            assert words.counts[i] == len(WORD.findall(text))


def brute_classes(texts, width=3, percent=90):
    sets, parent = [], list(range(len(texts)))
    for _, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(texts))


@pytest.mark.parametrize("percent,width,limit", [(90, 3, 40), (80, 5, 40), (90, 3, 12)])
def test_jaccard_classes_equal_brute_force(spark, monkeypatch, percent, width, limit):
    monkeypatch.setattr(jaccard_join, "LIGHT_LIMIT", limit)
    texts = odd_texts(percent + limit)
    got = jaccard_join.jaccard_classes(documents(spark, texts, extra=True), width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(texts, width, percent)


def test_jaccard_boundary_follows_the_cost():
    assert jaccard_join.light_boundary({5: 100}, 90) > 5
    assert jaccard_join.light_boundary({38: 1000, 39: 1000}, 90) <= 38  # pairs of these would write C(n, 2) subsets
    for n in range(1, 200):
        for m in range(n, jaccard_join.largest_partner(n, 90) + 1):
            need = jaccard_join.overlap(n, m, 90)
            assert 100 * need >= 90 * (n + m - need) and 100 * (need - 1) < 90 * (n + m - need + 1)


def test_jaccard_of_no_documents(spark):
    assert jaccard_join.jaccard_classes(documents(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 140)) and got[201] == 200


def test_mix_reaches_targets_and_repeats_at_most_three_times(spark):
    r = random.Random(3)
    texts = [(i, " ".join(["w"] * r.choice((0, 1, 7, 50)))) for i in range(300)] + [(7, None), (7, "a b c"), (7, "a b c"), (None, "x y")]
    rows = mixing.curriculum(mixing.mix_sources(documents(spark, texts, extra=True))).collect()
    assert len(rows) == len(texts)
    taken, target, size = Counter(), {}, Counter()
    for x in rows:
        taken[x.source] += x.taken
        target[x.source] = x.target
        size[x.source] += x.size
        assert 0 <= x.taken <= 3 * x.size and x.source_size >= x.size
        assert (x.position is None) == (x.taken == 0) and (x.position is None or 0 <= x.position <= 1)
    total = sum(size.values())
    assert math.isclose(sum(target.values()), total)
    weights = dict(zip(sorted(target, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2), strict=False))
    free = [s for s in target if target[s] < 3 * size[s] - 1e-9]
    levels = [target[s] / weights[s] for s in free]
    assert max(levels) - min(levels) < 1e-6 and all(3 * size[s] / weights[s] <= levels[0] + 1e-6 for s in target if s not in free)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = mixing.curriculum(mixing.mix_sources(documents(spark, texts, extra=True).repartition(5))).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_copies_hold_the_words_taken(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(i % 9)) + "  tail\n") for i in range(60)]
    docs = documents(spark, texts)
    mixed = mixing.mix_sources(docs, carry=("text",))
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got, seen = Counter(), dict(texts)
    for r in mixing.copies(mixed).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert seen[r.doc_id].startswith(r.text)
    assert got == +Counter(want)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(documents(spark, [])).collect() == []
    rows = mixing.mix_sources(documents(spark, [(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def reference_tokenizer():
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark):
    path, pattern, library = reference_tokenizer()
    r = random.Random(5)
    hard = ["a" * 5000, "ab" * 3000, "aab" * 999, " " * 3001, "\n" * 2000 + "x", "<|endoftext|>", "😀é́", "".join(r.choices("abcdeé", k=9000))]
    texts = odd_texts() + [(900 + k, t) for k, t in enumerate(hard)]
    rows = byte_bpe.encode_decode(documents(spark, texts, extra=True), path, pattern).collect()
    want = Counter()
    for i, t in texts:
        ids = library.encode_ordinary(t or "")
        named = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[i, len(ids), named, hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, tuple(x.token_ids)) for x in rows) == want
    assert byte_bpe.encode_decode(documents(spark, [])).collect() == []


def test_token_counts_for_every_limit(spark):
    path, pattern, library = reference_tokenizer()
    texts = odd_texts(7)
    lengths = [len(library.encode_ordinary(t or "")) for _, t in texts]
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(documents(spark, texts, extra=True), path, pattern))
    table = token_counts.limit_table(histogram)
    rows = table.collect()
    assert {r.context_limit for r in rows} == set(lengths)
    for r in rows:
        c = r.context_limit
        assert (r.documents, r.documents_within) == (lengths.count(c), sum(n <= c for n in lengths))
        assert (r.documents_longer, r.tokens_within) == (sum(n > c for n in lengths), sum(n for n in lengths if n <= c))
        assert (r.truncated_tokens, r.total_tokens) == (sum(min(n, c) for n in lengths), sum(lengths))
        assert r.total_documents == len(lengths) and math.isclose(r.share_within, sum(n <= c for n in lengths) / len(lengths))
    got = {r.context_limit: (r.documents_longer, r.truncated_tokens) for r in token_counts.at_limits(histogram, [0, 1, 17, 500, 10**6]).collect()}
    assert got == {c: (sum(n > c for n in lengths), sum(min(n, c) for n in lengths)) for c in (0, 1, 17, 500, 10**6)}
    ordered = sorted(lengths)
    for r in token_counts.quantiles(table, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == ordered[math.ceil(r.share * len(ordered)) - 1]
    assert token_counts.count_tokens(documents(spark, [])).collect() == []


def toxic_corpus():
    r = random.Random(9)
    clean = ["garden", "river", "window", "summer", "bread", "letter", "market", "forest", "number", "story"]
    stems = ["grumblok", "vexnor"]
    texts, labels = [], []
    for i in range(700):
        w = r.choices(clean, k=30)
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(30)] = r.choice(stems) + r.choice(["s", "ed", "ing", "x", "ly"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity_finds_unseen_spellings_in_the_held_out_fold(spark):
    texts, labels = toxic_corpus()
    odd = [(5000, "garden vexnorish grumblokky river bread"), (5001, None), (5002, ""), (5003, "river " * 20_000), (None, "story")]
    frame = spark.createDataFrame(labels + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(documents(spark, texts + odd + [texts[0]], extra=True), frame).collect()
    assert len(rows) == len(texts) + len(odd) + 1
    score = {x.doc_id: x.score for x in rows}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(score[i] >= 0.3) == bool(y) for i, y in held]) > 0.97
    assert score[5000] >= 0.3 and all(0 <= score[i] < 0.3 for i in (5001, 5002, 5003))


def test_toxicity_never_reads_held_out_labels(spark):
    texts, labels = toxic_corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    turned = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (
        {x.doc_id: x.score for x in toxicity.score_toxicity(documents(spark, texts), spark.createDataFrame(m, schema)).collect()}
        for m in (labels, turned)
    )
    assert a == b


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in toxicity.score_toxicity(documents(spark, [(1, "a")]), none).collect()] == [0.0]
    assert toxicity.score_toxicity(documents(spark, []), none).collect() == []


PAGES = "page_id long, url string, html string, n_tokens long"


def test_archives_round_trip(spark):
    long = "<p>" + "é" * 200_000 + "</p>"
    tricky = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n1 0 archive\nhttp://a 0 0 0 5\n"
    pages = [(k, f"http://h/{k}", "y" * 150) for k in (9, 4, 6)] + [
        (1, None, None), (2, "http://a b/é\n", ""), (3, "http://c", "short"), (5, "http://d", "short"), (7, "u", tricky), (8, "u", tricky),
        (10, "http://l", long), (None, "http://n", "y" * 150), (12, "z", "q" * 99), (13, "z", "q" * 99), (14, "z", "q" * 100), (15, "z", "q" * 100),
    ]
    frame = spark.createDataFrame([(*p, 1) for p in pages], PAGES)
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h, i)
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and first[h] != i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert Counter(tuple(r) for r in warc.archive_pages(frame).collect()) == want
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_arc_versions_and_faults():
    for version in (1, 2):
        data = warc.arc_version_block(version, "a.arc") + warc.arc_record(version, "http://x", 4, b"body\n\nhttp://y") + b"\n"
        ((_, fields, document),) = warc.read_arc(data)
        assert fields["URL"] == "http://x" and warc._http(document)[1:] == (b"body\n\nhttp://y", 4)
        assert fields["Archive-date"] == "20240101000000" and ("Result-code" in fields) == (version == 2)
        with pytest.raises(ValueError, match="beyond"):
            list(warc.read_arc(data[:-6]))
    record = warc.warc_record("a", 0, fields, document, None)
    ((named, block),) = warc.read_warc(record + b"\r\n\r\n")
    assert named["warc-date"] == "2024-01-01T00:00:00Z" and block == document and named["warc-type"] == "response"


def test_forest_reaches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 300)
    monkeypatch.setattr(forest, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(forest, "WHOLE_BLOCK", 100)
    r = np.random.default_rng(2)
    x = r.normal(size=(1200, 16)).round(3) * r.uniform(0.5, 2, (1200, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + k, rows[0][1]) for k in range(30)] + [rows[5]]  # ties and a repeated row
    bad = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0] * 15 + [None]), (3080, [float("inf")] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame([(*p, 1) for p in rows + bad], "vec_id long, embedding array<double>, score int")
    got = forest.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    vectors = dict(rows)
    ids, m = np.array(list(vectors)), np.array(list(vectors.values()))
    by_query = {}
    for g in got:
        by_query.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert set(by_query) == {int(i) for i in ids if i % 20 == 0}
    hits = []
    for q, found in by_query.items():
        s = (m * vectors[q]).sum(axis=1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1] for f in found] == [f[1] for f in sorted(found, key=lambda f: (-f[2], f[1]))]
        assert all(abs(f[2] - np.dot(vectors[f[1]], vectors[q])) < 1e-9 for f in found)
        hits.append(len(set(best) & {f[1] for f in found}) / 20)
    assert np.mean(hits) >= 0.9
    monkeypatch.undo()
    few = forest.nearest(frame.where("vec_id in (20, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(g["rank"], g.query_id) for g in sorted(few, key=lambda g: g["rank"])] == [(1, 20), (2, 20)]
    assert forest.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_quality_counts_and_verdicts(spark):
    r = random.Random(4)
    good = [" ".join(r.choices(["tree", "lake", "stone", "cloud", "field", "road"], k=40)) for _ in range(60)]
    junk = [" ".join(w + "%%%" for w in r.choices(["tree", "zzq", "qxv", "kkp"], k=40)) for _ in range(20)]
    texts = list(enumerate(good + junk)) + [(500 + k, t) for k, (_, t) in enumerate(odd_texts())]
    texts += [(900, "a b c d e f g h\na b c d e f g h\n\n \na|b #$%&<>*"), (901, "x y " * 3000), (902, None)]
    trusted = spark.createDataFrame([(k,) for k in range(60)] + [(None,), (3,), (99999,)], "doc_id long")
    rows = quality.quality_verdicts(documents(spark, texts, extra=True), trusted).collect()
    assert len(rows) == len(texts)
    of = {x.doc_id: x for x in rows}
    for i, t in texts:
        t, x = t or "", of[i]
        w = WORD.findall(t)
        where = {}
        for k in range(len(w) - 4):
            where.setdefault(tuple(w[k : k + 5]), []).append(k)
        again = {j for ks in where.values() if len(ks) > 1 for k in ks for j in range(k, k + 5)}
        lines = [s for s in t.split("\n") if WORD.search(s)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not x.base_failed or not x.kept)
    clean = [k for k in range(60) if not of[k].base_failed]
    assert sum(of[k].kept for k in clean) == len(clean) and not any(of[60 + k].kept for k in range(20))
    nobody = quality.quality_verdicts(documents(spark, texts), trusted.limit(0)).collect()
    assert all(x.ratio == 0 for x in nobody)
    assert quality.quality_verdicts(documents(spark, []), trusted).collect() == []


def test_language_scores_of_the_base(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "TABLE_WORDS", 20)
    texts = odd_texts()
    rows = context_tree.language_scores(documents(spark, texts, extra=True)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for _, t in texts]
    c = Counter(w for (i, _), ws in zip(texts, tokens, strict=True) if not held(i) for w in ws)
    n = sum(c.values())
    want = Counter(
        (i, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws), 4))
        for (i, _), ws in zip(texts, tokens, strict=True)
    )
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in rows) == want
    assert all(x.score < 0 for x in rows)
    assert context_tree.language_scores(documents(spark, [])).collect() == []


def plain_tree_scores(texts, held, depth):
    """Log10 probability of whole texts by the definition: nodes by decision and context, bits one at a time."""
    lined = [bytes([255]) * depth + (t or "").translate(LOWER).encode() + b"\xff" for t in texts]
    bits = lambda c: [((1 << k) | c >> (8 - k), c >> (7 - k) & 1) for k in range(8)]
    seen, below = {}, {}
    for line, out in zip(lined, held, strict=True):
        for i in range(depth, 0 if out else len(line)):
            for node, bit in bits(line[i]):
                for d in range(depth + 1):
                    key = (node, line[i - d : i])
                    seen.setdefault(key, [0, 0])[bit] += 1
                    if d:
                        below.setdefault((node, line[i - d + 1 : i]), set()).add(key)

    def kt(key):
        return sum(math.lgamma(c + 0.5) for c in seen[key]) - math.lgamma(sum(seen[key]) + 1) - math.log(math.pi)

    weighted = {}
    for key in sorted(seen, key=lambda k: -len(k[1])):
        weighted[key] = kt(key)
        if len(key[1]) < depth:
            children = sum(weighted[c] for c in below[key])
            weighted[key] = np.logaddexp(weighted[key], children) - math.log(2)

    def chance(node, context, bit, d=0):
        key = (node, context[depth - d :])
        if key not in seen:
            return None
        own = (seen[key][bit] + 0.5) / (sum(seen[key]) + 1)
        deeper = chance(node, context, bit, d + 1) if d < depth else None
        if deeper is None:
            return own
        stop = math.exp(kt(key) - math.log(2) - weighted[key])
        return stop * own + (1 - stop) * deeper

    def score(line):
        pairs = [(line[i - depth : i], nb) for i in range(depth, len(line)) for nb in bits(line[i])]
        return sum(math.log10(chance(node, context, bit) or 0.5) for context, (node, bit) in pairs)

    return [score(line) for line in lined]


@pytest.mark.parametrize("rows, depth", [(1 << 21, 4), (40, 3), (1, 6)])
def test_language_scores_of_whole_texts(spark, monkeypatch, rows, depth):
    """Every text against the plain trees, with all, some and next to none of the grams in the broadcast table."""
    monkeypatch.setattr(context_tree, "TABLE_GRAMS", rows)
    r = random.Random(depth)
    words = ["ab", "abc", "Bad", "É", "日本", "x", "zz"]
    texts = [(k, " ".join(r.choices(words, k=r.randrange(1, 30)))) for k in range(40)]
    texts += [(40, None), (41, ""), (42, "\n \t"), (43, "ab " * 3000), (None, "no id"), texts[7], texts[7], (44, "never Seen: 17")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    assert any(held) and not all(held)
    want = plain_tree_scores([t for _, t in texts], held, depth)
    got = context_tree.language_scores(documents(spark, texts, extra=True), depth).collect()
    key = lambda pair: (pair[0] is None, pair[0] or 0, pair[1])
    got = sorted(((x.doc_id, x.score) for x in got), key=key)
    want = sorted(((i, s) for (i, _), s in zip(texts, want, strict=True)), key=key)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-5, atol=1e-5)


def test_language_scores_without_training_texts(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = context_tree.language_scores(documents(spark, [(held, "abc")])).collect()[0]
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)
    assert math.isclose(row.score, 4 * 8 * math.log10(0.5))


def test_gram_scores_are_probabilities_and_grow_with_the_corpus():
    depth = 4
    text = np.frombuffer(b"abcabcabd" * 300, np.uint8)
    grams, begins = context_tree.grams_of(text, np.array([0, 900, 900, len(text)]), depth)
    assert len(grams) == len(text) + 3 and list(begins) == [0, 901, 902]
    contexts = np.unique(grams >> 8)
    every = (contexts[:, None] << 8 | np.arange(256)).ravel()  # each byte after each context
    train = np.array([Counter(grams.tolist())[g] for g in every.tolist()])
    parts, nodes = [], []
    pairs = every >> (8 * (depth + 1 - context_tree.TOP))
    for pair in np.unique(pairs):
        here = pairs == pair
        out = context_tree._weigh_group(pa.table({"gram": every[here], "train": train[here], "total": train[here]}), depth)
        shares = out.column("shares").to_pylist()
        nodes.append(shares[-1])
        parts.append(np.frombuffer(b"".join(shares[:-1]), np.float32).reshape(-1, 8).astype(float))
    logs = context_tree.Top(nodes).scores(every, np.concatenate(parts), depth)
    assert np.allclose((10.0 ** logs.reshape(-1, 256)).sum(axis=1), 1, atol=1e-5)
    assert (logs * train).sum() / train.sum() > -0.2
    # Large counts leave the table of logarithms.
    assert np.allclose(context_tree.block_log(np.array([5000, 3]), np.array([7000, 9000])),
                       [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in ((5000, 7000), (3, 9000))])


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 + len(b := len(body).to_bytes(2, "big").lstrip(b"\0"))]) + b
    return bytes([tag]) + size + body


def test_secrets_are_confirmed_by_structure(spark):
    r = random.Random(8)
    number = lambda n: der(2, b"\x01" + r.randbytes(n - 1))
    key = der(0x30, der(2, b"\0"), *(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
    public = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(3, b"\0" + key[:80]))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", r.randbytes(32)))
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = ".".join((url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url(b'{"sub":"1"}'), url(r.randbytes(32))))
    fake = ".".join((url(b'{"typ":"JWT","n":12345}'), url(b'{"sub":"1"}'), url(r.randbytes(32))))
    b64 = base64.b64encode(key).decode()
    wrapped = "\n".join(b64[k : k + 64] for k in range(0, len(b64), 64))
    broken = base64.b64encode(key[:-3]).decode()
    made = [(jwt, "jwt"), (b64, "der"), (wrapped, "der"), (base64.b64encode(public).decode(), "der"), (public.hex().upper(), "der"), (base64.b64encode(ssh).decode(), "ssh")]
    texts = [(k, f"é before {s} after") for k, (s, _) in enumerate(made)]
    clean = [fake, broken, base64.b64encode(r.randbytes(300)).decode(), "plain.words.here and-some_more", "x" * 60_000, None, "", "token: short", "AKIAABC", "tokeN: ſecret1"]
    texts += [(100 + k, t) for k, t in enumerate(clean)]
    base = 'Api_Key = "abcdefgh" AKIA' + "B" * 12 + " pass PASSWORD:0123456789abcdef0123456789abcdef0 token=1234567"
    texts += [(200, base), (200, base), (None, base)]
    rows = secrets.scan_secrets(documents(spark, texts, extra=True), redact=True).collect()
    assert len(rows) == len(texts)
    by = {x.doc_id: x for x in rows}
    for k, (s, kind) in enumerate(made):
        spans = by[k].spans.split(",")
        assert f"{kind}:9:{9 + len(s)}" in spans, (kind, spans)
        assert s not in by[k].redacted and by[k].redacted.startswith("é before [")
    assert all(by[100 + k].spans == "" and by[100 + k].redacted == (clean[k] or "") for k in range(len(clean)))
    x = by[200]
    assert (x.n_assign, x.n_access, x.n_hex) == (2, 1, 1)
    assert x.spans.startswith("assign:0:19,access:21:37,assign:43:") and x.base_sha256 == hashlib.sha256(x.spans.encode()).hexdigest()
    assert secrets.scan_secrets(documents(spark, [])).collect() == []


def test_keys_with_a_short_last_line_or_words_beside_them(spark):
    r = random.Random(9)
    number = lambda n: der(2, b"\x01" + r.randbytes(n - 1))
    wrap = lambda s: "\n".join(s[k : k + 64] for k in range(0, len(s), 64))
    curve = der(0x30, der(6, b"\x2a\x86\x48\xce\x3d\x02\x01"), der(6, b"\x2b\x81\x04\x00\x23"))
    secret = der(0x30, der(2, b"\1"), der(4, r.randbytes(66)), der(0xA1, der(3, b"\0" + r.randbytes(133))))
    p521 = der(0x30, der(2, b"\0"), curve, der(4, secret))
    assert len(p521) == 241
    by_size = {len(k): k for n in range(17, 240) for k in [der(0x30, der(2, b"\0"), number(n))]}
    keys = [p521, *(by_size[n] for n in (49, 50, 97, 98, 145, 193, 242))]
    texts, want = [], {}

    def add(text, *found):
        want[len(texts)] = ",".join(f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in found)
        texts.append((len(texts), text))

    for k in keys:
        s = wrap(base64.b64encode(k).decode())
        assert len(s.rsplit("\n", 1)[1].rstrip("=")) < 4
        add(f"-----BEGIN PRIVATE KEY-----\n{s}\n-----END PRIVATE KEY-----", ("der", s))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", r.randbytes(32)))
    field = lambda b: len(b).to_bytes(4, "big") + b
    openssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(ssh) + field(r.randbytes(136))
    for k, kind in ((by_size[120], "der"), (by_size[121], "der"), (ssh, "ssh"), (openssh, "ssh")):
        s = wrap(base64.b64encode(k).decode().rstrip("="))
        for word in ("words", "wordss", "wordsss", "wordssss", "ab=", "longer" * 9):
            add(f"see\n{s}\n{word}\nmore", (kind, s))
    one, two = (base64.b64encode(by_size[n]).decode() for n in (99, 102))
    add(f"{one}\n{two}\n", ("der", one), ("der", two))
    add(f"{'word' * 8}\n{two}\n{'word' * 8}", ("der", two))
    add(f"{one[:-4]}\n{'word' * 8}")
    got = {x.doc_id: x.spans for x in secrets.scan_secrets(documents(spark, texts)).collect()}
    assert got == want
