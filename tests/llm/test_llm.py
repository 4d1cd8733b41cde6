"""The training-data operators on small rows: null, empty, long, tied and repeated texts, empty tables, clashing columns."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, html, media, neardup, pii, ppm, quality, substrings, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus(seed=1):
    """(doc_id, text): random texts, near and exact copies, a shared passage, null, empty, short, repeated rows."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(5, 300)) for _ in range(40)]
    base = words(rng, 200)
    passage = words(rng, 60)
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [base] * 3
    texts += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(4)]
    texts += ["It " * 120, "", "  \n", "one", "one two", "One TWO", words(rng, 20000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(len(rows), None), rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column whose name clashes with what operators add
    return spark.createDataFrame([(i, t, "x", 1.0) for i, t in corpus()], "doc_id long, text string, kept string, score double")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# BPE


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    text = {i: t or "" for i, t in corpus()}
    for r in bpe.bpe_round_trip(docs, VOCABULARY).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == text[r.doc_id]


def test_bpe_on_odd_strings():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCABULARY), bpe.SpeculativeBPE(bpe.load_vocabulary(VOCABULARY))
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "​", "﻿", "a", "B", "'s", "'LL", "é", "ß", "中", "😀", "1", "Ⅷ", "!", "<|endoftext|>", "́", "　", "\x00", " the", "|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["a" * 5000, "中" * 3000]
    texts += ["the <|endof", "text|> the", "'sun 's ''s it's'll x'rest\t's", "a  <|endoftext|>  b", ""]
    ids, sizes = own.encode([t.encode() for t in texts])
    for t, part, back in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), own.decode(ids, sizes).to_pylist()):
        assert part.tolist() == library.encode(t, add_special_tokens=False).ids and back == t
    assert own.encode([b"", b""])[1].tolist() == [0, 0] and own.decode(np.empty(0, np.int32), np.zeros(2, int)).to_pylist() == ["", ""]


def test_bpe_forgets_and_learns_again():
    vocabulary, rng = bpe.load_vocabulary(VOCABULARY), random.Random(4)
    texts = [words(rng, 50, 10**6).encode() for _ in range(40)]
    small, large = bpe.SpeculativeBPE(vocabulary, most_words=10), bpe.SpeculativeBPE(vocabulary)
    for t in texts:
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()
    assert len(small.number) < len(large.number)


def test_bpe_pairs_and_merges():
    own = bpe.SpeculativeBPE(bpe.load_vocabulary(VOCABULARY))
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 3000, 2000), rng.integers(0, 3000, 2000)
    alone = [own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())]
    assert own.pairs_hold(left, right).tolist() == alone
    many = [bytes(rng.integers(97, 101, int(rng.integers(1, 60))).astype(np.uint8)) for _ in range(500)]
    flat, sizes = own.merge_all(many)
    assert [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])] == [own.merge(w) for w in many]


def test_bpe_empty_table(no_docs):
    assert bpe.bpe_round_trip(no_docs, VOCABULARY).count() == 0


# near duplicates


def groups(rows, k, percent):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            sets[i] |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
        else:
            sets[i] |= set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(docs, k, percent):
    expected = groups(corpus(), k, percent)
    rows = neardup.near_duplicates(docs.select("doc_id", "text"), k, percent, large_bucket=4, stars=1).collect()
    assert len(rows) == len(corpus())
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_null_ids_and_empty(spark, no_docs):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(df).collect()
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in rows if r.doc_id) == [(1, 1, True), (2, 1, False)]
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.drop_near_duplicates(df).count() == 3


def test_near_duplicates_clashing_columns_and_ids_of_text(spark):
    text = "a b c d e f"
    df = spark.createDataFrame([("x", text, 1, 2, 3), ("y", text, 4, 5, 6), ("z", "other words", 7, 8, 9), ("z", text + " g", 1, 1, 1)], "doc_id string, text string, _dropped int, _rank_in_id int, kept int")
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(df).collect()) == ["x", "z"]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {"x": "x", "y": "x", "z": "z"}


def test_bands_miss_less_than_once_in_a_hundred_million():
    for percent in (80, 85, 95):
        rows, bands = neardup.bands_for(percent)
        assert rows * bands <= neardup.BINS and (1 - (percent / 100) ** rows) ** bands < 1e-8


# repeated passages


def test_substrings_against_counting(spark, docs):
    rows, window = corpus(), 35
    split = [(i, (t or "").encode().split()) for i, t in rows]
    seen = collections.Counter(tuple(w[a : a + window]) for _, w in split for a in range(len(w) - window + 1))
    expected = collections.Counter()
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone |= set(range(a, a + window))
        expected[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    for limits in ({}, {"often": 2}, {"often": 4}, {"shard_words": 200}):
        for rows_a_batch in ("10000", "3"):  # the few rows of a batch know less of each other
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
            try:
                got = substrings.remove_repeats(docs.select("doc_id", "text"), window, **limits).collect()
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == expected


def test_word_hashes():
    from plumbline.llm.common import word_hashes

    rng = random.Random(5)
    parts = [" ", "\t", "\x0b", "\r\n", "a", "Bc", "abcdefgh", "é" * 5, "x" * 63, "y" * 64, "z" * 65, "w" * 200, "\x1f", "\x85", "　"]
    texts = [b"", b" ", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))).encode() for _ in range(500))]
    for lower in (False, True):
        hashes, sizes = word_hashes(texts, lower)
        split = [(t.lower() if lower else t).split() for t in texts]
        assert sizes.tolist() == [len(w) for w in split]
        told = list(zip((w for ws in split for w in ws), hashes.tolist()))
        assert len(set(told)) == len({w for w, _ in told}) == len({h for _, h in told})
    assert word_hashes([])[1].tolist() == [] and word_hashes([b""])[0].tolist() == []


def test_substrings_empty_and_null_ids(spark, no_docs):
    assert substrings.remove_repeats(no_docs).count() == 0
    text = " ".join(map(str, range(50)))
    rows = substrings.remove_repeats(spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in rows] == [50, 50]


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(3)
    parts = [rng.integers(1, 4, int(n)) for n in rng.integers(5, 30, 6)]
    text = np.concatenate([np.r_[p, 0] for p in parts])
    ends = np.flatnonzero(text == 0)
    index = substrings.FMIndex(text, ends, 4)
    at = np.flatnonzero(text)
    plain = [bytes(p.astype(np.uint8)) for p in parts]

    def occurs(x):
        return sum(p.startswith(x, k) for p in plain for k in range(len(p)))

    whole = bytes(text.astype(np.uint8))
    for place, got in zip(at, index.matching_statistics(text, at, 12)):
        best = 0
        for n in range(1, 13):
            x = whole[place - n + 1 : place + 1] if place - n + 1 >= 0 else b""
            if len(x) < n or 0 in x or occurs(x) < 2:
                break
            best = n
        assert got == best


# language model


def test_ppm_against_plain_tries(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(0, 40), 30)) for i in range(40)] + [(50, "é 中 zz\n\n"), (51, ""), (52, None), (1, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned = [t for i, t in rows if i % 5 != 1]
    counts = collections.Counter()
    tries = [collections.defaultdict(collections.Counter) for _ in range(6)]
    for t in learned:
        counts.update([*(t or "").encode().lower().split(), "end"])
        b = b"\xfe" * 5 + (t or "").encode() + b"\xff"
        for k in range(6):
            for a in range(5, len(b)):
                tries[k][b[a - k : a]][b[a]] += 1
    n, v = sum(counts.values()), len(counts)

    def log_p(context, symbol):
        out, excluded = 0.0, set()
        for k in (5, 4, 3, 2, 1, 0):
            here = {s: c for s, c in tries[k].get(context[5 - k :], {}).items() if s not in excluded}
            if here:
                total = 2 * sum(here.values())
                if symbol in here:
                    return out + math.log10((2 * here[symbol] - 1) / total)
                out += math.log10(len(here) / total)
                excluded |= set(here)
        return out - math.log10(256 - len(excluded))

    expected = collections.Counter()
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        b = b"\xfe" * 5 + (t or "").encode() + b"\xff"
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        score = sum(log_p(b[a - 5 : a], b[a]) for a in range(5, len(b)))
        expected[i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6), round(score, 6)] += 1
    got = ppm.score_texts(df, F.col("doc_id") % 5 != 1, chunk_bytes=300).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected


def test_ppm_without_training_or_rows(spark, no_docs):
    assert ppm.score_texts(no_docs, F.lit(True)).count() == 0
    one = ppm.score_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert one.train_tokens == 0 and abs(one.score + 3 * math.log10(256)) < 1e-9


def test_ppm_coder_without_dense_tables():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 250, 500).astype(np.uint8)) for _ in range(3)]
    dense, sizes = ppm.runs_of(texts)
    ppm.Coder.most, most = 16, ppm.Coder.most
    try:
        plain, _ = ppm.runs_of(texts)
    finally:
        ppm.Coder.most = most
    assert dense.dense and not plain.dense and (dense.key[dense.at] == plain.key[plain.at]).all() and sizes.sum() == len(dense.at)


# media


def test_media_round_trip(spark, docs, no_docs):
    text = {i: (t or "").encode() for i, t in corpus()}
    for r in media.media_columns(docs).collect():
        raw = text[r.doc_id]
        assert r.n_bytes == len(raw) and len(r.payload) % 576 == 0 and len(r.payload) >= 576
        assert bytes(r.payload)[: len(raw)] == raw and set(bytes(r.payload)[len(raw) :]) <= {255}
        assert media.read_wav(bytes(r.media)) == bytes(r.payload)
        assert r.fingerprint == media.pair_codes(media.peaks(bytes(r.payload))).tolist()
    assert media.media_columns(no_docs).count() == 0


def test_fingerprints_of_a_tone():
    t = np.arange(576 * 20)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 30 / media.FRAME)).astype(np.uint8).tobytes()
    assert (media.peaks(tone)[:, 1] == 30).all()
    assert (media.peaks(tone, 3) == media.peaks(tone, 4096)).all()


# pages


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body><nav>menu</nav><article><h1>T &amp; x</h1><p><b>one<br><p>two\n  words</article><footer>f</footer>", "T & x\none\ntwo words"),
        ("<main><p>body text here</p><div class='comments'><p>nice!</p></div><aside>more</aside></main>", "body text here"),
        ("<body><div id='menu'>a b</div><div id='content'><p>long enough text of the page</p><p>again some text</p></div>", "long enough text of the page\nagain some text"),
        ("<article><p>a</p><script>var x='<p>no</p>'</script><style>p{}</style><p>b</p>", "a\nb"),
        ("<article><p>cut &lt; off <b>her", "cut < off her"),
        ("", ""),
        ("<body><nav>only</nav></body>", ""),
        ("plain words", "plain words"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_with_nulls(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, "<article><p>x</p></article>"), (1, "u", None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in html.extract_main_text(df).collect()) == [(0, "", "x"), (1, "u", ""), (1, "u", "")]


# decontamination


def test_decontamination_against_all_windows(spark, no_docs):
    rng = random.Random(6)
    items = [(k, words(rng, rng.randrange(8, 40))) for k in range(12)] + [(20, "short one"), (21, None), (22, ""), (3, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for k in range(60):
        w = words(rng, rng.randrange(0, 120)).split()
        if k % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            a = rng.randrange(len(w) + 1)
            w[a:a] = part
        rows.append((k, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "Short ONE!"), (1, rows[1][1])]

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return [tuple(w[a : a + 5]) for a in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    expected = {}
    for i, t in rows:
        s = shingles(t)
        for k, item in items:
            own = collections.Counter(shingles(item))
            width = min(len(s), sum(own.values()))
            for a in range(len(s) - width + 1 if width else 0):
                there = collections.Counter(s[a : a + width])
                x = sum((there & own).values()) / sum((there | own).values())
                if x >= 0.8:
                    expected[i, k] = max(x, expected.get((i, k), 0))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.benchmark_hits(df, known).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    clean = decontaminate.decontaminate(df.withColumn("_k", F.lit(1)), known)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expected} and clean.columns == ["doc_id", "text", "_k"]
    assert decontaminate.benchmark_hits(no_docs, known).count() == 0
    assert decontaminate.benchmark_hits(df, known.where("false")).count() == 0
    for most_bytes in (400, 2000):  # a benchmark in parts
        in_parts = decontaminate.benchmark_hits(df, known, most_bytes=most_bytes)
        assert sorted(map(tuple, in_parts.collect())) == sorted(map(tuple, decontaminate.benchmark_hits(df, known).collect()))
        assert {r.doc_id for r in decontaminate.decontaminate(df, known, most_bytes=most_bytes).collect()} == {r.doc_id for r in clean.collect()}


def test_decontamination_of_a_long_text(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    items = spark.createDataFrame([(1, passage), (2, "it was " * 20)], "item_id long, text string")
    rows = [(1, words(random.Random(1), 200_000, 50) + " " + passage, 7), (2, "it was " * 100_000, 7), (3, "x" * 2_000_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    assert {(r.doc_id, r.item_id, r.similarity) for r in decontaminate.benchmark_hits(df, items).collect()} == {(1, 1, 1.0), (2, 2, 1.0)}
    assert [tuple(r) for r in decontaminate.decontaminate(df, items).collect()] == [rows[2]]


def test_fingerprints_recall_and_candidates():
    """Of pairs just above the threshold nearly all lie within the radius, and few items are looked at."""
    rng = np.random.default_rng(9)
    items = [rng.integers(0, 1 << 63, 60, dtype=np.uint64) for _ in range(2000)]
    near = []
    for s in items:
        other = s.copy()
        other[rng.choice(60, 6, replace=False)] = rng.integers(0, 1 << 63, 6, dtype=np.uint64)  # similarity 54 / 66
        near.append(other)
    prints, queries = (decontaminate.fingerprints(np.array([decontaminate.bit_votes(s).sum(axis=0) for s in x])) for x in (items, near))
    for spread in (4096, 100):
        decontaminate.HammingIndex.spread, kept = spread, decontaminate.HammingIndex.spread
        try:
            index = decontaminate.HammingIndex(prints, 19)
            q, i = index.near(queries)
        finally:
            decontaminate.HammingIndex.spread = kept
        assert len({a for a, b in zip(q.tolist(), i.tolist()) if a == b}) >= 0.998 * len(items)
        assert index.looked_at < 0.17 * len(items) ** 2


def test_decontamination_null_ids_and_short_items(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    items = spark.createDataFrame([(None, passage), (1, "short one"), (2, "solo"), (3, "short one"), (None, "a b c d")], "item_id long, text string")
    rows = [(1, f"x y {passage} z"), (2, "it is a Short one, and one short"), (3, "a short one"), (4, "Solo"), (5, "w w w w solo w solo"), (6, "nothing at all in this text"), (7, "w a b c d"), (8, "a b c e d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.first_word, r.n_words, r.hamming, r.similarity) for r in decontaminate.benchmark_hits(df, items).collect())
    assert got == [(1, 0, 2, 20, 0, 1.0), (2, 1, 3, 2, 0, 1.0), (2, 3, 3, 2, 0, 1.0), (3, 1, 1, 2, 0, 1.0), (3, 3, 1, 2, 0, 1.0), (4, 2, 0, 1, 0, 1.0), (5, 2, 4, 1, 0, 1.0), (7, 0, 1, 4, 0, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, items).collect()) == [6, 8]


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    queries = prints.copy()
    for k in range(50):
        for b in rng.choice(64, k % 30, replace=False):
            queries[k] ^= np.uint64(1) << np.uint64(b)
    q, i = decontaminate.HammingIndex(prints, 19).near(queries)
    every = {(a, b) for a in range(50) for b in range(50) if bin(int(queries[a] ^ prints[b])).count("1") <= 19}
    assert set(zip(q.tolist(), i.tolist())) == every


# personal data


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    rows = [
        "mail bosbt.42@mail8.example.com, x", "call +1 (988) 555-2485 or 555-123-4567 now", "ip 42.144.35.254. 1.2.3.4.5 999.1.1.1",
        "card 4041894974608795 and 4041-8949-7460-8795 not 4041894974608796", "born 1984-02-29 or 29.02.1984, 31/12/1999 not 2023-02-30",
        "ssn 123-45-6789 not 000-12-3456", "iban DE89370400440532013000 and GB29 NWBK 6016 1331 9268 19", None, "", "v4.0 License 2.0. 3", "again +1 (988) 555-2485",
    ]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(rows)], "doc_id int, text string, _found int")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert all(r._found == 7 for r in got.values())
    assert [got[k].n_pseudonyms for k in range(11)] == [1, 2, 1, 2, 3, 1, 2, 0, 0, 0, 1]
    text = {k: r.text for k, r in got.items()}
    assert text[7] is None and text[8] == "" and text[9] == rows[9]
    assert re.fullmatch(r"mail [a-z0-9]{5}\.[a-z0-9]{2}@mail8\.example\.com, x", text[0])
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1])[0]
    assert phone != "+1 (988) 555-2485" and text[10] == f"again {phone}"
    ip = re.search(r"ip (\S+)\. ", text[2])[1]
    assert ip != "42.144.35.254" and all(0 <= int(x) <= 255 for x in ip.split(".")) and text[2].endswith("1.2.3.4.5 999.1.1.1")
    a, b, c = re.findall(r"\d[\d-]{15,}", text[3])
    assert luhn(a) and a == b.replace("-", "") and a != "4041894974608795" and c == "4041894974608796"
    iso, german = re.search(r"born (\S+) or (\S+),", text[4]).groups()
    assert iso != "1984-02-29" and german == ".".join(reversed(iso.split("-"))) and text[4].endswith("not 2023-02-30")
    assert text[5].endswith("not 000-12-3456") and re.match(r"ssn \d{3}-\d{2}-\d{4} ", text[5]) and "123-45-6789" not in text[5]
    for code in re.findall(r"[A-Z]{2}\d{2}[A-Z0-9 ]{14,}", text[6]):
        flat = code.replace(" ", "")
        assert int("".join(str(int(x, 36)) for x in flat[4:] + flat[:4])) % 97 == 1
    assert pii.pseudonymise(df.where("false"), "key").count() == 0
    assert {r.doc_id: r.text for r in pii.pseudonymise(df, "other key").collect()}[2] != text[2]


def test_cards_ibans_and_phones_beside_other_numbers_and_words(spark):
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    rows = [
        (f"{card} 123", card), (f"{card} 12/27", card), ("4111111111111111 5 items", "4111111111111111"), (f"2 of {card} 12", card), (f"12 34 {card}", card),
        (f"{iban} EUR", iban), ("ES9121000418450200051332 EUR", "ES9121000418450200051332"), (f"{iban} 12", iban), (f"AB12 {card} EUR", card),
        (f"{card} 555 123 4567", "555 123 4567"), ("555 123 4567 8901 22", "555 123 4567"), (f"{iban} {card} 7", iban), (f"{iban} {card} 7", card),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "key").collect()}
    shape = lambda t: re.sub("[0-9]", "0", t)
    for k, (text, value) in enumerate(rows):
        at = text.index(value)
        new = got[k][at : at + len(value)]
        assert new != value and len(got[k]) == len(text) and shape(got[k]) == shape(text), text
        assert new == pii_of(spark, value), text
    kept = ["4041-8949-7460-8796", "4041 8949 7460 8796", "1990 1991 1992 1993", "4041894974608796 12", "BE69 5390 0754 7034 EUR", f"x{card.replace(' ', '')} 1", "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    df = spark.createDataFrame([(t,) for t in kept], "text string")
    assert [r.text for r in pii.pseudonymise(df, "key").collect()] == kept


def pii_of(spark, value):
    return pii.pseudonymise(spark.createDataFrame([(value,)], "text string"), "key").first().text


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    out = [r.y for r in df.select(pii.permute_symbols(F.col("x"), 10, "k", "t").alias("y")).collect()]
    assert len(set(out)) == 1000 and all(len(y) == 3 for y in out)
    days = spark.range(pii.DAYS_SIDE**2).select(F.date_format(F.date_add(F.to_date(F.lit(pii.FIRST_DAY)), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    assert days.where("d < '1910-01-01'").select(pii._date(F.col("d"), "k").alias("y")).distinct().count() == 3652


# classifiers


def labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = words(rng, 60)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, int(not bad), int(i % 4 == 0)))
        if i % 4 == 0:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = "loweidiot" + str(i)
            w[rng.randrange(len(w))] = "loweimoron" + str(i)
            rows[-1] = (i, " ".join(w))
    return rows, labels


def test_quality_and_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(600, 8)
    df, y = spark.createDataFrame(rows + [(9999, None), (10000, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    forest = quality.fit_quality(df, y, train=F.col("doc_id") % 5 != 0)
    scores = {r.doc_id: r.score for r in quality.quality_scores(df, forest).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == truth[i][0] for i in held]) > 0.97 and scores[9999] == scores[10000]
    kept = quality.keep_quality(df, forest)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3} and kept.columns == df.columns
    net = toxicity.fit_toxicity(df, y, train=F.col("doc_id") % 5 != 0)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(df, net).collect()}
    assert np.mean([(scores[i] >= 0.7) == truth[i][1] for i in held]) > 0.9 and scores[9999] == scores[10000]


def test_classifiers_without_labels(spark, no_docs):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(df, quality.fit_quality(df, none)).first().score == 0.5
    assert toxicity.toxicity_scores(df, toxicity.fit_toxicity(df, none)).first().score == 0.5
    assert quality.quality_scores(no_docs, quality.fit_quality(df, none)).count() == 0


def test_windows_overlap_and_cover():
    sizes = np.array([0, 1, 47, 48, 49, 72, 73, 500, 0])
    start, end, owner = toxicity.windows_of(sizes)
    assert sorted(set(owner.tolist())) == list(range(len(sizes)))
    for k, n in enumerate(sizes.tolist()):
        spans = [(a - int(sizes[:k].sum()), b - int(sizes[:k].sum())) for a, b, o in zip(start.tolist(), end.tolist(), owner.tolist()) if o == k]
        assert set().union(*[set(range(a, b)) for a, b in spans]) == set(range(n))
        assert all(b2 > b1 >= a2 for (_, b1), (a2, b2) in zip(spans, spans[1:]))
        passage = toxicity.WINDOW - toxicity.STRIDE  # lies whole in some window, wherever it begins
        assert all(any(a <= p and p + passage <= b for a, b in spans) for p in range(max(0, n - passage + 1)))


def test_network_gradients():
    rng = np.random.default_rng(9)
    net = toxicity.BiGRU(2)
    x = rng.standard_normal((6, 8)).astype(np.float32)
    at = np.array([[0, 1, 2, -1], [3, 4, 5, 0]])
    trace = {}
    net.forward(at, net.project(x), trace)
    grads, d_x = net.backward(at, np.ones(2, np.float32), trace, x)
    for name in ("wf", "ub", "nf", "att", "out", "cb"):
        spot = tuple(0 for _ in net.p[name].shape)
        before = net.p[name][spot]
        net.p[name][spot] = before + 1e-2
        up = net.forward(at, net.project(x)).sum()
        net.p[name][spot] = before - 1e-2
        down = net.forward(at, net.project(x)).sum()
        net.p[name][spot] = before
        assert abs((up - down) / 2e-2 - grads[name][spot]) < 2e-2


# pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    item = words(rng, 25)
    rows, labels = labelled(120, 11)
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    rows += [(1000 + k, rows[1][1], "en", "s", 1) for k in range(3)] + [(2000, f"{words(rng, 40)} {item} {words(rng, 30)}", "en", "s", 1), (2001, f"{words(rng, 40)} 42.144.35.254", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = {i for i, t, *_ in rows if not t.isupper() and "!!" not in t}
    near = groups([(i, t) for i, t, *_ in rows if i in good], 5, 80)
    assert out.keys() == {i for i in good if near[i] == i and i != 2000}
    assert "42.144.35.254" not in out[2001].text and out[1].text == rows[1][1] and out[1].n_tokens == len(out[1].ids)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_entry_points_name_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")} and "pipeline" in names
