"""The registered queries over whole tables: columns, digests and counts worked out again, plainly."""

import cmath
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import media, quality
from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def crc(key, modulus):
    return zlib.crc32(str(key).encode()) % modulus


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows_of(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = {r.doc_id: r for r in df.collect()}
    assert rows.keys() == DOCS.keys()
    return dict(df.dtypes), rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, FOLDER).select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_op1_columns(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()
    df = QUERIES["op1_html"](spark, FOLDER)
    assert dict(df.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    rows = {r.page_id: r for r in df.collect()}
    assert rows.keys() == {p["page_id"] for p in pages}
    for p in pages:
        r, article = rows[p["page_id"]], re.search("<article>(.*)</article>", p["html"] or "", re.S)
        assert r.url == p["url"] and r.n_chars == len(r.text)
        if article:  # these pages keep all their text in one article
            plain = re.sub("<[^>]+>", " ", re.sub(r"(?s)<(script|style|nav|aside|form).*?</\1>", " ", article[1]))
            assert set(r.text.split()) <= set(plain.replace("&amp;", "&").split()) | set("&<>\"'")


@pytest.mark.parametrize(("name", "modulus", "held", "cut"), [("op3_toxicity", 3, 1, 0.7), ("op10_quality", 5, 0, 0.3)])
def test_classifier_columns(spark, name, modulus, held, cut):
    kinds, rows = rows_of(spark, name)
    assert {"held_out": "boolean", "score": "double", "predicted": "int"}.items() <= kinds.items()
    for i, r in rows.items():
        assert r.held_out == (crc(i, modulus) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def test_op2_columns(spark):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()}
    words = lambda t: re.findall(r"\w+", t.lower())
    rows = QUERIES["op2_decontamination"](spark, FOLDER).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    for i, t in DOCS.items():  # whole passages are found in any case
        told = " " + " ".join(words(t)) + " "
        assert all((i, k) in found for k, x in items.items() if words(x) and f" {' '.join(words(x))} " in told)
    for r in rows:
        own, there = words(items[r.item_id]), words(DOCS[r.doc_id])[r.first_word : r.first_word + r.n_words]
        a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (own, there))
        assert r.similarity >= 0.8 and abs(r.similarity - sum((a & b).values()) / sum((a | b).values())) < 1e-9


def test_op7_columns(spark):
    kinds, rows = rows_of(spark, "op7_lm")
    tokens = {i: [*t.encode().lower().split(), "end"] for i, t in DOCS.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if crc(i, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert {"held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}.items() <= kinds.items()
    for i, r in rows.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 5) == 1, len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_op8_columns(spark):
    kinds, rows = rows_of(spark, "op8_media")
    for i, r in rows.items():
        raw = DOCS[i].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        stored = media.write_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), sha(stored)) and media.read_wav(stored) == payload
        codes = media.pair_codes(media.peaks(payload))
        assert r.feature == f"{len(codes)}:{sha(','.join(map(str, codes.tolist())))}"
    assert kinds["feature"] == "string" and kinds["tail_crc32"] == "bigint"


def test_op8_features_by_a_plain_transform():
    rng = random.Random(3)
    payload = bytes(rng.randrange(256) for _ in range(576))
    n, found = 288, []
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    for at in range(0, len(payload) - n + 1, 144):
        part = [(payload[at + k] - 128) * window[k] for k in range(n)]
        power = [abs(sum(x * cmath.exp(-2j * math.pi * k * b / n) for k, x in enumerate(part))) for b in range(n // 2 + 1)]
        found.append([max(range(low, high), key=lambda b: power[b]) for low, high in ((1, 12), (12, 48), (48, 145))])
    assert media.peaks(payload).tolist() == found
    codes = []
    for t, row in enumerate(found):
        for apart in (1, 2):
            if t + apart < len(found):
                codes += [t * 2**24 + row[k] * 2**14 + found[t + apart][(k + apart) % 3] * 2**4 + apart for k in range(3)]
    assert media.pair_codes(np.array(found)).tolist() == sorted(codes)


def test_op9_columns(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, rows = rows_of(spark, "op9_bpe")
    for i, r in rows.items():
        ids = library.encode(DOCS[i], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op4_columns(spark):
    kinds, rows = rows_of(spark, "op4_pii")
    assert kinds == {"doc_id": "bigint", "text": "string", "n_pseudonyms": "bigint"}
    changed = [i for i, r in rows.items() if (r.text or "") != DOCS[i]]
    assert set(changed) == {i for i, r in rows.items() if r.n_pseudonyms} and changed
    for i in changed:  # all but digits and letters stays; numbers of an address may differ in length
        assert re.sub("[A-Za-z0-9]+", "x", rows[i].text) == re.sub("[A-Za-z0-9]+", "x", DOCS[i])


# trees


def test_forest_walks_like_a_plain_tree():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(int)
    forest = quality.fit_forest(x, y, trees=12, depth=3)

    def walk(row):
        out = forest.base
        for root in forest.roots.tolist():
            node = root
            while forest.left[node] != node:
                node = int(forest.left[node]) + int(row[forest.feature[node]] > forest.threshold[node])
            out += forest.value[node]
        return out

    assert np.allclose(forest.raw(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (120, 3)).astype(float)
    y = (x[:, 1] + rng.standard_normal(120) > 4).astype(int)
    forest = quality.fit_forest(x, y, trees=1, depth=1, bins=64)
    p = 1 / (1 + math.exp(-forest.base))
    gain, h = {}, p * (1 - p)
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
            sides = [y[x[:, f] <= cut], y[x[:, f] > cut]]
            if min(map(len, sides)) >= 3:
                gain[f, cut] = sum((len(s) * p - s.sum()) ** 2 / (len(s) * h + 1) for s in sides)
    best = max(gain.values())
    assert math.isclose(gain[int(forest.feature[0]), float(forest.threshold[0])], best, rel_tol=1e-9)
    for node, side in ((1, x[:, forest.feature[0]] <= forest.threshold[0]), (2, x[:, forest.feature[0]] > forest.threshold[0])):
        assert math.isclose(forest.value[node], -0.2 * (side.sum() * p - y[side].sum()) / (side.sum() * h + 1), rel_tol=1e-9)


# classifiers and the pipeline on rows of every kind


def written(spark, folder, documents, labels, items, columns="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(documents, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_pipeline_on_rows_of_every_kind(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, labels = [], []
    for i in range(90):
        bad = i % 3 == 0
        text = prose(rng, 60)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", "s", 1, "kept", -1, 0.5))
        labels.append((i, int(not bad), None))
    long = prose(rng, 100_000)
    rows += [(200, None, None, None, None, None, None, None), (201, "", "en", "s", 0, "", 0, 0.0), (202, long, "en", "s", 1, "x", 1, 0.1), (None, rows[1][1], "en", "s", 1, "x", 1, 0.1), rows[1], (203, "mail me@example.org now " + (other := prose(rng, 60)), "en", "s", 1, "x", 1, 0.1)]
    labels += [(None, 1, 1), (7, None, 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, _dropped int, score double"
    folder = written(spark, tmp_path, rows, labels, [(None, "a b c d e f g h"), (1, None)], columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert sorted(after.columns) == sorted(docs.columns) and after.count() <= docs.count(), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    out = corpus_pipeline.run(spark, folder).collect()
    by_id = collections.Counter(r.doc_id for r in out)
    assert by_id[1] == 1 and by_id[202] == 1 and max(n for i, n in by_id.items() if i is not None) == 1
    texts = {r.doc_id: r.text for r in out}
    assert texts[202] == long and "me@example.org" not in texts[203] and texts[203].endswith("@example.org now " + other)
    assert not any(i % 3 == 0 for i in texts if i is not None and i < 90)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [], [])).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_classifiers_take_rows_of_every_kind(spark, name):
    from plumbline.llm import toxicity

    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" damn you" if i % 2 else ""), "score") for i in range(40)]
    rows += [(50, None, None), (51, "", ""), (None, "x", "x"), rows[0], (52, "word " * 100_000, "x"), (53, "x" * 500_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    if name == "toxicity":
        scored = toxicity.toxicity_scores(df, toxicity.fit_toxicity(df, labels))
        none = toxicity.toxicity_scores(df.where("false"), toxicity.fit_toxicity(df, labels))
    else:
        scored = quality.quality_scores(df, quality.fit_quality(df, labels))
        none = quality.quality_scores(df.where("false"), quality.fit_quality(df, labels))
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and none.count() == 0
    of = collections.defaultdict(set)
    for r in got:
        of[r.doc_id].add(r.score)
    assert len(of[0]) == 1 and of[50] == of[51]


def test_stream_of_ids_that_clash_in_name(spark):
    """Operators read the columns that they are told of, whatever the others are called."""
    from plumbline.llm import bpe, ppm, substrings

    df = spark.createDataFrame([("k", "one two three", 1, 2)], "key string, body string, text int, _text int")
    assert bpe.bpe_round_trip(df, public_tokenizers.path("byte_bpe_50k.json"), "key", "body").first().decoded == "one two three"
    assert ppm.score_texts(df, F.lit(True), "key", "body").first().n_tokens == 4
    assert substrings.remove_repeats(df, id_col="key", text_col="body").first().kept == "one two three"
