"""Vector codes, languages and importance against brute force on small rows with every defined edge case."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import SCHEMA, pairs, rows

from quarrystone.llm import importance, language_id, vector_codes
from quarrystone.llm.common import small_batches


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).withColumn("score", F.lit(1)).withColumn("above", F.lit(2)).withColumn("n_words", F.lit(3))


# ---- vector codes


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 48])
def test_nearest_entries(width):
    """Against all distances; most entries of long parts are never compared in full."""
    r = np.random.default_rng(width)
    entries = r.integers(-40, 40, (64, width)) + 30 * r.integers(-3, 4, (64, 1))
    entries[40:44] = entries[3:7]  # ties go to the lower index
    parts = entries[r.integers(0, 64, 3000)] + r.integers(-6, 7, (3000, width))
    parts[:64], parts[64:70] = entries, 0
    distances = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    book = vector_codes.Codebook(entries)
    index, away = book.nearest(parts)
    assert (index == distances.argmin(1)).all() and (away == distances.min(1)).all()
    assert book.compared < (0.1 if width >= 4 else 0.5) * distances.size
    assert len(book.nearest(parts[:0])[0]) == 0


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(5)
    a, b = r.integers(-(1 << 26), 1 << 26, (200, 12)), r.integers(-9, 9, (50, 12))
    book = vector_codes.Codebook(b)
    mine, norms = vector_codes.levels(a), (a * a).sum(1)
    distances = ((a[:, None, :] - b[None]) ** 2).sum(2)
    row, entry = np.indices(distances.shape)
    bounds = [book._bound(k, mine, row, entry) for k in range(len(mine))]
    assert len(bounds) == 3 and all((x <= distances + 0.5 + 1e-6 * (norms[:, None] + book.norms)).all() for x in bounds)


def brute_codes(table, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in table if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    width = 8 // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, table[n][1] is None, kept[n][1]))[:entries]
    books = [[cut[n][p] for n in first] for p in range(parts)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    code = lambda: [[min(range(len(books[p])), key=lambda e: (away(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        now = code()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, now) if k[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    final = code()
    return books, [(i, label, k, sum(away(c[p], books[p][k[p]]) for p in range(parts))) for (i, _, label), c, k in zip(kept, cut, final)]


@pytest.mark.parametrize("entries", [4, 64])
def test_vector_codes_of_odd_rows(spark, entries):
    small_batches(spark)
    r = random.Random(3)
    table = [(i * 3 - 5, [r.gauss(0, 0.2) for _ in range(8)], r.choice(["a", "b", None])) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    table += [(900, None, "a"), (901, [], "a"), (902, [nan] * 8, "a"), (903, [inf] + [0.0] * 7, None), (904, [None] + [0.0] * 7, "b"), (905, [0.1] * 16, "a"), (906, [0.1] * 3, "a")]
    table += [(None, table[3][1], "a"), table[5], table[5], (7, [0.0] * 8, None), (907, [-1.0] * 8, "hot"), (908, [-0.001] * 8, "hot")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label string").repartition(3)
    df = df.select("*", *(F.lit("x").alias(c) for c in ("id", "vec", "codes", "error", "of", "label_error")))
    found, books = vector_codes.vector_codes(df, parts=2, entries=entries, rounds=2)
    want_books, want = brute_codes(table, 2, entries, 2)
    assert books.tolist() == want_books
    assert sorted(map(str, ((x.id, x.label, list(x.codes), x.error) for x in found.collect()))) == sorted(map(str, want))


def test_vector_codes_saturate_and_empty(spark, tmp_path):
    small_batches(spark)
    huge = spark.createDataFrame([(1, [3e38, -3e38]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int"))
    _, books = vector_codes.vector_codes(huge, parts=2)
    assert books.tolist() == [[[vector_codes.LARGEST], [0]], [[-vector_codes.LARGEST], [0]]]
    for rows_ in (huge.limit(0), huge.filter("vec_id = 2").withColumn("embedding", F.lit(None).cast("array<float>"))):
        rows_.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        found = vector_codes.op11_vector_codes(spark, str(tmp_path))
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and found.count() == 0


# ---- languages


def brute_viterbi(scores, switch):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        total = sum(scores[t, x] for t, x in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        best = total if best is None or total > best else best
    return best


def worth(path, scores, switch):
    return scores[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    for _ in range(60):
        scores = r.normal(0, 3, (r.integers(1, 8), 3))
        path = language_id.viterbi(scores, 4.0)
        assert worth(path, scores, 4.0) == pytest.approx(brute_viterbi(scores, 4.0))


def test_labels_are_viterbi_paths():
    """Whether a text goes through the table or is proved to need none, its labels are worth as much as the best path."""
    r = np.random.default_rng(2)
    sizes = r.integers(1, 60, 300)
    owner = np.repeat(np.arange(300), sizes)
    lean = r.normal(0, 1, (300, 3))[owner] * 2
    turn = (r.random(300) < 0.3)[owner] & (np.arange(len(owner)) % 7 > 3)
    scores = r.normal(0, 2, (len(owner), 3)) + np.where(turn[:, None], np.roll(lean, 1, axis=1), lean)
    model = language_id.Model(["a", "b", "c"], np.zeros(0), np.zeros(0), 9.0)
    label = model.labels(owner, scores)
    ways = set()
    for k in range(300):
        mine, found = scores[owner == k], label[owner == k]
        assert worth(found, mine, 9.0) == pytest.approx(worth(language_id.viterbi(mine, 9.0), mine, 9.0))
        ways.add((np.diff(found) != 0).any())
    assert ways == {False, True}


ENGLISH = "the house and the river of our town with some people who were walking there when it was evening and they should have been home".split()
GERMAN = "das haus und der fluss unserer stadt mit einigen menschen die dort gingen als es abend wurde und sie hätten zuhause sein sollen".split()
RUSSIAN = "дом и река нашего города где люди гуляли вечером хотя должны были быть дома потому что было уже поздно".split()


@pytest.fixture(scope="module")
def model(spark):
    small_batches(spark)
    r = random.Random(4)
    text = lambda words: " ".join(r.choices(words, k=25)).capitalize() + "."
    table = [(i, text((ENGLISH, GERMAN, RUSSIAN)[i % 3]), ("en", "de", "ru")[i % 3]) for i in range(150)] + [(None, "x", "zz"), (151, None, "xx"), (152, "y", None)]
    return language_id.fit(spark.createDataFrame(table, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts(model):
    assert model.languages == ["de", "en", "ru"] and model.writes.sum() == 3
    english, german, russian = (" ".join(x) for x in (ENGLISH, GERMAN, RUSSIAN))
    text = f"{english}! {german.upper()}; 123 -- {russian}"
    (spans,), (lang,), (sure,) = language_id.spans_of([text], model)
    assert [x[0] for x in spans] == ["en", "de", "ru"] and lang in ("de", "en") and 0 < sure < 0.6
    assert [text[a:b].lower() for _, a, b in spans] == [english, german, russian]
    assert language_id.spans_of([english, german, russian, english + " fluss"], model)[1] == ["en", "de", "ru", "en"]


def test_words_by_script():
    words = language_id.words_of(["Éa b́c漢字かx", "", "12 — !", "Straßé Дом"])
    assert words.owner.tolist() == [0, 0, 0, 0, 0, 0, 3, 3] and words.length.tolist() == [2, 3, 1, 1, 1, 1, 7, 3]
    assert "".join(chr(c) if c else "|" for c in words.letters).startswith("|éa||b́c||漢||字||か||x|")
    assert language_id.words_of([]).owner.tolist() == language_id.words_of(["", " "]).owner.tolist() == []


def test_languages_of_odd_rows(spark, docs, model):
    got = language_id.identify(docs, model).collect()
    letters = {(r[0], r[1]) for r in rows() if r[1] and any(c.isalpha() for c in r[1])}
    assert len(got) == len(rows()) and all(0 <= x.score <= 1 for x in got)
    known = {i for i, _ in letters}
    assert all((x.lang_pred == "und") == (x.doc_id not in known) for x in got if x.doc_id is not None)
    assert all(x.spans == [] and x.score == 0 for x in got if x.lang_pred == "und")
    unseen = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unseen.languages == [] and {x.lang_pred for x in language_id.identify(docs, unseen).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model).count() == 0
    assert language_id.spans_of(["ελληνικά ελληνικά"], model)[1][0] in model.languages


def test_rows_held_out_are_not_learned(spark, monkeypatch):
    small_batches(spark)
    table = [(i, f"word{i}", "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "held") for i in range(400)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    assert language_id.fit(df).languages == ["en"]
    assert language_id.sampled(df, "doc_id", "text", "lang", 20).count() == 20
    assert {x.doc_id for x in df.filter(language_id.held_out(F.col("doc_id"))).collect()} == {i for i, _, x in table if x == "held"}


def test_languages_of_held_out_documents(spark):
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = language_id.op12_language(spark, SMALL).join(docs, "doc_id").filter("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in found) >= 0.95 * len(found) > 0


# ---- importance


def words_in(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text, buckets):
    w = words_in(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_importance(table, target, percent, least_words):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, text, *_ in table:
        np.add.at(s, buckets_of(text, 10_000), 1)
    for text in target:
        np.add.at(t, buckets_of(text, 10_000), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t)]
    out = []
    for i, text, *_ in table:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        found = buckets_of(text, 10_000)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_in(text)) >= least_words])
    able = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


@pytest.mark.parametrize(("percent", "coarse"), [(5, 4096), (60, 4096), (60, 2), (100, 1), (0, 3)])
def test_importance(docs, spark, monkeypatch, percent, coarse):
    monkeypatch.setattr(importance, "COARSE", coarse)
    target = ["ALPHA1 beta2 gamma3", "the of the of", None, "", "x1 y2 été7"]
    got = importance.importance_sample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=percent, least_words=3)
    assert pairs(got, "doc_id", "n_features", "weight", "score", "rank") == sorted(map(str, brute_importance(rows(), target, percent, 3)))


def test_importance_of_empty_tables(docs, spark):
    none = spark.createDataFrame([], "text string")
    assert importance.importance_sample(docs.limit(0), none).count() == 0
    assert importance.importance_sample(docs, none, percent=50).filter("rank IS NOT NULL").count() > 0


def test_hashes_of_word_runs():
    """Shifted CRCs are those of the joined bytes, for words of any length."""
    texts = ["a " + "x" * 63 + " b", "y" * 64 + " " + "z" * 65 + " w", "é" * 300 + " q " + "漢" * 1000, "", "one", "Two Words", "1-2-3_4"]
    n_words, owner, found = importance.features(texts)
    assert n_words.tolist() == [len(words_in(t)) for t in texts]
    assert [sorted(found[owner == k].tolist()) for k in range(len(texts))] == [sorted(buckets_of(t, 10_000)) for t in texts]
    assert [len(x) for x in importance.features([])] == [0, 0, 0]
