"""Operators against brute force on small rows that hold every defined edge case."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrystone.llm import bpe, exact_dedup, html_extract, lattice, mixing, segments, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from quarrystone.llm.common import small_batches
from quarrystone.llm.components import components
from quarrystone.llm.fm_index import FmIndex

SCHEMA = "doc_id long, text string, source string, keep_id string, key long, anchor string, shard int"
WORDS = "alpha beta gamma delta eins zwei drei vier fünf été naïve 漢字 x1 y2 the of".split()


def rows():
    """Nulls, empty and blank texts, copies, near copies, a periodic text, a shared passage, repeated rows and repeated ids."""
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    passage, base, long = text(30), text(60), text(4000)
    out = [(i, text(r.randrange(1, 80))) for i in range(1, 25)]
    out += [
        (30, base), (31, base), (29, base.replace(" ", "\n", 3)), (32, base + " tail"), (33, "head " + base), (40, "ab " * 400), (41, "x" * 1500), (42, long),
        (43, text(20) + " " + passage), (44, passage + " " + text(20)), (45, "a  b\tc"), (46, "a b c")
    ]
    out += [
        (50, None), (51, ""), (52, " \n "), (53, None), (None, base), (None, "a b c"), (None, None), (60, "same row twice " * 5), (60, "same row twice " * 5),
        (61, "one id"), (61, "two texts"), (-7, passage)
    ]
    return [(i, t, ["s1", "s2", None][n % 3] if n % 2 else "hot", "clash", 1, "a", 2) for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def pairs(df, *columns):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))


def expect(found):
    return sorted(map(str, found))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_exact():
    norm = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in rows()]
    seen, out = set(), []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        least = min((j for j in ids if j is not None), default=None)
        first = i == least and (i, t) not in seen
        seen.add((i, t))
        out.append((i, least, len(ids), first))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, spark, weak):
    digest = (lambda c: F.unhex(F.lpad(F.hex(F.length(c) % 5), 2, "0"))) if weak else exact_dedup.sha256
    assert pairs(exact_dedup.exact_dedup(docs, digest=digest), "doc_id", "keep_id", "group_size", "kept") == expect(brute_exact())
    assert exact_dedup.exact_dedup(empty(spark), digest=digest).count() == 0


def test_digest_index_compacts_levels(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    for k in range(5):
        index.flush(spark.createDataFrame([(bytes([i % 7]), i) for i in range(k, 20, 5)], "digest binary, id long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    want = {d: (d, len(range(d, 20, 7))) for d in range(7)}
    as_dict = lambda df: {bytes(r.digest)[0]: (r.keep_id, r.group_size) for r in df.collect()}
    assert as_dict(index.merged()) == want
    assert index.runs(2).count() == 7  # a merged run holds each digest once
    asked = index.lookup([b"\x03", b"\x06", b"\x09", b"\x03"])
    assert as_dict(asked) == {3: want[3], 6: want[6]}
    assert "EqualTo(digest" in asked._jdf.queryExecution().toString()


def test_toxicity_chains_keep_their_words_apart():
    """Two chains in one process, the second made where the first was."""
    def fitted(word):
        texts = [f"plain words number {i} " + (word if i % 3 == 0 else "") for i in range(120)]
        return toxicity.fit_chain(toxicity.features(texts), np.array([[int(i % 3 == 0)] for i in range(120)]), ["toxic"])

    first = fitted("poison")
    assert first.probabilities(["poison", "flower"])[:, 0].argmax() == 0
    import pickle

    copy = pickle.loads(pickle.dumps(first))
    assert toxicity.words_of(copy) is toxicity.words_of(first)
    del first
    for _ in range(20):
        other = fitted("flower")
        assert other.probabilities(["poison", "flower"])[:, 0].argmax() == 1
    assert copy.probabilities(["poison", "flower"])[:, 0].argmax() == 0


def area_under_curve(scores, y):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    ones = y.sum()
    return (order[y > 0].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_out_of_fold_scores_know_nothing_of_random_labels():
    """Random features and random, rare labels: there is nothing to learn, so honest scores are no better than chance; real evidence is still found."""
    r = np.random.default_rng(11)
    held = [np.unique(r.integers(0, 60_000, 90)).astype(np.int32) for _ in range(4000)]
    labels = (r.random((4000, 2)) < 0.02).astype(int)
    labels = np.column_stack((labels, labels[:, 0] & (r.random(4000) < 0.7)))
    chain = toxicity.fit_chain(held, labels[:, :2], ["a", "b"])
    assert len(chain.number) > 50  # the selection on all rows has much to choose from
    for scores, y in zip(chain.out_of_fold.T, labels.T):
        assert 0.4 < area_under_curve(scores, y) < 0.6
    chain = toxicity.fit_chain(held, labels[:, [0, 2]], ["a", "part of a"])
    assert 0.4 < area_under_curve(chain.out_of_fold[:, 0], labels[:, 0]) < 0.6 and 0.35 < area_under_curve(chain.out_of_fold[:, 1], labels[:, 2]) < 0.65
    marked = [np.append(h, 60_001).astype(np.int32) if y[0] else h for h, y in zip(held, labels)]
    assert area_under_curve(toxicity.fit_chain(marked, labels[:, :1], ["a"]).out_of_fold[:, 0], labels[:, 0]) > 0.95


def test_toxicity_of_odd_rows(spark):
    """Null, blank and very long texts, repeated rows and ids, and columns with the names the operator uses."""
    small_batches(spark)
    long = "plain words " * 200_000
    texts = [(i, f"text {i} " + ("venom" if i % 5 == 0 else "honey")) for i in range(100)] + [
        (170, None), (171, " "), (172, long + "venom"), (172, long + "venom"), (None, "venom"), (1, "another text of an id")
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("p", F.lit(1)).withColumn("c0", F.lit("x")).withColumn("id", F.lit(3)).withColumn("held", F.lit(4))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)] * 2, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    kept = toxicity.without_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*(i for i in range(100) if i % 5), 170, 171, 1]))


def test_forest_holds_one_key_and_one_batch(monkeypatch):
    """Keys that straddle batches are cut off as soon as the next one begins."""
    import pandas as pd

    r = random.Random(9)
    keys = sorted([k for k in range(40) for _ in range(r.randrange(2, 12))])
    rows = pd.DataFrame({"choice": 1, "mask": 0, "key": keys, "fp": [r.choice((0, 1, 3, 255)) for _ in keys], "node": range(len(keys))})
    rows = rows.drop_duplicates(["key", "fp"]).reset_index(drop=True)
    rows["node"] = range(len(rows))
    held, concat = [], pd.concat
    monkeypatch.setattr(simhash.pd, "concat", lambda parts, **k: held.append(sum(map(len, parts))) or concat(parts, **k))
    found = concat(list(simhash.forest(rows.iloc[k : k + 7] for k in range(0, len(rows), 7))))
    assert max(held) <= 7 + 12
    near = [
        (a, b)
        for a in range(len(rows)) for b in range(a) if rows["key"][a] == rows["key"][b] and (int(rows["fp"][a]) ^ int(rows["fp"][b])).bit_count() <= 3
    ]
    assert least_reachable(range(len(rows)), list(zip(found["a"], found["b"]))) == least_reachable(range(len(rows)), near)


def brute_substring(window):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows()]
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 10_000])
def test_substring_dedup(docs, spark, monkeypatch, hot):
    monkeypatch.setattr(segments, "HOT_ROWS", hot)
    got = substring_dedup.substring_dedup(docs).withColumn("h", F.sha2("kept", 256))
    assert pairs(got, "doc_id", "n_words", "n_removed", "h") == expect(brute_substring(13))
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(segments, "PIECE_BYTES", 200)
    cutter = substring_dedup.WordCutter()
    substring_dedup.PIECE_BYTES, old = 200, substring_dedup.PIECE_BYTES
    try:
        raw = cutter.canonical(" ".join(f"w{i % 50}" for i in range(500)))
        words = raw.split(b" ")
        windows = set()
        for piece, base in cutter.split(raw):
            part = piece.split(b" ")
            assert part == words[base : base + len(part)]
            windows |= set(range(base, base + len(part) - 12))
        assert windows == set(range(len(words) - 12))
    finally:
        substring_dedup.PIECE_BYTES = old


@pytest.mark.parametrize(("sigma", "depth", "size"), [(5, 6, 400), (3, 13, 600), (40, 13, 2000), (2, 4, 50)])
def test_matching_statistics_against_search(sigma, depth, size):
    """Streamed sequences that are in the index, in parts of it, or not: lengths and places of all longest matches."""
    r = np.random.default_rng(sigma)
    tokens = np.append(r.integers(1, sigma, size), 0)
    tokens[r.integers(0, size, size // 60)] = 0
    index = FmIndex(tokens, sigma, depth)
    copied = np.concatenate([tokens[a : a + 70] for a in r.integers(0, size - 20, 6)])
    streamed = np.concatenate((tokens, copied, r.integers(1, sigma + 2, 200), [0]))
    cuts = np.flatnonzero(streamed == 0)
    begins, ends = np.concatenate(([0], cuts[:-1] + 1)), cuts
    places: dict[tuple, set] = {}
    for m in range(1, depth + 1):
        for k in range(size - m + 1):
            places.setdefault(tuple(tokens[k : k + m].tolist()), set()).add(k)
    length, low, high = index.matching_statistics(streamed, begins, ends)
    assert length.max() == depth and (length[cuts] == 0).all()
    for begin, end in zip(begins, ends):
        for i in range(begin, end):
            fits = [m for m in range(1, min(depth, end - i) + 1) if tuple(streamed[i : i + m].tolist()) in places]
            assert length[i] == max(fits, default=0)
            if fits:
                assert set(index.order[low[i] : high[i]].tolist()) == places[tuple(streamed[i : i + max(fits)].tolist())]


def test_substring_dedup_rests_on_the_search(monkeypatch):
    """Intervals that miss an occurrence, or matches that are too short, change what the operator removes."""
    words = [f"w{i}" for i in range(20)]
    segs = [" ".join(words).encode(), " ".join(["x", *words[1:], "y"]).encode()]
    found = lambda: substring_dedup.shard_minima(13)(segs, pd.DataFrame({"least": [3, 8]}))
    assert [x.tolist() for x in found()] == [[3] * 8, [8] + [3] * 7 + [8]]
    right = FmIndex.matching_statistics
    monkeypatch.setattr(FmIndex, "matching_statistics", lambda self, *a: (lambda n, low, high: (n, np.maximum(low, high - 1), high))(*right(self, *a)))
    assert [x.tolist() for x in found()][1] != [8] + [3] * 7 + [8]
    monkeypatch.setattr(FmIndex, "step", lambda self, symbol, low, high: (low, low))
    assert all(len(x) == 0 for x in found())


def brute_suffix(window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows()]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for k in range(len(t) - window + 1):
            seen[t[k : k + window]] = seen.get(t[k : k + window], 0) + 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(400, 32, 10_000), (400, 32, 1), (50, 20, 1), (50, 20, 10_000)])
def test_suffix_dedup(docs, spark, monkeypatch, window, gram, hot):
    monkeypatch.setattr(segments, "HOT_ROWS", hot)
    got = suffix_dedup.suffix_dedup(docs, window=window, gram=gram).withColumn("h", F.sha2("kept", 256))
    assert pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "h") == expect(brute_suffix(window))
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("depth", [3, 8, 50, 64, 400])
def test_radix_sort_finds_equal_beginnings(depth):
    """Against a set of byte strings, for depths that are and are not multiples of a digit, within groups."""
    r = np.random.default_rng(depth)
    raw = r.integers(97, 99, 4000, dtype=np.uint8)
    raw[1500:2500] = raw[200:1200]
    starts = r.choice(len(raw) - depth, 1500, replace=False)
    group = r.integers(0, 3, len(starts)) * 10**12
    seen: dict[tuple, int] = {}
    keys = [(int(g), raw[s : s + depth].tobytes()) for s, g in zip(starts, group)]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    assert suffix_dedup.repeated_suffixes(raw, starts, group, depth).tolist() == [seen[key] > 1 for key in keys]


def test_very_long_texts_and_empty_tables(spark):
    """A text of some megabytes and its copy, beside short ones, through every operator on documents; then no rows at all."""
    small_batches(spark)
    r = random.Random(21)
    long = " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(200_000))
    table = [(1, long), (2, long), (3, "short"), (4, None)]
    docs = spark.createDataFrame([(*row, "s", "c") for row in table], "doc_id long, text string, source string, digest string")
    assert sorted((x.doc_id, x.keep_id, x.kept) for x in exact_dedup.exact_dedup(docs).collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert sorted((x.doc_id, x.component_id) for x in simhash.simhash_components(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert {x.doc_id: x["size"] for x in sharding.shard_rows(docs, sharding.Tree(24)).collect()} == {i: len((t or "").encode()) + 8 for i, t in table}
    found = {x.doc_id: x for x in bpe.bpe_digests(docs, bpe.byte_bpe_path()).collect()}
    assert found[1].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and found[1].ids_sha256 == found[2].ids_sha256
    assert {
        x.doc_id: (x.n_words, x.n_removed)
        for x in substring_dedup.substring_dedup(docs).collect()
    } == {1: (200_000, 0), 2: (200_000, 200_000), 3: (1, 0), 4: (0, 0)}
    size = len(long.encode())
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(docs).collect()} == {1: (size, 1), 2: (size, 1), 3: (0, 0), 4: (0, 0)}
    assert mixing.mix(docs, {}).count() == 4
    none = docs.limit(0)
    for empty_result in (
        bpe.bpe_digests(none, bpe.byte_bpe_path()), bpe.bpe_ids(none, bpe.byte_bpe_path()), mixing.mix(none, {}), simhash.simhash_components(none),
        sharding.shard_rows(none, sharding.Tree(24))
    ):
        assert empty_result.count() == 0


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_simhash(docs, spark):
    r = rows()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in r]
    known = [(i, f) for i, f in prints if i is not None]
    label = least_reachable({i for i, _ in known}, [(a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 3])
    want = [(i, f - (1 << 64) if f >> 63 else f) for i, f in prints]
    got = simhash.simhash_components(docs)
    assert pairs(got, "doc_id", "fp") == expect(want)
    by_print = {}
    for i, f in known:
        by_print[i, f] = min(label[j] for j, g in known if g == f)
    for row in got.collect():
        assert row.component_id == (None if row.doc_id is None else by_print[row.doc_id, row.fp & (1 << 64) - 1])
    assert simhash.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("dense", [8, 2048])
def test_simhash_links_in_crowded_keys(spark, monkeypatch, dense):
    small_batches(spark)
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(2)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(9))) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.near_edges(spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long"), dense)
    label = least_reachable(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    found = {r.node: r.component_id for r in components(edges, "t").collect()}
    assert [found.get(i, i) for i in range(len(fps))] == [label[i] for i in range(len(fps))]


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long"), "chain").collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_components_with_hot_centres(spark):
    """Stars whose centres are not the least ids, and chains between them."""
    r = random.Random(6)
    edges = [(5_000, i) for i in range(400)] + [(6_000, i) for i in range(1_000, 1_300)] + [(i, i + 1) for i in range(1_299, 1_400)] + [(9_000, 9_001), (7, 9_500)]
    label = least_reachable({n for e in edges for n in e}, edges)
    r.shuffle(edges)
    assert {x.node: x.component_id for x in components(spark.createDataFrame(edges, "a long, b long"), "hot").collect()} == label


def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.byte_bpe_path())
    want = []
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert pairs(bpe.bpe_digests(docs, bpe.byte_bpe_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expect(want)
    back = bpe.bpe_texts(bpe.bpe_ids(docs, bpe.byte_bpe_path()), bpe.byte_bpe_path())
    assert pairs(back, "doc_id", "text") == expect((i, t or "") for i, t, *_ in rows())


def test_bpe_on_odd_texts():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.byte_bpe_path()), bpe.PrefixBpe(bpe.byte_bpe_path())
    r = random.Random(4)
    parts = [" ", "\n", "<|endoftext|>", "'s", "'LL", "é", "日本", "🙂", "aaaa", "ababab", "ing", "!!", "123", "\t", " ", "\x1c", "\x85"]
    latin = [chr(c) for c in range(bpe.LATIN_END)]
    for n in range(1000):
        t = "".join(r.choice(parts if n % 2 else latin + [" "] * 90 + list("'stremvld") * 5) for _ in range(r.randrange(40)))
        assert own.pieces(t) == own.any_pieces(t)
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_sharding(docs, spark):
    got = sharding.shard_rows(docs, sharding.Tree(24)).collect()
    want = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows()]
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32) for r in got))) == expect(want)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.shard_rows(empty(spark), sharding.Tree(24)).count() == 0


def brute_shard(key, shards, base=24, regions=2, racks=3):
    """The leaf of a tree that is built from the list of its leaves, each (generation, region, rack): exponential draws by level."""
    from math import log

    def draw(node, weight):
        bits = int(hashlib.md5(f"{key}|{'.'.join(map(str, node))}".encode()).hexdigest()[:12], 16)
        return -log((bits + 0.5) / 2**48) / weight

    leaves = {}
    for shard in range(shards):
        spot = shard // (base // (regions * racks)) if shard < base else (shard - base) % (regions * racks)
        leaves[shard] = (0 if shard < base else shard - base + 1, spot // racks, spot % racks)
    for depth in (2, 3):
        names = sorted({(g, *rest)[:depth] for g, *rest in leaves.values()})
        if len(names) > 1:
            best = min(names, key=lambda name: draw(name, sum(p[:depth] == name for p in leaves.values())))
            leaves = {s: p for s, p in leaves.items() if p[:depth] == best}
        else:
            leaves = {s: p for s, p in leaves.items() if p[:depth] == names[0]}
    return min(leaves, key=lambda s: draw((s,), 1))


def test_shards_against_a_plain_tree(docs, spark):
    ids = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.createDataFrame([(None, "t"), (-5, "t")], "doc_id long, text string"))
    for shards in (24, 25, 31):
        for x in sharding.shard_rows(ids, sharding.Tree(shards)).collect():
            key = "null" if x.doc_id is None else str(x.doc_id)
            assert (x.shard, x.grown_shard) == (brute_shard(key, shards), brute_shard(key, shards + 1))


def test_growing_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    before = sharding.Tree(24)
    for _ in range(3):
        moved = sharding.shard_rows(ids, before).groupBy("shard", "grown_shard").count().collect()
        assert all(r.grown_shard in (r.shard, before.shards) for r in moved)
        share = sum(r["count"] for r in moved if r.grown_shard == before.shards) / 20_000
        assert abs(share - 1 / (before.shards + 1)) < 0.01
        before = sharding.Tree(before.shards + 1)


def test_rows_without_id_are_numbered_in_many_buckets(spark):
    df = spark.createDataFrame([(None, f"text {i % 150}") for i in range(300)], "doc_id long, text string")
    found = sharding.shard_rows(df, sharding.Tree(24))
    assert sorted(x.slot for x in found.collect()) == list(range(300)) and found.select("shard").distinct().count() == 1
    assert "md5(cast(coalesce(text" in found._jdf.queryExecution().optimizedPlan().toString()


def test_shard_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.Tree(24, weights=((3, 5.0),))
    n = sharding.shard_rows(ids, tree, grow=False).filter("shard = 3").count()
    assert abs(n / 20_000 - 5 / 28) < 0.015


def test_mixing_keeps_rows_and_stays_within_a_block(docs, spark):
    weights = {"hot": 0.5, "s1": 0.3, "s2": 0.2}
    ids = spark.range(9000).select("id", F.expr("CASE WHEN id % 10 < 6 THEN 'hot' WHEN id % 10 < 9 THEN 's1' ELSE 's2' END").alias("source"))
    got = mixing.mix(ids, weights, "id", block_rows=8, period=10).select("id", "_mix.*").toPandas()
    assert sorted(got["id"]) == list(range(9000))
    blocks = got.drop_duplicates(["source", "block"]).sort_values("slot")
    assert list(blocks["slot"]) == list(range(len(blocks)))
    first_end = min(blocks[blocks["source"] == s]["slot"].max() for s in weights)
    for t in range(1, first_end + 2):
        head = blocks[blocks["slot"] < t]
        for s, w in weights.items():
            assert abs((head["source"] == s).sum() - w * t) < 1
    assert mixing.mix(docs).count() == len(rows()) and mixing.mix(empty(spark)).count() == 0
    assert mixing.in_mixed_order(mixing.mix(docs)).columns == docs.columns


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 2 / 3}, {"a": 1.0, "b": 1 / 5000}, None])
def test_mixing_does_not_drift_over_many_periods(spark, weights):
    n = {"a": 12_000, "b": 24_000} if weights else {"hot": 20_000} | {f"s{k}": 2_000 for k in range(20)}
    ids = spark.createDataFrame([(i, s) for s in n for i in range(n[s])], "id long, source string")
    got = mixing.mix(ids, weights, "id", block_rows=1).select("id", "_mix.*").toPandas().sort_values("slot")
    assert list(got["slot"]) == list(range(sum(n.values())))
    wanted = weights or {s: k**0.5 for s, k in n.items()}
    first_end = got.groupby("source")["slot"].max().min()
    for s, w in wanted.items():
        placed = (got["source"] == s).to_numpy().cumsum()[: first_end + 1]
        assert np.abs(placed - w / sum(wanted.values()) * np.arange(1, first_end + 2)).max() < 1 + 1e-9


def test_mixing_of_more_than_a_thousand_sources(spark):
    ids = spark.range(9000).select("id", F.concat(F.lit("site "), F.expr("id % 1500")).alias("source"))
    got = mixing.mix(ids, id_col="id", block_rows=1).select("id", "source", "_mix.slot").toPandas().sort_values("slot")
    assert sorted(got["id"]) == list(range(9000)) and list(got["slot"]) == list(range(9000))
    assert got["source"][:1500].nunique() == 1500


def in_order(left, shares):
    """The source of each slot of a plan, with its stretches run, and by phase the slot of the last seam."""
    blocks, seams = [], {}
    for part in mixing.laid_out(left, shares):
        if isinstance(part, mixing.Stretch):
            seams[part.start] = part.start + part.high
            blocks += part.blocks()
        else:
            blocks.append(part)
    assert sorted(b[:2] for b in blocks) == sorted((s, k) for s, n in left.items() for k in range(n))
    assert [b[2] for b in sorted(blocks, key=lambda b: b[2])] == list(range(sum(left.values())))
    return [b[0] for b in sorted(blocks, key=lambda b: b[2])], seams


def check_phases(left, shares):
    """In every phase each source stays within a block of its exact target after every slot; a phase ends when a source has run out, at its last seam at the earliest."""
    order, seams = in_order(left, shares)
    at, phases = 0, 0
    while left:
        total, placed = sum(shares[s] for s in left), dict.fromkeys(left, 0)
        for slot, s in enumerate(order[at:], 1):
            placed[s] += 1
            assert all(abs(placed[x] * total - shares[x] * slot) < total for x in left)
            if at + slot >= seams.get(at, 0) and any(placed[x] == n for x, n in left.items()):
                break
        at, phases = at + slot, phases + 1
        left = {s: n - placed[s] for s, n in left.items() if n > placed[s]}
    assert at == len(order) and not seams.keys() - set(range(at))
    return len(seams)


@pytest.mark.parametrize("seed", range(12))
def test_no_source_is_a_block_off_across_seams(monkeypatch, seed):
    """Stretches of a few slots, planned apart."""
    r = random.Random(seed)
    many = r.choice([2, 3, 5, 9, 14])
    monkeypatch.setattr(mixing, "STRETCH", r.choice([7, 40, 111]))
    monkeypatch.setattr(mixing, "SHORT", r.choice([1, 60]))
    weights = {f"s{k:02}": r.choice([r.random(), 1 / r.randrange(1, 200), 1.0]) for k in range(many)}
    assert check_phases({s: r.randrange(100, 1500) for s in weights}, mixing.exact_shares(weights)) > 0


def test_mixing_in_tasks_and_named_like_null(spark, monkeypatch):
    """Stretches planned by tasks, pieces that lie across seams, and a source whose name might be taken for no source."""
    monkeypatch.setattr(mixing, "STRETCH", 300)
    monkeypatch.setattr(mixing, "SHORT", 100)
    ids = spark.range(6000).select("id", F.expr("element_at(array('\\0', null, '', 'a'), cast(id % 7 % 4 + 1 as int))").alias("source"))
    got = mixing.mix(ids, {"a": 0.2, "": 0.2, None: 0.35, "\0": 0.25}, "id", block_rows=2, period=64).select("id", "source", F.col("_mix.source").alias("of"), "_mix.slot", "_mix.block").collect()
    assert sorted(x.id for x in got) == list(range(6000)) and all(x.source == x.of for x in got)
    slots = {}
    for x in got:
        slots.setdefault(x.slot, set()).add((x.source, x.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    order = [next(iter(slots[k]))[0] for k in range(len(slots))]
    assert [k for k in slots if k < 400] and abs(order[:400].count(None) - 140) < 1 and abs(order[:400].count("\0") - 100) < 1


def test_mixing_of_weight_nought(spark):
    ids = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id long, source string")
    got = mixing.mix(ids, {"a": 1, "b": 0}, "id", block_rows=1).select("source", "_mix.slot").toPandas().sort_values("slot")
    assert list(got["source"]) == ["a"] * 20 + ["b"] * 20


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=x>menu</a></nav><div class="ad">buy</div>
    <article class=post><header><h1>Head &amp; line</h1></header><p><b>One<br>two</b> <i>three</i><p>Four &lt;tag&gt;<ul><li>five<li>six</ul><div id=comments><p>spam</p></div></article>
    <aside>side</aside><footer>foot</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line\nOne two three\nFour <tag>\nfive\nsix"
    assert [html_extract.main_text(h) for h in (None, "", "<script>x", "<p", "plain &am", "<div>" * 3000 + "deep")] == ["", "", "", "", "plain &am", "deep"]
    blog = "<body><div class=top><a>a</a> <a>b</a></div><div><div id=x><p>" + "long text " * 30 + "</p><p>" + "more text " * 30 + "</p></div><div><a>link one</a><a>link two</a></div></div></body>"
    assert html_extract.main_text(blog).startswith("long text") and "link" not in html_extract.main_text(blog)


@pytest.mark.parametrize(
    "wrapper", ['class="content no-sidebar"', 'class="layout with-sidebar"', 'class="has-comments"', 'id="widget-content"', 'class="sidebar"', 'id="comments"']
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_wrappers_named_after_side_matter(wrapper, tag):
    text = "Long sentences of the article. " * 20
    page = f'<body><div {wrapper}><{tag}><p>{text}</p><p>{text}</p></{tag}><div class="cookie-notice">We use cookies</div></div></body>'
    assert html_extract.main_text(page) == "\n".join([text.strip()] * 2)


def test_html_side_matter_by_name():
    text, more = "Long sentences of the article. " * 20, "Much more that readers say. " * 90
    for side in (
        '<div id="comments"><article class="comment-body"><p>{}</p></article></div>', '<ul class="commentReplies"><li><p>{}</p></ul>',
        '<section class="x comments"><p>{}</p></section>'
    ):
        assert html_extract.main_text(f"<body><div><p>{text}</p></div>{side.format(more)}</body>") == text.strip()
    assert html_extract.main_text('<body><div class="ad">An advert that is longer than the article.</div><article><p>Short.</p></article></body>') == "Short."
    card = '<div class="related"><article><p>Another page</p></article></div>'
    assert html_extract.main_text(f"<body><article><p>{text}</p></article>{card}</body>") == text.strip()


def labelled_page(r):
    """A page without article or main element and without telling names, and its article: paragraphs short and long, lists,
    quotes and links in lines, wrapped up to two times among link lists."""
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{word()} {word()}</a>'
    many = lambda part, low, high: "".join(part() for _ in range(r.randrange(low, high)))
    side = [
        lambda: "<div>" + many(lambda: link() + " ", 3, 9) + "</div>",
        lambda: "<ul>" + many(lambda: f"<li>{link()}</li>", 4, 20) + "</ul>",
        lambda: "<div><ul>" + many(lambda: f"<li>{link()} <span>{r.randrange(99)}</span></li>", 4, 12) + "</ul></div>",
        lambda: "<table>" + many(lambda: f"<tr><td>{link()}</td><td>{link()}</td></tr>", 3, 9) + "</table>",
    ]
    blocks, lines = [f"<h1>{(title := sentence(6))}</h1>"], [title]
    for kind in [*(r.randrange(8) for _ in range(r.randrange(3, 9))), 9]:
        if kind == 1:
            items = [sentence(r.randrange(4, 15)) for _ in range(r.randrange(2, 6))]
            blocks.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            lines += items
        elif kind == 2:
            a, b = sentence(12), sentence(9)
            blocks.append(f'<p>{a} <a href="#">note</a> {b}</p>')
            lines.append(f"{a} note {b}")
        else:
            lines.append(sentence(2 if kind == 0 else 20 if kind == 3 else r.randrange(25, 80)))
            blocks.append(f"<blockquote>{lines[-1]}</blockquote>" if kind == 3 else f"<p>{lines[-1]}</p>")
    page = "<div>" + "".join(blocks) + "</div>"
    for depth in range(r.randrange(3) + 1):
        around = [r.choice(side)() for _ in range(r.randrange(0 if depth else 1, 4))]
        around.insert(r.randrange(len(around) + 1), page)
        page = "<div>" + "".join(around) + "</div>"
    return f"<html><body>{page}</body></html>", "\n".join(lines)


def test_html_density_finds_the_article(monkeypatch):
    pages = [labelled_page(random.Random(k)) for k in range(200)]
    assert [k for k, (page, text) in enumerate(pages) if html_extract.main_text(page) != text] == []
    monkeypatch.setattr(html_extract, "composite_density", lambda *amounts: 1.0)
    assert sum(html_extract.main_text(page) != text for page, text in pages) > 150


SIDE_NAMES = ["user-comments", "post-comments", "readerReplies", "ad-box", "content_ad", "promo-block", "share-buttons", "newsletter-signup-form", "related-posts", "site-cookie-bar"]


def labelled_article(r):
    """A labelled page inside an article or main element, with prose of readers and advertisers and rows of links inside the same element, none named by one word alone."""
    page, text = labelled_page(r)
    page = page[len("<html><body>") : -len("</body></html>")]
    prose = lambda: " ".join("".join(r.choice("qrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 120)))
    row = "".join(f'<a href="/{k}">link {k}</a> ' for k in range(r.randrange(3, 9)))
    sides = [f'<{tag} {r.choice(("class", "id"))}="{r.choice(SIDE_NAMES)}"><p>{prose()}</p><p>{prose()}</p></{tag}>' for tag in ("div", "section")] + [f"<div>{row}</div>"]
    r.shuffle(sides)
    tag = r.choice(("article", "main"))
    before, after = (sides[:1], sides[1:]) if r.random() < 0.3 else ([], sides)
    return f'<html><body><ul><li><a href="/">home</a><li><a href="/x">x</a></ul><{tag}>{"".join(before)}{page}{"".join(after)}</{tag}></body></html>', text


def test_html_density_inside_the_article(monkeypatch):
    pages = [labelled_article(random.Random(k)) for k in range(200)]
    wrong = [k for k, (page, text) in enumerate(pages) if html_extract.main_text(page) != text]
    assert wrong == []
    monkeypatch.setattr(html_extract, "composite_density", lambda *amounts: 1.0)
    assert sum(html_extract.main_text(page) != text for page, text in pages) > 150


def test_html_names_are_evidence_only():
    text, other = "<p>" + "Long prose of the article here. " * 12 + "</p><p>" + "More prose in it. " * 12 + "</p>", "<p>" + "I think that this is prose, too. " * 9 + "</p>"
    want = html_extract.main_text(f"<main>{text}</main>")
    for name in SIDE_NAMES:
        for tag, around in itertools.product(("div", "section", "ul"), ("article", "main", "div")):
            assert html_extract.main_text(f'<body><{around}>{text}<{tag} class="x {name}">{other}</{tag}></{around}></body>') == want
        assert html_extract.main_text(f'<body><div id="{name}">{text}</div></body>') == want  # the lead itself stays, whatever its name
        assert html_extract.main_text(f'<body><main class="{name}">{text}</main><div>{other.replace("<p>", "<p><a>").replace("</p>", "</a></p>")}</div></body>') == want


def test_html_density_values():
    assert html_extract.composite_density(100, 4, 20, 1, 0.3) == pytest.approx(53.492, abs=1e-2)  # 25 ln 20 / ln ln(25 + 30 + e)
    assert html_extract.composite_density(5, 1, 5, 1, 0.3) == 0 == html_extract.composite_density(0, 3, 0, 0, 0.3)
    assert html_extract.composite_density(80, 0, 0, 0, 0.0) > html_extract.composite_density(80, 4, 0, 0, 0.0) > html_extract.composite_density(80, 4, 60, 3, 0.5)


def test_html_deep_and_long_pages_in_linear_time():
    import time

    start = time.perf_counter()
    deep = "<div>" * 20_000 + "<span>" * 20_000 + "<p>deep</b></i></p>" * 200
    assert html_extract.main_text(deep) == "\n".join(["deep"] * 200)
    long = "<body>" + "<p>some words here</p></em>" * 20_000
    assert html_extract.main_text(long).count("\n") == 19_999
    assert time.perf_counter() - start < 20


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 3), (1, "u", "<p>a</p>", 3), (None, None, None, 3)], "page_id long, url string, html string, text int")
    assert pairs(html_extract.extract_pages(pages), "page_id", "url", "text", "n_chars") == expect([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)])
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_lattice_links(spark):
    small_batches(spark)
    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 16))
    near = [(c + 0.12 * r.standard_normal(16)).tolist() for c in centres for _ in range(4)]
    table = [(i, v, i % 2 if i % 9 else None) for i, v in enumerate(near)]
    table += [
        (500, near[1], 1), (501, near[1], 1), (501, near[1], 1), (502, None, 1), (503, [0.0] * 16, 1), (504, [float("nan")] * 16, 1), (505, [], 1),
        (506, [1.0, 2.0], 1), (507, [None] * 16, 1), (None, near[1], 1)
    ]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("cell", F.lit(2))
    sound = [(n, i, np.array(v), l) for n, (i, v, l) in enumerate(table) if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]  # noqa: E741
    linked = [
        (a, b)
        for a in sound for b in sound if a[0] != b[0] and a[3] == b[3] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.93
    ]
    label = least_reachable({s[1] for s in sound}, [(a[1], b[1]) for a, b in linked])
    want = {n: (i, sum(a[0] == n for a, _ in linked), label.get(i, i)) for n, (i, *_) in enumerate(table)}
    got = lattice.lattice_links(df)
    assert pairs(got, "vec_id", "n_links", "component_id") == expect(want.values())
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got.collect())
    assert lattice.lattice_links(df.limit(0)).count() == 0


def test_lattice_recall_at_64_dimensions(spark):
    """Independent pairs at the threshold and a little above, among random vectors, with production parameters."""
    small_batches(spark)
    r = np.random.default_rng(8)
    table, cosines = [], {}
    for k in range(3000):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        cosine = (0.9302, 0.94, 0.96)[k % 3]
        cosines[2 * k] = cosine
        table += [(2 * k, a.tolist(), k % 5), (2 * k + 1, (cosine * a + (1 - cosine**2) ** 0.5 * b / np.linalg.norm(b)).tolist(), k % 5)]
    got = {x.vec_id: x for x in lattice.lattice_links(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(table) and all(x.component_id in (i, i - i % 2) for i, x in got.items())
    found = {c: np.mean([got[i].n_links == 1 == got[i + 1].n_links for i, x in cosines.items() if x == c]) for c in set(cosines.values())}
    assert found[0.9302] >= 0.9 and found[0.94] >= 0.93 and found[0.96] >= 0.99


def test_lattice_crowded_cells(spark, monkeypatch):
    """A cluster in which all are near, over many chunks and batches, with names of columns that the operator uses."""
    small_batches(spark)
    monkeypatch.setattr(lattice, "CHUNK", 16)
    monkeypatch.setattr(lattice, "ROWS", 64)
    r = np.random.default_rng(4)
    centre = r.standard_normal(64)
    near = [centre + 0.12 * r.standard_normal(64) for _ in range(150)] + [r.standard_normal(64) for _ in range(50)]
    names = ("n", "chunk", "chunks", "label_", "digest", "own", "low", "high", "root", "links", "ok", "p", "copies", "dims", "n_links", "component_id")
    df = spark.createDataFrame(
        [(i, v.tolist(), 3) for i, v in enumerate(near)], "vec_id long, embedding array<double>, label int"
    ).select("*", *(F.lit("x").alias(c) for c in names))
    unit = np.array(near) / np.linalg.norm(near, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= 0.93, 1)
    assert linked.sum() > 5000
    degree = linked.sum(0) + linked.sum(1)
    got = {x.vec_id: x.n_links for x in lattice.lattice_links(df).collect()}
    assert sum(got.values()) >= 0.99 * degree.sum() and all(got[i] <= degree[i] for i in got)


def test_lattice_points_are_nearest():
    x = np.random.default_rng(2).standard_normal((300, 8)) * 2
    found = lattice.nearest_e8(x) / 2
    assert (np.abs(found.sum(1) % 2) < 1e-9).all()
    near = ((x - found) ** 2).sum(1)
    for v in lattice.least_vectors() / 2:
        assert (((x - found - v) ** 2).sum(1) >= near - 1e-9).all()


def test_toxicity_chain(spark):
    small_batches(spark)
    r = random.Random(3)
    clean = lambda: " ".join(r.choice("the of and word other text plain time house tree".split()) for _ in range(30))
    texts = [
        (i, clean() + (" grumbash" + r.choice(["", "en", "ung", "heit"]) if i % 5 == 0 else ""), i)
        for i in range(400)
    ] + [(900, None, 0), (901, "", 0), (None, "grumbashig " + clean(), 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, p int")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(5000, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert chain.held_out["toxic"] > 0.98 and len(chain.models[1].dense) == 1 and len(chain.models[2].dense) == 2
    kept = {r.doc_id for r in toxicity.without_toxic(docs, chain).collect()}
    assert kept == {i for i in range(400) if i % 5} | {900, 901}
    assert toxicity.without_toxic(docs, chain).columns == docs.columns
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.without_toxic(docs, none).count() == len(texts)
    assert toxicity.without_toxic(docs.limit(0), chain).count() == 0


def test_toxicity_fits_at_most_the_sample(spark, monkeypatch):
    assert toxicity.SAMPLE_ROWS == 12_000 and toxicity.BUCKETS == 1 << 22
    fitted = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda held, flags, names: fitted.extend(held) or toxicity.Chain(names))
    texts = spark.createDataFrame([(i % 10, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    toxicity.train(texts, labels, sample_rows=7)
    assert len(fitted) == 7
