"""Representative sentences against the plain rule, and snapshots that rewrite changed buckets only."""

import collections
import random
import re

import pytest

from quarrystone.operators import sentences
from quarrystone.operators.gates import GateError
from quarrystone.operators.snapshot_store import SnapshotStore


def plain(text):
    line = re.sub(r"[\t\n\r ]+", " ", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text or "")).strip(" ")
    found = [p.strip(sentences.EDGES) for p in re.split(sentences.SENTENCE_END, line) if len(p.strip(" ")) >= 6]
    if not found:
        return line[:160], None
    tokens = lambda s: re.findall("[a-z0-9][a-z0-9_-]+|[一-鿿]", s.lower())
    often = collections.Counter(t for s in found for t in tokens(s))
    weight = lambda s: sum(often[t] for t in tokens(s) if t not in sentences.STOP_WORDS) / max(1, len(tokens(s)))
    best = max(found, key=lambda s: (weight(s), min(len(s), 180)))
    return best[:180], pytest.approx(weight(best))


def test_representative_sentences(spark):
    r = random.Random(2)
    words = "price order the and delivery x1 a_b-c you 价 格 的 了 交货 Order PRICE é".split()
    texts = [" ".join(r.choice(words) + r.choice(["", "", ".", "!", "。", ", ", "\n", ";"]) for _ in range(r.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", "short", "...", "!?!", " ; , . : ", "\x00\x07long enough words here", "same words. same words. same words", "x" * 400 + ". " + "y" * 400, "  ,edges of it;  . more", "éé éé éé. ??"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.sentence, x.weight) for x in sentences.representative(df, "doc_id", "text").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sentences.representative(df.limit(0), "doc_id", "text").count() == 0


def test_syncs_touch_changed_buckets_only(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    new = lambda: SnapshotStore(spark, folder, "id", "long", {"v": "string", "n": "int"}, buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string, n int")
    store = new()
    rows = {k: (f"v{k}", k % 3 if k % 5 else None) for k in range(200)}
    now = lambda: frame([(k, *v) for k, v in rows.items()] + [(None, "x", 1)])
    assert store.rows().count() == 0 and store.sync(now()).count() == 200 and len(store.files) == 8
    before, early = dict(store.files), new()
    assert store.sync(now()).count() == 0 and store.version == 1 and store.files == before  # nothing changed, nothing written
    gone = rows.pop(7)
    rows[11] = ("other", 1)
    changes = {x.id: (x.change, x.active, x.v) for x in store.sync(now()).collect()}
    assert changes == {7: ("deactivated", 0, "v7"), 11: ("updated", 1, "other")}
    moved = {b for b in range(8) if store.files[b] != before[b]}
    assert 1 <= len(moved) <= 2 and all(store.files[b] == before[b] for b in set(range(8)) - moved)
    want = sorted([(k, *v, 1) for k, v in rows.items()] + [(7, *gone, 0)], key=str)
    assert sorted((tuple(x) for x in store.rows().collect()), key=str) == want == sorted((tuple(x) for x in new().rows().collect()), key=str)
    assert early.rows().filter("active = 1").count() == 200  # a reader of the older version
    rows[7] = gone
    assert [(x.id, x.change) for x in store.sync(now()).collect()] == [(7, "reactivated")]
    with pytest.raises(GateError, match="SNAPSHOT_CHANGED_MEANWHILE"):
        early.refresh = lambda: None
        early.sync(frame([(1, "z", 1)]))
    with pytest.raises(GateError, match="SNAPSHOT_LAYOUT_DIFFERS"):
        SnapshotStore(spark, folder, "id", "long", {"v": "string", "n": "int"}, buckets=16)
