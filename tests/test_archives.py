"""Archives: damage becomes rows, nothing unsafe is inflated, ranges of members are read in bounded memory."""

import hashlib
import io
import resource
import struct
import zipfile

import pytest

from quarrystone.operators.ordered import running_totals
from quarrystone.sources import archives


def packed(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name) if isinstance(name, str) else name, body)
    return out.getvalue()


def spoiled(raw, at, value):
    return raw[:at] + value + raw[at + len(value) :]


def link(name):
    info = zipfile.ZipInfo(name)
    info.external_attr = 0o120777 << 16
    return info


@pytest.fixture(scope="module")
def containers(spark):
    good = packed([("a/one.txt", b"1"), ("a/", b""), ("../up", b"x"), ("C:\\x", b"x"), (link("l"), b"a"), ("a/one.txt", b"again")])
    plain = packed([("first", b"data " * 100), ("second", b"more " * 100)], zipfile.ZIP_STORED)
    entry = plain.rfind(b"PK\x01\x02")
    first = plain.find(b"PK\x01\x02")
    rows = {
        "good": good, "empty": packed([]), "none": None, "text": b"no archive at all", "cut": plain[: len(plain) // 2],
        "flipped": spoiled(plain, plain.index(b"data "), b"Data "),  # the checksum does not hold
        "method": spoiled(spoiled(plain, 8, struct.pack("<H", 97)), first + 10, struct.pack("<H", 97)),  # a method that nobody knows
        "locked": spoiled(spoiled(plain, 6, b"\x01"), first + 8, b"\x01"),
        "local": spoiled(plain, 0, b"XX"),  # the member's own header is gone
        "huge": spoiled(plain, entry + 24, struct.pack("<I", 3 << 30)),
        "lies": spoiled(plain, entry + 24, struct.pack("<I", 490)),  # inflates to more than it says
        "short": spoiled(spoiled(plain, entry + 24, struct.pack("<I", 600)), entry + 20, struct.pack("<I", 600)),
        "directory": spoiled(plain, first, b"XX"),
    }
    return spark.createDataFrame(list(rows.items()), "path string, content binary").repartition(3)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_damage_becomes_rows(containers):
    found = archives.expanded(archives.judged(archives.listed(containers)), containers)
    got = {}
    for r in found.collect():
        got.setdefault(r.path, []).append((r.member_index, r.error, r.sha256))
    first, second = sha(b"data " * 100), sha(b"more " * 100)
    whole, damaged = [(None, "ARCHIVE_DAMAGED", None)], "ARCHIVE_MEMBER_DAMAGED"
    unsafe = "ARCHIVE_MEMBER_UNSAFE_PATH"
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        "good": [(0, None, sha(b"1")), (1, None, None), (2, unsafe, None), (3, unsafe, None), (4, "ARCHIVE_MEMBER_SYMLINK", None), (5, None, sha(b"again"))],
        "none": whole, "text": whole, "cut": whole, "directory": whole,
        "flipped": [(0, damaged, None), (1, None, second)], "method": [(0, "ARCHIVE_MEMBER_UNSUPPORTED", None), (1, None, second)],
        "locked": [(0, "ARCHIVE_MEMBER_ENCRYPTED", None), (1, None, second)], "local": [(0, damaged, None), (1, None, second)],
        "huge": [(0, None, first), (1, "ARCHIVE_MEMBER_TOO_LARGE", None)], "lies": [(0, None, first), (1, damaged, None)], "short": [(0, None, first), (1, damaged, None)],
    }


def test_what_is_forbidden_is_not_inflated(containers, monkeypatch):
    """A budget of no members leaves nothing to read; the judge works on the list alone."""
    none = archives.expanded(archives.judged(archives.listed(containers), most_members=0), containers)
    assert none.filter("sha256 IS NOT NULL").count() == 0 and none.filter("error IS NULL").count() == 0


def test_a_bomb_stays_within_bounds():
    raw = packed([("bomb", b"\0" * (40 << 20))])
    at = raw.rfind(b"PK\x01\x02")
    lying = zipfile.ZipFile(io.BytesIO(spoiled(raw, at + 24, struct.pack("<I", 1000))))
    assert archives.inflated(lying, 0, True) == (None, "ARCHIVE_MEMBER_DAMAGED", None)
    assert archives.inflated(zipfile.ZipFile(io.BytesIO(raw)), 0, False, most=1 << 20)[1] == "ARCHIVE_MEMBER_DAMAGED"
    assert archives.inflated(zipfile.ZipFile(io.BytesIO(raw)), 0, False)[0] == sha(b"\0" * (40 << 20))


def test_large_files_at_flat_memory(tmp_path):
    """Members of 300 MB in a container on disk: listed and hashed without ever being held."""
    piece = bytes(range(256)) * 4096
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name in ("a", "b"):
            with z.open(name, "w") as stream:
                for _ in range(300):
                    stream.write(piece)
    path = f"file://{tmp_path}/big.zip"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert [r[2:5:2] for r in archives.directory(path, archives.opened(path))] == [("a", 300 << 20), ("b", 300 << 20)]
    archive = zipfile.ZipFile(archives.opened(path))
    digest = hashlib.sha256()
    for _ in range(300):
        digest.update(piece)
    assert archives.inflated(archive, 1, True) == (digest.hexdigest(), None, None)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10


def test_the_data_source_reads_ranges(spark, tmp_path, monkeypatch):
    for k in range(5):
        archives.store(f"file://{tmp_path}/deep/{k}/c{k}.zip", packed([(f"m{i:03}", f"{k} {i}".encode()) for i in range(40)]))
    archives.store(f"file://{tmp_path}/bad.zip", b"PK no")
    listed = archives.zip_files(spark, f"file://{tmp_path}", containers=2)
    assert listed.rdd.getNumPartitions() == 3 and listed.filter("damage IS NOT NULL").count() == 1
    monkeypatch.setattr(archives, "RANGE_BYTES", 10 * archives.MEMBER_COST)
    got = archives.expanded(archives.judged(listed), with_content=True).filter("member_index IS NOT NULL").collect()
    assert {(r.path.rsplit("/", 1)[1], r.member_path, r.content) for r in got} == {(f"c{k}.zip", f"m{i:03}", f"{k} {i}".encode()) for k in range(5) for i in range(40)}
    assert all(r.sha256 == sha(r.content) and r.error is None for r in got)


def test_nested_archives_with_damage(spark):
    inner = packed([("x.txt", b"deep")])
    damaged = spoiled(inner, 30 + len("x.txt"), b"\xff\xff")
    outer = spark.createDataFrame([("o.zip", packed([("in.zip", inner), ("broken.zip", inner[:20]), ("odd.zip", damaged), ("t.txt", b"t")]))], "path string, content binary")
    got = {(r.path, r.member_path): (r.depth, r.error) for r in archives.tree(outer).collect()}
    assert got["o.zip!in.zip", "x.txt"] == (2, None) and got["o.zip!broken.zip", None] == (2, "ARCHIVE_DAMAGED")
    assert got["o.zip!odd.zip", "x.txt"][1] == "ARCHIVE_MEMBER_DAMAGED" and got["o.zip", "t.txt"] == (1, None)
    spent = {r.path: r.error for r in archives.tree(outer, most_members=4).collect() if r.depth == 2}
    assert spent == {"o.zip!in.zip": "ARCHIVE_BUDGET_MEMBERS", "o.zip!broken.zip": "ARCHIVE_DAMAGED", "o.zip!odd.zip": "ARCHIVE_BUDGET_MEMBERS"}


def test_running_totals(spark):
    rows = [(f"p{(i * 7919) % 1000:04}", i % 13) for i in range(1000)]
    df = spark.createDataFrame(rows, "path string, n long").repartition(7)
    total, want = 0, {}
    for path, n in sorted(rows):
        want[path] = total
        total += n
    found = running_totals(df, ["path"], {"before": "n", "rank": "1"})
    assert {r.path: (r.before, r.rank) for r in found.collect()} == {p: (w, k) for k, (p, w) in enumerate(sorted(want.items()))}
    assert running_totals(df.limit(0), ["path"], {"before": "n"}).count() == 0
