import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.functions.classify import number
from quarrystone.functions.timeparse import normalised_time
from quarrystone.operators import walk
from quarrystone.operators.gates import GateError, enforce, expected_counts, gate, report
from quarrystone.operators.mail import checked_parents, cycle_members, without_cycles
from quarrystone.operators.search import page
from quarrystone.sources import archives, files, sinks
from tests.conftest import SMALL
from quarrystone.streaming import paths


def test_times(spark):
    cases = {
        "2024-03-01T08:00:00Z": (1709280000000000, "absolute", "iso_with_offset", "second"),
        "2024-03-01T08:00:00.25+08:00": (1709251200250000, "absolute", "iso_with_offset", "fractional_second"),
        "1709280000": (1709280000000000, "absolute", "epoch_seconds", "second"),
        "1709280000123": (1709280000123000, "absolute", "epoch_milliseconds", "millisecond"),
        "1709280000123456789": (1709280000123456, "absolute", "epoch_nanoseconds", "nanosecond"),
        "946684799": (None, "unparsed", "unknown", "unknown"),
        "2024/3/1": (None, "local_unzoned", "local_datetime", "day"),
        "2024-13-01": (None, "unparsed", "unknown", "day"),
        "2026": (None, "unparsed", "unknown", "unknown"),
        "12:00:00": (None, "unparsed", "unknown", "second"),
        "": (None, "unparsed", "unknown", "unknown"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", normalised_time(F.col("raw")).alias("t"))
    for r in df.collect():
        assert (r.t.sort_key, r.t.status, r.t.basis, r.t.precision) == cases[r.raw], r.raw


def test_sibling_zone_is_used_only_if_it_is_an_offset(spark):
    df = spark.createDataFrame([("+02:00",), ("Europe/Berlin",), ("+15:00",), (None,)], "zone string")
    got = [r.s for r in df.select(normalised_time(F.lit("2024-03-01 08:00:00"), F.col("zone"))["status"].alias("s")).collect()]
    assert got == ["absolute", "local_unzoned", "local_unzoned", "local_unzoned"]


def test_numbers(spark):
    df = spark.createDataFrame([("(1,234.50)",), ("USD 12",), ("-",), (None,), ("3 000",)], "t string")
    assert [r.n for r in df.select(number(F.col("t")).alias("n")).collect()] == [-1234.5, 12.0, None, None, 3000.0]


RECORD = {
    "company_id": "77",
    "create_time": "2024-01-02T03:04:05Z",
    "contacts": [{"contact_id": "5", "created_at": "2024-01-02T03:04:05+08:00"}],
    "orders": [{"order_id": "9", "company_id": "77", "order_time": 1709280000123, "products": [{"product_id": "p1", "created_at": "2024-01-02 03:04"}]}],
    "mails": [
        {"mail_id": "m1", "root_mail_id": "m0", "reply_mail_id": "m0", "source_mail_id": "m3", "folder_id": "f", "sender": "A@b.co", "receiver": "c@d.org, e@f.net", "attachment_list": [{"attachment_id": "a1"}], "trade_document_list": [{"document_id": "d1"}]}
    ],
}


def test_walk_finds_records_relations_and_events(spark):
    rows = [("record.json", 1, json.dumps(RECORD)), ("bad.jsonl", 3, "{"), ("bad.jsonl", 4, "5"), ("empty", 1, None)]
    found = walk.findings(spark.createDataFrame(rows, "source_rel string, line long, json string")).cache()
    predicates = {r.predicate for r in walk.relations(found).collect()}
    assert {
        "company_has_contact", "company_has_order", "order_has_product", "mail_has_sender", "mail_has_recipient", "mail_has_thread_root", "mail_replies_to",
        "mail_source_to_derived", "mail_in_folder", "mail_has_document", "mail_lists_attachment", "record_contains_record"
    } <= predicates
    records = walk.records(found).collect()
    assert {r.status for r in records} == {"parsed_json_object", "parsed_json_array", "invalid_json", "parsed_json_scalar"}
    assert [r.record_type for r in records if r.pointer == "/orders/0/products/0"] == ["product"]
    top = next(r for r in records if r.pointer == "" and r.source_rel == "record.json")
    assert top.sha256 == walk.sha(walk.canonical_json(RECORD)) and top.primary_entity_node_id == walk.node("company", "77")
    assert {(r.event_kind, r.raw_type) for r in walk.events(found).collect()} == {("create_time", "string"), ("created_at", "string"), ("order_time", "number")}
    assert all(r.subject != r.object for r in walk.relations(found).collect())
    found.unpersist()


def test_parents_and_cycles(spark):
    rows = [(1, "a", "c", "1"), (1, "b", "a", "1"), (1, "c", "b", "1"), (1, "d", "d", "1"), (1, "e", "gone", "1"), (2, "f", "g", "1"), (2, "g", None, "2")]
    checked = checked_parents(spark.createDataFrame(rows, "thread long, mail_id string, parent_id string, local_key string"))
    assert {r.mail_id: r.parent_status for r in checked.collect()} == {
        "a": "valid", "b": "valid", "c": "valid", "d": "self", "e": "missing", "f": "later", "g": "none"
    }
    assert {r.mail_id for r in cycle_members(checked, 3).collect()} == {"a", "b", "c"}
    assert {r.mail_id for r in without_cycles(checked, "thread", 3).filter("broken").collect()} == {"c"}


def test_long_chains_and_several_cycles(spark):
    chain = [(1, f"m{k:03}", f"m{k - 1:03}" if k else None, "1") for k in range(100)]
    rings = [(1, f"{name}{k:02}", f"{name}{(k + 1) % n:02}", "1") for name, n in (("p", 2), ("q", 37)) for k in range(n)]
    checked = checked_parents(spark.createDataFrame(chain + rings + [(1, "r", "q05", "1")], "thread long, mail_id string, parent_id string, local_key string"))
    found = {r.mail_id: r.cycle for r in cycle_members(checked, 3).collect()}
    assert found == {m: m[0] + "00" for _, m, _, _ in rings}
    assert {r.mail_id for r in without_cycles(checked, "thread", 3).filter("broken").collect()} == {"p01", "q36"}


def test_gates_fail_closed(spark):
    ok, bad = gate("A", spark.range(0)), gate("B", spark.range(3))
    enforce(report(ok))
    with pytest.raises(GateError, match="B=3"):
        enforce(report(ok, bad))
    with pytest.raises(GateError, match="EXPECTED_COUNT_INVALID"):
        expected_counts({"x": True}, {"x": spark.range(1)})
    with pytest.raises(GateError, match="EXPECTED_COUNT_MISSING"):
        expected_counts({}, {"x": spark.range(1)})
    assert expected_counts({"x": 2}, {"x": spark.range(1)}).first().status == "FAIL"


def test_pages_are_bounded(spark):
    with pytest.raises(GateError):
        page(spark.range(3), [F.col("id")], 1, 101)
    got = page(spark.range(60), [F.col("id")], 3, 25).collect()
    assert [r.id for r in got] == list(range(50, 60)) and {(r.total, r.pages) for r in got} == {(60, 3)}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "a/y.txt").write_text("hello")
    (tmp_path / "a/z.part").write_text("no")
    with zipfile.ZipFile(tmp_path / "a/b.zip", "w") as z:
        z.writestr("in/one.txt", "1")
        z.writestr("../up.txt", "2")
    (tmp_path / "a/w.docx").write_bytes(b"PK\x03\x04broken")
    found = files.identified(files.inventory(spark, str(tmp_path / "a")))
    assert {r.rel: (r.magic, r.category) for r in found.collect()} == {
        "x.png": ("png", "image"), "y.txt": ("text", "text"), "b.zip": ("zip", "archive"), "w.docx": ("bad-zip", "other")
    }
    zips = files.inventory(spark, str(tmp_path / "a")).filter("extension = '.zip'")
    members = archives.expanded(archives.judged(archives.listed(zips)), zips, with_content=True)
    judged = {r.member_path: (r.error, r.content) for r in members.collect()}
    assert judged == {"in/one.txt": (None, b"1"), "../up.txt": ("ARCHIVE_MEMBER_UNSAFE_PATH", None)}
    cut = files.within_budget(archives.listed(zips), most_bytes=1)
    assert sorted(r.budget_error or "" for r in cut.collect()) == ["", "ARCHIVE_BUDGET_BYTES"]


def test_jsonl_counts_blank_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{bad\n7\n')
    got = {r.line: r.status for r in files.jsonl_lines(spark, str(tmp_path)).collect()}
    assert got == {1: "parsed", 3: "invalid_jsonl_line", 4: "parsed_json_scalar"}
    assert files.ledger(spark, str(tmp_path), "a int").count() == 1


def test_csv_and_sqlite(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿k,v\n1,a\n", encoding="utf-8")
    assert files.csv_required(spark, str(tmp_path / "t.csv"), ["k", "v"], "CSV").first().v == "a"
    with pytest.raises(GateError, match="CSV: missing w"):
        files.csv_required(spark, str(tmp_path / "t.csv"), ["w"], "CSV")
    with sqlite3.connect(tmp_path / "d.db") as c:
        c.execute("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"v{i}", i / 2) for i in range(10)])
    df = files.sqlite_table(spark, str(tmp_path / "d.db"), "t", parts=3)
    assert df.agg(F.sum("a"), F.sum("c"), F.max("b")).first() == (45, 22.5, "v9")


def _graph(spark):
    nodes = spark.createDataFrame([("a:1", "a", "x<\x01"), ("b:2", "b", "y")], "node_id string, node_type string, value string")
    edges = spark.createDataFrame([("a:1", "r", "b:2")], "from_id string, relation string, to_id string")
    return nodes, edges


def test_publish_is_all_or_nothing(spark, tmp_path):
    nodes, edges = _graph(spark)
    target = str(tmp_path / "package")
    with pytest.raises(GateError):
        sinks.publish(spark, {"nodes": nodes}, [gate("G", spark.range(1))], target)
    assert not list(tmp_path.iterdir())
    assert sinks.publish(spark, {"nodes": nodes, "edges": edges}, [gate("G", spark.range(0))], target, (nodes, edges)) == {"nodes": 2, "edges": 1}
    sinks.verify_checksums(tmp_path / "package")
    with pytest.raises(GateError, match="TARGET_EXISTS"):
        sinks.publish(spark, {"nodes": nodes}, [gate("G", spark.range(0))], target)
    (tmp_path / "package/graph.graphml.gz").write_bytes(b"x")
    with pytest.raises(GateError, match="CHECKSUM_MISMATCH"):
        sinks.verify_checksums(tmp_path / "package")


def test_graphml_is_the_same_every_time(spark, tmp_path):
    for name in ("one", "two"):
        sinks.write_graphml(*_graph(spark), str(tmp_path / name))
    assert (tmp_path / "one").read_bytes() == (tmp_path / "two").read_bytes()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"k": "a", "n": 1, "ts": "2024-01-01T00:10:00Z"}\n{"k": "a", "n": 2, "ts": "2024-01-01T00:20:00Z"}\n{"k": "b", "n": 3, "ts": "2024-01-01T03:00:00Z"}\n')
    stream = lambda: paths.ledger_stream(spark, str(source), "k string, n long, ts timestamp")
    for name, df, mode in (
        ("seen", paths.first_seen(stream(), "k"), "append"), ("latest", paths.latest_by_key(stream(), "k", "n"), "complete"),
        ("windows", paths.business_windows(stream()), "append")
    ):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("seen").count() == 2
    assert {(r.k, r.n) for r in spark.table("latest").collect()} == {("a", 2), ("b", 3)}
    assert [r.events for r in spark.table("windows").collect()] == [2]


def test_repair_stream_keeps_resolved_entries(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "entry long, severity int, recorded long, attempts long, resolved_at long"
    read = lambda: paths.ledger_stream(spark, str(source), schema, 1)
    (source / "1.json").write_text('{"entry": 1, "severity": 1, "recorded": 5, "attempts": 1}\n{"entry": 2, "severity": 0, "recorded": 5, "attempts": 1, "resolved_at": 9}\n')
    paths.repair_queue(read(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    (source / "2.json").write_text('{"entry": 1, "severity": 2, "recorded": 7, "attempts": 3}\n{"entry": 2, "severity": 0, "recorded": 8, "attempts": 1}\n')
    paths.repair_queue(read(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.entry: (r.severity, r.attempts, r.status, r.change) for r in spark.read.parquet(str(tmp_path / "state/version=1")).collect()}
    assert got == {1: (2, 3, "open", "updated"), 2: (0, 1, "resolved", "unchanged")}


def test_split_records_lose_nothing():
    import json
    import random

    from quarrystone.operators.corpus import compact, largest_list, split_record

    r = random.Random(12)

    def value(depth):
        kind = r.randrange(5 if depth else 2)
        if kind == 0:
            return "é" * r.randrange(30)
        if kind == 1:
            return r.randrange(10**6)
        if kind == 2:
            return [value(depth - 1) for _ in range(r.randrange(12))]
        return {f"k{i}": value(depth - 1) for i in range(r.randrange(5))}

    for _ in range(300):
        record = {"a": value(3), "b": value(2), "list": [value(2) for _ in range(r.randrange(30))]}
        most = r.choice((80, 300, 2000))
        parts = split_record(record, most)
        assert all(len(body) <= most for *_, body in parts)
        if len(parts) == 1:
            assert json.loads(parts[0][3]) == record
            continue
        # text pieces of one run come first together, then runs of the list follow each other
        runs: dict[int, str] = {}
        for _, _, first, body in parts:
            runs[first] = runs.get(first, "") + body if parts[0][1] else runs.get(0, "") + body
        if not parts[0][1]:
            assert "".join(body for *_, body in parts) == compact(record)
            continue
        path, items = largest_list(record)
        found = []
        for first in sorted(runs):
            at = json.loads(runs[first])
            for step in path:
                at = at[step]
            assert first == len(found)
            found += at
        assert found == items


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    from quarrystone.sources import files

    lines = ["﻿{\"k\": 0}", *('{"k": %d}' % i if i % 7 else "" for i in range(1, 3000)), "{bad", "12"]
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("\r\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = files.jsonl_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((n + 1, text.lstrip("﻿")) for n, text in enumerate(lines) if text)
    for name in ("a.jsonl", "b.jsonl"):
        assert sorted((r.line, r.json) for r in found if r.source_rel.endswith(name)) == want
    assert {r.status for r in found if r.line == 3001} == {"invalid_jsonl_line"} and {r.status for r in found if r.line == 3002} == {"parsed_json_scalar"}


def test_boolean_queries_against_sets(spark):
    import random

    import pytest

    from quarrystone.operators import search
    from quarrystone.operators.gates import GateError

    r = random.Random(2)
    words = ["été", "ÉTÉ", "roi", "king", "queen", "x1", "of", "the"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(9)))) for i in range(60)] + [(60, None), (61, "")]
    index = search.word_index(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    fold = {i: (t or "").lower().replace("é", "e").split() for i, t in texts}
    has = lambda *p: {i for i, w in fold.items() if any(w[k : k + len(p)] == list(p) for k in range(len(w)))}
    cases = {
        "Ete": has("ete"), '"of the"': has("of", "the"), "king queen": has("king") & has("queen"), "king OR queen AND roi": has("king") | has("queen") & has("roi"),
        "(king OR queen) AND roi": (has("king") | has("queen")) & has("roi"), "king NOT queen": has("king") - has("queen"), 'roi NOT ("the king" OR x1)': has("roi") - (has("the", "king") | has("x1")),
        "nothing-here OR of": has("nothing", "here") | has("of"),
    }
    for query, want in cases.items():
        assert {x.id for x in search.boolean_hits(index, "id", query).collect()} == want, query
    for wrong in ("", "AND king", "king AND", "(king", "king)", "NOT", '""', "x" * 600):
        with pytest.raises(GateError):
            search.parsed_query(wrong)


def test_every_planted_fault_breaks_its_gate(spark):
    from quarrystone.plans.catalogue import QUERIES

    whole = {x.gate_id: x.status for x in QUERIES["pkg_gates"](spark, SMALL).collect()}
    assert set(whole.values()) == {"PASS"} and len(whole) >= 35
    broken = {x.gate_id for x in QUERIES["pkg_gates_broken"](spark, SMALL).collect() if x.status == "FAIL"}
    assert broken >= {
        "RELATION_EVIDENCE_COUNT_MISMATCH", "PROVENANCE_RECORD_MISMATCH", "ATTACHMENT_OCCURRENCE_ARTIFACT_MISMATCH", "ARTIFACT_RECORD_COVERAGE_MISMATCH", "RECORD_PARENT_MISSING",
        "EVIDENCE_EVENT_MISSING", "TIMELINE_SEQUENCE_NOT_CONTIGUOUS", "SOURCE_GAP_PRETENDED_DERIVED", "SOURCE_DERIVED_RELATION_MISMATCH", "TRADE_UNBOUND_FLAG_INVALID", "NODE_DUPLICATE", "UNREFERENCED_NODE_PRESENT",
    }


def test_natural_keys_and_safe_paths(spark):
    from pyspark.sql import functions as F

    from quarrystone.functions.text import resolved_inside, safe_relative
    from quarrystone.operators.capture import natural_key

    names = ["a2", "a10", "a010", "a1", "b", "", "10", "9", "9a", "a1b20", "a1b3"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.n for x in df.orderBy(natural_key(F.col("n")), "n").collect()] == ["", "9", "9a", "10", "a1", "a1b3", "a1b20", "a2", "a010", "a10", "b"]
    paths = {"a/b": "a/b", "a\\b": "a/b", "../a": None, "a/../b": None, "/a": None, "c:/a": None, "./a//b/.": "a/b", "": None, ".": None, "a..b": "a..b"}
    got = {x.p: x.s for x in spark.createDataFrame([(p,) for p in paths], "p string").select("p", safe_relative(F.col("p")).alias("s")).collect()}
    assert got == paths
    inside = {"/case/a": "/case/a", "a": "/case/a", "/cases/a": None, "/case/../a": None, "/case": None}
    got = {x.p: x.s for x in spark.createDataFrame([(p,) for p in inside], "p string").select("p", resolved_inside("/case", F.col("p")).alias("s")).collect()}
    assert got == inside
