"""Tests of what the reviewer of round 3 found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.plans import capture_queries


def tables(spark, folder, **rows) -> str:
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_sizes_of_long_texts_do_not_overflow(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 50_000), (2, None)], "doc_id long, text string")
    pages = spark.createDataFrame([(1,)], "page_id long")
    found = capture_queries.frozen_baseline(spark, tables(spark, tmp_path, documents=docs, pages=pages))
    assert {(r.rel, r.state) for r in found.collect()} == {("baseline/1", "bound_by_hash"), ("baseline/2", "copied"), ("pages/1", "missing")}


def test_pairs_are_counted_as_a_join_would(spark):
    from quarrystone.operators import package

    proof = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", None), (None, "x"), ("d", None)], "k string, v string")
    other = spark.createDataFrame([("a", "x"), ("a", "z"), ("d", None), ("d", "q"), (None, "x")], "k string, w string")
    joined = proof.join(other.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), "left").filter(~F.col("v").eqNullSafe(F.col("w")))
    found = package.mismatched("g", proof, other, "k", {"v": "w"}).collect()
    assert [(r.gate_id, r.violations) for r in found] == [("g", joined.count())]
    absent = package.absent("g", proof, other, "k").collect()[0].violations
    assert absent == proof.join(other, "k", "left_anti").count()


def test_relations_of_repeated_orders_are_those_of_the_join(spark, tmp_path):
    from quarrystone.operators import package
    from quarrystone.plans import package_queries as q

    folder = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    orders = read("orders")
    more = orders.filter("o_orderkey % 10 = 0")
    other = orders.filter("o_orderkey % 15 = 0").withColumn("o_custkey", F.lit(None).cast(orders.schema["o_custkey"].dataType))
    given = {t: read(t) for t in ("customer", "lineitem", "events", "documents", "pages")}
    path = tables(spark, tmp_path, orders=orders.union(more).union(other), **given)
    want = package.relations(q.pkg_relation_evidence(spark, path), q.pkg_timeline_event(spark, path))
    found = q.pkg_explicit_relation(spark, path).select(want.columns)
    assert found.count() == want.count() and found.exceptAll(want).isEmpty()
    assert found.agg(F.max("evidence_count")).collect()[0][0] >= 4


def test_plain_values_are_joined_where_they_stand_for_nodes(spark):
    from quarrystone.plans import graph_queries

    for query in (graph_queries.node_pairs_by_company, graph_queries.orphan_endpoints):
        assert "sha2(" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_counted_where_their_text_lies(spark):
    from quarrystone.operators import sentences

    docs = spark.createDataFrame([(1, "one two three. one two. ......... four five six seven")], "k long, t string")
    plan = sentences.representative(docs, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_relations_meet_where_documents_repeat(spark):
    from quarrystone.operators import walk

    one, other = '{"order_id": "1", "company_id": "c", "products": [{"product_id": "p"}, {"product_id": "p"}]}', '{"company_id": "c", "order_id": "1", "k#:": {"z": {}}}'
    docs = [("a", 1, one), ("a", 1, one), ("a", 1, other), ("b", None, other), ("a", 2, one), ("b", None, "5"), ("c", None, other), ("c#:/k#:", None, '{"z": {}}'), ("d", 1, None)]
    rows = spark.createDataFrame(docs, "source_rel string, line long, json string")
    want, found = walk.relations(walk.findings(rows)), walk.document_relations(rows)
    assert found.columns == want.columns and found.count() == want.count() == want.select("subject", "predicate", "object").distinct().count()
    assert found.exceptAll(want).isEmpty() and found.agg(F.max("evidence_count")).collect()[0][0] > 4
    again = walk.relations(walk.findings(rows, kinds=("relation",)))
    assert again.exceptAll(want).isEmpty() and again.count() == want.count()


def test_walks_carry_what_is_asked_for(spark):
    from quarrystone.plans import walk_queries

    plan = lambda query: query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "predicate" not in plan(walk_queries.walk_nodes) and "predicate" not in plan(walk_queries.walk_records)
    relations = plan(walk_queries.walk_relations)
    # the ends meet by type and value, not by hashes
    assert relations.count("Aggregate [subject_type") == 1 and "Aggregate [subject#" not in relations


def test_items_are_found_in_one_pass_over_their_table(spark):
    from quarrystone.operators import tables as t

    rows = [
        ("a", 1, [None, " "]), ("a", 2, ["note"]), ("a", 3, ["Item", " Unit\nPrice"]), ("a", 4, ["x  y", "1"]), ("a", 5, ["Qty", "Goods"]), ("a", 6, ["z", "(2)"]), ("a", 7, ["Sub  total", "3"]),
        ("b", 1, ["product"]), ("b", 2, ["w", "1"]), (None, 1, ["Item", "Price"]), (None, 2, ["x", "1"]), *(("c", k, ["row", str(k)]) for k in range(8)), ("c", 8, ["Item", "Price"]), ("c", 9, ["x", "1"]),
    ]
    found = t.line_items(spark.createDataFrame(rows, "tab string, at int, cells array<string>"), "tab", "at", "cells")
    assert sorted((r.tab, r.source_row, r.description, r.unit_price) for r in found.collect()) == [("a", 3, "x y", 1.0), ("a", 4, "Qty", None), ("a", 5, "z", -2.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1 and "Join" not in plan


def test_postings_are_gathered_in_their_row(spark, tmp_path):
    from quarrystone.operators import search
    from quarrystone.operators.word_store import WordStore

    docs = spark.createDataFrame([(1, "The été, the É"), (2, None), (3, "a b"), (3, "b a\u0301 a"), (None, "a")], "doc_id long, text string")
    once = docs.filter("doc_id < 3")
    plan = search.row_postings(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    rows = lambda df: sorted((r.word, r.doc_id, list(r.places)) for r in df.collect())
    assert rows(search.row_postings(once, "doc_id", "text")) == rows(search.word_index(once, "doc_id", "text"))
    store = WordStore(spark, f"file://{tmp_path}/store", buckets=3, spread=2)
    store.upsert(docs)
    assert rows(store.postings()) == [("a", 3, [0, 1, 2]), ("b", 3, [0, 1]), ("e", 1, [3]), ("ete", 1, [1]), ("the", 1, [0, 2])]


def test_profiles_make_relations_once(spark):
    from quarrystone.plans import record_queries

    found = record_queries.package_profiles(spark, "/root/testdata/sf0.001")
    kinds = {r.value: r.n for r in found.collect() if r.profile in ("predicate", "relation_kind")}
    assert kinds["business"] == kinds["company_has_order"] + kinds["order_has_product"]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # two profiles, one aggregate of relations: the second reads the shuffle of the first
    assert plan.count("], functions=[partial_count(1)], output=[predicate#") == 1 and "ReusedExchange [predicate#" in plan
