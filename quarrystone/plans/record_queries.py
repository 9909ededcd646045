"""Queries of the smaller record operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import corpus, ordered, records
from quarrystone.plans import package_queries
from quarrystone.plans.tables import table
from quarrystone.plans.walk_queries import NESTED_SQL, nested_orders
from quarrystone.sources.scratch import kept


def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand in one order, as facts with their evidence."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = records.pairs_within(lines, "l_orderkey", "l_linenumber", "l_partkey")
    return pairs.groupBy("left_id", "right_id").agg(F.count("*").alias("evidence_count"), F.min("l_orderkey").alias("first_record"))


def most_common_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.most_common(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")


def first_known_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user of each event type whose id is not divisible by three, as if those were unknown."""
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id"), "event_id")
    return records.first_known(e, "event_type", "user_id", "event_id")


def page_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: recognised text for every other one, blank for every fourth."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    seen = c.filter("turn % 2 = 0").withColumn(
        "text", F.when(F.col("turn") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("seen "), F.col("turn").cast("string")))
    )
    merged = records.merged_pages(c.filter("turn % 3 <> 2"), seen, ["conv_id", "turn"])
    return merged.select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), "origin")


def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recognised words; their discount in hundredths is the confidence, negative for every fifth."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    sure = F.when(F.col("l_partkey") % 5 == 0, F.lit(-1.0)).otherwise(F.round(F.col("l_discount") * 100))
    words = l.select("l_orderkey", "l_linenumber", F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"), sure.alias("confidence"))
    found = records.recognised_lines(words, ["l_orderkey"], "l_linenumber", "word", "confidence")
    return found.select("l_orderkey", "line_text", F.round("mean_confidence", 6).alias("mean_confidence"), "words")


def window_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.window_anchors(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


def window_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in order of their keys; a window holds six to either side, with holes.  Every twelfth is an anchor first."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    placed = kept(ordered.running_totals(c, ["c_custkey"], {"p": "1"}), "cover-places")
    reach = placed.select(F.col("c_custkey").alias("anchor"), F.col("p").alias("from"), F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("q"))
    whole = reach.filter("(from * 7 + q * 3 + 60) % 5 > 1").select("anchor", (F.col("from") + F.col("q")).alias("p"))
    windows = whole.join(placed, "p").select("anchor", F.col("c_custkey").alias("covered"))
    return records.window_cover(c, windows, placed.filter("p % 12 = 0").select("c_custkey"), "c_custkey").select("c_custkey", (F.col("round") > 0).alias("added"))


def receipt_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of documents: some lack, some name another size or text."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")
    )
    receipts = d.filter("doc_id % 7 <> 0").withColumn(
        "bytes", F.when(F.col("doc_id") % 5 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))
    ).withColumn("sha256", F.when(F.col("doc_id") % 4 == 0, F.lit("x")).otherwise(F.col("sha256")))
    return records.receipts_bound(receipts, d.filter("doc_id % 11 <> 0"), "doc_id", ["bytes", "sha256"])


def next_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of documents needs next, by the state of its labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = d.groupBy("source").agg(
        F.count_if(F.col("toxic").isNull()).alias("open_docs"), F.count_if(F.col("toxic") == 1).alias("gaps"), F.count_if(F.col("quality") == 1).alias("done")
    )
    steps = [("resolve_gaps", F.col("gaps") > 3), ("finalise", F.col("open_docs") == 0), ("extract", F.col("done") > F.col("gaps") * 10)]
    return records.next_action(status, steps, "wait")


def multi_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    }
    return records.multi_root_union(roots)


def record_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as JSON, in parts of 300 characters by their largest list; put together again, each is what it was."""
    parts = corpus.record_parts(nested_orders(spark, sf_dir), "source_rel", "json", 300)
    # all of a part but its list is the same in every part, so items in order and one frame make the record again
    frame, items = F.regexp_extract("body", r"^(.*\"products\":)\[.*\]\}$", 1), F.regexp_extract("body", r"\"products\":\[(.*)\]\}$", 1)
    whole = parts.groupBy("source_rel").agg(
        F.max("parts").cast("long").alias("parts"), F.max(F.length("body")).cast("long").alias("longest"), F.count_if(F.col("method") == "text").alias("cut_as_text"),
        F.min(frame).alias("frame"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", items.alias("items")))), lambda p: p["items"]), ",").alias("items"),
    )
    return whole.select(
        "source_rel", (F.col("longest") <= 300).alias("fits"), "cut_as_text", F.sha2(F.concat("frame", F.lit("["), "items", F.lit("]}")), 256).alias("sha256")
    )


def receipt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as receipts of their lines: every twelfth announces one more, every thirteenth other bytes, and lines of every eleventh order have none."""
    size = (F.col("l_partkey") % 100 + 1).cast("long").alias("bytes")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), size)
    told = lines.groupBy("session").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).filter("session % 11 <> 0")
    receipts = told.select(
        "session", (F.col("n") + (F.col("session") % 12 == 0).cast("int")).alias("announced"),
        (F.col("b") + (F.col("session") % 13 == 0).cast("int")).alias("announced_bytes")
    )
    return records.receipt_totals(receipts, lines, "session")


def package_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type of node, predicate, kind of relation, axis and record type of a relation package."""
    profile = lambda name, df, column, n=F.count("*"): df.groupBy(F.col(column).alias("value")).agg(n.alias("n")).select(F.lit(name).alias("profile"), "value", "n")
    # both profiles of relations start from the few pairs of predicate and kind, whose shuffle they share: relations are made once
    relation = package_queries.pkg_explicit_relation(spark, sf_dir).groupBy("predicate", "relation_kind").agg(F.count("*").alias("n"))
    found = [
        profile("node_type", package_queries.pkg_nodes(spark, sf_dir), "node_type"), profile("predicate", relation, "predicate", F.sum("n")), profile("relation_kind", relation, "relation_kind", F.sum("n")),
        profile("axis", package_queries.pkg_timeline_event(spark, sf_dir), "axis"), profile("record_type", package_queries.pkg_record_occurrence(spark, sf_dir), "record_type"),
    ]
    return reduce(DataFrame.unionByName, found)


QUERIES = {
    f.__name__: f
    for f in (cooccurrence_pairs, most_common_source, first_known_user, page_text_merge, recognised_lines, window_anchors, window_cover, receipt_binding, next_action, multi_root, record_parts, receipt_totals, package_profiles)
}

ORACLES = {
    "record_parts": f"""WITH {NESTED_SQL} SELECT rel AS source_rel, true AS fits, 0::bigint AS cut_as_text, sha256('{{"order_id":"O' || o_orderkey || '","company_id":"C' || o_custkey || '","order_time":"' || t || '","products":' || products || '}}') AS sha256 FROM o""",
    "receipt_totals": """WITH l AS (SELECT l_orderkey AS session, count(*) AS n, sum(l_partkey % 100 + 1)::bigint AS b FROM lineitem GROUP BY 1)
SELECT session, CASE WHEN session % 11 <> 0 THEN n + (session % 12 = 0)::int END AS announced, CASE WHEN session % 11 <> 0 THEN b + (session % 13 = 0)::int END AS announced_bytes, n AS artifacts, b AS bytes,
  CASE WHEN session % 11 = 0 THEN 'no_receipt' WHEN session % 12 = 0 THEN 'count_differs' WHEN session % 13 = 0 THEN 'bytes_differ' ELSE 'closed' END AS coverage FROM l""",
    "package_profiles": f"WITH {package_queries.PACKAGE_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS profile, {c} AS value, count(*) AS n FROM {t} GROUP BY ALL" for c, t in (("node_type", "nodes"), ("predicate", "explicit_relation"), ("relation_kind", "explicit_relation"), ("axis", "timeline_event"), ("record_type", "record_occurrence"))),
    "cooccurrence_pairs": """SELECT a.l_partkey AS left_id, b.l_partkey AS right_id, count(*) AS evidence_count, min(a.l_orderkey) AS first_record
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND (a.l_linenumber, a.l_partkey) < (b.l_linenumber, b.l_partkey) AND a.l_partkey <> b.l_partkey GROUP BY 1, 2""",
    "most_common_source": """WITH c AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2)
SELECT lang, source, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) = 1""",
    "first_known_user": "SELECT event_type, arg_min(user_id, event_id) FILTER (WHERE user_id % 3 <> 0) AS user_id FROM events GROUP BY 1",
    "page_text_merge": """WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), n AS (SELECT * FROM c WHERE turn % 3 <> 2),
s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN ' ' ELSE 'seen ' || turn END AS text FROM c WHERE turn % 2 = 0),
m AS (SELECT coalesce(n.conv_id, s.conv_id) AS conv_id, coalesce(n.turn, s.turn) AS turn, nullif(CASE WHEN trim(s.text) = '' THEN '' ELSE s.text END, '') AS st, CASE WHEN trim(n.text) <> '' THEN n.text END AS nt FROM n FULL JOIN s ON n.conv_id = s.conv_id AND n.turn = s.turn)
SELECT conv_id, turn, sha256(coalesce(st, nt, '')) AS text_sha256, CASE WHEN st IS NOT NULL THEN 'recognised' WHEN nt IS NOT NULL THEN 'native' ELSE 'blank' END AS origin FROM m""",
    "recognised_lines": """SELECT l_orderkey, string_agg('w' || l_partkey, ' ' ORDER BY l_linenumber, 'w' || l_partkey) AS line_text,
  round(avg(CASE WHEN l_partkey % 5 <> 0 THEN round(l_discount * 100) END), 6) AS mean_confidence, count(*) AS words FROM lineitem GROUP BY 1""",
    "window_anchors": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT o_orderkey, position FROM r WHERE position % 100 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders)""",
    "window_cover": """WITH RECURSIVE c AS MATERIALIZED (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer),
b AS MATERIALIZED (SELECT c.p, bool_or(c.p % 12 = 0 OR (a.p * 7 + (c.p - a.p) * 3 + 60) % 5 > 1 AND a.p IS NOT NULL) AS seen FROM c LEFT JOIN c a ON a.p % 12 = 0 AND a.p BETWEEN c.p - 6 AND c.p + 6 GROUP BY 1),
w AS (SELECT p, seen, list_sum(list_transform(range(1, 7), lambda q: CASE WHEN (p * 7 + q * 3 + 60) % 5 > 1 THEN 1 << q::int ELSE 0 END))::int AS ahead FROM b),
f AS (SELECT p, NOT seen AS added, CASE WHEN seen THEN 0 ELSE ahead END AS mask FROM w WHERE p = 0
  UNION ALL SELECT w.p, NOT w.seen AND (mask >> 1) % 2 = 0, (mask >> 1) | CASE WHEN NOT w.seen AND (mask >> 1) % 2 = 0 THEN ahead ELSE 0 END FROM f JOIN w ON w.p = f.p + 1)
SELECT c_custkey, added FROM f JOIN c USING (p) WHERE added OR p % 12 = 0""",
    "receipt_binding": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_receipt' WHEN doc_id % 11 = 0 THEN 'no_artifact' WHEN doc_id % 5 = 0 AND doc_id % 4 = 0 THEN 'differs:bytes,sha256'
  WHEN doc_id % 5 = 0 THEN 'differs:bytes' WHEN doc_id % 4 = 0 THEN 'differs:sha256' ELSE 'bound' END AS binding FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)""",
    "next_action": """WITH s AS (SELECT source, count(*) FILTER (WHERE toxic IS NULL) AS open_docs, count(*) FILTER (WHERE toxic = 1) AS gaps, count(*) FILTER (WHERE quality = 1) AS done FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN gaps > 3 THEN 'resolve_gaps' WHEN open_docs = 0 THEN 'finalise' WHEN done > gaps * 10 THEN 'extract' ELSE 'wait' END AS next_action FROM s""",
    "multi_root": "SELECT c_name AS name, c_mktsegment AS segment, 'customer' AS root FROM customer UNION ALL SELECT s_name, NULL, 'supplier' FROM supplier",
}
