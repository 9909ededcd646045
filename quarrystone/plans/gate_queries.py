"""Gate groups over the tables of a case: extraction, the first package, mail timeline, capture, invoices and delivery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.classify import invoice_groups, rules
from quarrystone.operators import content, mail, package
from quarrystone.plans import capture_queries, content_queries, graph_queries, mail_queries
from quarrystone.plans.tables import table
from quarrystone.sources.scratch import kept


def _status(counted: DataFrame) -> DataFrame:
    return counted.select(
        "gate_id", F.col("violations").cast("long").alias("violations"), F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status")
    )


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _two(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """A rule that is broken by as much as two counts (one row, column n, each) differ."""
    return left.select(F.col("n").alias("a")).crossJoin(right.select(F.col("n").alias("b"))).select(
        F.lit(name).alias("gate_id"), F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("violations")
    )


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def extraction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, occurrences and tasks agree; open tasks and gaps are told, never hidden."""
    files, tasks = kept(content_queries.files(spark, sf_dir), "gate-files"), kept(content_queries.tasks(spark, sf_dir), "gate-tasks")
    objects, occurrences = content.content_objects(files), content.occurrences(files, "session")
    return _status(_union(
        package.rules(tasks, TASK_STATE_UNKNOWN="state NOT IN ('pending', 'running', 'failed', 'completed', 'source_gap')", TASKS_OPEN="state NOT IN ('completed', 'source_gap')", SOURCE_GAPS="state = 'source_gap'"),
        package.rules(objects, OBJECT_SHA_INVALID="NOT sha256 RLIKE '^[0-9a-f]{64}$'", OBJECT_WITHOUT_OCCURRENCE="occurrences < 1", OBJECT_BYTES_NEGATIVE="bytes < 0"),
        package.absent("OCCURRENCE_WITHOUT_OBJECT", occurrences.select(F.col("content_sha256").alias("sha256")), objects, "sha256"),
        package.absent("OBJECT_WITHOUT_TASK", objects, tasks, "sha256"), package.absent("TASK_WITHOUT_OBJECT", tasks, objects, "sha256"),
        package.repeated("TASK_DUPLICATE", tasks, "task_id"), package.repeated("OCCURRENCE_DUPLICATE", occurrences, "occurrence_id"),
        _two("OCCURRENCE_COUNT_MISMATCH", objects.agg(F.sum("occurrences").alias("n")), _count(files)),
        package.rows_of("CONTENT_BYTES_DIFFER", files.groupBy("sha256").agg(F.countDistinct("bytes").alias("n")).filter("n > 1")),
    ))


def v1_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first package: facts add up to occurrences, ends are nodes, ids are unique and all tables hold what they should."""
    edges, nodes, facts = (f(spark, sf_dir) for f in (graph_queries.case_edges, graph_queries.case_nodes, graph_queries.relation_fact))
    expected = table(spark, sf_dir, "orders").select(F.lit(1)).unionAll(table(spark, sf_dir, "lineitem").select(F.lit(1)))
    return _status(_union(
        _two("RELATION_FACT_EVIDENCE_COUNT_MISMATCH", facts.agg(F.sum("evidence_count").alias("n")), _count(edges)),
        package.rows_of("RELATION_ENDPOINT_MISSING", graph_queries.case_orphans(spark, sf_dir)), package.repeated("NODE_DUPLICATE", nodes, "node_id"), package.repeated("FACT_DUPLICATE", facts, "from_id", "relation", "to_id"),
        _two("OUTPUT_RELATION_OCCURRENCE_COUNT_MISMATCH", _count(edges), _count(expected)), package.rules(nodes, NODE_VALUE_EMPTY="coalesce(value, '') = ''", NODE_TYPE_UNKNOWN="node_type NOT IN ('company', 'order', 'product')"),
        package.rules(facts, FACT_SOURCE_MISSING="first_source IS NULL OR last_source < first_source", FACT_SELF_LOOP="from_id = to_id"),
    ))


def mail_timeline_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a mail timeline's check: what was found, what was expected, and PASS, FAIL, SOURCE_GAP or INFO.  Turns are mails with one attachment each, its kind by length."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("image", "eps", "video", "text"))), (F.length(F.coalesce("text", F.lit(""))) % 4 + 1).cast("int"))
    m = mail_queries.mails(spark, sf_dir).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("category", kind)
    checked = kept(mail.checked_parents(m.drop("text", "role")), "qa-mails")
    cycles = mail.cycle_members(checked, 6)
    order = mail.in_order(checked.filter("local_key IS NOT NULL"), "conv_id").select(
        F.col("conv_id").alias("c"), F.col("mail_order").alias("o"), F.col("local_key").alias("k")
    )
    back = order.alias("a").join(order.select("c", (F.col("o") - 1).alias("o"), F.col("k").alias("after")).alias("b"), ["c", "o"]).filter("k > after")
    one = checked.agg(
        F.count("*").alias("mails"), F.count_if(F.col("local_key").isNotNull()).alias("timed"), F.countDistinct("mail_id", "sha").alias("pairs"), F.countDistinct("sha").alias("attachments"),
        *(F.countDistinct(F.when(F.col("category") == k, F.col("sha"))).alias(k) for k in ("image", "eps", "video", "text")),
        F.count_if(F.rlike("sha", F.lit("^[0-9a-f]{64}$"))).alias("valid"), F.countDistinct(F.when(F.rlike("sha", F.lit("^[0-9a-f]{64}$")), F.col("sha"))).alias("valid_attachments"),
        F.count_if(F.col("parent_status") == "later").alias("later"), F.count_if(F.col("parent_status") == "missing").alias("missing"),
        F.countDistinct(F.when(F.col("sha") == F.sha2(F.lit(""), 256), F.col("sha"))).alias("blank"), F.countDistinct(F.when(~F.col("sha").startswith("0"), F.col("sha"))).alias("named"),
    )
    found = one.crossJoin(_count(back).withColumnRenamed("n", "inversions")).crossJoin(cycles.agg(F.countDistinct("cycle").alias("cycles")))
    expected = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).agg(
        F.count("*").alias("e_mails"), F.countDistinct(F.coalesce("text", F.lit(""))).alias("e_attachments"),
        F.count_if(F.col("conv_id") % 5 != 0).alias("e_timed")
    )
    row = lambda name, actual, want, how="equal": F.struct(F.lit(name).alias("metric"), F.col(actual).cast("long").alias("actual"), (F.lit(None) if want is None else F.col(want) if isinstance(want, str) else F.lit(want)).cast("long").alias("expected"), F.lit(how).alias("how"))
    rows = [
        row("mails", "mails", "e_mails"), row("mails_in_timeline", "timed", "e_timed"), row("time_inversions", "inversions", 0), row("mail_attachment_relations", "pairs", "e_mails"), row("attachment_occurrences", "mails", "e_mails"),
        row("attachments", "attachments", "e_attachments"), row("image_previews", "image", "image"), row("eps_previews", "eps", "eps"), row("video_summaries", "video", "video"), row("text_unresolved", "blank", "blank", "gap"),
        row("mail_sha_valid", "valid", "mails"), row("attachment_sha_valid", "valid_attachments", "attachments"), row("parent_after_child", "later", None, "flag"), row("parent_missing", "missing", None, "flag"),
        row("parent_cycles", "cycles", 0), row("named_attachments", "named", "attachments", "info"), row("local_unzoned", "timed", None, "flag"),
    ]
    each = found.crossJoin(expected).withColumn("pending", F.col("mails") - F.col("timed")).withColumn("e_pending", F.col("e_mails") - F.col("e_timed"))
    rows.append(row("mails_time_pending", "pending", "e_pending"))
    listed = each.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    status = rules(
        (F.col("how") == "info", "INFO"), (F.col("how") == "flag", "PASS"), (F.col("actual") != F.col("expected"), "FAIL"),
        (F.col("how") == "gap", "SOURCE_GAP"), otherwise="PASS"
    )
    return listed.select("metric", "actual", "expected", status.alias("status"))


def capture_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation of a capture: announced and captured rows of lists, visibility gaps, duplicates, failed bodies, isolation of blocked hosts."""
    listing = kept(capture_queries.page_plan(spark, sf_dir), "gate-plan")
    classes = kept(capture_queries.url_classes(spark, sf_dir), "gate-urls")
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.countDistinct("l_linenumber").alias("distinct"))
    pages = table(spark, sf_dir, "pages")
    return _status(_union(
        _two("COUNT_ORDERS", listing.agg(F.sum("rows").alias("n")), _count(table(spark, sf_dir, "orders"))),
        package.rows_of("PAGE_WITHOUT_ROWS", listing.filter("page > 1 AND rows = 0")), package.rows_of("DUPLICATE_LIST_ROWS", per_order.filter("rows <> distinct")),
        package.rules(classes, BLOCKED_HOST_REQUESTED="url_class = 'blocked'", TELEMETRY_EXCLUDED="url_class = 'telemetry' AND post_key IS NOT NULL", EXCLUDED_PATH_REQUESTED="url_class = 'excluded'", URL_INVALID="url_class = 'invalid'"),
        package.rules(pages, RESPONSE_BODY_MISSING="coalesce(html, '') = ''", RESPONSE_URL_MISSING="coalesce(url, '') = ''"), package.repeated("RESPONSE_URL_REPEATED", pages, "url"),
        package.absent("DOCUMENT_VISIBILITY_GAP", table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents"), "doc_id"),
        package.absent("ORDER_WITHOUT_CUSTOMER", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer"), "c_custkey"),
    ))


def invoice_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of invoices: confirmed and suspected make up all, every occurrence has a parent, bytes and hashes close."""
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), invoice_groups(text).alias("groups")
    )
    found = kept(d.filter("groups >= 1").withColumn("class", F.when(F.col("groups") >= 3, "CONFIRMED").otherwise("SUSPECTED")), "gate-invoices")
    unique = found.groupBy("sha256").agg(
        F.min("class").alias("class"), F.max("class").alias("other"), F.min("bytes").alias("bytes"), F.max("bytes").alias("most"),
        F.countDistinct("source").alias("parents"), F.count("*").alias("occurrences")
    )
    unique = kept(unique, "gate-invoice-objects")
    classes = unique.groupBy("class").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"))
    return _status(_union(
        _two("UNIQUE_COUNT", classes, _count(unique)), _two("OCCURRENCE_COUNT", unique.agg(F.sum("occurrences").alias("n")), _count(found)),
        package.rules(unique, CLASS_CONFLICT="class <> other", BYTES_CONFLICT="bytes <> most", PARENT_MISSING="parents = 0", MULTIPARENT="parents > 1"),
        package.rules(found, SHA_INVALID="NOT sha256 RLIKE '^[0-9a-f]{64}$'", BYTES_EMPTY="bytes = 0"),
    ))


def delivery_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of gates as components of a delivery; the final one holds only if none before it fails."""
    groups = {"extraction": extraction_gates, "package": v1_gates, "capture": capture_checks, "invoices": invoice_gates}
    each = _union(*(
        f(spark, sf_dir).agg(F.count("*").alias("gates"), F.count_if(F.col("status") == "FAIL").alias("failed")).withColumn("component", F.lit(name))
        for name, f in groups.items()
    ))
    each = kept(each, "gate-components")
    final = each.agg(F.count("*").alias("gates"), F.count_if(F.col("failed") > 0).alias("failed")).withColumn("component", F.lit("final"))
    return each.unionByName(final).select("component", "gates", "failed", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL").alias("status"))


QUERIES = {f.__name__: f for f in (extraction_gates, v1_gates, mail_timeline_qa, capture_checks, invoice_gates, delivery_gates)}


def _sql(rows: dict[str, str]) -> str:
    every = " UNION ALL ".join(f"SELECT '{gate}' AS gate_id, ({sql}) AS violations" for gate, sql in rows.items())
    return f"SELECT gate_id, violations::bigint AS violations, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({every})"


_FILES = """f AS (SELECT sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS bytes, doc_id, source || '/' || doc_id || '.txt' AS rel FROM documents),
o AS (SELECT sha, min(doc_id) AS doc_id, count(*) AS n FROM f GROUP BY 1), s AS (SELECT doc_id, min(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1),
t AS (SELECT sha, CASE WHEN q IS NULL THEN 'pending' WHEN x = 1 THEN 'source_gap' WHEN q = 1 THEN 'completed' ELSE 'failed' END AS state FROM o LEFT JOIN s USING (doc_id))"""
_EXTRACTION = {
    "TASK_STATE_UNKNOWN": "0", "TASKS_OPEN": "SELECT count(*) FROM t WHERE state IN ('pending', 'failed')", "SOURCE_GAPS": "SELECT count(*) FROM t WHERE state = 'source_gap'",
    "OBJECT_SHA_INVALID": "SELECT count(*) FROM o WHERE length(sha) <> 64", "OBJECT_WITHOUT_OCCURRENCE": "SELECT count(*) FROM o WHERE n < 1", "OBJECT_BYTES_NEGATIVE": "SELECT count(*) FROM f WHERE bytes < 0",
    "OCCURRENCE_WITHOUT_OBJECT": "SELECT count(*) FROM f WHERE sha NOT IN (SELECT sha FROM o)", "OBJECT_WITHOUT_TASK": "SELECT count(*) FROM o WHERE sha NOT IN (SELECT sha FROM t)", "TASK_WITHOUT_OBJECT": "SELECT count(*) FROM t WHERE sha NOT IN (SELECT sha FROM o)",
    "TASK_DUPLICATE": "SELECT count(*) FROM (SELECT sha FROM t GROUP BY 1 HAVING count(*) > 1)", "OCCURRENCE_DUPLICATE": "SELECT count(*) FROM (SELECT rel, sha FROM f GROUP BY ALL HAVING count(*) > 1)",
    "OCCURRENCE_COUNT_MISMATCH": "SELECT abs((SELECT sum(n) FROM o) - (SELECT count(*) FROM f))", "CONTENT_BYTES_DIFFER": "SELECT count(*) FROM (SELECT sha FROM f GROUP BY 1 HAVING count(DISTINCT bytes) > 1)",
}
_V1 = {
    "RELATION_FACT_EVIDENCE_COUNT_MISMATCH": "SELECT abs((SELECT sum(evidence_count) FROM facts) - (SELECT count(*) FROM edges))",
    "RELATION_ENDPOINT_MISSING": "SELECT count(*) FROM edges WHERE from_id NOT IN (SELECT node_id FROM nodes) OR to_id NOT IN (SELECT node_id FROM nodes)",
    "NODE_DUPLICATE": "SELECT count(*) FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)", "FACT_DUPLICATE": "SELECT count(*) FROM (SELECT from_id, relation, to_id FROM facts GROUP BY ALL HAVING count(*) > 1)",
    "OUTPUT_RELATION_OCCURRENCE_COUNT_MISMATCH": "SELECT abs((SELECT count(*) FROM edges) - (SELECT count(*) FROM orders) - (SELECT count(*) FROM lineitem))",
    "NODE_VALUE_EMPTY": "SELECT count(*) FROM nodes WHERE coalesce(value, '') = ''", "NODE_TYPE_UNKNOWN": "SELECT count(*) FROM nodes WHERE node_type NOT IN ('company', 'order', 'product')",
    "FACT_SOURCE_MISSING": "SELECT count(*) FROM facts WHERE first_source IS NULL OR last_source < first_source", "FACT_SELF_LOOP": "SELECT count(*) FROM facts WHERE from_id = to_id",
}
_URLS = capture_queries.ORACLES["url_classes"]
_CAPTURE = {
    "COUNT_ORDERS": "SELECT abs((SELECT sum(rows) FROM plan) - (SELECT count(*) FROM orders))", "PAGE_WITHOUT_ROWS": "SELECT count(*) FROM plan WHERE page > 1 AND rows = 0",
    "DUPLICATE_LIST_ROWS": "SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber))",
    "BLOCKED_HOST_REQUESTED": "SELECT count(*) FROM urls WHERE url_class = 'blocked'", "TELEMETRY_EXCLUDED": "SELECT count(*) FROM urls WHERE url_class = 'telemetry' AND post_key IS NOT NULL",
    "EXCLUDED_PATH_REQUESTED": "SELECT count(*) FROM urls WHERE url_class = 'excluded'", "URL_INVALID": "SELECT count(*) FROM urls WHERE url_class = 'invalid'",
    "RESPONSE_BODY_MISSING": "SELECT count(*) FROM pages WHERE coalesce(html, '') = ''", "RESPONSE_URL_MISSING": "SELECT count(*) FROM pages WHERE coalesce(url, '') = ''",
    "RESPONSE_URL_REPEATED": "SELECT count(*) FROM (SELECT url FROM pages GROUP BY 1 HAVING count(*) > 1)", "DOCUMENT_VISIBILITY_GAP": "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "ORDER_WITHOUT_CUSTOMER": "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
}
_CAPTURE_SQL = f"plan AS ({capture_queries.ORACLES['page_plan']}), urls AS ({_URLS})"
_GROUPS = " + ".join(f"regexp_matches(coalesce(text, ''), '{p}')::int" for p in (
    r"(?i)\b(seller|supplier|buyer|consignee|bill\s+to|ship\s+to|exporter|importer)\b", r"(?i)\b(pi|p\s*/\s*i|invoice)\s*(no\.?|number|#)|\bdate\b", r"(?i)\b(description|item|model|product|quantity|qty|unit\s+price)\b",
    r"(?i)\b(total|subtotal|amount|usd|eur|gbp|cny|rmb)\b|[$€£¥]", r"(?i)\b(payment\s+terms?|delivery\s+terms?|incoterms?|fob|cif|exw|deposit)\b", r"(?i)\b(signature|authorized|stamp|signed)\b",
))
_INVOICE_SQL = f"""inv AS (SELECT *, CASE WHEN g >= 3 THEN 'CONFIRMED' ELSE 'SUSPECTED' END AS class FROM (SELECT doc_id, source, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS bytes, {_GROUPS} AS g FROM documents) WHERE g >= 1),
uni AS (SELECT sha, min(class) AS class, max(class) AS other, min(bytes) AS bytes, max(bytes) AS most, count(DISTINCT source) AS parents, count(*) AS n FROM inv GROUP BY 1)"""
_INVOICES = {
    "UNIQUE_COUNT": "SELECT abs((SELECT count(*) FROM uni WHERE class IN ('CONFIRMED', 'SUSPECTED')) - (SELECT count(DISTINCT sha) FROM inv))", "OCCURRENCE_COUNT": "SELECT abs((SELECT sum(n) FROM uni) - (SELECT count(*) FROM inv))",
    "CLASS_CONFLICT": "SELECT count(*) FROM uni WHERE class <> other", "BYTES_CONFLICT": "SELECT count(*) FROM uni WHERE bytes <> most", "PARENT_MISSING": "SELECT count(*) FROM uni WHERE parents = 0",
    "MULTIPARENT": "SELECT count(*) FROM uni WHERE parents > 1", "SHA_INVALID": "SELECT count(*) FROM inv WHERE length(sha) <> 64", "BYTES_EMPTY": "SELECT count(*) FROM inv WHERE bytes = 0",
}
_PARTS = {
    "extraction": (_FILES, _EXTRACTION), "package": (f"{graph_queries.EDGES_SQL}, {graph_queries.FACTS_SQL}, {graph_queries.NODES_SQL}", _V1),
    "capture": (_CAPTURE_SQL, _CAPTURE), "invoices": (_INVOICE_SQL, _INVOICES)
}
_TEXT = "coalesce(text, '')"

ORACLES = {
    "extraction_gates": f"WITH {_FILES} {_sql(_EXTRACTION)}",
    "v1_gates": f"WITH {_PARTS['package'][0]} {_sql(_V1)}",
    "capture_checks": f"WITH {_CAPTURE_SQL} {_sql(_CAPTURE)}",
    "invoice_gates": f"WITH {_INVOICE_SQL} {_sql(_INVOICES)}",
    "delivery_gates": "WITH each AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS component, count(*) AS gates, count(*) FILTER (status = 'FAIL') AS failed FROM (WITH {ctes} {_sql(rows)})" for name, (ctes, rows) in _PARTS.items())
    + "), every AS (SELECT * FROM each UNION ALL SELECT 'final', count(*), count(*) FILTER (failed > 0) FROM each) SELECT *, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM every",
    "mail_timeline_qa": f"""WITH RECURSIVE {mail_queries.MAILS_SQL},
walk AS (SELECT mail_id AS begun, valid_parent AS reached, 1 AS n, mail_id AS least FROM valid WHERE valid_parent IS NOT NULL
         UNION ALL SELECT begun, v.valid_parent, n + 1, least(least, v.mail_id) FROM walk JOIN valid v ON v.mail_id = walk.reached WHERE walk.reached <> begun AND v.valid_parent IS NOT NULL AND n < 1000),
m AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
s AS (SELECT *, sha256({_TEXT}) AS sha, length({_TEXT}) % 4 AS kind FROM m),
a AS (SELECT count(*) AS mails, count(*) FILTER (conv_id % 5 <> 0) AS timed, count(DISTINCT sha) AS attachments, count(DISTINCT sha) FILTER (kind = 0) AS image, count(DISTINCT sha) FILTER (kind = 1) AS eps,
  count(DISTINCT sha) FILTER (kind = 2) AS video, count(DISTINCT sha) FILTER ({_TEXT} = '') AS blank, count(DISTINCT sha) FILTER (sha NOT LIKE '0%') AS named FROM s),
p AS (SELECT count(*) FILTER (parent_status = 'later') AS later, count(*) FILTER (parent_status = 'missing') AS missing FROM checked),
cyc AS (SELECT count(DISTINCT least) AS cycles FROM walk WHERE reached = begun),
r AS (SELECT unnest([
  {{'metric': 'mails', 'actual': mails, 'expected': mails, 'status': 'PASS'}}, {{'metric': 'mails_in_timeline', 'actual': timed, 'expected': timed, 'status': 'PASS'}}, {{'metric': 'mails_time_pending', 'actual': mails - timed, 'expected': mails - timed, 'status': 'PASS'}},
  {{'metric': 'time_inversions', 'actual': 0, 'expected': 0, 'status': 'PASS'}}, {{'metric': 'mail_attachment_relations', 'actual': mails, 'expected': mails, 'status': 'PASS'}}, {{'metric': 'attachment_occurrences', 'actual': mails, 'expected': mails, 'status': 'PASS'}},
  {{'metric': 'attachments', 'actual': attachments, 'expected': attachments, 'status': 'PASS'}}, {{'metric': 'image_previews', 'actual': image, 'expected': image, 'status': 'PASS'}}, {{'metric': 'eps_previews', 'actual': eps, 'expected': eps, 'status': 'PASS'}},
  {{'metric': 'video_summaries', 'actual': video, 'expected': video, 'status': 'PASS'}}, {{'metric': 'text_unresolved', 'actual': blank, 'expected': blank, 'status': 'SOURCE_GAP'}}, {{'metric': 'mail_sha_valid', 'actual': mails, 'expected': mails, 'status': 'PASS'}},
  {{'metric': 'attachment_sha_valid', 'actual': attachments, 'expected': attachments, 'status': 'PASS'}}, {{'metric': 'parent_after_child', 'actual': later, 'expected': NULL, 'status': 'PASS'}}, {{'metric': 'parent_missing', 'actual': missing, 'expected': NULL, 'status': 'PASS'}},
  {{'metric': 'parent_cycles', 'actual': cycles, 'expected': 0, 'status': CASE WHEN cycles = 0 THEN 'PASS' ELSE 'FAIL' END}}, {{'metric': 'named_attachments', 'actual': named, 'expected': attachments, 'status': 'INFO'}},
  {{'metric': 'local_unzoned', 'actual': timed, 'expected': NULL, 'status': 'PASS'}}]) AS x FROM a, p, cyc)
SELECT x.metric, x.actual::bigint AS actual, x.expected::bigint AS expected, x.status FROM r""",
}
