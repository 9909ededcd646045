"""Capture queries: pages are requests, events are payloads and sessions, conversations are mails, orders and lines are listings, boxes and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions import urls
from quarrystone.functions.classify import field_route
from quarrystone.operators import capture
from quarrystone.plans.tables import table

EXCLUDED, BLOCKED, ALLOWED = ("/api/tradedata", "/trade/info"), ("ai.example", "assistant.example"), ("example.com", "example.org")
PREFIXES, LABELS = ("click__", "view__", "purchase__", "login__"), ("1", "2", "3", "5", "8")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls, seven of eight sent to another host or path."""
    p, tail = table(spark, sf_dir, "pages"), F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("?b=2&a=1"))
    kinds = (
        "https://chat.ai.example", "https://www.google-analytics.com", "https://EXAMPLE.com/Trade/Info", "https://api.example.net/api/orderRead",
        "https://x.sensorsdata.example", "not a url", "https://cdn.example.org:8443/api/tradedata2"
    )
    made = F.col("url")
    for k, base in enumerate(kinds):
        made = F.when(F.col("page_id") % 8 == k, F.concat(F.lit(base), tail)).otherwise(made)
    return p.select(
        "page_id", made.alias("url"), F.when(F.col("page_id") % 3 == 0, "post").otherwise("GET").alias("method"),
        F.when(F.col("page_id") % 5 != 0, F.sha2("url", 256)).alias("body_sha256")
    )


def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    key = urls.read_only_post_key(F.col("method"), u, F.col("body_sha256"), EXCLUDED)
    return _requests(spark, sf_dir).select(
        "page_id", urls.host_of(u).alias("host"), urls.path_of(u).alias("path"), urls.url_class(u, EXCLUDED, BLOCKED, ALLOWED).alias("url_class"),
        key.alias("post_key")
    )


def allowed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    path = F.concat(
        F.lit("api/"), "event_type", F.lit("__"), (F.col("user_id") % 10).cast("string"), F.lit("__"), F.lpad(F.col("event_id").cast("string"), 9, "0"),
        F.lit(".json")
    )
    return capture.payloads(e.select(path.alias("path"), F.col("props").alias("content")), PREFIXES, LABELS)


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"),
        F.concat(F.lit("mail "), F.col("doc_id").cast("string"), F.lit("."), (F.col("doc_id") % 12).cast("string")).alias("name")
    )
    return capture.with_natural_rank(d, "source", "name").select("doc_id", "name", F.col("natural_rank").cast("long").alias("natural_rank"))


def repair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 4 == 0, "resolved").when(F.col("event_id") % 4 == 1, "running").otherwise("open")
    entries = e.select(F.col("event_id").alias("entry"), state.alias("state"), (F.col("user_id") % 13).alias("attempts"), F.col("ts").alias("updated_at"))
    return capture.repair_order(entries, ("open", "running"), 99).select("entry", "attempts", F.col("place").cast("long").alias("place"))


def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of a customer from the last to the first, the pages of each forward."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("l_orderkey"), "l_linenumber"))
    return lines.select("o_custkey", "l_orderkey", "l_linenumber", place.cast("long").alias("place"))


def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten orders for each customer, with or without orders."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    planned = capture.page_plan(c.select("c_custkey", F.coalesce("total", F.lit(0)).alias("total"), F.lit(10).alias("size")), "total", "size")
    return planned.select(
        "c_custkey", "total", "page", F.least(F.lit(10), F.greatest(F.col("total") - (F.col("page") - 1) * 10, F.lit(0))).cast("long").alias("rows")
    )


def top_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return capture.template_of(n, "user_id", "event_type", "n")


def hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects; labels tell another place of those they cover, the higher id last."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")
    d = table(spark, sf_dir, "documents")
    told = table(spark, sf_dir, "labels").join(d, "doc_id").select(
        sha, F.concat(F.lit("index/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("position")
    )
    return capture.hash_index(d.select(sha, F.concat(F.lit("objects/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path")), told)


def reuse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against bodies known from even shelves and sources seen before with several codes."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), urls.identity(F.col("url")).alias("source_identity"))
    index = p.filter("substring(sha256, 1, 1) IN ('0', '2', '4')")
    seen = p.select(
        "source_identity", (F.lit(200) + F.col("page_id") % 3 * 102).cast("int").alias("status"), (F.col("page_id") % 4).alias("size"),
        (F.col("page_id") % 5 != 0).alias("verified")
    )
    return capture.reuse(p.withColumnRenamed("page_id", "response_id"), index, seen)


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("folder"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("name"), "l_returnflag"
    )
    return lines.select("folder", "name"), lines.filter("l_returnflag <> 'R' OR folder % 2 = 0").select("folder", "name")


def folder_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders of parts; returned parts of odd orders were not there before."""
    return capture.listing_changes(*_listings(spark, sf_dir))[0].select("folder", F.col("names").alias("names"), "state")


def folder_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.listing_changes(*_listings(spark, sf_dir))[1]


def frozen_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as baseline files; what is expected lacks some, names pages that are not there, and some changed since."""
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("baseline/"), F.col("doc_id").cast("string")).alias("rel"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"),
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 50_000).alias("bytes"), "doc_id"
    )
    told = files.select(
        "rel", F.when(F.col("doc_id") % 6 == 0, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), "doc_id"
    ).filter("doc_id % 5 <> 0").drop("doc_id")
    more = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("rel"), F.lit("1").alias("sha256"))
    return capture.frozen(files.drop("doc_id"), told.unionByName(more))


def related_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws(" ", "text", F.concat(F.lit("see https://files.example.com/"), F.col("source"), F.lit(" and http://ai.example/x?token="), F.col("doc_id").cast("string"), F.lit(" or https://files.example.com/"), F.col("source"))).alias("text")
    )
    return capture.related_resources(d, "doc_id", "text", BLOCKED)


def attempt_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    status = F.when(F.length("text") % 9 == 0, "unavailable").when(F.length("text") % 4 == 0, "deleted").otherwise("available")
    return capture.attempts(c.select("conv_id", status.alias("status")), "conv_id", "status")


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are sessions, equal properties are equal bytes."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.sha2(F.coalesce("props", F.lit("")), 256).alias("sha"))
    return capture.session_counters(e, "event_type", "event_id", "sha")


def advance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return capture.advance(e, "user_id", "ts", 3600, F.col("event_type") == "purchase").select("event_id", "decision")


def written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are tasks, labels their results."""
    task = lambda c: F.concat(F.lit("task-"), c.cast("string"))
    tasks = table(spark, sf_dir, "documents").select(
        task(F.col("doc_id")).alias("task_id"), F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("running").alias("state")
    )
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    results = one.select(
        task(F.col("doc_id")).alias("task_id"), (F.col("quality") == 1).alias("ok"),
        F.when(F.col("quality") == 0, F.when(F.col("toxic") == 1, "SOURCE_BLOCKED").otherwise("READER_FAILED")).alias("error_code"),
        F.sha2(F.col("doc_id").cast("string"), 256).alias("output_sha256")
    )
    strange = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("task_id"), F.lit(True).alias("ok"),
        F.lit(None).cast("string").alias("error_code"), F.lit("x").alias("output_sha256")
    )
    return capture.written_back(tasks, results.unionByName(strange))


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are pages, lines are word boxes, and each page has the cells of a table that leaves a gap on the right."""
    lines = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") * 37 % 130, F.col("l_suppkey") * 53 % 100
    boxes = lines.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("box_id"), F.col("l_orderkey").alias("page"),
        x.alias("x0"), y.alias("y0"), (x + 3 + F.col("l_linenumber") * 4).alias("x1"), (y + 5).alias("y1")
    )
    cell = F.explode(F.sequence(F.lit(0), F.lit(7)))
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), cell.alias("cell_id"))
    left, top = F.col("cell_id") % 4 * 25, F.floor(F.col("cell_id") / 4) * 40
    grid = cells.select("page", "cell_id", left.alias("x0"), top.alias("y0"), (left + 20 + F.col("cell_id")).alias("x1"), (top + 40).alias("y1"))
    return capture.boxes_in_cells(boxes, grid)


def message_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are messages; the turns of their users are sources, of which each must have one."""
    c = table(spark, sf_dir, "conversations")
    return capture.matched_sources(c, c.filter("role = 'user'"), "conv_id")


def mail_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as mails of a manifest, with their document as detail and their event as time, where there are any."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("subject"))
    manifest = c.select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("mail"))
    detail = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("mail")).agg(F.min("lang").alias("lang"), F.max("n_chars").alias("chars"))
    time = table(spark, sf_dir, "events").select(F.col("event_id").alias("mail"), F.unix_micros(F.col("ts").cast("timestamp")).alias("sort_key"))
    joined = manifest.join(detail, "mail", "left").join(time, "mail", "left")
    status = F.when(F.col("lang").isNull(), "DETAIL_MISSING").when(F.col("sort_key").isNull(), "TIME_MISSING").otherwise("COMPLETE")
    return joined.select("mail", "conv_id", "turn", "lang", "chars", "sort_key", status.alias("status"))


def hit_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase, are attached (labelled) and stand in the list of files (pages), by three semi-joins."""
    d = table(spark, sf_dir, "documents")
    folded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    hits = d.filter(folded.contains(" the ")).select("doc_id", "source")
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return hits.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").join(files, "doc_id", "left_semi")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined with their stored text on four keys, and whether the keys name one text each."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    keys = (
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("source_rel"), F.sha2(text, 256).alias("source_sha256"),
        F.concat(F.lit("text/"), F.col("doc_id").cast("string")).alias("artifact_rel"), F.coalesce("lang", F.lit("")).alias("task_kind")
    )
    on = ["source_rel", "source_sha256", "artifact_rel", "task_kind"]
    documents, stored = d.select("doc_id", *keys), d.select(*keys, text.alias("text")).groupBy(*on).agg(F.min("text").alias("text"), F.count("*").alias("texts"))
    return documents.join(stored, on).select("doc_id", F.length("text").cast("long").alias("text_chars"), (F.col("texts") == 1).alias("unique"))


def report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and the largest file of each source, the heaviest first."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    facts = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("files"), F.sum(size).cast("long").alias("total_bytes"), F.max(size).cast("long").alias("largest")
    )
    return facts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total_bytes"), "source")).cast("long"))


def attachment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as attachments, by kind: how many, their distinct orders and customers, and the bytes of distinct parts."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.octet_length("p_name").alias("bytes"))
    each = lines.join(parts, "l_partkey").groupBy("p_brand").agg(
        F.count("*").alias("occurrences"), F.countDistinct("l_orderkey").alias("mails"), F.countDistinct("o_custkey").alias("customers")
    )
    return each.join(parts.groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("bytes").cast("long").alias("bytes")), "p_brand")


def case_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases: the states of their orders as a set, the newest order and whether all are finished."""
    o = table(spark, sf_dir, "orders")
    newest = F.max(F.struct("o_orderdate", "o_orderkey"))
    found = o.groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"), newest.alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("orders")
    )
    cases = table(spark, sf_dir, "customer").select("c_custkey").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    return cases.select(
        "c_custkey", F.coalesce("states", F.lit("")).alias("states"), F.col("n.o_orderkey").alias("newest_order"),
        F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.coalesce(F.col("finished") == F.col("orders"), F.lit(False)).alias("complete")
    )


def configured_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the dedicated list and, of configured kinds, of the broad one, each once."""
    broad = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase")).select(F.col("event_id").alias("id"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(broad).distinct()


def section_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of customers: orders, an empty list of missing paths and their segment, routed by the name of the section."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    body = F.to_json(F.struct(
        F.coalesce("orders", F.array().cast("array<long>")).alias("order_list"), F.array().cast("array<string>").alias("missing_paths"),
        F.col("c_mktsegment").alias("customer_type"), F.struct(F.col("c_nationkey").alias("nation")).alias("needs")
    ))
    found = capture.section_records(c.select("c_custkey", body.alias("body")), "c_custkey", "body")
    return found.select(
        "c_custkey", "section", F.col("item_index").cast("long").alias("item_index"), "value", field_route(F.col("section"), F.lit("summary")).alias("route")
    )


def resource_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say of the file behind their url; the last that says something leads."""
    p = table(spark, sf_dir, "pages")
    found = p.select(
        urls.base_of(F.col("url")).alias("url"), "page_id",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("f"), F.col("page_id").cast("string"))).alias("filename"),
        F.when(F.col("page_id") % 3 != 0, "text/html").alias("mime"), F.when(F.col("page_id") % 5 != 0, F.octet_length("html").cast("long")).alias("size")
    )
    return capture.resource_facts(found, "url", "page_id")


def attachment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mails with three lists of attachments, some without a name."""
    c = table(spark, sf_dir, "conversations")
    item = lambda k: F.array(F.struct(F.concat(F.lit("https://files.example.com/"), (F.col("turn") * k % 7).cast("string")).alias("url"), F.when(F.col("conv_id") % k != 0, F.concat(F.lit("file "), (F.col("conv_id") % k).cast("string"))).otherwise(" ").alias("name")))
    mails = c.select("conv_id", item(2).alias("a"), F.when(F.col("turn") > 1, item(3)).alias("b"), item(5).alias("c"))
    return capture.attachment_names(mails, "conv_id", ["a", "b", "c"])


def pointer_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose property, read again at its pointer, is not what was recorded; every hundredth record was altered."""
    e = table(spark, sf_dir, "events")
    recorded = F.from_json("props", "k long")["k"] + F.when(F.col("event_id") % 100 == 0, 1).otherwise(0)
    again = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", recorded.alias("recorded"), again.alias("resolved")).filter(F.sha2(F.col("recorded").cast("string"), 256) != F.sha2(F.col("resolved").cast("string"), 256))


QUERIES = {f.__name__: f for f in (
    url_classes, allowed_payloads, natural_order, repair_order, stage_order, page_plan, top_template, hash_index, reuse_decisions, folder_states, folder_scans, frozen_baseline, related_resources,
    attempt_counters, session_counters, advance_decisions, written_back, cell_boxes, message_sources, mail_details, hit_attachments, document_texts, report_facts, attachment_summary, case_sets,
    configured_ids, section_records, resource_facts, attachment_names, pointer_recheck,
)}

_BASE = "regexp_replace(url, '[?#].*$', '')"
_LISTINGS = """now AS (SELECT l_orderkey AS folder, 'part-' || l_partkey AS name, l_returnflag FROM lineitem), old AS (SELECT folder, name FROM now WHERE l_returnflag <> 'R' OR folder % 2 = 0)"""
_FILES = "'https://files.example.com/'"

ORACLES = {
    "url_classes": rf"""WITH r AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://chat.ai.example' || t WHEN 1 THEN 'https://www.google-analytics.com' || t WHEN 2 THEN 'https://EXAMPLE.com/Trade/Info' || t
  WHEN 3 THEN 'https://api.example.net/api/orderRead' || t WHEN 4 THEN 'https://x.sensorsdata.example' || t WHEN 5 THEN 'not a url' || t WHEN 6 THEN 'https://cdn.example.org:8443/api/tradedata2' || t ELSE url END AS url,
  page_id % 3 = 0 AS posted, CASE WHEN page_id % 5 <> 0 THEN sha256(url) END AS body FROM (SELECT *, '/' || page_id || '?b=2&a=1' AS t FROM pages)),
h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract({_BASE}, '^[a-z]+://[^/]*(.*)$', 1) AS path FROM r),
c AS (SELECT *, CASE WHEN host = '' THEN 'invalid' WHEN regexp_matches(host, '(^|\.)(ai|assistant)\.example$') THEN 'blocked' WHEN host LIKE '%sensorsdata%' OR regexp_matches(host, '(^|\.)google-analytics\.com$') THEN 'telemetry'
  WHEN regexp_matches(lower(path), '^(/api/tradedata|/trade/info)(/|$)') THEN 'excluded' WHEN regexp_matches(path, '^/api/[^/]*Read/[^/]+$') THEN 'read_only_api' WHEN regexp_matches(host, '(^|\.)example\.(com|org)$') THEN 'allowed' ELSE 'other' END AS url_class FROM h)
SELECT page_id, host, path, url_class, CASE WHEN posted AND body IS NOT NULL AND url_class = 'read_only_api' THEN 'POST' || chr(10) || {_BASE} || '?a=1&b=2' || chr(10) || body END AS post_key FROM c""",
    "allowed_payloads": """WITH f AS (SELECT 'api/' || event_type || '__' || user_id % 10 || '__' || lpad(event_id::varchar, 9, '0') || '.json' AS path, (user_id % 10)::varchar AS label, sha256(props) AS sha256
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'login') AND user_id % 10 IN (1, 2, 3, 5, 8))
SELECT sha256, min(path) AS path, arg_min(label, path) AS label, count(*) - 1 AS duplicates FROM f GROUP BY 1""",
    "natural_order": """SELECT doc_id, 'mail ' || doc_id || '.' || doc_id % 12 AS name, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id, doc_id % 12) AS natural_rank FROM documents""",
    "repair_order": "SELECT event_id AS entry, user_id % 13 AS attempts, row_number() OVER (ORDER BY user_id % 13, ts, event_id) AS place FROM events WHERE event_id % 4 <> 0 AND user_id % 13 < 10",
    "stage_order": "SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey DESC, l_linenumber) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "page_plan": """WITH t AS (SELECT c_custkey, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT c_custkey, total, unnest(range(1, greatest(1, ceil(total / 10))::int + 1)) AS page FROM t)
SELECT c_custkey, total, page::int AS page, least(10, greatest(0, total - (page - 1) * 10))::bigint AS rows FROM p""",
    "top_template": """SELECT user_id, event_type AS template, n AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
    "hash_index": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents), o AS (SELECT sha256, min('objects/' || lpad(doc_id::varchar, 12, '0')) AS p FROM d GROUP BY 1),
t AS (SELECT sha256, max(doc_id) AS i FROM d JOIN labels USING (doc_id) GROUP BY 1)
SELECT sha256, coalesce('index/' || i, p) AS path, CASE WHEN i IS NULL THEN 'object' ELSE 'index' END AS origin FROM o LEFT JOIN t USING (sha256)""",
    "reuse_decisions": """WITH p AS (SELECT page_id, sha256(html) AS h, sha256(url) AS s FROM pages), i AS (SELECT h FROM p WHERE h[1] IN ('0', '2', '4')), g AS (SELECT s FROM p WHERE page_id % 3 = 0 AND page_id % 4 > 0 AND page_id % 5 <> 0)
SELECT page_id AS response_id, CASE WHEN h IN (FROM i) THEN 'reuse_bytes' WHEN s IN (FROM g) THEN 'skip_download' ELSE 'store' END AS decision FROM p""",
    "folder_states": f"""WITH {_LISTINGS}, a AS (SELECT folder, list_sort(list(DISTINCT name)) AS n FROM now GROUP BY 1), b AS (SELECT folder, list_sort(list(DISTINCT name)) AS m FROM old GROUP BY 1)
SELECT folder, len(n) AS names, CASE WHEN m IS NULL THEN 'new' WHEN n = m THEN 'cached' ELSE 'changed' END AS state FROM a LEFT JOIN b USING (folder)""",
    "folder_scans": f"WITH {_LISTINGS} SELECT folder, name FROM now EXCEPT SELECT folder, name FROM old",
    "frozen_baseline": """WITH f AS (SELECT 'baseline/' || doc_id AS rel, doc_id, strlen(coalesce(text, '')) * 50000 AS bytes FROM documents)
SELECT rel, CASE WHEN doc_id % 5 = 0 THEN 'unlisted' WHEN doc_id % 6 = 0 THEN 'hash_mismatch' WHEN bytes <= 67108864 THEN 'copied' ELSE 'bound_by_hash' END AS state FROM f UNION ALL SELECT 'pages/' || page_id, 'missing' FROM pages""",
    "related_resources": rf"""WITH d AS (SELECT doc_id, concat_ws(' ', text, 'see https://files.example.com/' || source || ' and http://ai.example/x?token=' || doc_id || ' or https://files.example.com/' || source) AS t FROM documents),
u AS (SELECT doc_id, unnest(regexp_extract_all(t, '((?:http|HTTP)[sS]?://[^\s<>"''`}}\]]+)', 1)) AS url, generate_subscripts(regexp_extract_all(t, '((?:http|HTTP)[sS]?://[^\s<>"''`}}\]]+)', 1), 1) - 1 AS place FROM d),
k AS (SELECT * FROM u WHERE NOT regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '(^|\.)(ai|assistant)\.example$'))
SELECT doc_id, sha256(url) AS identity, url, min(place)::bigint AS place FROM k GROUP BY ALL""",
    "attempt_counters": """WITH s AS (SELECT conv_id, CASE WHEN length(text) % 9 = 0 THEN 'u' WHEN length(text) % 4 = 0 THEN 'd' ELSE 'a' END AS s FROM conversations)
SELECT conv_id, count(*) AS attempted, count(*) FILTER (s = 'a') AS available, count(*) FILTER (s = 'd') AS deleted, count(*) FILTER (s = 'u') AS unavailable, count(*) FILTER (s = 'u') = 0 AS closed FROM s GROUP BY 1""",
    "session_counters": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY coalesce(props, '') ORDER BY event_id) AS n FROM events)
SELECT event_type, count(*) AS rows, min(event_id) AS first_sequence, max(event_id) AS last_sequence, count(*) FILTER (n = 1) AS new_objects, count(*) FILTER (n > 1) AS deduplicated FROM e GROUP BY 1""",
    "advance_decisions": """WITH e AS (SELECT event_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events)
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'stop' WHEN gap IS NULL OR gap >= 3600000000 THEN 'advance' ELSE 'ignore' END AS decision FROM e""",
    "written_back": """WITH t AS (SELECT 'task-' || doc_id AS task_id, doc_id % 3 <> 0 AS running FROM documents),
r AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1)
SELECT task_id, CASE WHEN NOT running THEN 'pending' WHEN q = 1 THEN 'completed' WHEN q = 0 AND x = 1 THEN 'source_gap' WHEN q = 0 THEN 'failed' ELSE 'running' END AS state,
  CASE WHEN running AND q = 0 THEN CASE WHEN x = 1 THEN 'SOURCE_BLOCKED' ELSE 'READER_FAILED' END END AS error_code, CASE WHEN running AND q = 1 THEN sha256(doc_id::varchar) END AS output_sha256
FROM t LEFT JOIN r ON task_id = 'task-' || doc_id
UNION ALL SELECT 'task-' || doc_id, 'unknown_task', NULL, NULL FROM r WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'nation-' || n_nationkey, 'unknown_task', NULL, NULL FROM nation""",
    "cell_boxes": """WITH b AS (SELECT l_orderkey || '/' || l_linenumber AS box_id, l_orderkey AS page, l_partkey * 37 % 130 AS x0, l_suppkey * 53 % 100 AS y0, l_partkey * 37 % 130 + 3 + l_linenumber * 4 AS x1, l_suppkey * 53 % 100 + 5 AS y1 FROM lineitem),
c AS (SELECT i AS cell_id, i % 4 * 25 AS cx0, i // 4 * 40 AS cy0, i % 4 * 25 + 20 + i AS cx1, i // 4 * 40 + 40 AS cy1 FROM range(8) t(i)),
m AS (SELECT box_id, cell_id, (x0 + x1) / 2 BETWEEN cx0 AND cx1 AND (y0 + y1) / 2 BETWEEN cy0 AND cy1 AS inside, (cx1 - cx0) * (cy1 - cy0) AS area, greatest(0, least(x1, cx1) - greatest(x0, cx0)) * greatest(0, least(y1, cy1) - greatest(y0, cy0)) AS shared FROM b CROSS JOIN c),
r AS (SELECT box_id, cell_id, inside, shared, row_number() OVER (PARTITION BY box_id ORDER BY NOT inside, CASE WHEN inside THEN area ELSE -shared END, cell_id) AS n FROM m)
SELECT box_id, CASE WHEN inside OR shared > 0 THEN cell_id::int END AS cell_id, CASE WHEN inside THEN 'centre' WHEN shared > 0 THEN 'overlap' ELSE 'none' END AS how FROM r WHERE n = 1""",
    "message_sources": """SELECT conv_id, count(*) FILTER (role = 'user') AS sources, CASE count(*) FILTER (role = 'user') WHEN 0 THEN 'missing' WHEN 1 THEN 'matched' ELSE 'duplicate' END AS match FROM conversations GROUP BY 1""",
    "mail_details": """WITH m AS (SELECT DISTINCT conv_id, turn, conv_id * 10 + turn AS mail FROM conversations), d AS (SELECT doc_id, min(lang) AS lang, max(n_chars) AS chars FROM documents GROUP BY 1)
SELECT mail, conv_id, turn, lang, chars, epoch_us(ts) AS sort_key, CASE WHEN lang IS NULL THEN 'DETAIL_MISSING' WHEN ts IS NULL THEN 'TIME_MISSING' ELSE 'COMPLETE' END AS status FROM m LEFT JOIN d ON doc_id = mail LEFT JOIN events ON event_id = mail""",
    "hit_attachments": r"""SELECT doc_id, source FROM documents WHERE contains(' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' the ') AND doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT page_id FROM pages)""",
    "document_texts": """SELECT doc_id, length(coalesce(text, '')) AS text_chars, count(*) OVER (PARTITION BY doc_id, coalesce(text, ''), coalesce(lang, '')) = 1 AS "unique" FROM documents""",
    "report_facts": """WITH f AS (SELECT coalesce(source, 'unknown') AS source, count(*) AS files, sum(strlen(coalesce(text, '')))::bigint AS total_bytes, max(strlen(coalesce(text, '')))::bigint AS largest FROM documents GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY total_bytes DESC, source) AS place FROM f""",
    "attachment_summary": """WITH p AS (SELECT p_brand, count(*) AS parts, sum(strlen(p_name))::bigint AS bytes FROM part GROUP BY 1)
SELECT p_brand, count(*) AS occurrences, count(DISTINCT l_orderkey) AS mails, count(DISTINCT o_custkey) AS customers, any_value(p.parts) AS parts, any_value(p.bytes) AS bytes
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN p USING (p_brand) GROUP BY 1""",
    "case_sets": """SELECT c_custkey, coalesce(array_to_string(list_sort(list(DISTINCT o_orderstatus)), ','), '') AS states, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest_order, count(o_orderkey) AS orders,
  count(o_orderkey) > 0 AND count(*) FILTER (o_orderstatus = 'F') = count(o_orderkey) AS complete FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "configured_ids": "SELECT doc_id AS id FROM labels UNION SELECT event_id FROM events WHERE event_type IN ('click', 'view', 'purchase')",
    "section_records": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT c_custkey, 'order_list' AS section, i AS item_index, coalesce(o_orderkey::varchar, '[]') AS value, 'transactions_operations' AS route FROM customer LEFT JOIN o ON o_custkey = c_custkey
UNION ALL SELECT c_custkey, 'missing_paths', NULL, '[]', 'conflicts_missing_paths' FROM customer
UNION ALL SELECT c_custkey, 'customer_type', NULL, c_mktsegment, 'customer_type_roles' FROM customer
UNION ALL SELECT c_custkey, 'needs', NULL, '{"nation":' || c_nationkey || '}', 'needs_pain_focus' FROM customer""",
    "resource_facts": f"""SELECT {_BASE} AS url, arg_max('f' || page_id, page_id) FILTER (page_id % 2 = 0) AS filename, max('text/html') FILTER (page_id % 3 <> 0) AS mime, arg_max(strlen(html), page_id) FILTER (page_id % 5 <> 0) AS size FROM pages GROUP BY 1""",
    "attachment_names": f"""WITH a AS (SELECT conv_id, {_FILES} || turn * k % 7 AS url, CASE WHEN conv_id % k <> 0 THEN 'file ' || conv_id % k END AS name FROM conversations, (VALUES (2), (3), (5)) v(k) WHERE k <> 3 OR turn > 1)
SELECT sha256(url) AS identity, array_to_string(list_sort(list(DISTINCT name)), '|') AS names, count(DISTINCT conv_id) AS mails FROM a WHERE name IS NOT NULL GROUP BY 1""",
    "pointer_recheck": """SELECT event_id, (props->>'$.k')::bigint + 1 AS recorded, (props->>'$.k')::bigint AS resolved FROM events WHERE event_id % 100 = 0 AND props->>'$.k' IS NOT NULL""",
}
