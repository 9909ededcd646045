"""Evidence queries: line items of tables, amounts, nested archives, bindings of manifests, paths, denied terms, reuse of results."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text, urls
from quarrystone.operators import content, reconcile, tables
from quarrystone.plans.content_queries import tasks
from quarrystone.plans.tables import table
from quarrystone.sources import archives, files
from quarrystone.sources.scratch import kept

DENIED = ("idiot", "Password", "the of")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables: an empty row, a title, a header, the lines, and a sum that is no item.  Orders divisible by nine have no header."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    word = lambda c: F.col(c).cast("string")
    cents = F.concat(F.floor("l_quantity").cast("long").cast("string"), F.lit(",000.50"))
    row = lambda place, *cells: F.struct(F.lit(place).cast("long").alias("place"), F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells)).alias("cells"))
    head = F.when(
        F.col("l_orderkey") % 9 == 0, F.array(F.lit("Remarks"), F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    ).otherwise(F.array(F.lit("Part No"), F.lit(" Goods  "), F.lit("Qty"), F.lit("Unit"), F.lit("Amount")))
    frame = orders.select(
        "l_orderkey",
        F.explode(F.array(row(0, "", " "), row(1, F.concat(F.lit("Order "), word("l_orderkey"))), F.struct(F.lit(2).cast("long").alias("place"), head.alias("cells")), row(10**17, "Sub total", "", "", "", "99"))).alias("r")
    )
    items = lines.select(
        "l_orderkey",
        F.struct((F.col("l_linenumber") * 10**13 + F.col("l_partkey") * 10**6 + F.col("l_suppkey") + 10).cast("long").alias("place"), F.array(word("l_partkey"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.concat(F.lit("part\n"), word("l_suppkey"))), F.floor("l_quantity").cast("long").cast("string"), F.lit("pcs"), F.when(F.col("l_linenumber") == 2, F.concat(F.lit("("), cents, F.lit(")"))).otherwise(cents)).alias("cells")).alias("r")
    )
    rows = frame.unionByName(items).select("l_orderkey", "r.place", "r.cells")
    return tables.line_items(rows, "l_orderkey", "place", "cells").withColumn("source_row", F.col("source_row").cast("long"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as running text with a subtotal, a tax, two totals and no discount."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey").cast("string")
    body = F.concat(
        F.lit("Sub total: USD "), n, F.lit(",125.5\nVAT "), F.col("o_custkey").cast("string"), F.lit("\nTotal amount EUR "), n,
        F.lit(" carried over, grand total ... "), n, F.lit(".75 in all")
    )
    found = {"subtotal": (False,), "tax": (False,), "discount": (False,), "total": (True,)}
    return o.select(
        "o_orderkey", *(tables.labelled_amount(body, label, *last).alias(label) for label, last in found.items()),
        tables.labelled_amount(body, "total").alias("first_total")
    )


def archive_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in archives of their region, each inside four more archives: what lies deeper than is opened is told."""

    def nested(key, rows: pd.DataFrame) -> pd.DataFrame:
        raw = b""
        for level in range(5):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                if level == 0:
                    for k, name in sorted(zip(rows["n_nationkey"], rows["n_name"])):
                        z.writestr(zipfile.ZipInfo(f"{k}.txt"), name)
                else:
                    z.writestr(zipfile.ZipInfo(f"level{level}.zip"), raw)
                    z.writestr(zipfile.ZipInfo(f"note{level}.txt"), f"region {key[0]}")
            raw = out.getvalue()
        return pd.DataFrame({"path": [f"region-{key[0]}.zip"], "content": [raw]})

    made = table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(nested, "path string, content binary")
    return archives.tree(kept(made, "archives")).select(
        "path", "depth", "member_index", "member_path", F.when(F.col("member_path").endswith(".txt"), F.col("sha256")).alias("text_sha256"), "error"
    )


def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as manifests of the orders (mails) and parts (resources) they hold; some counts, hashes and sizes are wrong."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("manifest_id"))
    rel = F.concat(F.lit("parts/"), F.col("l_partkey").cast("string"))
    held = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select(
        "manifest_id", F.col("l_orderkey").alias("mail_id"), rel.alias("artifact_rel"),
        F.when(F.col("l_partkey") % 50 == 1, F.lit("x")).otherwise(F.sha2(rel, 256)).alias("sha256"), (F.col("l_partkey") % 7).cast("long").alias("bytes")
    )
    told = held.groupBy("manifest_id").agg(F.countDistinct("mail_id").alias("m"), F.count("*").alias("r")).select(
        "manifest_id", (F.col("m") + (F.col("manifest_id") % 10 == 0).cast("int")).alias("mails"),
        (F.col("r") + (F.col("manifest_id") % 15 == 4).cast("int")).alias("resources")
    )
    key = F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"))
    there = table(spark, sf_dir, "part").filter("p_size <= 45").select(
        key.alias("artifact_rel"), F.sha2(key, 256).alias("sha256"),
        F.when(F.col("p_partkey") % 60 == 2, 99).otherwise(F.col("p_partkey") % 7).cast("long").alias("bytes")
    )
    return files.manifest_faults(told, held, there)


def package_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of seven kinds, some of which lead out of a package."""
    n = F.col("doc_id").cast("string")
    kinds = (
        F.concat(F.lit("a/"), n), F.concat(F.lit("a\\b\\"), n), F.concat(F.lit("../"), n), F.concat(F.lit("/etc/"), n), F.concat(F.lit("C:\\x\\"), n),
        F.concat(F.lit("/case/./d//"), n), F.concat(F.lit("/case/../"), n)
    )
    path = F.element_at(F.array(*kinds), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), text.safe_relative(path).alias("relative"), text.resolved_inside("/case", path).alias("inside")
    )


def denied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "body"))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), text.denied_terms(F.col("body"), DENIED).alias("terms")).filter("terms <> ''")


def failure_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed requests covered by successes on four keys, the exact one first: url, read-only post, the url without its signature, its path."""
    p = table(spark, sf_dir, "pages")
    signed = F.concat(
        urls.base_of(F.col("url")), F.lit("?v="), (F.col("page_id") % 3).cast("string"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&Expires="), F.col("page_id").cast("string"))).otherwise("")
    )
    body = F.when(F.col("page_id") % 5 == 0, F.lit("b"))
    post = F.concat(F.lit("https://x.example/api/orderRead/list?p="), (F.col("page_id") % 11).cast("string"))
    keyed = p.select(
        "page_id", (F.col("page_id") % 4 == 0).alias("failed"), urls.canonical(signed).alias("get_key"),
        urls.read_only_post_key(F.lit("POST"), post, body, ()).alias("post_key"),
        F.coalesce(urls.signed_variant(signed), urls.canonical(signed)).alias("variant_key"), urls.alias_key(F.col("url")).alias("alias_key")
    )
    found = reconcile.covered_failures(keyed.filter("failed"), keyed.filter("NOT failed"), ["get_key", "post_key", "variant_key", "alias_key"])
    return found.select("page_id", "covered_by")


def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ids of some tables stand to each other."""
    ids = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id", "events": "event_id"}
    keyed = {name: table(spark, sf_dir, name).select(F.col(c).alias("id")) for name, c in ids.items()}
    pairs = [("documents", "documents"), ("labels", "documents"), ("documents", "labels"), ("pages", "labels"), ("events", "documents")]
    found = [reconcile.set_relation(keyed[a], keyed[b], "id").withColumn("pair", F.lit(f"{a}/{b}")) for a, b in pairs]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a flag, and suppliers, whose table has none."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).cast("int").alias("active"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return content.active_rows(c).select(F.lit("customer").alias("kind"), "id").unionByName(content.active_rows(s).select(F.lit("supplier").alias("kind"), "id"))


def task_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned tasks that take over prior results: some outputs are gone, some changed, and of several results the completed one leads."""
    planned = tasks(spark, sf_dir).select("sha256", "task_kind", "task_id")
    turn = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    digit = F.conv(F.substring("sha256", 1, 2), 16, 10).cast("int")
    rel = F.concat_ws("/", "task_kind", F.substring("sha256", 1, 12), F.col("turn").cast("string"))
    prior = planned.select("sha256", "task_kind", turn.alias("turn")).select(
        "sha256", "task_kind",
        F.when((digit + F.col("turn")) % 4 == 0, "failed").when((digit + F.col("turn")) % 4 == 1, "source_gap").otherwise("completed").alias("state"),
        F.col("turn").alias("updated_at"), rel.alias("output_rel"), F.sha2(rel, 256).alias("result_sha256"), digit.alias("digit")
    )
    outputs = prior.filter((F.col("digit") + F.col("updated_at")) % 3 != 0).select(
        "output_rel", F.when(F.col("digit") % 5 == 0, F.lit("changed")).otherwise(F.col("result_sha256")).alias("sha256")
    )
    return content.reused_tasks(planned, prior.drop("digit"), outputs).select("task_id", "state", "output_rel")


QUERIES = {
    f.__name__: f
    for f in (line_items, amounts, archive_tree, manifest_faults, package_paths, denied_lines, failure_keys, set_relations, active_customers, task_reuse)
}

_SETS = ("documents", "doc_id"), ("labels", "doc_id"), ("pages", "page_id"), ("events", "event_id")
_ID = dict(_SETS)


def _set_sql(a: str, b: str) -> str:
    left, right = f"SELECT {_ID[a]} FROM {a}", f"SELECT {_ID[b]} FROM {b}"
    return f"SELECT '{a}/{b}' AS pair, (SELECT count(*) FROM ({left} EXCEPT {right})) AS left_only, (SELECT count(*) FROM ({right} EXCEPT {left})) AS right_only, (SELECT count(*) FROM ({left} INTERSECT {right})) AS \"both\""


ORACLES = {
    "line_items": r"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + 2 AS source_row FROM lineitem WHERE l_orderkey % 9 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT l_orderkey, source_row, l_partkey::varchar AS sku, CASE WHEN l_linenumber = 3 THEN '' ELSE 'part ' || l_suppkey END AS description, '' AS spec, floor(l_quantity)::double AS quantity, 'pcs' AS unit, NULL::double AS unit_price,
  CASE WHEN l_linenumber = 2 THEN -1 ELSE 1 END * (CASE WHEN l_quantity >= 1 THEN floor(l_quantity) * 1000 ELSE 0 END + 0.5) AS line_amount, CASE WHEN l_linenumber = 3 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS review_status FROM l""",
    "amounts": """SELECT o_orderkey, (o_orderkey || '125.5')::double AS subtotal, o_custkey::double AS tax, NULL::double AS discount, (o_orderkey || '.75')::double AS total, (o_orderkey || '125.5')::double AS first_total FROM orders""",
    "archive_tree": """WITH r AS (SELECT DISTINCT n_regionkey AS k FROM nation), p AS (SELECT k, d, 'region-' || k || '.zip' || CASE d WHEN 1 THEN '' WHEN 2 THEN '!level4.zip' WHEN 3 THEN '!level4.zip!level3.zip' ELSE '!level4.zip!level3.zip!level2.zip' END AS path FROM r, range(1, 5) t(d))
SELECT path, d::int AS depth, 0 AS member_index, 'level' || (5 - d) || '.zip' AS member_path, NULL AS text_sha256, CASE WHEN d = 4 THEN 'ARCHIVE_DEPTH' END AS error FROM p
UNION ALL SELECT path, d::int, 1, 'note' || (5 - d) || '.txt', sha256('region ' || k), NULL FROM p""",
    "manifest_faults": """WITH h AS (SELECT o_custkey AS id, l_orderkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey), there AS (SELECT p_partkey FROM part WHERE p_size <= 45)
SELECT DISTINCT id AS manifest_id, '' AS artifact_rel, CASE WHEN id % 10 = 0 THEN 'MANIFEST_MAIL_COUNT' ELSE 'MANIFEST_RESOURCE_COUNT' END AS fault FROM h WHERE id % 10 = 0 OR id % 15 = 4
UNION ALL SELECT DISTINCT id, 'parts/' || l_partkey, CASE WHEN l_partkey NOT IN (FROM there) THEN 'MANIFEST_ARTIFACT_MISSING' WHEN l_partkey % 50 = 1 THEN 'MANIFEST_ARTIFACT_HASH' ELSE 'MANIFEST_ARTIFACT_BYTES' END
FROM h WHERE l_partkey NOT IN (FROM there) OR l_partkey % 50 = 1 OR l_partkey % 60 = 2""",
    "package_paths": r"""WITH d AS (SELECT doc_id, doc_id % 7 AS k, CASE doc_id % 7 WHEN 0 THEN 'a/' WHEN 1 THEN 'a\b\' WHEN 2 THEN '../' WHEN 3 THEN '/etc/' WHEN 4 THEN 'C:\x\' WHEN 5 THEN '/case/./d//' ELSE '/case/../' END || doc_id AS path FROM documents)
SELECT doc_id, path, CASE k WHEN 0 THEN 'a/' || doc_id WHEN 1 THEN 'a/b/' || doc_id END AS relative, CASE k WHEN 0 THEN '/case/a/' || doc_id WHEN 1 THEN '/case/a/b/' || doc_id WHEN 5 THEN '/case/d/' || doc_id END AS inside FROM d""",
    "denied_lines": """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, array_to_string(list_filter(['idiot', 'Password', 'the of'], lambda t: contains(lower(body), lower(t))), ',') AS terms FROM l WHERE contains(lower(body), 'idiot') OR contains(lower(body), 'password') OR contains(lower(body), 'the of')""",
    "failure_keys": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, page_id % 3 AS v, page_id % 2 = 0 AS signed, page_id % 5 = 0 AS posted, page_id % 11 AS q, page_id % 4 = 0 AS failed FROM pages),
k AS (SELECT *, base || '?' || CASE WHEN signed THEN 'Expires=' || page_id || '&' ELSE '' END || 'v=' || v AS g, CASE WHEN posted THEN q END AS o, base || '?v=' || v AS s, regexp_extract(base, '^[a-z]+://[^/]*(.*)$', 1) AS a FROM p), ok AS (SELECT * FROM k WHERE NOT failed)
SELECT page_id, CASE WHEN g IN (SELECT g FROM ok) THEN 'get_key' WHEN o IN (SELECT o FROM ok WHERE o IS NOT NULL) THEN 'post_key' WHEN s IN (SELECT s FROM ok) THEN 'variant_key' WHEN a IN (SELECT a FROM ok) THEN 'alias_key' ELSE 'uncovered' END AS covered_by FROM k WHERE failed""",
    "set_relations": '''SELECT *, CASE WHEN left_only = 0 AND right_only = 0 THEN 'equal' WHEN left_only = 0 THEN 'subset' WHEN right_only = 0 THEN 'superset' WHEN "both" = 0 THEN 'disjoint' ELSE 'overlap' END AS relation FROM ('''
    + " UNION ALL ".join(_set_sql(a, b) for a, b in (("documents", "documents"), ("labels", "documents"), ("documents", "labels"), ("pages", "labels"), ("events", "documents"))) + ")",
    "active_customers": "SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'supplier', s_suppkey FROM supplier",
    "task_reuse": """WITH f AS (SELECT sha256(coalesce(text, '')) AS sha, min(CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'image' WHEN 'fr' THEN 'office' ELSE 'other' END) AS c FROM documents GROUP BY 1),
t AS (SELECT sha, CASE c WHEN 'text' THEN 'extract_text' WHEN 'image' THEN 'ocr_image' WHEN 'office' THEN 'extract_office_xml' ELSE 'classify_binary' END AS kind, ('0x' || substr(sha, 1, 2))::int AS g FROM f),
p AS (SELECT *, CASE (g + n) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'source_gap' ELSE 'completed' END AS state, kind || '/' || substr(sha, 1, 12) || '/' || n AS rel FROM t, (VALUES (1), (2), (3)) v(n)),
s AS (SELECT * FROM p WHERE state <> 'failed' AND (g + n) % 3 <> 0 AND g % 5 <> 0), b AS (SELECT sha, kind, state, rel FROM s QUALIFY row_number() OVER (PARTITION BY sha, kind ORDER BY state <> 'completed', n DESC) = 1)
SELECT sha256('v2' || chr(0) || t.sha || chr(0) || t.kind) AS task_id, coalesce(b.state, 'pending') AS state, b.rel AS output_rel FROM t LEFT JOIN b ON b.sha = t.sha AND b.kind = t.kind""",
}
