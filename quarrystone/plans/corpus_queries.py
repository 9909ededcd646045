"""Reconciliation and corpus queries: orders are pages of a listing, documents field records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import classify, text, urls
from quarrystone.operators import corpus, packing, reconcile
from quarrystone.plans.tables import table


def _ascii(column: str) -> Column:
    """Other letters as x, so that words end at the same places for every reader of patterns."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\x00-\x7F]", "x")


def invoice_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with signs of invoices put between their words: how many groups of signs each text shows, and what follows."""
    signs = F.array(*(F.lit(x) for x in ("", " SELLER ", " Invoice  No. 5, unit price ", " date: qty 4 TOTAL ", " bill to: signed, exw $ ", "item amount incoterms\nstamp ", " p / i # cny Deposit authorized buyer model ")))
    t = _ascii("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.get(signs, (F.col("doc_id") % 7).cast("int")), t, F.get(signs, (F.floor(F.col("doc_id") / 7) % 7).cast("int"))).alias("text"))
    hit = F.contains("text", F.lit(" the "))
    return rows.select("doc_id", classify.invoice_groups(F.col("text")).alias("groups"), classify.invoice_status(F.col("text"), hit).alias("status"))


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with separators, parentheses and signs, read again in cents."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole = F.floor(cents / 100).cast("string")
    amount = F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ","), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.lit("("), amount, F.lit(")"))).when(k == 1, F.concat(F.lit("USD "), amount)).when(k == 2, F.concat(F.lit("€"), amount)).otherwise(F.lit("n/a"))
    parsed = F.round(classify.number(F.col("raw")) * 100).cast("long")
    return l.select("l_orderkey", "l_linenumber", raw.alias("raw")).select(
        "l_orderkey", "l_linenumber", parsed.alias("cents"), classify.currency(F.col("raw")).alias("currency")
    )


def _first_word() -> Column:
    return F.regexp_extract(F.lower(_ascii("text")), "([a-z]+)", 1)


def id_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of fields that begin with a word of the document, in places of its path."""
    keys = F.array(*(F.lit(k) for k in ("mail_id", "root_mail_id", "buyer_company_id", "email_message_id", "sku_id", "id", "orderid", "reply_to", "trade_doc_id", "valid", "xyz_id", "customs_shipment_id")))
    paths = F.array(F.lit("orders_"), F.lit("mails_"), F.lit("nothing_here_"))
    key = F.get(keys, (F.col("doc_id") % 12).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when((F.col("doc_id") % 2 == 1) & (key != "id"), F.concat(F.lit("x"), _first_word(), F.lit("_"), key)).otherwise(key).alias("key"),
        F.concat(F.get(paths, (F.floor(F.col("doc_id") / 12) % 3).cast("int")), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, F.lit("_products_1")).otherwise("")).alias("path")
    )
    context = classify.context_type(F.col("path"))
    return rows.select("doc_id", "key", "path", context.alias("context"), classify.id_type(F.col("key"), context).alias("id_type"))


def field_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections named after the beginning of a document and what its number makes of it."""
    names = F.array(*(
        F.lit(n)
        for n in ("missing_paths", "product_list", "procurement_habits", "pain_points", "timeline", "stakeholders", "order_history", "profile")
    ))
    kinds = F.array(*(F.lit(k) for k in ("mail", "mail", "mail", "vlm", "customs")))
    name = F.get(names, (F.col("doc_id") % 8).cast("int"))
    section = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace(F.lower(F.substring(_ascii("text"), 1, 60)), "[^a-z]+", "_")).otherwise(F.concat(_first_word(), F.lit("_"), name))
    d = table(spark, sf_dir, "documents").select("doc_id", section.alias("section"), F.get(kinds, (F.floor(F.col("doc_id") / 8) % 5).cast("int")).alias("kind"))
    return d.select("doc_id", "section", "kind", classify.field_route(F.col("section"), F.col("kind")).alias("route"))


def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", corpus.SHARD_CHARS).withColumnRenamed("doc_id", "position")


def pack_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a single group, small shards: the records, characters and first document of each."""
    d = table(spark, sf_dir, "documents").select(F.lit(1).alias("all"), "doc_id", "n_chars")
    shards = packing.packed(d, "all", "doc_id", "n_chars", 3000).join(d.select("doc_id", "n_chars"), "doc_id")
    return shards.groupBy("shard").agg(F.count("*").alias("records"), F.sum("n_chars").cast("long").alias("chars"), F.min("doc_id").alias("first_doc"))


def record_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = corpus.fragments(table(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    return pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), F.sha2("fragment", 256).alias("sha256"))


def exact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_union(table(spark, sf_dir, "documents"), "lang", F.coalesce("text", F.lit("")), "doc_id", "source")


def union_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.union_balance(exact_union(spark, sf_dir), "lang").select("lang", "records_in", "values_out", "duplicates")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of the listing of their order; every ninth row lost its id, and totals are one too high for some orders."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    total = l.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return l.join(total, "l_orderkey").select(
        "l_orderkey", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 9 != 0, F.col("l_partkey")).alias("item"),
        (F.col("n") + (F.col("l_orderkey") % 10 == 0).cast("int")).alias("announced"), "l_partkey", "l_suppkey"
    )


def pagination_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.pagination_summary(_listing(spark, sf_dir), "l_orderkey", "item", "announced")


def multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.sorted_fingerprint(
        table(spark, sf_dir, "lineitem"), "l_orderkey", F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    )


def summed_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.multiset_fingerprint(
        table(spark, sf_dir, "lineitem"), "l_partkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string"))
    )


def page_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over the listing; the second lost the third line of orders divisible by seven."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    identity = F.col("l_partkey").cast("string")
    second = l.filter("NOT (l_orderkey % 7 = 0 AND l_linenumber = 3)")
    found = reconcile.stable(
        reconcile.multiset_fingerprint(l, "l_orderkey", identity), reconcile.multiset_fingerprint(second, "l_orderkey", identity), "l_orderkey"
    )
    return found.groupBy("stable").agg(F.count("*").alias("orders"))


def bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.bijection(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def path_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are expected; labels and pages are there."""
    there = table(spark, sf_dir, "labels").select("doc_id").union(table(spark, sf_dir, "pages").select("page_id"))
    return reconcile.symmetric_difference(table(spark, sf_dir, "documents").select("doc_id"), there, "doc_id")


def _resources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages").select("page_id", urls.identity(F.col("url")).alias("identity"), urls.alias_key(F.col("url")).alias("alias"))
    artifacts = p.filter("page_id % 3 = 0").select(F.col("page_id").alias("artifact_id"), "identity", "alias", F.col("page_id").alias("sequence"))
    return p.withColumnRenamed("page_id", "resource_id"), artifacts, p.filter("page_id % 3 = 1").select("identity")


def resource_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.resolved_resources(*_resources(spark, sf_dir))


def failure_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("get_key"), urls.alias_key(F.col("url")).alias("alias_key"))
    found = reconcile.covered_failures(p.filter("page_id % 4 = 0"), p.filter("page_id % 4 <> 0"), ["get_key", "alias_key"])
    return found.select("page_id", "covered_by")


def repair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are repair entries: toxic is grave; a second batch observes every other one again."""
    base = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("entry")).agg(
        F.max("toxic").cast("int").alias("severity"), F.max("quality").alias("quality")
    )
    queue = base.select(
        "entry", "severity", (F.col("entry") % 100).alias("recorded"), (F.col("entry") % 4).alias("attempts"),
        F.when(F.col("quality") == 1, F.col("entry") % 130).alias("resolved_at")
    ).filter("entry % 3 <> 0")
    seen = base.filter("entry % 2 = 0").select(
        "entry", (F.col("severity") + (F.col("entry") % 4 == 0).cast("int")).alias("severity"), F.lit(110).cast("long").alias("recorded"),
        F.lit(1).cast("long").alias("attempts"), F.lit(None).cast("long").alias("resolved_at")
    )
    return reconcile.merged_repairs(queue, seen)


def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source before and after equal texts became one; a source of labelled documents is a metric of its own."""
    d = table(spark, sf_dir, "documents")
    old = d.groupBy("source").agg(F.count("*").alias("n"))
    new = d.groupBy("source").agg(F.countDistinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("n"))
    labelled = table(spark, sf_dir, "labels").join(d, "doc_id").groupBy(F.concat(F.lit("labelled "), "source").alias("source")).agg(F.count("*").alias("n"))
    return reconcile.metric_diff(old, new.unionByName(labelled))


def capped_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return reconcile.capped(c, [F.col("c_custkey")], 100)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signs of vectors, and of every tenth a later copy in which up to four of them are turned round."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", corpus.sign_bits(F.col("embedding")).alias("bits"))
    turned = F.when(F.col("vec_id") % 50 == 0, 0).when(F.col("vec_id") % 50 == 10, 1).when(F.col("vec_id") % 50 == 20, 1 + (1 << 20)).when(F.col("vec_id") % 50 == 30, 2 + (1 << 40) + (1 << 62)).otherwise(1 + 4 + (1 << 33) + (1 << 50))
    copies = e.filter("vec_id % 10 = 0").select("label", (F.col("vec_id") + 10_000_000).alias("vec_id"), F.col("bits").bitwiseXOR(turned.cast("long")).alias("bits"))
    return e.unionByName(copies)


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames: pairs of a label whose 64 signs differ in at most three bits."""
    return corpus.near_pairs(_frames(spark, sf_dir), "label", "vec_id", "bits")


def frames_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a label that differ in more than three of 64 signs from every frame kept before."""
    return corpus.kept_frames(_frames(spark, sf_dir), "label", "vec_id", "bits")


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.human_bytes(F.octet_length(F.coalesce("text", F.lit(""))).cast("double")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (invoice_classify, money_parse, id_infer, field_route, greedy_pack, pack_as_one, record_fragments, exact_union, union_balance, pagination_summary, multiset_fingerprint, summed_fingerprint, page_stability, bijection, path_difference, resource_resolution, failure_coverage, repair_merge, metric_diff, capped_payload, frame_pairs, frames_kept, size_labels)
}

_SIGNS = "e AS (SELECT vec_id, label, list_reduce(list_prepend(0::hugeint, list_transform(embedding, lambda x: (x > 0)::hugeint)), lambda a, x: a * 2 + x) AS b FROM embeddings), v AS (SELECT * FROM e UNION ALL SELECT vec_id + 10000000, label, xor(b, CASE vec_id % 50 WHEN 0 THEN 0 WHEN 10 THEN 1 WHEN 20 THEN 1048577 WHEN 30 THEN 4611687117939015682 ELSE 1125908496777221 END::hugeint) FROM e WHERE vec_id % 10 = 0)"
_CANON = r"""
q AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '')) AS pairs, url FROM pages),
k AS (SELECT page_id, url, CASE WHEN len(pairs) > 0 THEN base || '?' || array_to_string(pairs, '&') ELSE base END AS canonical, regexp_extract(base, '^[a-z]+://[^/]*(.*)$', 1) AS alias FROM q)"""

ORACLES = {
    "invoice_classify": r"""WITH s AS (SELECT ['', ' SELLER ', ' Invoice  No. 5, unit price ', ' date: qty 4 TOTAL ', ' bill to: signed, exw $ ', 'item amount incoterms' || chr(10) || 'stamp ', ' p / i # cny Deposit authorized buyer model '] AS s),
d AS (SELECT doc_id, s[doc_id % 7 + 1] || regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') || s[doc_id // 7 % 7 + 1] AS t FROM documents, s),
g AS (SELECT doc_id, t, """ + " + ".join(f"regexp_matches(t, '(?i){p}')::int" for p in classify.INVOICE_GROUPS.values()) + """ AS groups FROM d)
SELECT doc_id, groups, CASE WHEN contains(t, ' the ') AND groups >= 3 THEN 'CONFIRMED' ELSE 'SUSPECTED' END AS status FROM g""",
    "money_parse": """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN -round(l_extendedprice * 100)::bigint WHEN 3 THEN NULL ELSE round(l_extendedprice * 100)::bigint END AS cents,
CASE l_linenumber % 4 WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE '' END AS currency FROM lineitem""",
    "id_infer": r"""WITH k AS (SELECT ['mail_id', 'root_mail_id', 'buyer_company_id', 'email_message_id', 'sku_id', 'id', 'orderid', 'reply_to', 'trade_doc_id', 'valid', 'xyz_id', 'customs_shipment_id'] AS keys,
  ['mail', 'mail', 'company', 'mail', 'product', '*', 'order', NULL, 'trade_record', NULL, NULL, 'trade_record'] AS types, ['orders_', 'mails_', 'nothing_here_'] AS paths, ['order', 'mail', NULL] AS contexts),
d AS (SELECT doc_id, keys[doc_id % 12 + 1] AS k, types[doc_id % 12 + 1] AS t, paths[doc_id // 12 % 3 + 1] || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_products_1' ELSE '' END AS path,
  CASE WHEN doc_id % 5 = 0 THEN 'product' ELSE contexts[doc_id // 12 % 3 + 1] END AS context, regexp_extract(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g')), '([a-z]+)', 1) AS w FROM documents, k)
SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND k <> 'id' THEN 'x' || w || '_' || k ELSE k END AS key, path, context, CASE WHEN t = '*' THEN context ELSE t END AS id_type FROM d""",
    "field_route": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g') AS t, ['missing_paths', 'product_list', 'procurement_habits', 'pain_points', 'timeline', 'stakeholders', 'order_history', 'profile'][doc_id % 8 + 1] AS name,
  ['mail', 'mail', 'mail', 'vlm', 'customs'][doc_id // 8 % 5 + 1] AS kind FROM documents),
s AS (SELECT doc_id, kind, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(lower(substr(t, 1, 60)), '[^a-z]+', '_', 'g') ELSE regexp_extract(lower(t), '([a-z]+)', 1) || '_' || name END AS section FROM d)
SELECT doc_id, section, kind, CASE WHEN kind = 'vlm' THEN 'visual_and_ocr' WHEN kind = 'customs' THEN 'customs_identity' """
    + " ".join("WHEN " + " OR ".join(f"contains(section, '{w}')" for w in words) + f" THEN '{route}'" for route, words in classify.FIELD_ROUTES) + " ELSE 'identity_general_facts' END AS route FROM s",
    "greedy_pack": """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, doc_id, k, 0::bigint AS shard, n_chars AS used FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.k, CASE WHEN f.used > 0 AND f.used + o.n_chars > 24000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.used > 0 AND f.used + o.n_chars > 24000 THEN o.n_chars ELSE f.used + o.n_chars END
  FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, doc_id AS position, shard FROM f""",
    "pack_as_one": """WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
f AS (SELECT doc_id, k, 0::bigint AS shard, n_chars AS used, n_chars FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, CASE WHEN f.used > 0 AND f.used + o.n_chars > 3000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.used > 0 AND f.used + o.n_chars > 3000 THEN o.n_chars ELSE f.used + o.n_chars END, o.n_chars
  FROM f JOIN o ON o.k = f.k + 1)
SELECT shard, count(*) AS records, sum(n_chars)::bigint AS chars, min(doc_id) AS first_doc FROM f GROUP BY 1""",
    "record_fragments": """WITH n AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 1000))::bigint AS n FROM documents), p AS (SELECT doc_id, text, unnest(range(n)) AS piece FROM n)
SELECT doc_id, piece, sha256(substr(text, piece * 1000 + 1, 1000)) AS sha256 FROM p""",
    "exact_union": "SELECT lang, sha256(coalesce(text, '')) AS value_sha256, min(doc_id) AS first_position, count(*) AS records, count(DISTINCT source) AS sources FROM documents GROUP BY 1, 2",
    "union_balance": "SELECT lang, count(*) AS records_in, count(DISTINCT coalesce(text, '')) AS values_out, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates FROM documents GROUP BY 1",
    "pagination_summary": """WITH r AS (SELECT l_orderkey, CASE WHEN (l_orderkey + l_linenumber) % 9 <> 0 THEN l_partkey END AS item, count(*) OVER (PARTITION BY l_orderkey) + (l_orderkey % 10 = 0)::int AS announced FROM lineitem),
s AS (SELECT l_orderkey, max(announced)::bigint AS expected, count(*) AS rows, count(item) AS with_id, count(DISTINCT item) AS distinct_ids FROM r GROUP BY 1)
SELECT *, rows - with_id AS without_id, with_id - distinct_ids AS duplicates, expected = distinct_ids AND rows = distinct_ids AS complete FROM s""",
    "multiset_fingerprint": "SELECT l_orderkey, count(*) AS rows, sha256(string_agg(l_partkey || '/' || l_suppkey, chr(10) ORDER BY l_partkey || '/' || l_suppkey)) AS fingerprint FROM lineitem GROUP BY 1",
    "summed_fingerprint": "WITH h AS (SELECT l_partkey, sha256(l_orderkey || '/' || l_suppkey) AS d FROM lineitem), s AS (SELECT l_partkey, count(*) AS rows, " + ", ".join(f"sum(('0x' || substr(d, {1 + 12 * k}, 12))::hugeint) AS p{k}" for k in range(5)) + " FROM h GROUP BY 1)\nSELECT l_partkey, rows, sha256(rows || '|' || p0 || '|' || p1 || '|' || p2 || '|' || p3 || '|' || p4) AS fingerprint FROM s",
    "page_stability": "SELECT stable, count(*) AS orders FROM (SELECT l_orderkey, NOT coalesce(bool_or(l_orderkey % 7 = 0 AND l_linenumber = 3), false) AS stable FROM lineitem GROUP BY 1) GROUP BY 1",
    "bijection": """WITH a AS (SELECT count(*) AS left_keys, count(*) FILTER (WHERE n > 1) AS left_conflicts FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey)), b AS (SELECT count(*) AS right_keys, count(*) FILTER (WHERE n > 1) AS right_conflicts FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey))
SELECT *, left_conflicts = 0 AND right_conflicts = 0 AS bijective FROM a, b""",
    "path_difference": """WITH a AS (SELECT doc_id FROM labels UNION SELECT page_id FROM pages)
SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION SELECT doc_id, 'unexpected' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "resource_resolution": f"""WITH {_CANON}, p AS (SELECT page_id, sha256(url) AS identity, alias FROM k), a AS (SELECT * FROM p WHERE page_id % 3 = 0),
e AS (SELECT identity, min(page_id) AS exact_id FROM a GROUP BY 1), u AS (SELECT alias, min(page_id) AS alias_id FROM a GROUP BY 1 HAVING count(DISTINCT identity) = 1), g AS (SELECT DISTINCT identity FROM p WHERE page_id % 3 = 1)
SELECT page_id AS resource_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN alias_id IS NOT NULL THEN 'alias' WHEN g.identity IS NOT NULL THEN 'source_unavailable' ELSE 'unresolved' END AS resolution, coalesce(exact_id, alias_id) AS artifact_id
FROM p LEFT JOIN e USING (identity) LEFT JOIN u USING (alias) LEFT JOIN g ON g.identity = p.identity""",
    "failure_coverage": f"""WITH {_CANON}, s AS (SELECT * FROM k WHERE page_id % 4 <> 0)
SELECT page_id, CASE WHEN canonical IN (SELECT canonical FROM s) THEN 'get_key' WHEN alias IN (SELECT alias FROM s) THEN 'alias_key' ELSE 'uncovered' END AS covered_by FROM k WHERE page_id % 4 = 0""",
    "repair_merge": """WITH b AS (SELECT doc_id AS entry, max(toxic)::int AS severity, max(quality) AS quality FROM labels GROUP BY 1),
q AS (SELECT entry, severity, entry % 100 AS recorded, entry % 4 AS attempts, CASE WHEN quality = 1 THEN entry % 130 END AS resolved_at FROM b WHERE entry % 3 <> 0), s AS (SELECT entry, severity + (entry % 4 = 0)::int AS severity FROM b WHERE entry % 2 = 0),
m AS (SELECT coalesce(q.entry, s.entry) AS entry, greatest(q.severity, s.severity) AS severity, greatest(q.attempts, CASE WHEN s.entry IS NOT NULL THEN 1 END)::bigint AS attempts, least(q.recorded, CASE WHEN s.entry IS NOT NULL THEN 110 END)::bigint AS first_recorded,
  greatest(q.recorded, CASE WHEN s.entry IS NOT NULL THEN 110 END)::bigint AS last_recorded, resolved_at, s.entry IS NOT NULL AS seen, q.entry IS NOT NULL AS known, q.severity AS old, coalesce(resolved_at >= CASE WHEN s.entry IS NOT NULL THEN 110 ELSE resolved_at END, false) AS resolved FROM q FULL JOIN s ON q.entry = s.entry)
SELECT entry, severity, attempts, first_recorded, last_recorded, CASE WHEN resolved THEN 'resolved' ELSE 'open' END AS status,
  CASE WHEN NOT known THEN 'added' WHEN NOT seen OR resolved THEN 'unchanged' WHEN resolved_at IS NOT NULL THEN 'reopened' WHEN severity > old THEN 'updated' ELSE 'unchanged' END AS change FROM m""",
    "metric_diff": """WITH o AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), n AS (SELECT source, count(DISTINCT sha256(coalesce(text, ''))) AS n FROM documents GROUP BY 1
  UNION ALL SELECT 'labelled ' || source, count(*) FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT coalesce(o.source, n.source) AS metric, coalesce(o.n, 0) AS old, coalesce(n.n, 0) AS new, coalesce(n.n, 0) - coalesce(o.n, 0) AS difference FROM o FULL JOIN n ON o.source = n.source""",
    "capped_payload": "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total_rows FROM customer ORDER BY c_custkey LIMIT 100",
    "frame_pairs": f"""WITH {_SIGNS}
SELECT a.vec_id AS left_id, b.vec_id AS right_id, bit_count(xor(a.b, b.b))::int AS bits FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.b, b.b)) <= 3""",
    "frames_kept": f"""WITH RECURSIVE {_SIGNS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM v),
f AS (SELECT label, vec_id, n, true AS kept, [b] AS held FROM n WHERE n = 1
  UNION ALL SELECT label, vec_id, n, k, CASE WHEN k THEN list_append(held, b) ELSE held END FROM (
    SELECT n.label, n.vec_id, n.n, n.b, f.held, len(list_filter(f.held, lambda h: bit_count(xor(h, n.b)) <= 3)) = 0 AS k FROM f JOIN n ON n.label IS NOT DISTINCT FROM f.label AND n.n = f.n + 1))
SELECT label, vec_id, kept FROM f""",
    "size_labels": """WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%d B', n) END AS size FROM s""",
}
