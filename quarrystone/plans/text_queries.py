"""Text, URL and search queries over documents, pages and benchmark phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text, urls
from quarrystone.operators import search, sentences
from quarrystone.plans.tables import table

NEEDLE, PHRASE = "idiot", "of the"


def normalise_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of texts as names of fields, with capitals, marks and line ends as they come, some joined in camel case."""
    name = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.substring("text", 1, 40), " ", "")).otherwise(F.substring("text", 1, 40))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(name, F.lit("ID/~")).alias("name"))
    return d.select("doc_id", text.normalised_name(F.col("name")).alias("normalised"), text.pointer_part(F.col("name")).alias("pointer"))


def html_chunks_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.chunks_text(F.col("html")).alias("text"))


def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


def html_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.block_text(F.col("html")).alias("text"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls, every other one with secrets and signatures of several kinds added."""
    p = table(spark, sf_dir, "pages")
    bare, fragment = urls.without_fragment(F.col("url")), F.regexp_extract("url", "(#.*)$", 1)
    more = F.concat(
        bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("token=s"), F.col("page_id").cast("string"),
        F.lit("&Expires=9&b=2&X-Amz-Signature=5f&security-token=q&policy=&a=1"), fragment
    )
    return p.select("page_id", F.when(F.col("page_id") % 2 == 0, more).otherwise(F.col("url")).alias("url"))


def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _signed(spark, sf_dir).select(
        "page_id", "url", urls.redacted(u).alias("redacted"), urls.canonical(u).alias("canonical"), urls.signed_variant(u).alias("signed_variant"),
        urls.identity(u).alias("identity"), urls.alias_key(u).alias("alias")
    )


def url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.page_url(F.col("url"), "page", F.col("page_id") % 7, ("ref",)).alias("next_url"))


def latest_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page with the highest id of each canonical url."""
    p = table(spark, sf_dir, "pages").withColumn("canonical", urls.canonical(F.col("url")))
    return p.groupBy("canonical").agg(F.max("page_id").alias("page_id"), F.count("*").alias("captures"))


def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_hits(table(spark, sf_dir, "documents"), "text", PHRASE).select("doc_id")


BOOLEAN = 'the AND (of OR "for the") NOT "of the" der OR éra'


def fts_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean search over the word index: diacritics do not count, NOT takes away, unsaid AND binds as AND does."""
    return search.boolean_hits(search.word_index(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", BOOLEAN)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and places of each word of the index."""
    index = search.word_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("word").agg(F.count("*").alias("documents"), F.sum(F.size("places")).cast("long").alias("places"))


def like_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(text.like_any([F.col("text"), F.col("source"), F.col("doc_id")], NEEDLE)).select("doc_id", "source")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.phrase_hits(table(spark, sf_dir, "documents"), "text", PHRASE).select("doc_id", "source", "text")
    return search.page(search.with_preview(hits, "text", 40), [F.col("doc_id")], 2, 25)


def document_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.slice_of(F.col("text"), 100, 50).alias("chunk"), F.length("text").cast("long").alias("chars")
    )


def preview_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_preview(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 400)


def phrase_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrases_in_docs(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", "text")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that look like secrets, by rule, with their numbers."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.rlike("body", F.lit(p)).alias("hit")) for n, p in text.SECRET_RULES)))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), rules.alias("r")).filter("r.hit").select("doc_id", "line", "r.rule")


def representative_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that stands for each document; some texts are cut into Chinese sentences first."""
    d = table(spark, sf_dir, "documents")
    mixed = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("我们的价格。价格和交货是价格的问题！"), F.translate("text", ".", "。"))).otherwise(F.col("text"))
    return sentences.representative(d.select("doc_id", mixed.alias("text")), "doc_id", "text")


def safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("="), "c_name")).when(F.col("c_custkey") % 3 == 1, F.lpad(F.col("c_custkey").cast("string"), 6, "0")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.safe_cell(raw, 12).alias("cell"))


def evidence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), NEEDLE).alias("excerpt")).filter("excerpt IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (normalise_key, html_chunks_text, html_visible_text, html_block_text, url_identity, url_pages, latest_per_url, fts_phrase, fts_boolean, word_counts, like_any, search_page, document_slice, preview_flag, phrase_intersection, secret_scan, representative_sentences, safe_cells, evidence_excerpt)
}

_ENT = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g'), '(?is)<noscript\\b.*?</noscript>', '', 'g')"
_FOLD = "' ' || trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_PLAIN = "' ' || trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
SIGNED_SQL = r"""
s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN b || CASE WHEN contains(b, '?') THEN '&' ELSE '?' END || 'token=s' || page_id || '&Expires=9&b=2&X-Amz-Signature=5f&security-token=q&policy=&a=1' || f ELSE url END AS url
  FROM (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b, regexp_extract(url, '(#.*)$', 1) AS f FROM pages)),
q AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS base, regexp_extract(url, '(#.*)$', 1) AS frag,
  list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '') AS pairs FROM s),
r AS (SELECT *, list_transform(pairs, lambda p: CASE WHEN lower(split_part(p, '=', 1)) IN ('token', 'expires', 'x-amz-signature', 'security-token', 'policy') THEN split_part(p, '=', 1) || '=<redacted:sha256:' || substr(sha256(substr(p, length(split_part(p, '=', 1)) + 2)), 1, 16) || '>' ELSE p END) AS hidden,
  list_sort(pairs) AS sorted, list_sort(list_filter(pairs, lambda p: lower(split_part(p, '=', 1)) NOT IN ('expires', 'x-amz-signature', 'policy'))) AS unsigned, list_contains(list_transform(pairs, lambda p: lower(split_part(p, '=', 1))), 'expires') AS signed FROM q),
u AS (SELECT page_id, url, CASE WHEN len(hidden) > 0 THEN base || '?' || array_to_string(hidden, '&') ELSE base END || frag AS redacted,
  CASE WHEN len(sorted) > 0 THEN base || '?' || array_to_string(sorted, '&') ELSE base END AS canonical,
  CASE WHEN signed THEN CASE WHEN len(unsigned) > 0 THEN base || '?' || array_to_string(unsigned, '&') ELSE base END END AS signed_variant, regexp_extract(base, '^[a-z]+://[^/]*(.*)$', 1) AS alias FROM r)"""

ORACLES = {
    "normalise_key": r"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(substr(text, 1, 40), ' ', '') ELSE substr(text, 1, 40) END || 'ID/~' AS name FROM documents)
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(name, '([A-Z])', '_\1', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS normalised, replace(replace(name, '~', '~0'), '/', '~1') AS pointer FROM n""",
    "html_chunks_text": f"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(html, '(?s)<!--.*?-->', '<>', 'g'), '<[^>]*>'), lambda p: trim(regexp_replace({_ENT.format('p')}, '\\s+', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS text FROM pages""",
    "html_visible_text": f"SELECT page_id, trim(regexp_replace({_ENT.format(f'''regexp_replace({_BARE}, '<[^>]*>', ' ', 'g')''')}, '\\s+', ' ', 'g')) AS text FROM pages",
    "html_block_text": f"""WITH l AS (SELECT page_id, string_split({_ENT.format(f'''regexp_replace(regexp_replace({_BARE}, '(?i)</?(p|div|li|ul|ol|tr|table|h[1-6]|article|nav|footer|header|section|br|title)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')''')}, chr(10)) AS x FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(x, lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS text FROM l""",
    "url_identity": f"WITH {SIGNED_SQL} SELECT page_id, url, redacted, canonical, signed_variant, sha256(redacted) AS identity, alias FROM u",
    "url_pages": r"""WITH q AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('page', 'ref')) AS pairs FROM pages)
SELECT page_id, base || '?' || array_to_string(list_append(pairs, 'page=' || page_id % 7), '&') AS next_url FROM q""",
    "latest_per_url": r"""WITH q AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '')) AS pairs FROM pages)
SELECT CASE WHEN len(pairs) > 0 THEN base || '?' || array_to_string(pairs, '&') ELSE base END AS canonical, max(page_id) AS page_id, count(*) AS captures FROM q GROUP BY 1""",
    "fts_phrase": f"SELECT doc_id FROM documents WHERE contains({_FOLD.format('text')}, ' of the ')",
    "fts_boolean": f"""WITH f AS (SELECT doc_id, {_PLAIN} AS t FROM documents)
SELECT doc_id FROM f WHERE (contains(t, ' the ') AND (contains(t, ' of ') OR contains(t, ' for the ')) AND NOT contains(t, ' of the ') AND contains(t, ' der ')) OR contains(t, ' era ')""",
    "word_counts": f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split({_PLAIN}, ' '), lambda x: x <> '')) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS places FROM w GROUP BY 1""",
    "like_any": "SELECT doc_id, source FROM documents WHERE text ILIKE '%idiot%' OR source ILIKE '%idiot%' OR doc_id::varchar ILIKE '%idiot%'",
    "search_page": f"""WITH h AS (SELECT doc_id, source, text FROM documents WHERE contains({_FOLD.format('text')}, ' of the '))
SELECT doc_id, source, substr(text, 1, 40) AS text, length(text) > 40 AS text_truncated, (SELECT count(*) FROM h) AS total, greatest(1, ceil((SELECT count(*) FROM h) / 25))::bigint AS pages FROM h ORDER BY doc_id LIMIT 25 OFFSET 25""",
    "document_slice": "SELECT doc_id, substr(text, 101, 50) AS chunk, length(text) AS chars FROM documents",
    "preview_flag": "SELECT doc_id, substr(text, 1, 400) AS text, coalesce(length(text) > 400, false) AS text_truncated FROM documents",
    "phrase_intersection": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS run FROM d WHERE len(w) >= 5),
br AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS run FROM b WHERE len(w) >= 5)
SELECT doc_id, item_id, count(*) AS shared_runs FROM dr JOIN br USING (run) GROUP BY ALL""",
    "secret_scan": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)\n" + "\nUNION ALL ".join(f"SELECT doc_id, line, '{n}' AS rule FROM l WHERE regexp_matches(body, '{p}')" for n, p in text.SECRET_RULES),
    "representative_sentences": rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(CASE WHEN doc_id % 9 = 0 THEN '我们的价格。价格和交货是价格的问题！' || translate(text, '.', '。') ELSE text END, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[\t\n\r ]+', ' ', 'g')) AS line FROM documents),
p AS (SELECT doc_id, list_transform(list_filter(string_split_regex(line, '{sentences.SENTENCE_END}'), lambda x: length(trim(x)) >= 6), lambda x: trim(x, ' ，,;；:' || chr(9))) AS ss FROM d),
s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS k FROM p),
t AS (SELECT doc_id, k, unnest(regexp_extract_all(lower(s), '{sentences.TOKEN}')) AS t FROM s),
w AS (SELECT doc_id, t, CASE WHEN t IN ({", ".join(f"'{w}'" for w in sentences.STOP_WORDS)}) THEN 0 ELSE count(*) END AS w FROM t GROUP BY 1, 2),
m AS (SELECT doc_id, k, sum(w)::bigint / count(*) AS score FROM t JOIN w USING (doc_id, t) GROUP BY 1, 2),
b AS (SELECT doc_id, s, coalesce(score, 0.0)::double AS weight FROM s LEFT JOIN m USING (doc_id, k) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0.0)::double DESC, least(length(s), 180) DESC, k) = 1)
SELECT doc_id, coalesce(substr(s, 1, 180), substr(line, 1, 160)) AS sentence, weight FROM d LEFT JOIN b USING (doc_id)""",
    "safe_cells": r"""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '=' || c_name WHEN 1 THEN lpad(c_custkey::varchar, 6, '0') ELSE c_name END AS raw FROM customer)
SELECT c_custkey, substr(CASE WHEN regexp_matches(raw, '^[=+\-@\t\r]') OR regexp_matches(raw, '^0\d+$|^\d{16,}$') THEN '''' || raw ELSE raw END, 1, 12) AS cell FROM c""",
    "evidence_excerpt": r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents), a AS (SELECT *, strpos(lower(x), 'idiot') AS pos FROM f)
SELECT doc_id, substr(substr(x, greatest(pos - 120, 1), pos - greatest(pos - 120, 1) + 5 + 260), 1, 500) AS excerpt FROM a WHERE pos > 0""",
}
