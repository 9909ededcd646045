"""Searches over a word index that is stored once and changed by batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import search
from quarrystone.operators.word_store import WordStore
from quarrystone.plans.tables import table
from quarrystone.plans.text_queries import _PLAIN, BOOLEAN, PHRASE
from quarrystone.sources.scratch import scratch_folder


def _store(spark: SparkSession, sf_dir: str, merged: bool = False) -> WordStore:
    """All documents, of which some first had other texts and were replaced, and some were taken out: doc_id % 5 = 0 and doc_id % 7 = 3."""
    store = WordStore(spark, f"{scratch_folder(spark)}/words-{uuid.uuid4().hex}", buckets=16, spread=2)
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    stale = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("éra of the stale der "), F.reverse("text"))).otherwise(F.col("text"))
    store.upsert(d.withColumn("text", stale))
    store.upsert(d.filter("doc_id % 5 = 0"))
    store.delete(d.filter("doc_id % 7 = 3"))
    if merged:
        store.merge()
    return store


def stored_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean search after a batch of replacements and one of deletions."""
    return _store(spark, sf_dir).search(BOOLEAN)


def stored_boolean_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search after the segments were merged."""
    return _store(spark, sf_dir, merged=True).search(BOOLEAN)


def stored_phrase_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a phrase search: hits come from the index, texts are read for the page only."""
    hits = _store(spark, sf_dir).phrase(PHRASE)
    page = search.page(hits, [F.col("doc_id")], 2, 25)
    return search.with_preview(table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(page, "doc_id"), "text", 40)


def stored_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, merged=True).counts()


QUERIES = {f.__name__: f for f in (stored_boolean, stored_boolean_merged, stored_phrase_page, stored_word_counts)}

_LIVE = f"f AS (SELECT doc_id, source, text, {_PLAIN} AS t FROM documents WHERE doc_id % 7 <> 3)"
_BOOLEAN_SQL = f"WITH {_LIVE} SELECT doc_id FROM f WHERE (contains(t, ' the ') AND (contains(t, ' of ') OR contains(t, ' for the ')) AND NOT contains(t, ' of the ') AND contains(t, ' der ')) OR contains(t, ' era ')"

ORACLES = {
    "stored_boolean": _BOOLEAN_SQL,
    "stored_boolean_merged": _BOOLEAN_SQL,
    "stored_phrase_page": f"""WITH {_LIVE}, h AS (SELECT * FROM f WHERE contains(t, ' of the '))
SELECT doc_id, source, substr(text, 1, 40) AS text, length(text) > 40 AS text_truncated, (SELECT count(*) FROM h) AS total, greatest(1, ceil((SELECT count(*) FROM h) / 25))::bigint AS pages FROM h ORDER BY doc_id LIMIT 25 OFFSET 25""",
    "stored_word_counts": f"WITH {_LIVE}, w AS (SELECT doc_id, unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) AS word FROM f) SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS places FROM w GROUP BY 1",
}
