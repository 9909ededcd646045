"""Searching and paging for a reader: bounded pages of ordered rows with their total."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import has_phrase, preview
from quarrystone.operators.gates import GateError

PAGE_SIZE, MOST_PAGE_SIZE, MOST_PAGES, MOST_QUERY, PREVIEW = 25, 100, 100_000, 512, 4000


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of rows with total and pages in every row; page and size are bounded."""
    if not 1 <= number <= MOST_PAGES or not 1 <= size <= MOST_PAGE_SIZE:
        raise GateError("PAGE_OUT_OF_RANGE")
    total = rows.agg(F.count("*").alias("total"))
    chosen = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return chosen.join(F.broadcast(total)).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def phrase_hits(docs: DataFrame, text: str, phrase: str) -> DataFrame:
    if len(phrase) > MOST_QUERY:
        raise GateError("QUERY_TOO_LONG")
    return docs.filter(has_phrase(F.col(text), F.lit(phrase)))


def with_preview(docs: DataFrame, text: str, limit: int = PREVIEW) -> DataFrame:
    head, cut = preview(F.col(text), limit)
    return docs.withColumns({text: head, f"{text}_truncated": cut})


def without_marks(text: Column) -> Column:
    """Latin letters without their diacritics: each letter of the Latin blocks that is a base and marks becomes the base."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    plain = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(map(unicodedata.combining, d[1:]))]
    return F.regexp_replace(F.translate(text, "".join(c for c, _ in plain), "".join(d for _, d in plain)), r"\p{M}", "")


def _folded(text: Column) -> Column:
    return F.regexp_replace(without_marks(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", " ")


def words_of(text: Column) -> Column:
    """Lower-case words without diacritics: runs of letters and digits."""
    return F.filter(F.split(_folded(text), " "), lambda w: w != "")


def word_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, key, places): where each document holds each word; written once, it answers searches without the texts."""
    words = docs.select(key, F.posexplode(words_of(F.col(text))).alias("place", "word"))
    return words.groupBy("word", key).agg(F.sort_array(F.collect_list("place")).alias("places"))


#: Places that a task gathers before it hands them on.
MOST_PLACES = 200_000


def row_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, key, places) of each row of docs, gathered where the row lies; rows of one key are not put together."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, rows, places = batch.column(0), [], [], []
            offsets = [0]
            for row, body in enumerate(batch.column(1).to_pylist()):
                at: dict[str, list[int]] = {}
                for place, word in enumerate(filter(None, body.split(" "))):
                    at.setdefault(word, []).append(place)
                words += at
                rows += [row] * len(at)
                for found in at.values():
                    places += found
                    offsets.append(len(places))
                if len(places) >= MOST_PLACES:
                    yield table(words, keys, rows, offsets, places)
                    words, rows, places, offsets = [], [], [], [0]
            if words:
                yield table(words, keys, rows, offsets, places)

    def table(words: list, keys: pa.Array, rows: list, offsets: list, places: list) -> pa.RecordBatch:
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), keys.take(pa.array(rows, pa.int32())), listed], names=["word", key, "places"])

    rows = docs.select(key, _folded(F.col(text)).alias("text"))
    return rows.mapInArrow(gathered, f"word string, {key} {rows.schema[key].dataType.simpleString()}, places array<int>")


def parsed_query(query: str) -> list[tuple[str, list[str]]]:
    """A boolean query in postfix form: words and "phrases" as ("phrase", words), joined by AND (also unsaid), OR and NOT, which binds
    AND and leaves the documents that the left side has and the right side lacks; parentheses group."""
    if len(query) > MOST_QUERY:
        raise GateError("QUERY_TOO_LONG")
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    split = lambda t: re.findall(r"[^\W_]+", fold(t))
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    binds, out, held, ready = {"OR": 1, "AND": 2, "NOT": 2}, [], [], False

    def operator(name: str) -> None:
        while held and held[-1] != "(" and binds[held[-1]] >= binds[name]:
            out.append((held.pop(), []))
        held.append(name)

    for token in tokens:
        if token in binds and ready:
            operator(token)
            ready = False
        elif token == ")":
            while held and held[-1] != "(":
                out.append((held.pop(), []))
            if not held or not ready:
                raise GateError("QUERY_SYNTAX")
            held.pop()
        elif token in binds:
            raise GateError("QUERY_SYNTAX")
        else:
            words = [] if token == "(" else split(token)
            if token != "(" and not words:
                continue
            if ready:
                operator("AND")
            if token == "(":
                held.append("(")
            else:
                out.append(("phrase", words))
            ready = token != "("
    while held:
        if held[-1] == "(" or not ready:
            raise GateError("QUERY_SYNTAX")
        out.append((held.pop(), []))
    if not out:
        raise GateError("QUERY_SYNTAX")
    return out


def boolean_hits(index: DataFrame, key: str, query: str) -> DataFrame:
    """The keys of word_index() that a boolean query finds.  Only the words of the query are read from the index, a phrase needs its words
    in places that follow each other, and the parts meet by key."""
    steps = parsed_query(query)
    words = sorted({w for _, phrase in steps for w in phrase})
    held = index.filter(F.col("word").isin(*words)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("at"))
    stack: list[Column] = []
    places = lambda word: F.element_at(F.col("at"), word)

    def stands(phrase: list[str]) -> Column:
        """Whether the words of a phrase stand one after another somewhere."""
        later = lambda begin: reduce(Column.__and__, [F.coalesce(F.array_contains(places(w), begin + n), F.lit(False)) for n, w in enumerate(phrase)])
        return F.coalesce(F.exists(places(phrase[0]), later), F.lit(False))

    for kind, phrase in steps:
        if kind == "phrase":
            stack.append(stands(phrase))
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left & right if kind == "AND" else left | right if kind == "OR" else left & ~right)
    return held.filter(stack.pop()).select(key)


def phrases_in_docs(docs: DataFrame, doc_key: str, phrases: DataFrame, phrase_key: str, text: str, width: int = 5) -> DataFrame:
    """Pairs (doc, phrase) that share runs of width words, and how many different ones; keys are unique on either side.

    Runs meet by a 64-bit hash, so eight bytes a run are shuffled and no phrase is held against every document; the words themselves
    are compared for the pairs that met."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    places = lambda w: F.sequence(F.lit(1), F.size(w) - width + 1)
    shaped = lambda df, key: df.select(key, words(F.col(text)).alias("_w")).filter(F.size("_w") >= width)
    hashed = lambda df, key: df.select(key, F.explode(F.array_distinct(F.transform(places("_w"), lambda i: F.xxhash64(F.slice("_w", i, width))))).alias("_h"))
    runs = lambda c: F.array_distinct(F.transform(places(c), lambda i: F.array_join(F.slice(c, i, width), " ")))
    d, p = shaped(docs, doc_key), shaped(phrases, phrase_key)
    met = hashed(d, doc_key).join(hashed(p, phrase_key), "_h").select(doc_key, phrase_key).distinct()
    both = met.join(d, doc_key).join(p.withColumnRenamed("_w", "_p"), phrase_key)
    shared = F.size(F.array_intersect(runs(F.col("_w")), runs(F.col("_p")))).cast("long")
    return both.select(doc_key, phrase_key, shared.alias("shared_runs")).filter("shared_runs > 0")
