"""Corpus building: routing, packing, splitting and exact unions of field records."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a packed shard and of a split record.
SHARD_CHARS, CHUNK_CHARS = 24_000, 60_000
#: A long as 64 bits, whatever its sign.
ALL_BITS = (1 << 64) - 1


def fragments(records: DataFrame, key: str, text: str, width: int = CHUNK_CHARS) -> DataFrame:
    """Fixed-width pieces of long texts, in order; a short or empty text is one piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / width).cast("int"))
    return records.select(
        key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * width + 1, F.lit(width)))).alias("piece", "fragment")
    )


def exact_union(records: DataFrame, field: str, value: Column, position: str, source: str) -> DataFrame:
    """Distinct values of each field with their first position, how many records had them and how many sources."""
    return records.groupBy(field, F.sha2(value, 256).alias("value_sha256")).agg(
        F.min(position).alias("first_position"), F.count("*").alias("records"), F.countDistinct(source).alias("sources")
    )


def union_balance(union: DataFrame, field: str) -> DataFrame:
    """Records in equal distinct values out plus duplicates."""
    return union.groupBy(field).agg(F.sum("records").alias("records_in"), F.count("*").alias("values_out")).withColumn("duplicates", F.col("records_in") - F.col("values_out"))


def sign_bits(vector: Column) -> Column:
    """The signs of all components (at most 64) as one long."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("long")))


def block_edges(blocks: int) -> list[tuple[int, int]]:
    """The first bit of each of so many blocks of 64 bits, and the one after its last."""
    return [(64 * i // blocks, 64 * (i + 1) // blocks) for i in range(blocks)]


def near_pairs(frames: DataFrame, group: str, order: str, bits: str, most: int = 3) -> DataFrame:
    """Pairs of frames of a group whose 64 bits differ in at most most bits.

    Bits that differ in at most most places agree in one of most + 1 blocks, so frames meet by block and value; a pair
    that agrees in several blocks is made in the first of them only."""
    edges = block_edges(most + 1)
    block_of = lambda c, low, high: F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << high - low) - 1).cast("long"))
    values = [block_of(F.col("b"), low, high) for low, high in edges]
    rows = frames.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(bits).alias("b"))
    keyed = rows.select("g", "o", "b", F.posexplode(F.array(*values)).alias("place", "value"))
    a, b = keyed.alias("a"), keyed.alias("b")
    joined = a.join(
        b, (F.col("a.g") == F.col("b.g")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.o") < F.col("b.o"))
    )
    differ = F.col("a.b").bitwiseXOR(F.col("b.b"))
    earlier = F.lit(False)
    for place, (low, high) in enumerate(edges):
        earlier |= (F.col("a.place") > place) & (block_of(differ, low, high) == 0)
    apart = F.bit_count(differ)
    return joined.filter((apart <= most) & ~earlier).select(F.col("a.o").alias("left_id"), F.col("b.o").alias("right_id"), apart.cast("int").alias("bits"))


def kept_frames(frames: DataFrame, group: str, order: str, bits: str, least: int = 3) -> DataFrame:
    """Frames of each group in order that differ in more than least bits from every frame kept before.

    A frame is compared with those kept that agree with it in one of least + 1 blocks of bits; no other can be within least bits."""
    edges = [(low, (1 << high - low) - 1) for low, high in block_edges(least + 1)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for batch in batches:
            keep = []
            for g, b in zip(batch["g"], batch["b"].tolist()):
                if g != now:
                    now, held = g, {}
                b &= ALL_BITS
                keys = [(place, b >> low & mask) for place, (low, mask) in enumerate(edges)]
                new = all((b ^ h).bit_count() > least for key in keys for h in held.get(key, ()))
                if new:
                    for key in keys:
                        held.setdefault(key, []).append(b)
                keep.append(new)
            yield pd.DataFrame({"g": batch["g"], "o": batch["o"], "kept": keep})

    rows = frames.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(bits).alias("b"))
    kinds = dict(rows.dtypes)
    return rows.repartition("g").sortWithinPartitions("g", "o").mapInPandas(fold, f"g {kinds['g']}, o {kinds['o']}, kept boolean").toDF(group, order, "kept")


PART_SCHEMA = "part int, parts int, method string, json_path string, first_item int, body string"


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def lists_in(value) -> Iterator[tuple[tuple, list]]:
    """Every list of two items or more inside a value, with its path, outer ones first."""
    todo = [((), value)]
    while todo:
        path, at = todo.pop(0)
        if isinstance(at, list) and len(at) > 1:
            yield path, at
        if isinstance(at, list | dict):
            todo += [((*path, k), v) for k, v in (at.items() if isinstance(at, dict) else enumerate(at)) if isinstance(v, list | dict)]


def largest_list(value) -> tuple[tuple, list] | None:
    """The list that takes most characters when written; of equals, the one found first."""
    return max(lists_in(value), key=lambda found: len(compact(found[1])), default=None)


def with_list(value, path: tuple, items: list):
    """value with the list at path replaced; nothing else is copied."""
    if not path:
        return items
    inner = with_list(value[path[0]], path[1:], items)
    if isinstance(value, dict):
        return {k: inner if k == path[0] else v for k, v in value.items()}
    return [inner if k == path[0] else v for k, v in enumerate(value)]


def split_record(value, most: int) -> list[tuple[str, str, int, str]]:
    """(method, json_path, first_item, body) of the parts of a record that is too long: its largest list is shared out in runs that
    fit, again and again; what has no list to share is cut as text.  A single item may stay above most until it is cut itself."""
    body = compact(value)
    if len(body) <= most:
        return [("whole", "", 0, body)]
    found = largest_list(value)
    if found is None:
        return [("text", "", at, body[at : at + most]) for at in range(0, len(body), most)]
    path, items = found
    room = most - len(compact(with_list(value, path, [])))
    runs, begin, size = [], 0, 0
    for k, item in enumerate(items):
        length = len(compact(item)) + 1
        if k > begin and size + length > room + 1:
            runs.append((begin, k))
            begin, size = k, 0
        size += length
    runs.append((begin, len(items)))
    if len(runs) == 1:
        return [("text", "", at, body[at : at + most]) for at in range(0, len(body), most)]
    name = "".join(f"/{step}" for step in path)
    parts = []
    for first, end in runs:
        part = with_list(value, path, items[first:end])
        text = compact(part)
        if len(text) <= most:
            parts.append(("list", name, first, text))
        else:
            parts += [("text", name, first, text[at : at + most]) for at in range(0, len(text), most)]
    return parts


def record_parts(records: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """key, part, parts, method, json_path, first_item, body: JSON records in parts of at most most characters, nothing lost."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch["k"], batch["body"]):
                parts = split_record(json.loads(body), most)
                rows += [(k, n + 1, len(parts), *part) for n, part in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["k", "part", "parts", "method", "json_path", "first_item", "body"])

    rows = records.select(F.col(key).alias("k"), F.col(text).alias("body")).filter("body IS NOT NULL")
    return rows.mapInPandas(split, f"k {dict(rows.dtypes)['k']}, {PART_SCHEMA}").withColumnRenamed("k", key)
