"""Evidence graph: nodes, relation occurrences (a multiset) and aggregated relation facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.keys import fact_id, node_id


#: (type, rows, value column, source column) of nodes, and the arguments of occurrences() and facts_of().
Typed = tuple[str, DataFrame, Column, Column]
Relation = tuple[DataFrame, tuple[str, Column], str, tuple[str, Column], Column]


def nodes(*typed: Typed) -> DataFrame:
    """Distinct nodes of (type, rows, value column, source column); of a repeated node the entry
    with the least source stays.  Combines by plain values, which are hashed afterwards."""
    found = [
        rows.groupBy("_value").agg(F.min("_source").alias("source_rel")).select(
            node_id(kind, F.col("_value")).alias("node_id"), F.lit(kind).alias("node_type"), F.col("_value").cast("string").alias("value"), "source_rel"
        )
        for kind, rows in _values(typed).items()
    ]
    return reduce(DataFrame.unionByName, found)


def _values(typed: tuple[Typed, ...]) -> dict[str, DataFrame]:
    """By type, _value and _source of its rows; values of several tables meet as text."""
    kinds = list(dict.fromkeys(kind for kind, *_ in typed))
    several = {k for k in kinds if sum(kind == k for kind, *_ in typed) > 1}
    return {
        k: reduce(DataFrame.unionByName, [df.select((value.cast("string") if k in several else value).alias("_value"), source.alias("_source")) for kind, df, value, source in typed if kind == k])
        for k in kinds
    }


def _same_type(left: DataFrame, right: DataFrame, column: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Values are nodes by their text: columns of two types are compared as text."""
    if left.schema[column].dataType == right.schema[other].dataType:
        return left, right
    return left.withColumn(column, F.col(column).cast("string")), right.withColumn(other, F.col(other).cast("string"))


def ends_of(df: DataFrame, left: tuple[str, Column], relation: str, right: tuple[str, Column], source: Column) -> DataFrame:
    """_left and _right of occurrences() as plain values."""
    rows = df.select(left[1].alias("_left"), right[1].alias("_right")).filter("_left IS NOT NULL AND _right IS NOT NULL")
    return rows.filter(F.col("_left").cast("string") != F.col("_right").cast("string")) if left[0] == right[0] else rows


def orphans_of(relations: list[Relation], typed: list[Typed]) -> DataFrame:
    """relation and to (its value as text) of the occurrences of orphans(), matched by plain values."""
    known, found = _values(tuple(typed)), []
    for relation in relations:
        rows = ends_of(*relation)
        for side, (kind, _) in (("_left", relation[1]), ("_right", relation[3])):
            flag = f"_known{side}"
            if kind not in known:
                rows = rows.withColumn(flag, F.lit(None).cast("boolean"))
                continue
            rows, there = _same_type(rows, known[kind].select(F.col("_value").alias(side)), side, side)
            rows = rows.join(there.filter(F.col(side).isNotNull()).distinct().withColumn(flag, F.lit(True)), side, "left")
        found.append(rows.filter("_known_left IS NULL OR _known_right IS NULL").select(F.lit(relation[2]).alias("relation"), F.col("_right").cast("string").alias("to"), F.lit(relation[3][0]).alias("to_type")))
    return reduce(DataFrame.unionByName, found)


def unreferenced_of(relations: list[Relation], typed: list[Typed], *kinds: str) -> DataFrame:
    """unreferenced() of all nodes or those of some types, matched by plain values."""
    found = []
    for kind in kinds or dict.fromkeys(k for k, *_ in typed):
        rows = _values(tuple(t for t in typed if t[0] == kind))[kind].groupBy("_value").agg(F.min("_source").alias("source_rel"))
        for relation in relations:
            for side, (of, _) in (("_left", relation[1]), ("_right", relation[3])):
                if of == kind:
                    rows, ends = _same_type(rows, ends_of(*relation).select(F.col(side).alias("_value")), "_value", "_value")
                    rows = rows.join(ends.distinct(), "_value", "left_anti")
        found.append(rows.select(node_id(kind, F.col("_value")).alias("node_id"), F.lit(kind).alias("node_type"), F.col("_value").cast("string").alias("value"), "source_rel"))
    return reduce(DataFrame.unionByName, found)


def occurrences(df: DataFrame, left: tuple[str, Column], relation: str, right: tuple[str, Column], source: Column) -> DataFrame:
    """One edge per row: from_id, relation, to_id, source_rel.  Self-loops are dropped."""
    edges = df.select(node_id(*left).alias("from_id"), F.lit(relation).alias("relation"), node_id(*right).alias("to_id"), source.alias("source_rel"))
    return edges.filter("from_id <> to_id")


def facts(edges: DataFrame) -> DataFrame:
    """Aggregates edge occurrences: evidence count and the first and last source."""
    return edges.groupBy("from_id", "relation", "to_id").agg(
        F.count("*").alias("evidence_count"), F.min("source_rel").alias("first_source"), F.max("source_rel").alias("last_source")
    )


def facts_of(df: DataFrame, left: tuple[str, Column], relation: str, right: tuple[str, Column], source: Column) -> DataFrame:
    """facts() of occurrences(), combined by the plain values of both ends before these are hashed: one hash for a fact instead of one for each row."""
    rows = df.select(left[1].alias("_left"), right[1].alias("_right"), source.alias("_source"))
    if left[0] == right[0]:
        rows = rows.filter(F.col("_left").cast("string") != F.col("_right").cast("string"))
    found = rows.filter("_left IS NOT NULL AND _right IS NOT NULL").groupBy("_left", "_right").agg(
        F.count("*").alias("evidence_count"), F.min("_source").alias("first_source"), F.max("_source").alias("last_source")
    )
    return found.select(
        node_id(left[0], F.col("_left")).alias("from_id"), F.lit(relation).alias("relation"), node_id(right[0], F.col("_right")).alias("to_id"),
        "evidence_count", "first_source", "last_source"
    )


def catalog(fact_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Facts with the type and value of both ends (null where an end is unknown) and a fact id."""
    ends = node_rows.select("node_id", "node_type", "value")
    left = ends.toDF("from_id", "from_type", "from_value")
    right = ends.toDF("to_id", "to_type", "to_value")
    joined = fact_rows.join(left, "from_id", "left").join(right, "to_id", "left")
    return joined.select(
        fact_id(F.col("from_id"), F.col("relation"), F.col("to_id")).alias("fact_id"), "from_type", "from_value", "relation", "to_type", "to_value",
        "evidence_count", "first_source", "last_source"
    )


def orphans(edges: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Edge occurrences with an end that is no node."""
    ids = node_rows.select("node_id")
    no_left = edges.join(ids, edges.from_id == ids.node_id, "left_anti")
    no_right = edges.join(ids, edges.from_id == ids.node_id, "left_semi").join(ids, edges.to_id == ids.node_id, "left_anti")
    return no_left.unionByName(no_right)


def unreferenced(edges: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Nodes that no edge names at either end."""
    named = edges.select(F.col("from_id").alias("node_id")).union(edges.select("to_id")).distinct()
    return node_rows.join(named, "node_id", "left_anti")
