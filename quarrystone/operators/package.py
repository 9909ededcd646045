"""The relation package: tables that tie every relation, event and output to the bytes it came from, and the gates over them.

Builders take plain columns and add the keys.  Gates count the rows that break a rule; rules that look at one row of one table
are counted in a single pass over it, and those that look at two tables are joins on keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.keys import match_key, stable_key
from quarrystone.functions.timeparse import order_key
from quarrystone.operators import timeline
from quarrystone.sources.scratch import kept

#: Relations that say no more than nearness, which a package must not hold.
COARSE_PREDICATES = ("cooccurs_in_record", "observed_in_customer_case")


def artifact_id(source_rel: Column) -> Column:
    return stable_key(F.lit("artifact"), source_rel)


def record_id(source_rel: Column, pointer: Column) -> Column:
    return stable_key(F.lit("record"), source_rel, pointer)


def artifacts(files: DataFrame) -> DataFrame:
    """files: source_rel, source_scope, content, category, mime.  One row for each, with the identity of its content."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return files.select(
        artifact_id(F.col("source_rel")).alias("artifact_id"), "source_rel", "source_scope", F.sha2(content, 256).alias("source_sha256"),
        F.octet_length(content).cast("long").alias("source_bytes"), "category", "mime"
    )


def records(found: DataFrame) -> DataFrame:
    """found: source_rel, json_pointer, parent_pointer, depth, record_type, content."""
    return found.select(
        record_id(F.col("source_rel"), F.col("json_pointer")).alias("record_id"), artifact_id(F.col("source_rel")).alias("artifact_id"),
        F.when(F.col("parent_pointer").isNotNull(), record_id(F.col("source_rel"), F.col("parent_pointer"))).alias("parent_record_id"), "source_rel",
        F.when(F.col("json_pointer") == "", "artifact").otherwise("json").alias("pointer_kind"), "json_pointer", F.col("depth").cast("int").alias("depth"), "record_type",
        F.sha2(F.coalesce(F.col("content"), F.lit("")), 256).alias("record_sha256"),
    )


def events(found: DataFrame) -> DataFrame:
    """found: axis, source_rel, json_pointer, field_name, sort_key.  Adds keys, a stable order and its numbers."""
    return dated(sequenced(found))


def sequenced(found: DataFrame) -> DataFrame:
    """found with stable_sequence.  Rows are dealt as they are found; the keys that order them are made where they are sorted."""
    event = stable_key(F.lit("event"), record_id(F.col("source_rel"), F.col("json_pointer")), F.col("field_name"))
    none = F.lit(None).cast("string")
    # the beginning of an order key hangs on its id only where there is no time
    key = order_key(F.col("sort_key"), none, F.col("axis"), F.when(F.col("sort_key").isNull(), event).otherwise(F.lit("")))
    rows = found.select("axis", "source_rel", "json_pointer", "field_name", "sort_key").withColumn("_bucket", timeline.bucket_of(key))
    dealt = rows.repartition("axis", "_bucket").withColumn("_event", F.unhex(event))
    # on one axis and in one bucket, order keys differ by time first and by id then
    return timeline.numbered(dealt, rows, "sort_key", "_event").select("axis", "source_rel", "json_pointer", "field_name", "sort_key", "stable_sequence")


def dated(rows: DataFrame) -> DataFrame:
    """Rows of sequenced() with their keys."""
    record = record_id(F.col("source_rel"), F.col("json_pointer"))
    keyed = rows.select(
        stable_key(F.lit("event"), record, F.col("field_name")).alias("event_id"), artifact_id(F.col("source_rel")).alias("artifact_id"),
        record.alias("record_id"), "axis", "field_name", "source_rel", "json_pointer", "sort_key", F.lit(None).cast("string").alias("local_key"), "stable_sequence"
    )
    return timeline.with_order_key(keyed).select(*(c for c in keyed.columns if c != "stable_sequence"), "stable_order_key", "stable_sequence")


def evidence(found: DataFrame) -> DataFrame:
    """found: subject, predicate, object, relation_kind, source_rel, json_pointer, field_name (of the event that dates it, or null)."""
    record = record_id(F.col("source_rel"), F.col("json_pointer"))
    relation = stable_key(F.col("subject"), F.col("predicate"), F.col("object"))
    event = F.when(F.col("field_name").isNotNull(), stable_key(F.lit("event"), record, F.col("field_name")))
    return found.select(
        stable_key(F.lit("evidence"), relation, record).alias("evidence_id"), relation.alias("relation_id"), "subject", "predicate", "object", "relation_kind",
        artifact_id(F.col("source_rel")).alias("artifact_id"), record.alias("record_id"), event.alias("event_id"), "source_rel", "json_pointer"
    )


def relations(proofs: DataFrame, dated: DataFrame) -> DataFrame:
    """Each relation with the number of its proofs and the first and last time of the events that date them."""
    times = dated.select("event_id", "sort_key")
    joined = proofs.select("relation_id", "subject", "predicate", "object", "relation_kind", "event_id").join(times, "event_id", "left")
    return joined.groupBy("relation_id", "subject", "predicate", "object", "relation_kind").agg(
        F.count("*").alias("evidence_count"), F.min("sort_key").alias("first_event_sort_key"), F.max("sort_key").alias("last_event_sort_key")
    )


def lineage(built: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """built: table name -> (rows with artifact_id, name of the key column).  Which row of which table came from which artifact."""
    rows = [
        df.select(stable_key(F.lit("lineage"), F.lit(name), F.col(key)).alias("lineage_id"), F.col("artifact_id").alias("source_artifact_id"), F.lit(name).alias("target_table"), F.col(key).alias("target_key"))
        for name, (df, key) in built.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def rules(df: DataFrame, **conditions: str | Column) -> DataFrame:
    """gate_id, violations: how many rows meet each condition, in one pass."""
    counted = df.agg(*(F.count_if(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in conditions.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(name).alias("gate_id"), F.col(name).alias("violations")) for name in conditions))).alias("r")).select("r.*")


def rows_of(name: str, df: DataFrame) -> DataFrame:
    """A rule that the rows of df break."""
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate_id"), "violations")


def repeated(name: str, df: DataFrame, *columns: str) -> DataFrame:
    """A rule that keys which stand more than once break."""
    return rows_of(name, df.groupBy(match_key(*(F.col(c) for c in columns)).alias("k")).agg(F.count("*").alias("n")).filter("n > 1"))


def _tally(**keys: tuple[DataFrame, str]) -> DataFrame:
    """k, and for each name how many of its rows have this key: all tables meet in one shuffle of short keys, counted before it."""
    zero = F.lit(0).cast("long")
    rows = [df.select(match_key(F.col(key)).alias("k"), *((F.lit(1).cast("long") if n == name else zero).alias(n) for n in keys)) for name, (df, key) in keys.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("k").agg(*(F.sum(n).alias(n) for n in keys))


def _sums(df: DataFrame, **amounts: Column) -> DataFrame:
    """gate_id, violations: sums over all rows, 0 where there are none."""
    summed = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in amounts.items()))
    return summed.select(F.explode(F.array(*(F.struct(F.lit(name).alias("gate_id"), F.col(name).alias("violations")) for name in amounts))).alias("r")).select("r.*")


def _without(name: str, other: str) -> Column:
    """Rows of name whose key no row of other has; a null key has no partner."""
    return F.when(F.col("k").isNull() | (F.col(other) == 0), F.col(name))


def absent(name: str, df: DataFrame, other: DataFrame, on: str, other_on: str | None = None) -> DataFrame:
    """A rule that rows without a partner in other break."""
    return _sums(_tally(here=(df, on), there=(other, other_on or on)), **{name: _without("here", "there")})


def mismatched(name: str, df: DataFrame, other: DataFrame, on: str, values: dict[str, str]) -> DataFrame:
    """A rule that pairs of rows with one key break when values (column of df -> column of other) differ, and rows of df without a partner when they have any
    value.  Pairs are counted, not made: of a key, all pairs less those of equal values."""
    value = lambda columns: F.when(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull(), match_key(*(F.col(c) for c in columns)))
    side = lambda rows, columns, here: rows.select(match_key(F.col(on)).alias("k"), value(columns).alias("v"), F.lit(int(here)).cast("long").alias("here"), F.lit(int(not here)).cast("long").alias("there"))
    rows = side(df, list(values), True).unionByName(side(other.filter(F.col(on).isNotNull()), list(values.values()), False))
    same = rows.groupBy("k", "v").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))
    keys = same.groupBy("k").agg(
        F.sum("here").alias("here"), F.sum("there").alias("there"), F.sum(F.col("here") * F.col("there")).alias("equal"), F.sum(F.when(F.col("v").isNull(), F.col("here")).otherwise(0)).alias("blank")
    )
    return _sums(keys, **{name: F.col("here") * F.greatest("there", F.lit(1)) - F.col("equal") - F.when(F.col("there") == 0, F.col("blank")).otherwise(0)})


def empty(name: str, df: DataFrame, condition: str) -> DataFrame:
    """A rule that is broken if no row meets the condition."""
    return df.agg((F.count_if(F.expr(condition)) == 0).cast("long").alias("violations")).select(F.lit(name).alias("gate_id"), "violations")


def _one_pass(rows: DataFrame, **amounts: Column) -> DataFrame:
    """gate_id, violations of amounts that aggregate all rows."""
    counted = rows.agg(*(c.cast("long").alias(name) for name, c in amounts.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(name).alias("gate_id"), F.col(name).alias("violations")) for name in amounts))).alias("r")).select("r.*")


def _of_relations(t: dict[str, DataFrame]) -> DataFrame:
    """Rules over single relations, read once, and those that count them beside the rows they tell of."""
    told = lambda predicate: F.count_if(F.col("predicate") == predicate)
    parity = {
        "SOURCE_DERIVED_RELATION_MISMATCH": ("derived_artifacts", "source_artifact_derived_to_output"),
        "SOURCE_GAP_RELATION_MISMATCH": ("source_gap_task", "source_artifact_has_source_gap"),
        "ARCHIVE_MEMBER_RELATION_MISMATCH": ("archive_member", "archive_contains_member")
    }
    counted = _one_pass(
        t["explicit_relation"], RELATION_WITHOUT_EVIDENCE=F.count_if(F.col("evidence_count") == 0), COARSE_PREDICATE_PRESENT=F.count_if(F.col("predicate").isin(*COARSE_PREDICATES)),
        RELATION_END_MISSING=F.count_if(F.col("subject").isNull() | F.col("object").isNull()), BUSINESS_RELATIONS_EMPTY=F.count_if(F.col("relation_kind") == "business") == 0,
        STRUCTURAL_RELATIONS_EMPTY=F.count_if(F.col("relation_kind") == "structural") == 0, **{gate: told(predicate) for gate, (_, predicate) in parity.items()},
    )
    # a rule of parity is broken by as much as its relations and its rows differ
    rows = [t[name].agg((-F.count("*")).alias("violations")).select(F.lit(gate).alias("gate_id"), "violations") for gate, (name, _) in parity.items()]
    return reduce(DataFrame.unionByName, [counted, *rows]).groupBy("gate_id").agg(F.abs(F.sum("violations")).alias("violations"))


def _of_events(event: DataFrame) -> DataFrame:
    """Rules over single events and their stable keys, which are made once."""
    rules = {
        "TIMELINE_STABLE_KEY_MISSING": "stable_order_key IS NULL OR stable_order_key = ''", "TIMELINE_SEQUENCE_MISSING": "stable_sequence IS NULL OR stable_sequence <= 0",
        "TIMELINE_ABSOLUTE_INCOMPLETE": "sort_key IS NULL AND local_key IS NULL", "TIMELINE_LOCAL_INCONSISTENT": "sort_key IS NOT NULL AND local_key IS NOT NULL",
        "BUSINESS_TIMELINE_EMPTY": "axis = 'business'", "CAPTURE_TIMELINE_EMPTY": "axis = 'capture'",
    }
    each = event.select(match_key(F.col("stable_order_key")).alias("k"), *(F.coalesce(F.expr(rule), F.lit(False)).cast("long").alias(name) for name, rule in rules.items()))
    keys = each.groupBy("k").agg(F.count("*").alias("n"), *(F.sum(name).alias(name) for name in rules))
    summed = {name: F.coalesce(F.sum(name), F.lit(0)) for name in rules}
    summed |= {name: summed[name] == 0 for name in rules if name.endswith("_EMPTY")}
    return _one_pass(keys, **summed, TIMELINE_STABLE_KEY_DUPLICATE=F.count_if(F.col("n") > 1))


def _of_records(proof: DataFrame, record: DataFrame, event: DataFrame) -> DataFrame:
    """Proofs, parents and events meet their records in one shuffle.  A proof and its record must name one place: all pairs of a key less those of equal values break the rule."""
    sides = ("proofs", "records", "parents", "events")
    side = lambda name, rows, key, value=None: rows.select(match_key(F.col(key)).alias("k"), (F.lit(None) if value is None else value).cast("struct<a:bigint,b:int>").alias("v"), *(F.lit(int(s == name)).cast("long").alias(s) for s in sides))
    place = F.when(F.col("artifact_id").isNotNull() | F.col("json_pointer").isNotNull(), match_key(F.col("artifact_id"), F.col("json_pointer")))
    rows = reduce(DataFrame.unionByName, [
        side("proofs", proof, "record_id", place), side("records", record, "record_id", place), side("parents", record.filter("parent_record_id IS NOT NULL"), "parent_record_id"), side("events", event, "record_id")
    ])
    same = rows.groupBy("k", "v").agg(*(F.sum(s).alias(s) for s in sides))
    # a null key has no partner
    equal, blank = F.when(F.col("k").isNotNull(), F.col("proofs") * F.col("records")), F.when(F.col("v").isNull(), F.col("proofs"))
    keys = same.groupBy("k").agg(*(F.sum(s).alias(s) for s in sides), F.coalesce(F.sum(equal), F.lit(0)).alias("equal"), F.coalesce(F.sum(blank), F.lit(0)).alias("blank"))
    there = F.when(F.col("k").isNotNull(), F.col("records")).otherwise(F.lit(0))
    pairs = F.col("proofs") * F.greatest(there, F.lit(1)) - F.col("equal") - F.when(there == 0, F.col("blank")).otherwise(0)
    return _sums(
        keys, PROVENANCE_RECORD_MISMATCH=pairs, RECORD_DUPLICATE=F.when(F.col("records") > 1, 1), RECORD_PARENT_MISSING=_without("parents", "records"), EVENT_RECORD_MISSING=_without("events", "records")
    )


def _of_proofs(relation: DataFrame, proof: DataFrame, record: DataFrame) -> DataFrame:
    """Relations beside the number of their proofs, and of those whose record has a pointer: both are counted from one reading of the proofs."""
    pointed = record.filter("json_pointer <> ''").select(match_key(F.col("record_id")).alias("r")).distinct().withColumn("_pointed", F.lit(1).cast("long"))
    named = proof.select(match_key(F.col("record_id")).alias("r"), match_key(F.col("relation_id")).alias("k")).join(pointed, "r", "left")
    proven = named.groupBy("k").agg(F.count("*").alias("proofs"), F.count("_pointed").alias("pointed"))
    told = relation.select(match_key(F.col("relation_id")).alias("k"), "evidence_count", (F.col("predicate") == "order_has_product").alias("product")).join(proven, "k", "left")
    return _one_pass(
        told, RELATION_EVIDENCE_COUNT_MISMATCH=F.count_if(F.col("evidence_count") != F.coalesce("proofs", F.lit(0))),
        ORDER_PRODUCT_WITHOUT_SOURCE_POINTER=F.count_if(F.col("product") & (F.coalesce("pointed", F.lit(0)) == 0))
    )


def gates(t: dict[str, DataFrame]) -> DataFrame:
    """gate_id, violations, status of all rules over the tables of a package.  Rules that match the same keys share a pass; each pass leaves its few rows only."""
    relation, proof, event, artifact, record = t["explicit_relation"], t["relation_evidence"], t["timeline_event"], t["artifacts"], t["record_occurrence"]
    ends = relation.select(F.explode(F.array("subject", "object")).alias("node_id"))
    manifest = t["source_manifest"]
    same = ["source_rel", "source_sha256", "source_bytes"]
    once = lambda c: F.when(c, 1)
    passes = [
        [
            _of_relations(t),
            rules(t["trade_entity"], TRADE_UNBOUND_FLAG_INVALID="NOT unbound_to_customer OR binding_status <> 'UNBOUND' OR binding_evidence_pointer IS NOT NULL"),
            empty("TRADE_ENTITY_EMPTY", t["trade_entity"], "true"),
        ],
        [mismatched("ATTACHMENT_OCCURRENCE_ARTIFACT_MISMATCH", t["attachment_occurrence"], artifact, "artifact_id", {"artifact_source_rel": "source_rel", "artifact_sha256": "source_sha256"})],
        [mismatched("PROVENANCE_ARTIFACT_MISMATCH", proof, artifact, "artifact_id", {"source_rel": "source_rel"})],
        [_of_records(proof, record, event)],
        [_of_proofs(relation, proof, record)],
        [_sums(_tally(nodes=(t["nodes"], "node_id"), ends=(ends, "node_id")), UNREFERENCED_NODE_PRESENT=_without("nodes", "ends"), RELATION_NODE_MISSING=once((F.col("ends") > 0) & (F.col("k").isNull() | (F.col("nodes") == 0))), NODE_DUPLICATE=once(F.col("nodes") > 1))],
        [_of_events(event)],
        [rows_of("TIMELINE_SEQUENCE_NOT_CONTIGUOUS", event.groupBy("axis").agg(F.min("stable_sequence").alias("low"), F.max("stable_sequence").alias("high"), F.count("*").alias("n"), F.countDistinct("stable_sequence").alias("d")).filter("low <> 1 OR high <> n OR d <> n"))],
        [_sums(_tally(files=(artifact, "artifact_id"), roots=(record.filter("pointer_kind = 'artifact'"), "artifact_id"), lines=(t["lineage"], "source_artifact_id")), ARTIFACT_DUPLICATE=once(F.col("files") > 1), ARTIFACT_RECORD_COVERAGE_MISMATCH=_without("files", "roots"), ARTIFACT_LINEAGE_MISSING=_without("files", "lines"))],
        [absent("EVIDENCE_EVENT_MISSING", proof.filter("event_id IS NOT NULL"), event, "event_id")],
        [
            rows_of("SOURCE_GAP_PRETENDED_DERIVED", t["source_gap_task"].join(t["derived_artifacts"], "task_id", "left_semi")),
            rows_of("PROVENANCE_MANIFEST_ARTIFACT_MISMATCH", manifest.join(artifact, same, "left_anti")),
        ],
    ]
    every = reduce(DataFrame.unionByName, [kept(reduce(DataFrame.unionByName, found).select("gate_id", F.col("violations").cast("long").alias("violations")).coalesce(1), "gates") for found in passes])
    return every.select("gate_id", "violations", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"))
