"""Reconciling what was announced with what was captured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")


def pagination_summary(rows: DataFrame, group: str, item: str, announced: str) -> DataFrame:
    """Rows of pages against the total they announce: complete if each announced item is there once."""
    found = rows.groupBy(group).agg(
        F.max(announced).alias("expected"), F.count("*").alias("rows"), F.count(item).alias("with_id"), F.countDistinct(item).alias("distinct_ids"),
    )
    return found.withColumn("without_id", F.col("rows") - F.col("with_id")).withColumn("duplicates", F.col("with_id") - F.col("distinct_ids")).withColumn(
        "complete", (F.col("expected") == F.col("distinct_ids")) & (F.col("rows") == F.col("distinct_ids"))
    )


def multiset_fingerprint(rows: DataFrame, group: str, identity: Column) -> DataFrame:
    """One hash for the rows of each group, repeats counted, whatever their order.

    Hashes of rows are added up in two exact halves, so groups of any size combine before the shuffle and none is gathered."""
    digest = F.sha2(identity, 256)
    part = lambda k: F.sum(F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{k}")
    sums = rows.groupBy(group).agg(F.count("*").alias("rows"), *(part(k) for k in range(5)))
    return sums.select(
        group, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *(F.col(f"p{k}").cast("string") for k in range(5))), 256).alias("fingerprint")
    )


def sorted_fingerprint(rows: DataFrame, group: str, identity: Column) -> DataFrame:
    """SHA-256 of the sorted identities of a group joined by newlines: for groups that a page or a case bounds."""
    return rows.groupBy(group).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(identity)), "\n"), 256).alias("fingerprint"))


def stable(first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """Two passes over the same groups: stable where both gave the same fingerprint."""
    a, b = first.select(group, F.col("fingerprint").alias("f1")), second.select(group, F.col("fingerprint").alias("f2"))
    return a.join(b, group, "full").select(group, F.coalesce(F.col("f1") == F.col("f2"), F.lit(False)).alias("stable"))


def bijection(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """How far pairs are one to one: keys of either side with several partners."""
    by_left = pairs.groupBy(left).agg(F.countDistinct(right).alias("n")).agg(
        F.count("*").alias("left_keys"), F.count_if(F.col("n") > 1).alias("left_conflicts")
    )
    by_right = pairs.groupBy(right).agg(F.countDistinct(left).alias("n")).agg(
        F.count("*").alias("right_keys"), F.count_if(F.col("n") > 1).alias("right_conflicts")
    )
    return by_left.join(by_right).withColumn("bijective", (F.col("left_conflicts") == 0) & (F.col("right_conflicts") == 0))


def symmetric_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    a, b = expected.select(key).distinct(), actual.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def resolved_resources(resources: DataFrame, artifacts: DataFrame, unavailable: DataFrame) -> DataFrame:
    """Resources (resource_id, identity, alias) to artifacts (artifact_id, identity, alias, sequence): by exact identity, else by an
    alias that names one artifact only, else known to be unavailable, else unresolved."""
    exact = artifacts.groupBy("identity").agg(F.min_by("artifact_id", "sequence").alias("exact_id"))
    unique = artifacts.groupBy("alias").agg(
        F.countDistinct("identity").alias("n"), F.min_by("artifact_id", "sequence").alias("alias_id")
    ).filter("n = 1").drop("n")
    gone = unavailable.select("identity").distinct().withColumn("gone", F.lit(True))
    joined = resources.join(exact, "identity", "left").join(unique, "alias", "left").join(gone, "identity", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").when(F.col("gone"), "source_unavailable").otherwise("unresolved")
    return joined.select("resource_id", how.alias("resolution"), F.coalesce("exact_id", "alias_id").alias("artifact_id"))


def covered_failures(failures: DataFrame, successes: DataFrame, keys: list[str]) -> DataFrame:
    """Failures with the first of the given keys that a success shares; null keys never match."""
    found = failures
    for k in keys:
        hit = successes.select(F.col(k).alias(f"_{k}")).filter(F.col(f"_{k}").isNotNull()).distinct()
        found = found.join(hit, F.col(k) == F.col(f"_{k}"), "left")
    case = F.lit("uncovered")
    for k in reversed(keys):
        case = F.when(F.col(f"_{k}").isNotNull(), k).otherwise(case)
    return found.withColumn("covered_by", case).drop(*(f"_{k}" for k in keys))


def merged_repairs(queue: DataFrame, observed: DataFrame) -> DataFrame:
    """Repair entries (entry, severity 0-2, recorded, attempts, resolved_at) merged with new observations of the same columns.

    The graver and later entry leads, attempts keep their maximum and the first record its time; an entry resolved after
    it was last observed stays resolved."""
    both = queue.withColumn("known", F.lit(True)).unionByName(observed.withColumn("known", F.lit(False)))
    one = both.groupBy("entry").agg(
        F.max("severity").alias("severity"), F.max("attempts").alias("attempts"), F.min("recorded").alias("first_recorded"), F.max("recorded").alias("last_recorded"), F.max("resolved_at").alias("resolved_at"),
        F.max(F.when(~F.col("known"), F.col("recorded"))).alias("observed"), F.max("known").alias("was_known"), F.max(F.when(F.col("known"), F.col("severity"))).alias("old_severity"),
    )
    resolved = F.coalesce(F.col("resolved_at") >= F.coalesce("observed", F.col("resolved_at")), F.lit(False))
    change = F.when(~F.col("was_known"), "added").when(F.col("observed").isNull(), "unchanged").when(resolved, "unchanged").when(F.col("resolved_at").isNotNull(), "reopened").when(F.col("severity") > F.col("old_severity"), "updated").otherwise("unchanged")
    return one.select(
        "entry", "severity", "attempts", "first_recorded", "last_recorded", F.when(resolved, "resolved").otherwise("open").alias("status"),
        change.alias("change")
    )


def metric_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """metric, old, new and their difference; a metric on one side counts as 0 on the other."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = old.toDF("metric", "old").join(new.toDF("metric", "new"), "metric", "full").select("metric", z("old"), z("new"))
    return joined.withColumn("difference", F.col("new") - F.col("old"))


def capped(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows for presentation, each with the uncapped total."""
    total = rows.agg(F.count("*").alias("total_rows"))
    return rows.orderBy(*order).limit(most).join(F.broadcast(total))


def set_relation(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How two sets of keys stand to each other, with the sizes of their parts."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    counted = a.join(b, key, "full").agg(
        F.count_if(F.expr("_b IS NULL")).alias("left_only"), F.count_if(F.expr("_a IS NULL")).alias("right_only"),
        F.count_if(F.expr("_a = 1 AND _b = 1")).alias("both")
    )
    none = lambda c: F.col(c) == 0
    how = F.when(none("left_only") & none("right_only"), "equal").when(none("left_only"), "subset").when(none("right_only"), "superset").when(none("both"), "disjoint").otherwise("overlap")
    return counted.withColumn("relation", how)
