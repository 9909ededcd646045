"""Smaller record operators: pairs seen together, modes, first known values, merged pages, recognised words, covers, receipts and next actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.functions.classify import rules
from quarrystone.sources.scratch import kept


def pairs_within(rows: DataFrame, record: str, position: str, ident: str) -> DataFrame:
    """Ordered pairs of different ids of one record, earlier position first: records are single objects, so their lists are short.

    Pairs are made inside each record's own array; no self-join."""
    listed = rows.groupBy(record).agg(F.sort_array(F.collect_list(F.struct(position, ident)))[ident].alias("_ids"))
    n = F.size("_ids")
    lefts = F.explode(F.sequence(F.lit(1), n - 1))
    pairs = listed.filter(n > 1).select(record, "_ids", lefts.alias("_i"))
    return pairs.select(
        record, F.element_at("_ids", F.col("_i")).alias("left_id"), F.explode(F.slice("_ids", F.col("_i") + 1, n)).alias("right_id")
    ).filter("left_id <> right_id")


def most_common(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each group; of equals, the one seen first."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    best = F.max(F.struct(F.col("n"), (-F.col("_first")).alias("_early"), F.col(value).alias("_value")))
    return counted.groupBy(group).agg(best.alias("_b")).select(group, F.col("_b._value").alias(value), F.col("_b.n").alias("n"))


def first_known(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The first value of each key that is not null, in order of position; keys without one keep null."""
    return rows.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias(value))


def merged_pages(native: DataFrame, recognised: DataFrame, key: list[str]) -> DataFrame:
    """Text of each page: recognised text where it says anything, else the page's own."""
    n, r = native.select(*key, F.col("text").alias("_native")), recognised.select(*key, F.col("text").alias("_seen"))
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    how = F.when(blank("_seen").isNotNull(), "recognised").when(blank("_native").isNotNull(), "native").otherwise("blank")
    return n.join(r, key, "full").select(*key, F.coalesce(blank("_seen"), blank("_native"), F.lit("")).alias("text"), how.alias("origin"))


def recognised_lines(words: DataFrame, line: list[str], position: str, word: str, confidence: str) -> DataFrame:
    """Words of a line joined in order, with the mean of the confidences that are not negative."""
    sure = F.when(F.col(confidence) >= 0, F.col(confidence))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, word))), lambda s: s[word]), " ")
    return words.groupBy(*line).agg(joined.alias("line_text"), F.avg(sure).alias("mean_confidence"), F.count("*").alias("words"))


def window_anchors(ids: DataFrame, ident: str, step: int, buckets: int = 256) -> DataFrame:
    """Every step-th id in order and the last: from these, windows of step ids cover all.  Ranks come from counts of id ranges."""
    bounds = ids.agg(F.min(ident).alias("_low"), F.max(ident).alias("_high"))
    dealt = ids.join(F.broadcast(bounds)).withColumn("_b", F.floor((F.col(ident) - F.col("_low")) * buckets / (F.col("_high") - F.col("_low") + 1)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(ident))
    ranked = dealt.withColumn("_r", rank).join(F.broadcast(offsets), "_b").withColumn("position", F.col("_o") + F.col("_r") - 1)
    return ranked.filter((F.col("position") % step == 0) | (F.col(ident) == F.col("_high"))).select(ident, "position")


def window_cover(ids: DataFrame, windows: DataFrame, anchors: DataFrame, ident: str) -> DataFrame:
    """The anchors whose windows cover all ids, with the round that added them (0 for the given ones).

    windows (anchor, covered) says which ids each id's window holds; windows may have holes.  Of the ids that the given anchors leave uncovered, the first
    becomes an anchor, and so on with those that its window leaves.  A round takes at once every uncovered id that no earlier uncovered one can cover,
    which are the same ids in fewer rounds: as many as there are ids in the longest chain of windows that reach into each other.  State is a table for
    each round."""
    pairs = windows.select(F.col("anchor").alias("_a"), F.col("covered").alias("_c"))
    wanted = ids.select(F.col(ident).alias("_id")).distinct()
    chosen = kept(anchors.select(F.col(ident).alias("_id")).distinct().withColumn("round", F.lit(0)), "cover-anchors")
    picked, left, rounds, done = chosen, wanted, [chosen], 0
    while True:
        # when the first uncovered id is taken, all before it are covered: windows of added anchors matter forwards only
        seen = (pairs.filter("_c > _a") if done else pairs).join(picked, F.col("_a") == F.col("_id"), "left_semi").select(F.col("_c").alias("_id")).unionByName(picked.select("_id")).distinct()
        left = kept(left.join(seen, "_id", "left_anti"), "cover-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, rounds).select(F.col("_id").alias(ident), "round")
        done += 1
        inside = pairs.filter("_c > _a").join(left, F.col("_a") == F.col("_id"), "left_semi")
        later = inside.select(F.col("_c").alias("_id")).distinct()
        picked = kept(left.join(later, "_id", "left_anti").withColumn("round", F.lit(done)), "cover-anchors")
        rounds.append(picked)


def receipts_bound(receipts: DataFrame, artifacts: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """Whether each receipt agrees with its artifact in every check column; a receipt or artifact alone is unbound."""
    a = artifacts.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in checks))
    joined = receipts.join(a, F.col(key) == F.col("_key"), "full")
    wrong = F.array_join(F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in checks)), lambda x: x.isNotNull()), ",")
    status = F.when(F.col(key).isNull(), "no_receipt").when(F.col("_key").isNull(), "no_artifact").when(wrong != "", F.concat(F.lit("differs:"), wrong)).otherwise("bound")
    return joined.select(F.coalesce(key, "_key").alias(key), status.alias("binding"))


def receipt_totals(receipts: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """What a receipt (key, announced, announced_bytes) says against the artifacts (key, bytes) that are there: counts, bytes, and what does not close."""
    found = artifacts.groupBy(key).agg(F.count("*").alias("artifacts"), F.sum("bytes").cast("long").alias("bytes"))
    joined = receipts.join(found, key, "full").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("artifacts", "bytes")})
    status = rules(
        (F.col("announced").isNull(), "no_receipt"), (F.col("announced") != F.col("artifacts"), "count_differs"), (F.col("announced_bytes") != F.col("bytes"), "bytes_differ"), otherwise="closed",
    )
    return joined.withColumn("coverage", status)


def next_action(status: DataFrame, steps: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """The first step whose condition holds for a status row."""
    return status.withColumn("next_action", rules(*((condition, name) for name, condition in steps), otherwise=otherwise))


def multi_root_union(roots: dict[str, DataFrame]) -> DataFrame:
    """Rows of several roots with the root they came from; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("root", F.lit(name)) for name, df in roots.items()])
