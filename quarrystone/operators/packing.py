"""Greedy packing of ordered records into shards, in parallel.

Records of a group fill a shard in order until the next would overflow it, so where a shard begins depends on all records before.  But it does so
through one number only: how full the open shard is.  Records are laid out in ranges of their order; each range works out, from its end to its
start, where shards go on from any record at which one might begin.  For what a range makes of a shard that comes in, only records within the first
capacity matter: that is its summary.  Summaries of a group are walked in order, which gives every range the shard that is open when it begins, and
all ranges number their records at once.  A group of any size is spread over as many tasks as it has ranges.

Defined cases: a null or negative size counts nothing; a record larger than a shard stands alone, after records of size nought at most; null groups are one
group; records that are equal in order follow each other in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.operators.ordered import in_ranges
from quarrystone.sources.scratch import kept

SUMMARY = "_part int, place int, after array<long>, before array<long>, used array<long>, begun array<long>, total long"


def next_beginnings(before: np.ndarray, after: np.ndarray, capacity: int) -> np.ndarray:
    """For each record the one at which the next shard begins if one begins here; before and after: sums of sizes."""
    return np.maximum(np.searchsorted(after, before + capacity, side="right"), np.searchsorted(before, before, side="right"))


def goes_on(before: np.ndarray, after: np.ndarray, used: int, capacity: int) -> int:
    """The record at which the shard that comes in, so full, is closed."""
    return int(max(np.searchsorted(after, capacity - used, side="right"), np.searchsorted(before, -used, side="right")))


def segments(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]], np.ndarray]:
    """A range in order, the bounds of its groups and the sizes of its records."""
    table = table.take(pc.sort_indices(table, sort_keys=[("_rank", "ascending")]))
    group = table["_group"].to_numpy()
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)])) if len(group) else []
    return table, bounds, table["n"].to_numpy()


def packed(records: DataFrame, group: str, order: str, size: str, capacity: int) -> DataFrame:
    """group, order and shard (from 0 in each group) of each record."""
    rows = records.select(F.col(group).alias("g"), F.col(order).alias("o"), F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias("n"))
    kinds = dict(rows.dtypes)
    dealt = in_ranges(rows, ["g", "o"], "packing")
    here = Window.partitionBy("_part")
    ranked = dealt.withColumn("_rank", F.row_number().over(here.orderBy("g", "o"))).withColumn("_group", F.dense_rank().over(here.orderBy("g")))

    def summed_up(table: pa.Table) -> pa.Table:
        table, bounds, sizes = segments(table)
        found = []
        for low, high in dict.fromkeys((bounds[0], bounds[-1])):  # only these can go on in another range
            after = np.cumsum(sizes[low:high])
            before = after - sizes[low:high]
            ahead = next_beginnings(before, after, capacity).tolist()
            used, begun, total = [0] * len(ahead), [0] * len(ahead), int(after[-1])
            for k in range(len(ahead) - 1, -1, -1):
                at = ahead[k]
                used[k], begun[k] = (total - int(before[k]), 1) if at == len(ahead) else (used[at], begun[at] + 1)
            most = min(len(ahead), goes_on(before, after, 0, capacity) + 1)
            found.append((table["_part"][0].as_py(), low, after[:most].tolist(), before[:most].tolist(), used[:most], begun[:most], total))
        return pa.Table.from_pylist([dict(zip(names, f)) for f in found], schema=kind)

    names = [c.split()[0] for c in SUMMARY.split(", ")]
    longs = pa.list_(pa.int64())
    kind = pa.schema(list(zip(names, (pa.int32(), pa.int32(), longs, longs, longs, longs, pa.int64()))))
    of = ranked.select("_part", (F.col("_rank") - 1).alias("place"), "g")
    summaries = ranked.select("_part", "_rank", "_group", "n").groupBy("_part").applyInArrow(summed_up, SUMMARY).join(of, ["_part", "place"])

    def walked(table: pa.Table) -> pa.Table:
        used, shard, found = 0, -1, []
        for row in sorted(table.drop_columns("g").to_pylist(), key=lambda r: (r["_part"], r["place"])):
            if shard >= 0:
                found.append({"_part": row["_part"], "open_used": used, "open_shard": shard})
            after, before = np.array(row["after"]), np.array(row["before"])
            at = 0 if shard < 0 else goes_on(before, after, used, capacity)
            if at == len(after):  # nothing begins in this range
                used += row["total"]
            else:
                used, shard = row["used"][at], shard + row["begun"][at]
        return pa.Table.from_pylist(found, schema=pa.schema([("_part", pa.int32()), ("open_used", pa.int64()), ("open_shard", pa.int64())]))

    opened = kept(summaries.groupBy("g").applyInArrow(walked, "_part int, open_used long, open_shard long"), "packing-open")

    def numbered(table: pa.Table) -> pa.Table:
        table, bounds, sizes = segments(table)
        shards = np.zeros(len(sizes), np.int64)
        for low, high in bounds:
            after = np.cumsum(sizes[low:high])
            before = after - sizes[low:high]
            ahead = next_beginnings(before, after, capacity)
            first, at = 0, 0
            if low == 0 and table["open_shard"][0].is_valid:
                first = table["open_shard"][0].as_py()
                at = goes_on(before, after, table["open_used"][0].as_py(), capacity)
            else:
                at = int(ahead[0])
            while at < high - low:
                shards[low + at] = 1
                at = int(ahead[at])
            shards[low:high] = first + np.cumsum(shards[low:high])
        return table.select(["g", "o"]).append_column("shard", pa.array(shards))

    joined = ranked.join(opened, "_part", "left")
    return joined.groupBy("_part").applyInArrow(numbered, f"g {kinds['g']}, o {kinds['o']}, shard long").toDF(group, order, "shard")
