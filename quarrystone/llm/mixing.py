"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows.  With its exact weight w (a rational number, all of them summing to 1), the j-th
block of a source is released at floor((j - 1) / w) and due at ceil(j / w); earliest deadline first fills one slot
after another.  At any slot every source is less than one block away from its target, however many slots went before:
weights are not rounded, so nothing adds up.

When a source runs out, a new phase begins: the others share the slots in the same proportions, and releases and deadlines
count from its first slot.  No row is dropped and none repeats.

The plan is made in stretches.  A phase that is long is cut at seams; what each source has placed before a seam is settled on the driver,
in time that does not depend on the blocks between seams, so that on both sides all blocks still fit between their releases and deadlines.  Then
each stretch is a task of its own.  Short phases and the last slots of a phase are planned on the driver.  The plan is a table in
the shared folder with PERIOD blocks of a source in a row; rows are numbered inside a source by (source, bucket of
the id's hash), so a source with most rows is spread over many tasks.

Defined cases: a null source is a source of its own; rows with a null id or repeated rows get places of
their own; a source without a weight gets the square root of its share of rows; weights of sources that are absent count
for nothing; a source of weight nought follows when those with a weight have run out; a negative weight is an error; an empty table gives an empty result; other columns are kept by mix(), but for one named _mix, and ignored by the query.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.llm.common import read_table, scratch_path, written

BLOCK_ROWS, PERIOD, BUCKETS = 32, 1000, 4096
#: Slots whose plan the driver writes at once.
PLAN_SLOTS = 1_000_000
#: Slots between seams, slots of a phase that is planned on the driver as a whole at most, and slots that are tried for a seam.
STRETCH, SHORT, TRIES = 1_000_000, 65_536, 1_000
PLAN = "_mix_source string, _mix_piece long, first long, slots array<long>"


def exact_shares(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Integers in exactly the proportions of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is negative")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def earliest_deadline_first(left: dict[str, int], shares: dict[str, int]) -> Iterator[str]:
    """The source of each slot until every source has placed its left blocks.

    At the start of a phase all sources wait for their first block, in the order of their shares, which is that of the deadlines; only
    those that got a slot enter the heaps, so a new phase costs nothing for the others."""
    left = dict(left)
    place = lambda s: (-shares[s], s)
    order = sorted(left, key=place)
    total = sum(shares[s] for s in order)
    while order:
        fresh, slot = 0, 0
        later: list[tuple[int, str, int]] = []
        ready: list[tuple[int, str, int]] = []
        while True:
            while later and later[0][0] <= slot:
                _, s, j = heapq.heappop(later)
                heapq.heappush(ready, (-(-j * total // shares[s]), s, j))
            if fresh < len(order) and (not ready or -(-total // shares[order[fresh]]) <= ready[0][0]):
                s, j = order[fresh], 1
                fresh += 1
            else:
                _, s, j = heapq.heappop(ready)
            yield s
            slot += 1
            left[s] -= 1
            if not left[s]:
                break
            heapq.heappush(later, (j * total // shares[s], s, j + 1))
        del order[bisect_left(order, place(s), key=place)]
        total -= shares[s]


@dataclass
class Stretch:
    """Slots low to high of a phase.  By source: its share, the blocks placed before the phase, and in the phase before low and before high."""

    start: int
    low: int
    high: int
    sources: list[str]
    shares: list[int]
    earlier: list[int]
    placed: list[int]
    until: list[int]

    def blocks(self) -> Iterator[tuple[str, int, int]]:
        """(source, block, slot): earliest deadline first among what lies between the two seams; a block that is placed before high is due there at the latest."""
        total, placed = sum(self.shares), list(self.placed)
        ready: list[tuple[int, int]] = []
        later: list[tuple[int, int]] = []
        for i, n in enumerate(placed):
            if n < self.until[i]:
                later.append((n * total // self.shares[i], i))
        heapq.heapify(later)
        for slot in range(self.low, self.high):
            while later and later[0][0] <= slot:
                i = heapq.heappop(later)[1]
                heapq.heappush(ready, (min(self.high, -(-(placed[i] + 1) * total // self.shares[i])), i))
            due, i = heapq.heappop(ready)
            if due <= slot:
                raise AssertionError("a block is late")
            yield self.sources[i], self.earlier[i] + placed[i], self.start + slot
            placed[i] += 1
            if placed[i] < self.until[i]:
                heapq.heappush(later, (placed[i] * total // self.shares[i], i))


def seam(slot: int, low: int, shares: list[int], before: list[int]) -> list[int] | None:
    """How many blocks of each source are placed before a slot, given how many were before an earlier seam at low; None if this slot is no place for a seam.

    Blocks due by then are placed.  Blocks under way share the slots that are left: as many go first as the deadlines after the seam ask for,
    of equal need those released first, and no more than there was room for since their releases.  Both bounds compare with the exact targets, summed over
    all sources whose deadline, or release, lies beyond: what holds for them holds for every stretch of slots that ends, or begins, at the seam."""
    total = sum(shares)
    placed, part = [slot * w // total for w in shares], [slot * w % total for w in shares]
    under_way = [i for i, x in enumerate(part) if x]
    gone = {i for i in under_way if before[i] > placed[i]}
    releases = {i: placed[i] * total // shares[i] for i in under_way}
    ends = sorted((-(-(placed[i] + 1) * total // shares[i]), i) for i in under_way)
    waiting: list[tuple[int, int]] = []
    beyond, inside, counted = sum(shares[i] for i in under_way), 0, 0
    for k, (end, i) in enumerate(ends):
        beyond -= shares[i]
        inside += part[i]
        if i in gone:
            counted += 1
        else:
            heapq.heappush(waiting, (releases[i], i))
        if k + 1 == len(ends) or ends[k + 1][0] > end:
            for _ in range((inside - (end - slot) * beyond) // total - counted):
                if not waiting:
                    return None
                gone.add(heapq.heappop(waiting)[1])
                counted += 1
    if len(gone) != slot - sum(placed):
        return None
    beyond, inside, counted = sum(shares[i] for i in under_way), 0, 0
    starts = sorted(((releases[i], i) for i in under_way), reverse=True)
    for k, (start, i) in enumerate(starts):
        beyond -= shares[i]
        inside += part[i]
        counted += i in gone
        if start > low and (k + 1 == len(starts) or starts[k + 1][0] < start) and counted > -(-(inside + (slot - start) * beyond) // total):
            return None
    return [n + (i in gone) for i, n in enumerate(placed)]


def until_one_runs_out(low: int, shares: list[int], placed: list[int], left: list[int]) -> Iterator[int]:
    """The source of each slot from low on, until one has placed all its blocks; placed is kept up to date."""
    total = sum(shares)
    later = [(n * total // w, i) for i, (n, w) in enumerate(zip(placed, shares))]
    heapq.heapify(later)
    ready: list[tuple[int, int]] = []
    slot = low
    while True:
        while later and later[0][0] <= slot:
            i = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(placed[i] + 1) * total // shares[i]), i))
        _, i = heapq.heappop(ready)
        placed[i] += 1
        yield i
        slot += 1
        if placed[i] == left[i]:
            return
        heapq.heappush(later, (placed[i] * total // shares[i], i))


def laid_out(left: dict[str, int], shares: dict[str, int]) -> Iterator[Stretch | tuple[str, int, int]]:
    """Stretches for tasks, and (source, block, slot) of the slots between them; together every block has one slot."""
    left, earlier, slot = dict(left), dict.fromkeys(left, 0), 0
    while left:
        many = len(left)
        if sum(left.values()) >= max(SHORT, many * many):
            names = sorted(left, key=lambda s: (-shares[s], s))
            ws, ns, es = [shares[s] for s in names], [left[s] for s in names], [earlier[s] for s in names]
            total = sum(ws)
            end = min(n * total // w for n, w in zip(ns, ws))
            low, placed = 0, [0] * many
            if end >= max(SHORT, many):
                for wanted in [*range(STRETCH, end, STRETCH), end]:
                    near = range(wanted, min(wanted + TRIES, end)) if wanted < end else range(end, max(low, end - TRIES), -1)
                    high, until = next(((at, found) for at in near if at > low and (found := seam(at, low, ws, placed))), (0, None))
                    if until:  # else the next stretch begins where this one did
                        yield Stretch(slot, low, high, names, ws, es, placed, until)
                        low, placed = high, until
            now = list(placed)
            for k, i in enumerate(until_one_runs_out(low, ws, now, ns) if all(map(int.__lt__, placed, ns)) else ()):
                yield names[i], es[i] + now[i] - 1, slot + low + k
            slot += sum(now)
            left = {s: n - k for s, n, k in zip(names, ns, now) if n > k}
            earlier = {s: e + k for s, e, k in zip(names, es, now)}
        else:
            for s in earliest_deadline_first(left, shares):
                yield s, earlier[s], slot
                earlier[s] += 1
                slot += 1
            return


def plan(rows: dict[str, int], weights: dict[str, float | Fraction], block_rows: int) -> Iterator[Stretch | tuple[str, int, int]]:
    """What laid_out() gives for all sources, those of weight nought after the others."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    shares = exact_shares({s: weights[s] for s in left})
    first = {s: n for s, n in left.items() if shares[s]}
    last = {s: n for s, n in left.items() if not shares[s]}
    yield from laid_out(first, shares)
    start = sum(first.values())
    for part in laid_out(last, dict.fromkeys(last, 1)):
        if isinstance(part, Stretch):
            part.start += start
            yield part
        else:
            yield part[0], part[1], part[2] + start


class Pieces:
    """Gathers slots by (source, piece): blocks of a source follow each other, period of them share a piece."""

    def __init__(self, period: int):
        self.period, self.open, self.held, self.done = period, {}, 0, []

    def add(self, source: str, block: int, slot: int) -> None:
        if source not in self.open:
            self.open[source] = block, array("q")
        elif not block % self.period:
            self._close(source)
            self.open[source] = block, array("q")
        self.open[source][1].append(slot)
        self.held += 1

    def _close(self, source: str) -> None:
        block, slots = self.open.pop(source)
        self.done.append((source, block // self.period, block, slots))

    def taken(self) -> pa.Table:
        """All that is held, which is let go."""
        for source in list(self.open):
            self._close(source)
        columns = list(zip(*self.done)) or [[], [], [], []]
        self.done, self.held = [], 0
        kinds = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())
        return pa.table([pa.array(map(memoryview, c) if k == kinds[3] else c, k) for c, k in zip(columns, kinds)], names=["_mix_source", "_mix_piece", "first", "slots"])


STRETCHES = "start long, low long, high long, sources array<string>, shares array<string>, earlier array<long>, placed array<long>, until array<long>"


def plan_table(spark: SparkSession, steps: Iterator[Stretch | tuple[str, int, int]], period: int) -> DataFrame:
    """_mix_source, _mix_piece, slots: block k of a source has the slot slots[k % period] in piece k // period; a table in the shared folder."""
    path = scratch_path(spark, "mix-plan")
    schema = spark.createDataFrame([], PLAN).schema
    pieces, stretches = Pieces(period), []

    def write() -> None:
        spark.createDataFrame(pieces.taken(), schema).coalesce(1).write.mode("append").parquet(path)

    for step in steps:
        if isinstance(step, Stretch):
            stretches.append((step.start, step.low, step.high, step.sources, list(map(str, step.shares)), step.earlier, step.placed, step.until))
            continue
        pieces.add(*step)
        if pieces.held >= PLAN_SLOTS:
            write()
    write()

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = Pieces(period)
                for block in Stretch(**(row | {"shares": [*map(int, row["shares"])]})).blocks():
                    mine.add(*block)
                yield from mine.taken().to_batches()

    if stretches:
        tasks = spark.createDataFrame(stretches, STRETCHES).repartition(len(stretches))
        tasks.mapInArrow(planned, PLAN).write.mode("append").parquet(path)
    parts = spark.read.schema(schema).parquet(path).groupBy("_mix_source", "_mix_piece").agg(F.sort_array(F.collect_list(F.struct("first", "slots"))).alias("parts"))
    return parts.select("_mix_source", "_mix_piece", F.flatten("parts.slots").alias("slots"))


def mix(
    docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS,
    period: int = PERIOD
) -> DataFrame:
    """docs with _mix: struct(source, block, slot, within).  slot and within order the mixture."""
    spark = docs.sparkSession
    row = docs.select(F.struct(*(c for c in docs.columns if c != "_mix")).alias("row"))
    ident = F.col(f"row.{id_col}")
    # no name of a source is empty here, so that stands for null
    source = F.coalesce(F.concat(F.lit("="), F.col(f"row.{source_col}").cast("string")), F.lit(""))
    bucket = F.pmod(F.when(ident.isNull(), F.xxhash64("row")).otherwise(F.xxhash64(ident.cast("long"))), F.lit(BUCKETS))
    named = row.select("row", source.alias("_mix_source"), bucket.alias("_mix_bucket"))
    counts = written(named.groupBy("_mix_source", "_mix_bucket").agg(F.count("*").alias("n")), "mix-counts")
    totals = dict(counts.groupBy("_mix_source").agg(F.sum("n")).toLocalIterator())
    all_rows = sum(totals.values())
    wanted = {s: (weights or {}).get(s[1:] if s else None, math.sqrt(n / all_rows)) for s, n in totals.items()}
    schedule = plan_table(spark, plan(totals, wanted, block_rows), period)

    offsets = counts.select(
        "_mix_source", "_mix_bucket",
        F.coalesce(F.sum("n").over(Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_mix_offset")
    )
    inside = named.withColumn("_mix_rank", F.row_number().over(Window.partitionBy("_mix_source", "_mix_bucket").orderBy(ident)))
    ranked = inside.join(offsets, ["_mix_source", "_mix_bucket"]).withColumn("_mix_rank", F.col("_mix_offset") + F.col("_mix_rank") - 1)
    block = F.floor(F.col("_mix_rank") / block_rows)
    blocks = ranked.withColumn("_mix_block", block).withColumn("_mix_piece", F.floor(F.col("_mix_block") / period))
    placed = blocks.join(schedule, ["_mix_source", "_mix_piece"])
    slot = F.get("slots", (F.col("_mix_block") % period).cast("int"))
    return placed.select(
        "row.*",
        F.struct(F.when(F.col("_mix_source") != "", F.substring("_mix_source", 2, 1 << 30)).alias("source"), F.col("_mix_block").alias("block"), slot.alias("slot"), (F.col("_mix_rank") % block_rows).alias("within")).alias("_mix")
    )


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows of mix() laid out in the order of the mixture, over files and inside each."""
    ordered = mixed.repartitionByRange(F.col("_mix.slot"), F.col("_mix.within")).sortWithinPartitions("_mix.slot", "_mix.within")
    return ordered.drop("_mix")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mix(docs)
    return mixed.select("doc_id", "source", F.col("_mix.block").alias("block"), F.col("_mix.slot").alias("slot"), F.col("_mix.within").alias("within"))
