"""Repair entries as keyed state with timers.

Entries are kept in Spark's state store in runs of RUN neighbouring ids, which share one state: a batch touches the runs whose entries it names and no others, so its
cost follows the batch and not the queue, and a call of Python serves a run instead of an entry.  A run never holds more than RUN entries, whatever the ids.
Observations of an entry raise its severity and attempts; one that was resolved after it was last observed stays resolved, and an observation
after that opens it again.  A timer in business time follows every open entry: if nothing is heard of it for RETRY_AFTER, it is due for another
attempt, which counts; when it has had MOST_ATTEMPTS, it is given up and forgotten.  A run wakes at the first timer of its entries.

Updates are a ledger of their own, appended by batch; a batch that is run again after a failure writes the same file set once more under its number, so
nothing counts twice.  The newest update of an entry is its present state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds of business time without news after which an open entry is due, and attempts that it has.
RETRY_AFTER, MOST_ATTEMPTS = 3_600_000, 5
#: Ids that share a state, as a power of two.
RUN_BITS = 8
RUN = 1 << RUN_BITS
#: What a state holds of each of its entries, as 64-bit numbers, and what stands for a missing one: less than any other, so the greater of two is right.
FIELDS = "slot", "severity", "attempts", "first", "last", "resolved", "timer", "steps"
NONE = -(1 << 63)
STATE = "entries binary"
UPDATE = "entry long, severity int, attempts long, first_recorded long, last_recorded long, status string, step long"


def repair_states(stream: DataFrame, timed: bool = True, retry_after: int = RETRY_AFTER, most_attempts: int = MOST_ATTEMPTS, late: str = "0 seconds") -> DataFrame:
    """UPDATE rows of a stream (entry, severity, recorded (milliseconds), attempts, resolved_at): what a batch, or a timer, makes of an entry.

    step counts the updates of an entry.  Without timed no timer is set."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {f: np.full(RUN, NONE) for f in FIELDS[1:]}
        known["steps"][:] = 0
        if state.exists:
            slot, *values = np.frombuffer(bytes(state.get[0]), np.int64).reshape(len(FIELDS), -1)
            for f, v in zip(FIELDS[1:], values):
                known[f][slot] = v
        severity, attempts, first, last, resolved, timer, steps = known.values()
        heard, low, observed = steps == 0, np.full(RUN, np.iinfo(np.int64).max), np.full(RUN, NONE)
        held, now = ~heard, state.getCurrentWatermarkMs() if timed else NONE
        heard[:] = False
        if not state.hasTimedOut:
            for rows in batches:
                slot = rows["entry"].to_numpy() & (RUN - 1)
                heard[slot] = True
                for best, of, column in ((np.maximum, observed, "recorded"), (np.minimum, low, "recorded"), (np.maximum, severity, "severity"), (np.maximum, attempts, "attempts"), (np.maximum, resolved, "resolved_at")):
                    best.at(of, slot, rows[column].to_numpy())
        first[heard] = np.where(first == NONE, low, np.minimum(first, low))[heard]
        last[heard] = np.maximum(last, observed)[heard]
        done = heard & (resolved != NONE) & (resolved >= observed)
        resolved[heard & ~done] = NONE
        timer[heard] = np.where(done | (not timed), NONE, np.maximum(last, now) + retry_after)[heard]
        # entries of the run that nothing was heard of go by their own timers
        over = held & ~heard & (timer != NONE) & (timer < now)
        attempts[over & (attempts == NONE)] = 0
        gone = over & (attempts >= most_attempts)
        due = over & ~gone
        attempts[due] += 1
        last[due], timer[due] = now, now + retry_after
        steps[heard | over] += 1

        stays = np.flatnonzero((held | heard) & ~gone)
        if len(stays):
            state.update((np.stack([stays, *(v[stays] for v in known.values())]).tobytes(),))
            if (timer[stays] != NONE).any():
                state.setTimeoutTimestamp(int(timer[stays][timer[stays] != NONE].min()))
        else:
            state.remove()
        at = np.flatnonzero(heard | over)
        status = np.select([done, heard, gone], ["resolved", "open", "given_up"], "due")[at]
        number = lambda v: pd.array(v[at], "Int64") if (v[at] != NONE).all() else pd.arrays.IntegerArray(v[at], v[at] == NONE)
        yield pd.DataFrame(dict(zip((c.split()[0] for c in UPDATE.split(", ")), (
            (int(key[0]) << RUN_BITS) + at, number(severity), number(attempts), first[at], last[at], status.astype(object), steps[at],
        ))))

    if timed:
        stream = stream.withColumn("at", F.timestamp_millis("recorded")).withWatermark("at", late)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    known = stream.filter("entry IS NOT NULL AND recorded IS NOT NULL")
    # missing numbers cross to Python as one that says so: pandas would make floats of a column that has any
    numbers = {c: F.coalesce(F.col(c).cast("long"), F.lit(NONE).cast("long")) for c in ("severity", "attempts", "resolved_at")}
    numbers |= {c: F.col(c).cast("long") for c in ("entry", "recorded")}
    return known.withColumns(numbers).withColumn("run", F.shiftright("entry", RUN_BITS)).groupBy("run").applyInPandasWithState(step, UPDATE, STATE, "update", timeout)


def append_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the updates of each batch under its number."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def present(spark: SparkSession, path: str) -> DataFrame:
    """The newest update of each entry."""
    rows = spark.read.schema(f"{UPDATE}, batch long").parquet(path)
    rest = [c.split()[0] for c in UPDATE.split(", ")][1:]
    return rows.groupBy("entry").agg(F.max_by(F.struct(*rest), F.struct("batch", "step")).alias("_v")).select("entry", *(F.col("_v")[c].alias(c) for c in rest))
