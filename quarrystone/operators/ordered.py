"""Running totals over a whole table in a stated order, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrystone.sources.scratch import kept


def in_ranges(df: DataFrame, order: list[str], label: str = "ranges") -> DataFrame:
    """df with _part: ranges of rows that follow each other in order, as a written table.  Rows that are equal in order share a range."""
    return kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)


def running_totals(df: DataFrame, order: list[str], amounts: dict[str, str]) -> DataFrame:
    """df with a column for each of amounts (name -> expression): its sum over all rows before this one.

    Ranges add up on their own; there are as many sums as ranges, and those are added up in order.  order must tell rows apart."""
    dealt = in_ranges(df, order)
    names = {name: f"_{name}" for name in amounts}
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(*(F.sum(F.expr(e)).alias(names[n]) for n, e in amounts.items()))
    offsets = sums.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in names.values()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({n: F.coalesce(F.sum(F.expr(e)).over(inside), F.lit(0)) for n, e in amounts.items()})
    return within.join(F.broadcast(offsets), "_part").withColumns({n: F.col(n) + F.col(c) for n, c in names.items()}).drop("_part", *names.values())
