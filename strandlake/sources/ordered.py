"""Order-dependent columns without a window over a whole file: within slices of places, then over one row a slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import settled

SLICE = 100_000


def _sliced(rows: DataFrame, place: str, size: int) -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(place) / size))


def neighbour(rows: DataFrame, partition: Sequence[str], place: str, value: Column, name: str, ahead: bool = False, size: int = SLICE) -> DataFrame:
    """Adds the value of the row before, or ahead, in the order of `place`; null at the ends."""
    rows = _sliced(rows, place, size).withColumn("_value", F.struct(F.col(place), value.alias("v")))
    within, over = Window.partitionBy(*partition, "_slice").orderBy(place), Window.partitionBy(*partition).orderBy("_slice")
    shift = F.lead if ahead else F.lag
    ends = rows.groupBy(*partition, "_slice").agg((F.min if ahead else F.max)("_value").alias("_end"))
    ends = ends.select(*partition, "_slice", shift("_end").over(over).alias("_beyond"))
    out = rows.withColumn("_near", shift("_value").over(within)).join(ends, [*partition, "_slice"])
    return out.withColumn(name, F.coalesce("_near", "_beyond")["v"]).drop("_slice", "_value", "_near", "_beyond")


def running(rows: DataFrame, partition: Sequence[str], place: str, value: Column, name: str, how: str = "sum", size: int = SLICE) -> DataFrame:
    """Adds the running sum or maximum of a value up to and including each row."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = _sliced(rows, place, size).withColumn("_value", value)
    within = Window.partitionBy(*partition, "_slice").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*partition).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*partition, "_slice").agg(fold("_value").alias("_total"))
    totals = totals.select(*partition, "_slice", fold("_total").over(earlier).alias("_before"))
    out = rows.withColumn("_within", fold("_value").over(within)).join(totals, [*partition, "_slice"])
    both = F.coalesce("_before", F.lit(0)) + F.col("_within") if how == "sum" else F.coalesce("_within", "_before")
    return out.withColumn(name, both).drop("_slice", "_value", "_within", "_before")


def places(rows: DataFrame) -> DataFrame:
    """Adds place, the place of a row of a sorted frame, from 0: written once, counted by partition, and then numbered without a window over all."""
    at = F.monotonically_increasing_id()
    kept = settled(rows.withColumns({"_part": F.shiftrightunsigned(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = kept.groupBy("_part").agg(F.max("_at").alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
