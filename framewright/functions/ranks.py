"""Running sums and exact quantiles over values too many for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch


def running_sum(rows: DataFrame, order: list[str], value: str, total: str) -> DataFrame:
    """rows with `total`: the sum of value over all rows before, in an order that has no ties.

    Rows are dealt into ranges; each range is summed by itself, and what comes before it is one row per range.
    """
    x = scratch(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(F.broadcast(sums), "_range").withColumn(total, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_before")


def quantiles(rows: DataFrame, group: str, column: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each of shares): exact quantiles, interpolated, of few groups of many rows; nulls don't count.

    Values are counted before they move, so equal ones are one row, and are ranked in ranges; no task holds a group.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = scratch(running_sum(counts, [group, column], "_n", "_at"), "ranked")
    sizes = ranked.groupBy(group).agg(F.sum("_n").alias("_size"), F.min("_at").alias("_start"))
    x = ranked.join(F.broadcast(sizes), group).withColumn("_at", F.col("_at") - F.col("_start"))
    place = lambda q: F.lit(q) * (F.col("_size") - 1)
    holds = lambda i: F.max(F.when((F.col("_at") <= i) & (i < F.col("_at") + F.col("_n")), F.col(column)))
    found = x.groupBy(group).agg(F.first("_size").alias("_size"), *(holds(f(place(q))).alias(f"_{name}{side}") for name, q in shares.items() for side, f in ((0, F.floor), (1, F.ceil))))
    part = lambda q: place(q) - F.floor(place(q))
    return found.select(group, *(((1 - part(q)) * F.col(f"_{name}0") + part(q) * F.col(f"_{name}1")).alias(name) for name, q in shares.items()))
