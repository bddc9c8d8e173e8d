"""Exact order statistics of a column that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orewright.plans.shared import Scratch


def values_at(values: DataFrame, column: str, places: list[int], own: Scratch) -> list[float]:
    """The values at the given places (from 0) of the column in rising order, nulls left out.

    Values are dealt into ranges and counted there; only the ranges that hold a place are looked into, by value and count, so many equal values are one row.
    """
    dealt = own.keep(values.select(F.col(column).alias("v")).where("v is not null").repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each range
    found: dict[int, float] = {}
    before = 0
    for part, n in counts:
        inside = [p for p in places if before <= p < before + n]
        if inside:
            ends = dealt.where(F.col("part") == part).groupBy("v").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy("v")) + before)  # one range
            for p in inside:
                found[p] = ends.where(F.col("end") > p).agg(F.min("v")).first()[0]
        before += n
    return [found[p] for p in places]


def percentile(values: DataFrame, column: str, share: float, own: Scratch) -> float | None:
    """The percentile with linear interpolation between neighbours; None without a value."""
    n = values.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    low, high = values_at(values, column, [int(at), min(int(at) + 1, n - 1)], own)
    return low + (high - low) * (at - int(at))
