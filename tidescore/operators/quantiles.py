"""Exact order statistics of groups of any size.

A value's bucket is its number of bits and its leading ones, an order-preserving coarsening to a few thousand buckets. The
first pass counts buckets with map-side combining and finds the bucket that holds each wanted rank; the second reads those
buckets only and counts their values. No group is sorted or gathered whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEADING_BITS = 11


def _bucket(value: Column) -> Column:
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - LEADING_BITS)
    return (shift * (1 << LEADING_BITS)).cast("bigint") + F.call_function("shiftright", value, shift)


def rank_of(q: Column, n: Column) -> Column:
    """The 0-based place floor(q * n), at most n - 1; the product is a double."""
    return F.least(F.floor(q.cast("double") * n.cast("double")).cast("bigint"), n - 1)


def quantiles(rows: DataFrame, key: str, value: str, qs: Sequence[float]) -> DataFrame:
    """(key, q, value) for each group and q, of whole numbers that aren't negative; null values are passed over, a null key is a group."""
    known = rows.where(F.col(value).isNotNull()).select(F.struct(F.col(key)).alias("k"), F.col(value).cast("bigint").alias("v")).withColumn("b", _bucket(F.col("v")))
    up = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = known.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"))
    placed = coarse.withColumn("before", F.coalesce(F.sum("n").over(up("k", "b")), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    wanted = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("rank", rank_of(F.col("q"), F.col("total")))
    hit = wanted.where("rank >= before AND rank < before + n").select("k", "b", "q", (F.col("rank") - F.col("before")).alias("rank"))
    fine = known.join(hit.select("k", "b").distinct(), ["k", "b"]).groupBy("k", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = fine.withColumn("before", F.coalesce(F.sum("n").over(up("k", "b", "v")), F.lit(0)))
    found = counted.join(hit, ["k", "b"]).where("rank >= before AND rank < before + n")
    return found.select(F.col("k")[key].alias(key), "q", F.col("v").alias(value))
