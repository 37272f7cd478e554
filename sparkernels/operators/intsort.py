"""Integer sort by buckets: the steps by themselves, and the global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import positioned

BUCKETS = 256


def largest(ints: DataFrame) -> DataFrame:
    """(max)."""
    return ints.agg(F.max("a").alias("max"))


def histogram(ints: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, cnt): counts of equally wide buckets, the last one taking what is left over."""
    # One row of one number, so this broadcast is bounded.
    width = largest(ints).select(F.greatest(F.lit(1), F.expr(f"max div {buckets}")).alias("width"))
    bucket = F.least(F.lit(buckets - 1), F.call_function("div", F.col("a"), F.col("width")))
    return ints.join(F.broadcast(width)).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("cnt"))


def offsets(ints: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, cnt, start): where each bucket begins in the sorted order. A window over at most `buckets` rows."""
    before = F.sum("cnt").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return histogram(ints, buckets).select("bucket", "cnt", F.coalesce(before, F.lit(0)).alias("start"))


def sort(ints: DataFrame) -> DataFrame:
    """(pos, a): all values with their positions in ascending order, from 0."""
    return positioned(ints.select("a"), "a").select("pos", "a")
