"""Friendly numbers: numbers that share an abundancy, the sum of divisors over the number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers


def sigma(naturals: DataFrame) -> DataFrame:
    """(n, sigma) for each n >= 1; the sum for 1 is 1. A narrow projection: work grows with the root of n, nothing moves."""
    return naturals.select("n", numbers.sigma(F.col("n")).alias("sigma"))


def abundance(naturals: DataFrame) -> DataFrame:
    """(n, num, den): sigma(n)/n in lowest terms."""
    s = sigma(naturals).withColumn("g", numbers.gcd(F.col("sigma"), F.col("n")))
    return s.select("n", F.call_function("div", F.col("sigma"), F.col("g")).alias("num"), F.call_function("div", F.col("n"), F.col("g")).alias("den"))


def friend_pairs(naturals: DataFrame) -> DataFrame:
    """(pairs): how many unordered pairs share an abundancy: sizes of groups, combined before the shuffle, not pairs."""
    groups = abundance(naturals).groupBy("num", "den").agg(F.count("*").alias("c"))
    return groups.agg(F.coalesce(F.sum(F.expr("c * (c - 1) div 2")), F.lit(0)).cast("long").alias("pairs"))


def friends(naturals: DataFrame) -> DataFrame:
    """(a, b): the pairs themselves, a > b, as an equi-join on the abundancy; no number's group is gathered."""
    r = abundance(naturals)
    shared = r.groupBy("num", "den").agg(F.count("*").alias("c")).where("c > 1").select("num", "den")
    only = r.join(shared, ["num", "den"])
    return only.withColumnRenamed("n", "a").join(only.withColumnRenamed("n", "b"), ["num", "den"]).where("a > b").select("a", "b")


def worker(position: Column, count: Column, workers: int) -> Column:
    """The worker of a position among `count`: the first with the last, the second with the one before it, in turns."""
    paired = F.when(count % 2 == 0, F.least(position, count - 1 - position)).otherwise(F.least(position, count - position) - 1)
    return F.when((count % 2 == 1) & (position == 0), F.lit(0)).otherwise(F.pmod(paired, F.lit(workers))).cast("int")


def balance(naturals: DataFrame, workers: int) -> DataFrame:
    """(n, worker): numbers of a dense range dealt out so that each worker gets small and large ones alike."""
    ends = naturals.agg(F.min("n").alias("first"), (F.max("n") - F.min("n") + 1).alias("count"))
    # One row of two numbers, so this broadcast is bounded.
    return naturals.join(F.broadcast(ends)).select("n", worker(F.col("n") - F.col("first"), F.col("count"), workers).alias("worker"))


def interval(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).withColumnRenamed("id", "n")
