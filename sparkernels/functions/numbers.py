"""Number theory as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _up_to_root(n: Column) -> Column:
    return F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(n)).cast("long"))


def sigma(n: Column) -> Column:
    """The sum of the divisors of n >= 1: each divisor up to the root stands for its partner too."""
    small = F.filter(_up_to_root(n), lambda d: n % d == 0)
    return F.aggregate(small, F.lit(0).cast("long"), lambda total, d: total + d + F.when(d * d == n, F.lit(0)).otherwise(F.call_function("div", n, d)))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of positive numbers below 2**63, by Euclid's steps: at most 91 of them."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(91)), start, step, lambda s: s["a"])
