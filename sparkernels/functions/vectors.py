"""Vectors as column expressions: arrays of any length, and structs of x, y and z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """The Euclidean distance of two arrays, in double precision."""
    squares = F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def _each(f, *vs: Column) -> Column:
    return vector(*[f(*[v[k] for v in vs]) for k in "xyz"])


def add(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p + q, a, b)


def subtract(a: Column, b: Column) -> Column:
    return _each(lambda p, q: p - q, a, b)


def product(a: Column, b: Column) -> Column:
    """Component by component."""
    return _each(lambda p, q: p * q, a, b)


def scale(a: Column, k: Column) -> Column:
    return _each(lambda p: p * k, a)


def invert(a: Column) -> Column:
    return _each(lambda p: -p, a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def normalize(a: Column) -> Column:
    """The vector at length 1; the zero vector stays."""
    n = F.sqrt(dot(a, a))
    return _each(lambda p: F.when(n > 0, p / n).otherwise(p), a)
