"""The kernels' inputs as views of whole warehouse tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    """The side of the least square image that holds a pixel for every event."""
    n = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    n, w = 0 if n is None else n + 1, 0
    while w * w < n:
        w = max(w + 1, int(n**0.5) - 1)
    return w


def image(spark: SparkSession, sf_dir: str, mask: int) -> tuple[DataFrame, int]:
    """(y, x, v) of all pixels, row by row, and the side: events by id, their values cut to `mask`; absent ones are 0."""
    w = side(spark, sf_dir)
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.floor("value").cast("int").bitwiseAND(F.lit(mask)).alias("v"))
    grid = spark.range(w * w).join(events, "id", "left")
    return grid.select(F.floor(F.col("id") / max(w, 1)).cast("long").alias("y"), (F.col("id") % max(w, 1)).alias("x"), F.coalesce("v", F.lit(0)).alias("v")), w


def naturals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n): the parts' keys, counted from 1."""
    return table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("n"))


def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a): the part keys of all line items."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features): all embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The products of all pairs of dimensions, summed over a task's vectors: one row for each dimension."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            total = x.T @ x if total is None else total + x.T @ x
    rows = [] if total is None else list(total)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "row"])


def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, row): the products of the embeddings' dimensions, summed over all vectors: a square, positive matrix."""
    each = points(spark, sf_dir).where(F.col("features").isNotNull()).select("features").mapInArrow(_products, "i int, row array<double>")
    sums = each.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return sums.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("i", F.transform("r", lambda p: p["v"]).alias("row"))


def towns(spark: SparkSession, sf_dir: str, count: int = 9) -> DataFrame:
    """(t, x, y): `count` towns, each placed by the sums over its share of all suppliers."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % count).cast("int").alias("t"), F.col("s_nationkey").cast("long").alias("a"), F.floor(F.abs("s_acctbal")).cast("long").alias("b"))
    return s.groupBy("t").agg((F.sum(F.col("a") * 4) % 100).cast("int").alias("x"), (F.sum("b") % 100).cast("int").alias("y"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, mass, xold, yold, zold): the first three dimensions of all embeddings, at rest, of mass 1."""
    xyz = [F.col("features")[k].cast("double") for k in range(3)]
    return points(spark, sf_dir).select("id", *[c.alias(n) for n, c in zip("xyz", xyz, strict=True)], F.lit(1.0).alias("mass"), *[c.alias(n) for n, c in zip(("xold", "yold", "zold"), xyz, strict=True)])
