"""Connected components of a link table by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table

EDGES = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep, batch by batch, only links that join two trees, so dense groups leave a task as sparse ones."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        us, vs = [], []
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def thinned(links: DataFrame) -> DataFrame:
    """A subset of the links with the same components."""
    return links.mapInArrow(_forest, EDGES)


def _pointed(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _pointed(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a")
    return kept.select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("a", "m")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; those smallest nodes have no row themselves.

    links: u, v (long). Links of a node to itself, repeats and either direction are allowed; nulls are ignored.
    Nodes without a link to another have no row. No node's neighbours are ever gathered: each round takes a minimum
    per node (combined before the shuffle) and one join, whose hot keys Spark splits. Rounds: O(log^2 n).
    """
    at = Table(thinned(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct(), "links")
    mark = _mark(at.df)
    while mark[0]:
        after = Table(_small_star(_large_star(at.df)), "links")
        now = _mark(after.df)
        at.release()
        at, same, mark = after, now == mark, now
        if same:
            break
    return at.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
