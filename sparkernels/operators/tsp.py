"""The shortest path through all towns from town 0: prefix frontiers, and an exact search below each prefix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.loops import checkpointed

#: Towns at most: the search is exponential in them, and all that is sent to tasks is their distances.
TOWNS = 20
#: Prefixes are made long enough for so many jobs a worker.
JOBS = 100
#: Parts of the search between which the best length so far is shared.
WAVES = 3


def distances(towns: DataFrame) -> DataFrame:
    """(src, dst, dist, rank): whole distances between all towns, itself included, and their order from each town.

    More than TOWNS towns are an error; the order is by distance, ties by the town's number. Each town meets a literal
    list of the towns, so nothing is joined.
    """
    listed = F.array(*[F.struct(F.lit(r.t).alias("dst"), F.lit(r.x).alias("bx"), F.lit(r.y).alias("by")) for r in _listed(towns)])
    each = towns.select(F.col("t").alias("src"), "x", "y", F.explode(listed).alias("o"))
    dx, dy = F.col("x") - F.col("o.bx"), F.col("y") - F.col("o.by")
    pairs = each.select("src", "o.dst", F.floor(F.sqrt(dx * dx + dy * dy)).cast("int").alias("dist"))
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def _listed(towns: DataFrame) -> list[Row]:
    rows = towns.orderBy("t").limit(TOWNS + 1).collect()
    if len(rows) > TOWNS:
        raise ValueError(f"more than {TOWNS} towns")
    return rows


def matrix(towns: DataFrame) -> np.ndarray:
    """The distances as a matrix; at most TOWNS towns."""
    xy = np.array([(r.x, r.y) for r in _listed(towns)], np.int64).reshape(-1, 2)
    d = xy[:, None] - xy[None]
    return np.sqrt((d * d).sum(axis=2)).astype(np.int64)


def greedy(d: np.ndarray) -> int:
    """The length of the path that always takes the nearest town left, the lowest of equals: the bound to start with."""
    left, at, total = set(range(1, len(d))), 0, 0
    while left:
        to = min(left, key=lambda t: (d[at, t], t))
        total, at = total + int(d[at, to]), to
        left.remove(to)
    return total


def hops(towns: int, workers: int = 1) -> int:
    """How many towns a prefix has, so that there are JOBS jobs for each worker."""
    total, n = 1, 0
    while total < JOBS * workers and n < towns - 1:
        n += 1
        total *= towns - n
    return n + 1


def _edges(d: np.ndarray):
    return F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in d])


def extended(frontier: DataFrame, d: np.ndarray) -> DataFrame:
    """Every prefix (path, len) with every town that is not in it."""
    last = F.element_at("path", -1)
    every = F.array(*[F.lit(t) for t in range(len(d))])
    step = frontier.select("path", "len", F.explode(F.array_except(every, F.col("path"))).alias("to"))
    return step.select(F.concat("path", F.array("to")).alias("path"), (F.col("len") + _edges(d)[last][F.col("to")]).alias("len"))


def start(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.array(F.lit(0)).alias("path"), F.lit(0).alias("len"))


def prefixes(spark: SparkSession, d: np.ndarray, length: int) -> DataFrame:
    """(path, len): all prefixes of `length` towns from town 0: a frontier grown level by level."""
    return reduce(lambda f, _: extended(f, d), range(min(length, len(d)) - 1), start(spark))


def cuts(spark: SparkSession, d: np.ndarray, bound: int | None = None) -> DataFrame:
    """(hops, cuts, paths): prefixes as long as the bound or longer at each level, and the paths that cutting them saves."""
    bound = greedy(d) if bound is None else bound
    frontier, levels = start(spark), []
    for k in range(2, len(d) + 1):
        grown = checkpointed(extended(frontier, d))
        levels.append(grown.where(F.col("len") >= bound).agg(F.lit(k).alias("hops"), F.count("*").alias("cuts")).withColumn("paths", (F.col("cuts") * F.factorial(F.lit(len(d) - k))).cast("long")))
        frontier = grown.where(F.col("len") < bound)
    return reduce(DataFrame.union, levels)


def best_completion(d: np.ndarray, last: int, left: list[int], closed: bool) -> int:
    """The shortest way from `last` through all towns in `left`, by dynamic programming over their subsets."""
    m = len(left)
    if not m:
        return int(d[last, 0]) if closed else 0
    inner = d[np.ix_(left, left)]
    far = np.int64(1) << 40
    cost = np.full((1 << m, m), far)
    cost[1 << np.arange(m), np.arange(m)] = d[last, left]
    sizes = np.bitwise_count(np.arange(1 << m))
    for size in range(1, m):
        sets = np.flatnonzero(sizes == size)
        for to in range(m):
            free = sets[(sets >> to & 1) == 0]
            grown = (cost[free] + inner[:, to][None]).min(axis=1)
            cost[free | 1 << to, to] = grown
    ends = cost[-1] + (d[left, 0] if closed else 0)
    return int(ends.min())


def _searcher(d: np.ndarray, closed: bool, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = bound
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if length < best:
                    left = [t for t in range(len(d)) if t not in path]
                    best = min(best, length + best_completion(d, path[-1], left, closed))
        yield pa.RecordBatch.from_arrays([pa.array([best], pa.int64())], ["len"])

    return run


def shortest(towns: DataFrame, closed: bool = False, workers: int = 8, waves: int = WAVES) -> DataFrame:
    """(len): the length of the shortest path from town 0 through all towns, or of the closed tour.

    Prefixes, shortest first, are searched in `waves` of many small tasks. A task starts from the best length that all
    waves before it found, at first the greedy one, and goes on with its own best; prefixes as long as that are not
    searched.
    """
    spark, d = towns.sparkSession, matrix(towns)
    if not len(d):
        return spark.createDataFrame([(0,)], "len long")
    best = greedy(d) + (int(d.max()) if closed else 0)
    jobs = checkpointed(prefixes(spark, d, min(hops(len(d), workers), max(1, len(d) - 1))))
    # Cuts of the prefixes' lengths; a wave without prefixes costs nothing.
    edges = sorted(set(jobs.where(F.col("len") < best).approxQuantile("len", [k / waves for k in range(1, waves)], 0.01))) if waves > 1 else []
    for low, high in zip([float("-inf"), *edges], [*edges, float("inf")], strict=True):
        if low >= best:
            break
        wave = jobs.where((F.col("len") > low) & (F.col("len") <= high) & (F.col("len") < best))
        found = wave.repartition(20 * workers).mapInArrow(_searcher(d, closed, best), "len long").agg(F.min("len").alias("len")).first().len
        best = best if found is None else min(best, found)
    return spark.range(1).select(F.lit(best).cast("long").alias("len"))
