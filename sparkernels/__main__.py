"""Run a kernel on a generated workload: python -m sparkernels KERNEL [--class NAME] [--nthreads N] [--verbose]."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import friendly, intsort, kmeans, lu, nbody, raytrace, stencil, tsp
from .plans.classes import NAMES, SIZES, problem
from .plans.loops import checkpointed, timed, with_parallelism
from .sources import random, sinks


def _fast(spark: SparkSession, side: int) -> Callable[[], DataFrame]:
    image = checkpointed(random.image(spark, side, signed=True))
    return lambda: stencil.count(stencil.corners(image, side))


def _friendly(spark: SparkSession, first: int, last: int) -> Callable[[], DataFrame]:
    return lambda: friendly.friend_pairs(friendly.interval(spark, first, last))


def _gauss(spark: SparkSession, size: int, side: int) -> Callable[[], DataFrame]:
    image = checkpointed(random.image(spark, side, signed=False))
    return lambda: sinks.rows_of(stencil.smooth(image, side, size))


def _sort(spark: SparkSession, count: int) -> Callable[[], DataFrame]:
    ints = checkpointed(random.integers(spark, count))
    return lambda: intsort.sort(ints)


def _kmeans(spark: SparkSession, count: int, k: int) -> Callable[[], DataFrame]:
    points = checkpointed(random.points(spark, count))
    return lambda: kmeans.population(kmeans.iterate(points, k))


def _lu(spark: SparkSession, side: int) -> Callable[[], DataFrame]:
    matrix = checkpointed(random.matrix(spark, side))
    return lambda: lu.split(lu.factor(matrix))


def _tsp(spark: SparkSession, count: int) -> Callable[[], DataFrame]:
    towns = random.towns(spark, count)
    return lambda: tsp.shortest(towns)


def _nbody(spark: SparkSession, count: int, steps: int) -> Callable[[], DataFrame]:
    bodies = checkpointed(random.bodies(spark, count))
    return lambda: sinks.positions_of(nbody.simulate(bodies, steps)[0])


def _raytrace(spark: SparkSession, width: int, height: int, depth: int) -> Callable[[], DataFrame]:
    return lambda: raytrace.render(spark, width, height, depth)


KERNELS = {"fast": _fast, "friendly": _friendly, "gauss": _gauss, "sort": _sort, "kmeans": _kmeans, "lu": _lu, "tsp": _tsp, "nbody": _nbody, "raytrace": _raytrace}


def run(spark: SparkSession, kernel: str, sizes: tuple[int, ...], verbose: bool = False) -> float:
    """Seconds that the kernel takes; making its input is not counted."""
    kernel_of = KERNELS[kernel](spark, *sizes)
    began = time.perf_counter()
    result = kernel_of()
    timed(result)
    seconds = time.perf_counter() - began
    if verbose:
        result.show(20, truncate=100)
    return seconds


def main(args: list[str] | None = None) -> None:
    said = argparse.ArgumentParser(prog="sparkernels", description=__doc__)
    said.add_argument("kernel", choices=sorted(SIZES))
    said.add_argument("--class", dest="name", choices=NAMES, default="standard")
    said.add_argument("--nthreads", type=int, default=0, help="tasks of a shuffle; 0 leaves the session's own number")
    said.add_argument("--verbose", action="store_true", help="show the first rows of the result")
    given = said.parse_args(args)
    if given.nthreads < 0:
        said.error("--nthreads takes a positive number")
    spark = SparkSession.builder.appName("sparkernels").getOrCreate()
    if given.nthreads:
        with_parallelism(spark, given.nthreads)
    seconds = run(spark, given.kernel, problem(given.kernel, given.name).sizes, given.verbose)
    print(f"total time: {seconds:.6f} s")


if __name__ == "__main__":
    main()
