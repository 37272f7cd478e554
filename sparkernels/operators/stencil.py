"""Image stencils: corner detection by a ring of 16 pixels, and Gaussian smoothing.

Two shapes: gathering neighbours by an equi-join on the pixel's index, for the steps taken apart; and for whole images
row bands with a halo, each band a dense block in one task. A band's size is bounded by the image's width.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ring of radius 3 as (dx, dy), the threshold and the arc; the smoothing width.
RING = ((-1, -3), (0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2))
THRESHOLD, ARC = 20, 12
SIGMA = 0.8

#: Pixels that a band is meant to hold.
BAND = 1 << 20


def ring(pixels: DataFrame, side: int) -> DataFrame:
    """(y, x, k, p, q): each pixel with the k-th of its ring; q is null where that lies outside.

    A ring pixel lies outside when x + dx or y + dy is negative or its index y * side + x ends beyond the image; on the
    right the index runs on into the next row.
    """
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(RING)])
    each = pixels.select("y", "x", F.col("v").alias("p"), F.explode(offsets).alias("o"))
    at = (F.col("y") + F.col("o.dy")) * side + F.col("x") + F.col("o.dx")
    inside = (F.col("x") + F.col("o.dx") >= 0) & (F.col("y") + F.col("o.dy") >= 0) & (at < side * side)
    asked = each.select("y", "x", "o.k", "p", F.when(inside, at).alias("at"))
    known = pixels.select((F.col("y") * side + F.col("x")).alias("at"), F.col("v").alias("q"))
    return asked.join(known, "at", "left").select("y", "x", "k", "p", "q")


def classes(gathered: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(y, x, k, class): 1 for a ring pixel brighter by the threshold, -1 for a darker one, 0 for others and outside."""
    kind = F.when(F.col("q") >= F.col("p") + threshold, 1).when(F.col("q") <= F.col("p") - threshold, -1).otherwise(0)
    return gathered.select("y", "x", "k", kind.cast("int").alias("class"))


def _banded(pixels: DataFrame, side: int, above: int, below: int) -> DataFrame:
    """(band, y, x, v): pixels in bands of whole rows, rows near an edge also in the neighbouring bands."""
    rows = max(above + below, BAND // max(side, 1), 1)
    bands = F.sequence(F.floor(F.greatest(F.col("y") - below, F.lit(0)) / rows).cast("int"), F.floor(F.least(F.col("y") + above, F.lit(max(side - 1, 0))) / rows).cast("int"))
    return pixels.select(F.explode(bands).alias("band"), F.lit(rows).alias("rows"), "y", "x", "v")


def _block(table: pa.Table, side: int, above: int, below: int) -> tuple[int, int, np.ndarray]:
    """The first row and row count of a band, and its pixels with the halo, 0 where there are none."""
    band, rows = table["band"][0].as_py(), table["rows"][0].as_py()
    first = band * rows
    count = min(rows, side - first)
    block = np.zeros((count + above + below, side), np.int64)
    block[table["y"].to_numpy() - first + above, table["x"].to_numpy()] = table["v"].to_numpy()
    return first, count, block


def _corner_finder(side: int, wrap: bool, threshold: int, arc: int):
    def run(table: pa.Table) -> pa.Table:
        first, count, block = _block(table, side, 3, 4)
        flat, y = block.ravel(), np.arange(first, first + count)[:, None]
        x = np.arange(side)[None, :]
        p = block[3 : 3 + count]
        signs = []
        for dx, dy in RING:
            at = (y - first + 3 + dy) * side + x + dx
            inside = (x + dx >= 0) & (y + dy >= 0) & ((y + dy) * side + x + dx < side * side)
            q = flat[np.clip(at, 0, len(flat) - 1)]
            signs.append(np.where(inside, (q >= p + threshold).astype(np.int8) - (q <= p - threshold), 0))
        corner = np.zeros(p.shape, bool)
        for start in range(len(RING)):
            arc_sum = sum(signs[(start + i) % len(RING)].astype(np.int16) for i in range(arc))
            corner |= np.abs(arc_sum) == arc
        if not wrap:
            corner &= (x >= 3) & (x < side - 3) & (y >= 3) & (y < side - 3)
        ys, xs = np.nonzero(corner)
        return pa.table({"y": pa.array(ys + first, pa.int64()), "x": pa.array(xs, pa.int64()), "band": pa.array(np.full(len(ys), table["band"][0].as_py()), pa.int32())})

    return run


def corners(pixels: DataFrame, side: int, edge: str = "wrap", threshold: int = THRESHOLD, arc: int = ARC) -> DataFrame:
    """(y, x, band): pixels with `arc` ring pixels in a row all brighter or all darker. edge: 'wrap', or 'interior' for whole rings only."""
    banded = _banded(pixels, side, 3, 4)
    return banded.groupBy("band").applyInArrow(_corner_finder(side, edge == "wrap", threshold, arc), "y long, x long, band int")


def count(found: DataFrame) -> DataFrame:
    """(corners): how many there are, counted by band first."""
    return found.groupBy("band").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("corners"))


def gauss(size: int, sigma: float = SIGMA) -> np.ndarray:
    """The mask of odd size: exp(-(i^2 + j^2) / 2 * sigma^2), scaled to a sum of 1."""
    i = np.arange(size) - size // 2
    w = np.exp(-((i[:, None] ** 2 + i[None, :] ** 2) / 2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)
    return w / w.sum()


def mask(spark: SparkSession, size: int, sigma: float = SIGMA) -> DataFrame:
    """(dy, dx, w): the mask as rows, normalised by the sum over all."""
    n = size // 2
    grid = spark.range(size * size).select((F.floor(F.col("id") / size) - n).cast("int").alias("dy"), (F.col("id") % size - n).cast("int").alias("dx"))
    w = F.exp(-((F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")) / 2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)
    total = float(sum(math.exp(-((i * i + j * j) / 2 * sigma * sigma)) / (2 * math.pi * sigma * sigma) for i in range(-n, n + 1) for j in range(-n, n + 1)))
    return grid.select("dy", "dx", (w / total).alias("w"))


def _smoother(side: int, size: int, sigma: float):
    def run(table: pa.Table) -> pa.Table:
        n, weights = size // 2, gauss(size, sigma)
        first, count, block = _block(table, side, n, n)
        out = np.zeros((count, side), np.float64)
        if side >= size:
            for i in range(size):
                for j in range(size):
                    out[:, n : side - n] += weights[i, j] * block[i : i + count, j : j + side - 2 * n]
        y = np.arange(first, first + count)
        out[(y < n) | (y >= side - n)] = 0
        v = np.minimum(255, np.floor(np.round(out, 6))).astype(np.int32)
        ys, xs = np.mgrid[first : first + count, 0:side]
        return pa.table({"y": pa.array(ys.ravel(), pa.int64()), "x": pa.array(xs.ravel(), pa.int64()), "v": pa.array(v.ravel(), pa.int32())})

    return run


def smooth(pixels: DataFrame, side: int, size: int = 7, sigma: float = SIGMA) -> DataFrame:
    """(y, x, v): the image under the mask, cut to whole numbers up to 255; a border of half a mask is 0."""
    n = size // 2
    return _banded(pixels, side, n, n).groupBy("band").applyInArrow(_smoother(side, size, sigma), "y long, x long, v int")
