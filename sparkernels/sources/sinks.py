"""Text and picture output of results that a person looks at; everything else is written with df.write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of the largest picture that the driver writes as one file.
PICTURE = 1 << 24


def write_ppm(pixels: DataFrame, width: int, height: int, path: str) -> None:
    """Write (y, x, r, g, b) as a binary PPM file, streamed to the driver one partition at a time."""
    if width * height > PICTURE:
        raise ValueError("too large for one picture: write the pixels as a table")
    with open(path, "wb") as file:
        file.write(f"P6\n{width} {height}\n255\n".encode())
        for row in pixels.orderBy("y", "x").select("r", "g", "b").toLocalIterator():
            file.write(bytes(row))


def rows_of(pixels: DataFrame) -> DataFrame:
    """(y, line): each image row's values in order, as text."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"].cast("string"))
    return pixels.groupBy("y").agg(F.array_join(line, " ").alias("line"))


def positions_of(bodies: DataFrame) -> DataFrame:
    """(id, line): the bodies' positions with five decimals."""
    return bodies.select("id", F.format_string("%.5f | %.5f | %.5f", "x", "y", "z").alias("line"))
