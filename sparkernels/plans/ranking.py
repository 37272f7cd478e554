"""A global order and positions in it, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loops import checkpointed

SEED = 17


def positioned(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with `name`, the position (from 0) of each row when sorted by `order`.

    A range-partitioned sort deals rows out by sampled bounds; a row's place in its partition plus the rows of earlier
    partitions, one number for each, is its position. Equal rows fall in any order, which a random last key uses: it
    lets the bounds cut a value that many rows share, so no task gets all of them. The sort is checkpointed, because
    bounds are sampled again on every run of it.
    """
    keys = [*order, "_any"]
    ordered = df.withColumn("_any", F.rand(SEED)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_any").withColumn("_id", F.monotonically_increasing_id())
    held = checkpointed(ordered).withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each partition of the sort.
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))
