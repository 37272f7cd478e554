"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Table, prepare, text_key

#: A source is repeated at most this often.
MOST = 3
SEED = 7


def words(text: str = "text") -> Column:
    """The number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: float(i % 3 + 1) for i, s in enumerate(ordered)}


def shared(sizes: dict[str | None, int], weights: dict[str | None, float], most: int = MOST) -> dict[str | None, float]:
    """Each source's target: the total by weight, none above `most` times its size, the excess reshared by weight."""
    left, free, targets = float(sum(sizes.values())), set(sizes), {}
    while free:
        unit = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * unit > most * sizes[s]}
        for s in over or free:
            targets[s] = float(most * sizes[s]) if over else weights[s] * unit
        left -= sum(targets[s] for s in over)
        free = free - over if over else set()
    return targets


def _running(group: int, size: int, out: list[tuple[str, pa.DataType]]):
    """Per task: the running sum of column `size` within runs of equal column `group`, with the task and row numbers.

    Rows come sorted by group, so one running value is all the state that a task holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, total = TaskContext.get().partitionId(), 0, object(), 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False)
            cum = np.cumsum(sizes)
            groups = batch.column(group).to_pylist() if batch.num_rows else []
            firsts = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]]
            base = np.empty(len(groups), np.int64)
            for a, b in zip(firsts, [*firsts[1:], len(groups)], strict=True):
                base[a:b] = (total if groups[a] == last else 0) - (cum[a - 1] if a else 0)
                last, total = groups[a], int(cum[b - 1] + base[a])
            rows = np.arange(row, row + len(groups), dtype=np.int64)
            row += len(groups)
            made = {"part": pa.array(np.full(len(groups), part, np.int32)), "row": pa.array(rows), "cum": pa.array(cum + base)}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(batch.schema.get_field_index(n)) for n, _ in out], [n for n, _ in out])

    return run


def _with_sums(df: DataFrame, group: str | None, order: list[str], size: str, label: str) -> tuple[DataFrame, Table]:
    """df with part, row and cum: the running sum of `size` in `order` within each `group`, over the whole table.

    A range-partitioned sort deals out any group, however large, over many tasks; each takes its own running sums,
    and a table of one row per task and group says what stands before.
    """
    keys = ([group] if group else []) + order
    at = df.columns
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if not group:
        ordered, at = ordered.withColumn("whole", F.lit(0)), [*at, "whole"]
    kinds = [*((f.name, None) for f in ordered.schema.fields), ("part", None), ("row", None), ("cum", None)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", part int, row long, cum long"
    table = Table(ordered.mapInArrow(_running(at.index(group or "whole"), at.index(size), kinds), schema), label)
    by = group or "whole"
    parts = table.df.groupBy("part", by).agg(F.sum(size).alias("held"))
    before = parts.select(F.col("part").alias("of_task"), F.col(by).alias("group"), F.coalesce(F.sum("held").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    t = table.df
    found = t.join(before, (F.col("part") == F.col("of_task")) & F.col(by).eqNullSafe(F.col("group"))).select(*[c for c in t.columns if c not in ("cum", "whole")], (F.col("cum") + F.col("before")).alias("cum"))
    return found, table


def _queued(docs: DataFrame, weigh) -> tuple[DataFrame, DataFrame]:
    """(rows, takes): each row's doc_id, key, source, size, source_size, target; and the copies that the mix takes.

    Rows are shuffled by a hash of doc_id and text; within a source, a copy's virtual finish time is the source's
    cumulative words, passes repeated, over its target. All copies are range-sorted by it and cut at the total budget.
    """
    prepare(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "source", words().alias("size")).withColumn("shuffled", F.xxhash64("doc_id", "key", F.lit(SEED)))
    rows, table = _with_sums(sized, "source", ["shuffled", "doc_id", "key"], "size", "mix-rows")
    # One row for each source comes to the driver: a mixture is a stated list of weights.
    sizes = {r.source: r.n for r in table.df.groupBy("source").agg(F.sum("size").alias("n")).toLocalIterator()}
    targets = shared(sizes, weigh(list(sizes)))
    spec = docs.sparkSession.createDataFrame([(s, int(n), float(targets[s])) for s, n in sizes.items()], "source string, source_size long, target double")
    spec = spec.withColumnRenamed("source", "of")
    rows = rows.join(spec, rows.source.eqNullSafe(spec.of)).drop("of")
    budget = round(sum(targets.values()))
    copies = (
        rows.where("size > 0 and target > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(MOST), F.ceil(F.col("target") / F.col("source_size"))) - 1).cast("int"))))
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("cum")) / F.col("target"))
        .select("part", "row", "doc_id", "key", "copy", "finish", "size")
        .withColumnsRenamed({"part": "of_part", "row": "of_row"})
    )
    queue, _ = _with_sums(copies, None, ["finish", "doc_id", "key", "copy", "of_part", "of_row"], "size", "mix-queue")
    taken = queue.where(F.col("cum") <= budget).groupBy("of_part", "of_row").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    return rows, taken


def mix(docs: DataFrame, weigh=cyclic_weights) -> DataFrame:
    """For each row of docs (doc_id, source, text): doc_id, key, size, source_size, target (its source's), taken, copies.

    weigh maps the list of sources to weights. Null texts have size 0 and are never taken; a null source is a source of
    its own; repeated rows are rows of their own; an empty table gives none. Equal finish times are cut in the order
    of the shuffle, so reruns agree.
    """
    rows, taken = _queued(docs, weigh)
    joined = rows.join(taken, (rows.part == taken.of_part) & (rows.row == taken.of_row), "left")
    return joined.select("doc_id", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weigh=cyclic_weights) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them; those that it leaves out go.

    Rows that repeat each other share what the mix takes of them: each as often as the others, or once more.
    """
    taken = Table(mix(docs, weigh).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "mix-taken").df
    a = docs.select(F.col("doc_id").cast("long").alias("of"), text_key().alias("text_of"), F.struct(*docs.columns).alias("row"))
    found = a.join(taken, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("text_of") == F.col("key")))
    once = found.where("rows = 1").select("row", F.col("copies").alias("times"))
    often = taken.where("rows > 1")
    if not often.take(1):
        return once.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
    # Repeated rows are numbered where they lie, in a table that keeps their places: a window takes one group's rows of
    # one partition, and another a group's counts by partition.
    some = a.join(Table(often, "mix-often").df, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("text_of") == F.col("key")))
    held = Table(some.select("doc_id", "key", "row", "copies", "rows").withColumn("id", F.monotonically_increasing_id()), "mix-repeated").df
    parted = held.withColumn("part", F.shiftright("id", 33))
    by = Window.partitionBy("part", "doc_id", "key")
    counts = parted.groupBy("part", "doc_id", "key").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("part").alias("of_part"), F.col("doc_id").alias("of"), F.col("key").alias("text_of"), F.coalesce(upto, F.lit(0)).alias("before"))
    numbered = parted.withColumn("nth", F.row_number().over(by.orderBy("id")) - 1)
    dealt = numbered.join(before, (F.col("part") == F.col("of_part")) & F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("text_of")))
    times = F.expr("copies div rows") + (F.col("before") + F.col("nth") < F.expr("copies % rows")).cast("int")
    every = once.union(dealt.select("row", times.alias("times"))).where("times > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
