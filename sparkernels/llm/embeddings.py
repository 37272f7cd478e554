"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, prepare
from .components import components, thinned

COSINE = 0.93
#: Pivots over all labels at most (so what tasks are sent is bounded), and the vectors that a cell is meant to own.
PIVOTS, CELL = 4096, 2048
#: Vectors in a block of a cell; a task holds two blocks at a time.
BLOCK = 1024
#: Slack for rounding in bounds, which only ever keeps more.
SLACK = 1e-7


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column of one length, as rows of unit length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def replicated(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The own cell of each vector (its nearest pivot), and a mask of the cells that must also see it.

    The triangle inequality alone bounds d_j - d_own by 2 reach for a vector within `reach` of one nearer to pivot j. The
    bound here is tighter: that other one lies beyond the plane halfway between the pivots, so by the triangle inequality
    the distance to this plane is `reach` at most: (d_j^2 - d_own^2) / (2 d(own, j)) <= reach.
    """
    d2 = np.maximum(0, 2 - 2 * (x @ pivots.T))
    own = d2.argmin(axis=1)
    between = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[own]
    mask = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * between * reach + SLACK
    mask[np.arange(len(x)), own] = True
    return own, mask


def _assigner(pivots: dict[tuple, np.ndarray], reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, dims = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            rows, cells, own = [], [], []
            for key in sorted(set(zip(labels.tolist(), dims.tolist(), strict=True))):
                at = np.flatnonzero((labels == key[0]) & (dims == key[1]))
                if key not in pivots:
                    mine, mask = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                else:
                    mine, mask = replicated(_matrix(batch.column(4).take(pa.array(at))), pivots[key], reach)
                i, j = np.nonzero(mask)
                rows.append(at[i])
                cells.append(j)
                own.append(mine[i] == j)
            take = pa.array(np.concatenate(rows))
            kept = batch.take(take)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(own))], [*batch.schema.names, "cell", "own"])

    return run


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of a link with which of b; what rounding could tip is decided by the plain formula."""
    sims = a @ b.T
    mask = sims >= cosine
    for i, j in zip(*np.nonzero(np.abs(sims - cosine) < 1e-12), strict=True):
        mask[i, j] = float(np.sum(a[i] * b[j])) >= cosine
    return mask


def _joiner(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        left = np.asarray(table["side"].combine_chunks()) == 0
        ids, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        u: list[int] = []
        v: list[int] = []
        n: list[int] = []
        if left.any() and (~left).any():
            x = _matrix(table["embedding"])
            a, b = ids[left], ids[~left]
            mask = linked(x[left], x[~left], cosine) & (a[:, None] != b[None, :])
            links = mask @ copies[~left].astype(np.float64)
            some = np.flatnonzero(links)
            u, v, n = a[some].tolist(), a[some].tolist(), links[some].astype(np.int64).tolist()
            parent: dict[int, int] = {}

            def root(k: int) -> int:
                while (up := parent.setdefault(k, k)) != k:
                    parent[k] = k = parent.setdefault(up, up)
                return k

            for i, j in zip(*np.nonzero(mask), strict=True):
                p, q = root(int(a[i])), root(int(b[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    u.append(int(a[i]))
                    v.append(int(b[j]))
                    n.append(0)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _pivots(reps: DataFrame, cell: int) -> dict[tuple, np.ndarray]:
    """A bounded sample of each large label's vectors, by a hash of their ids; labels of one cell need none."""
    sizes = reps.groupBy("label", "dim").count().where(F.col("count") > cell).orderBy(F.desc("count"), "label", "dim").limit(PIVOTS // 2).collect()
    total = sum(r["count"] for r in sizes)
    want = {(r.label, r.dim): max(2, min(-(-r["count"] // cell), PIVOTS * r["count"] // total // 2)) for r in sizes}
    # At most PIVOTS / 2 rows, so this broadcast is bounded; about twice the pivots wanted come to the driver.
    shares = [(label, dim, 2 * k / n["count"]) for ((label, dim), k), n in zip(want.items(), sizes, strict=True)]
    spec = F.broadcast(reps.sparkSession.createDataFrame(shares, "label long, dim int, share double"))
    place = F.xxhash64("rep").bitwiseAND(F.lit(0xFFFFFFFF)) / 2.0**32
    found: dict[tuple, list] = {}
    for r in reps.join(spec, ["label", "dim"]).where(place < F.col("share")).select("label", "dim", "rep", "embedding", place.alias("place")).collect():
        found.setdefault((r.label, r.dim), []).append((r.place, r.rep, list(r.embedding)))
    return {key: _matrix(pa.array([e for *_, e in sorted(rows)[: want[key]]], pa.list_(pa.float64()))) for key, rows in found.items()}


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """For each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and their cosine is at least `cosine`. Null or zero vectors, null or
    non-finite components, null labels and vectors of other lengths link with nothing; a null vec_id links with
    nothing either and its component is null. Repeated rows are vectors of their own, and so are unlike vectors under
    one vec_id. Equal vectors are joined once, with a count. Pivots cut each large label into cells, every vector is owned by the cell of its nearest pivot and
    copied to those whose boundary it is near to, and an owner meets all vectors of its cell in pairs of bounded blocks.
    """
    spark = vectors.sparkSession
    prepare(spark)
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>" if "double" in dict(vectors.dtypes)["embedding"] else "array<float>"), F.col("label").cast("long"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    # Written once, so the numbers of the distinct vectors stay: a vec_id may stand for several.
    reps = Table(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("rep"), "least", "label", F.size("embedding").alias("dim"), "copies", "embedding"), "reps").df
    spread = Table(reps.select("rep", "label", "dim", "copies", "embedding").mapInArrow(_assigner(_pivots(reps, cell), reach), "rep long, label long, dim int, copies long, embedding " + dict(reps.dtypes)["embedding"] + ", cell int, own boolean"), "cells").df
    where = ["label", "dim", "cell"]
    blocks = spread.groupBy(*where).agg(F.ceil(F.sum(F.col("own").cast("int")) / block).cast("int").alias("owners"), F.ceil(F.count("*") / block).cast("int").alias("others"))
    dealt = spread.join(blocks.where("owners > 0"), where).withColumn("h", F.xxhash64("rep"))
    row = F.pmod("h", "owners").cast("int")
    col = F.pmod("h", "others").cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sides = F.array_compact(F.array(
        F.when(F.col("own"), F.struct(F.lit(0).alias("side"), F.array(row).alias("rows"), upto("others").alias("cols"))),
        F.struct(F.lit(1).alias("side"), upto("owners").alias("rows"), F.array(col).alias("cols")),
    ))
    units = dealt.select("rep", "copies", "embedding", *where, F.explode(sides).alias("s")).select("rep", "copies", "embedding", *where, "s.side", F.explode("s.rows").alias("i"), F.col("s.cols").alias("cols")).select("rep", "copies", "embedding", *where, "side", "i", F.explode("cols").alias("j"))
    found = Table(units.groupBy(*where, "i", "j").applyInArrow(_joiner(cosine), "u long, v long, n long"), "found").df
    counts = found.where("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    joined = components(thinned(found.where("u <> v").select("u", "v")))
    named = reps.join(counts, F.col("rep") == F.col("u"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("label", "embedding", "n_links", "component_id")
    inside = valid.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    outside = rows.where(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(outside).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
