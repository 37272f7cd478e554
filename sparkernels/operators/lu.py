"""LU factorisation of a matrix kept as rows, by panels: only a panel of rows is ever in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loops import checkpointed

#: Rows of a panel, and numbers that it may hold: it comes to the driver and goes to every task.
PANEL, HELD = 64, 1 << 24



class ZeroPivot(ArithmeticError):
    """A pivot is zero: the matrix has no factorisation in this order."""


def pivot(matrix: DataFrame, k: int = 0) -> DataFrame:
    """(i, j, v): the entry of largest absolute value among rows and columns from k on; ties to the lowest i, then j."""
    cells = matrix.where(F.col("i") >= k).select("i", F.posexplode("row").alias("j", "v")).where(F.col("j") >= k)
    best = cells.agg(F.max(F.struct(F.abs("v").alias("size"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "v")).alias("b"))
    return best.select((-F.col("b.i")).alias("i"), (-F.col("b.j")).alias("j"), F.col("b.v").alias("v"))


def reduce(matrix: DataFrame, k: int) -> DataFrame:
    """(i, row): one elimination step. Rows below k lose their multiple of row k and keep the multiplier in column k."""
    top = matrix.where(F.col("i") == k).select(F.col("row").alias("top"))
    # One row of the matrix, so this broadcast is bounded by its width.
    each = matrix.join(F.broadcast(top))
    m = F.col("row")[k] / F.col("top")[k]
    lowered = F.transform(F.zip_with("row", "top", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda c, j: F.when(j < k, c["a"]).when(j == k, m).otherwise(c["a"] - m * c["b"]))
    return each.select("i", F.when(F.col("i") > k, lowered).otherwise(F.col("row")).alias("row"))


def _factor_panel(rows: np.ndarray, k: int) -> np.ndarray:
    """Eliminate within the rows k, k+1, .. of a panel."""
    a = rows.copy()
    for s in range(len(a)):
        head = a[s, k + s]
        if head == 0 and k + s < a.shape[1] - 1:
            raise ZeroPivot(k + s)
        if s + 1 < len(a):
            a[s + 1 :, k + s] /= head
            a[s + 1 :, k + s + 1 :] -= np.outer(a[s + 1 :, k + s], a[s, k + s + 1 :])
    return a


def _eliminator(panel: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            a = batch.column(1).flatten().to_numpy().reshape(len(ids), -1).copy()
            below, inside = ids >= k + len(panel), (ids >= k) & (ids < k + len(panel))
            a[inside] = panel[ids[inside] - k]
            rest = a[below]
            for s in range(len(panel)):
                rest[:, k + s] /= panel[s, k + s]
                rest[:, k + s + 1 :] -= np.outer(rest[:, k + s], panel[s, k + s + 1 :])
            a[below] = rest
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(a), pa.list_(pa.float64()))], ["i", "row"])

    return run


def factor(matrix: DataFrame, panel: int = PANEL) -> DataFrame:
    """(i, row): multipliers below the diagonal, the upper factor on and above it. No rows or columns are exchanged.

    A zero pivot raises ZeroPivot. Rounds: the side over `panel`; each moves one panel and rewrites the rows.
    """
    state = checkpointed(matrix.select(F.col("i").cast("int").alias("i"), F.transform("row", lambda v: v.cast("double")).alias("row")))
    n = state.count()
    if panel * n > HELD:
        panel = max(1, HELD // n)
    for k in range(0, n, panel):
        rows = state.where((F.col("i") >= k) & (F.col("i") < k + panel)).orderBy("i").collect()
        done = _factor_panel(np.array([r.row for r in rows]), k)
        state = checkpointed(state.mapInArrow(_eliminator(done, k), "i int, row array<double>"))
    return state


def split(packed: DataFrame) -> DataFrame:
    """(i, l, u): the unit lower factor and the upper factor of a packed factorisation, row by row."""
    lower = F.transform("row", lambda v, j: F.when(j < F.col("i"), v).when(j == F.col("i"), 1.0).otherwise(0.0))
    upper = F.transform("row", lambda v, j: F.when(j >= F.col("i"), v).otherwise(0.0))
    return packed.select("i", lower.alias("l"), upper.alias("u"))


def factor_pivoted(matrix: DataFrame) -> tuple[DataFrame, list[int], list[int]]:
    """The packed factorisation with full pivoting, and the row and column orders: row r of it is row rows[r] of matrix."""
    state = checkpointed(matrix.select(F.col("i").cast("int").alias("i"), F.transform("row", lambda v: v.cast("double")).alias("row")))
    n = state.count()
    rows, columns = list(range(n)), list(range(n))
    for k in range(n - 1):
        at = pivot(state, k).first()
        if at.v == 0:
            raise ZeroPivot(k)
        rows[k], rows[at.i] = rows[at.i], rows[k]
        columns[k], columns[at.j] = columns[at.j], columns[k]
        i = F.when(F.col("i") == k, at.i).when(F.col("i") == at.i, k).otherwise(F.col("i")).cast("int")
        row = F.col("row") if at.j == k else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _swapped(at.j, k))
        state = checkpointed(reduce(state.select(i.alias("i"), row.alias("row")), k))
    return state, rows, columns


def _swapped(a: int, b: int):
    return lambda j: F.col("row")[F.when(j == a, b).when(j == b, a).otherwise(j)]
