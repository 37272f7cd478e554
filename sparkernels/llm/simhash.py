"""Near-duplicate documents by SimHash, linked through multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import LOWER_ASCII, Table, encoded, prepare, tidied
from .components import components, thinned

WORDS = 3
SEED = 42
MAX_BITS = 3
#: Shingles hashed at once, which bounds a worker's memory for any length of text.
BLOCK = 1 << 16
#: Table rows under one segment value beyond which the value is indexed again by the other segment's halves.
HOT = 2048


def _ones(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def folded(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, each counted once; zero if there are none."""
    return _majority(sum((_ones(hashes[i : i + BLOCK]) for i in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64)), len(hashes))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of all word shingles: a bit is set if it is set in over half of their hashes."""
    tokens = text.translate(LOWER_ASCII).split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles, total = iter([b" ".join(tokens)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)), len(tokens) - words + 1
    ones = np.zeros(64, np.int64)
    while block := list(islice(shingles, BLOCK)):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, block, repeat(seed)), "<u8", len(block))
        ones += _ones(hashes)
    return _majority(ones, total)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter(map(fingerprint, encoded(batch.column(1))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _balls(value: Column, width: int, upward: bool = False) -> Column:
    """The value and all values that differ from it in one of `width` bits; upward: only those with that bit set."""
    bits = F.sequence(F.lit(0), F.lit(width - 1))
    mask = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    if upward:
        bits = F.filter(bits, lambda i: value.bitwiseAND(mask(i)) == 0)
    return F.concat(F.array(value), F.transform(bits, lambda i: value.bitwiseXOR(mask(i))))


def _segments(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)]


def _exploded(df: DataFrame, keys: list[Column]) -> DataFrame:
    """A row for each segment's key (arrays of keys are enumerated): seg tells the segment."""
    return df.select("fp", F.posexplode(F.array(*keys)).alias("seg", "key"))


def near(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` that differ in at most 3 bits, u < v; none is lost.

    Multi-index hashing with two 32-bit segments: of 3 differing bits at most one lies in one of the two, so each
    fingerprint looks up the ball within one bit of each of its segments in the table of segment values, and full
    distances are verified. Of two values that differ in one bit, the one without it finds the other, so half of each
    ball is enough. A segment value that over `hot` fingerprints share is indexed once more: the rest of the
    difference, at most 3 bits of the other segment, leaves at most one in one of that segment's 16-bit halves, so
    (value, half) with the 17 values around it finds the same links with a 2^16 times finer key.
    """
    lo, hi = _segments(F.col("fp"))
    table = _exploded(prints, [lo, hi])
    probe = _exploded(prints, [_balls(lo, 32, upward=True), _balls(hi, 32, upward=True)]).select("fp", "seg", F.explode("key").alias("key"))
    crowded = table.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key")
    some = bool(crowded.take(1))

    def met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        a, b = left.withColumnRenamed("fp", "u"), right.withColumnRenamed("fp", "v")
        low, high = _segments(F.col("u"))
        once = (F.col("u") < F.col("v")) | (F.when(F.col("seg") == 0, low).otherwise(high) != F.col("key"))
        found = a.join(b, list(on)).where(once & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
        return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    if not some:
        return met(probe, table, "seg", "key")
    plain = met(probe.join(crowded, ["seg", "key"], "left_anti"), table.join(crowded, ["seg", "key"], "left_anti"), "seg", "key")
    other = F.when(F.col("seg") == 0, hi).otherwise(lo)
    halves = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]
    fine = ["seg", "key", "half", "part"]
    again = table.join(crowded, ["seg", "key"]).select("fp", "seg", "key", F.posexplode(F.array(*halves)).alias("half", "part"))
    asked = probe.join(crowded, ["seg", "key"]).select("fp", "seg", "key", F.posexplode(F.array(*[_balls(x, 16) for x in halves])).alias("half", "parts")).select("fp", "seg", "key", "half", F.explode("parts").alias("part"))
    return plain.union(met(asked, again, *fine))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root) of each distinct fingerprint with its smallest doc_id `least`."""
    prepare(docs.sparkSession)
    prints = Table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_fingerprints), "doc_id long, fp long"), "prints").df
    classes = Table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes").df
    joined = components(thinned(near(classes.select("fp"))))
    return prints, classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable through fingerprints at 3 or fewer differing bits. Null and empty
    texts have fingerprint zero and link like any other; repeated rows each get a row; rows whose doc_id is null link
    but never name a component (component_id is null only where a whole component has no id). An empty table gives none.
    """
    prints, groups = _grouped(docs)
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(groups.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each group of near-duplicates: that of the smallest doc_id.

    Near-duplicates are documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, by way of
    others too. SimHash comes first: the sets' fingerprints meet by multi-index hashing (`near`), and what they link is
    checked by whole sets. No radius promises all similar pairs, so an exact join finds those that it leaves apart.
    Rows that repeat both its doc_id and its text are one document, and one of them stays; different texts under one
    doc_id are told apart only by their groups and stay while one of those groups has that smallest id. Rows without
    a doc_id cannot be chosen and stay.
    """
    kept = similar.grouped(docs, folded, near).groupBy("root").agg(F.min("least").alias("doc_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).union(docs.where(F.col("doc_id").isNull()))
