"""Groups of documents whose sets of word shingles have a Jaccard similarity of 4/5 or more: SimHash, checked by whole
sets, then an exact prefix join for the pairs that it leaves apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, Table, encoded, prepare, text_key, tidied
from .components import components, thinned

WORDS = 5
SEED = 42
#: The least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Shingles hashed at once.
BLOCK = 1 << 16
#: One document in SAMPLE is counted to find common shingles: those in COMMON or more of them, LISTED at most. They come
#: last in the order of shingles. Any order gives the same groups, so this bounds work and not results.
SAMPLE, COMMON, LISTED = 16, 4, 1 << 16

#: Rounds in which each set is compared with a few others, and how many: large groups become one without all their pairs.
#: What they leave is compared in full, so they bound work and not results.
ROUNDS, PARTNERS = 3, 6

#: Bits of a set's parity sketch; two sketches differ in at most as many bits as their sets in shingles.
BITS = 2048

INDEX = "doc_id long, key long, fp long, n int, bits array<long>, sim long, rare int, prefix array<long>"


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted; fewer words than a shingle's are one shingle."""
    tokens = text.translate(LOWER_ASCII).split()
    if not tokens:
        return np.empty(0, np.uint64)
    n = min(words, len(tokens))
    every, parts = map(b" ".join, zip(*(tokens[i:] for i in range(n)), strict=False)), []
    while block := list(islice(every, BLOCK)):
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, block, repeat(SEED)), np.uint64, len(block)))
    return np.unique(np.concatenate(parts))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """A bit for each value of a shingle's low bits: set if an odd number of shingles have it."""
    return np.packbits(np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1 == 1).view(np.uint64)


def _longs(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _longs([shingles(t) for t in encoded(batch.column(1))])], ["id", "set"])


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and how often the sample has them."""
    some = docs.where(F.pmod(text_key(), F.lit(SAMPLE)) == 0).select(text_key().alias("id"), "text")
    each = some.mapInArrow(tidied(_sets), "id long, set array<long>").select(F.explode("set").alias("token"))
    rows = each.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(LISTED).collect()
    found = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in rows], np.int64)[order]


def _indexer(common: np.ndarray, counts: np.ndarray, fold: Callable[[np.ndarray], int]):
    def prefix(tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """The first shingles, rare ones first, of which two similar sets have one in common, and how many are not listed as common."""
        rank = np.zeros(len(tokens), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            rank = np.where(common[at] == tokens, counts[at], 0)
        first = tokens[np.lexsort((tokens, rank))][: len(tokens) + OVER * len(tokens) // -UNDER + 1]
        return first, min(len(first), int(np.count_nonzero(rank == 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in encoded(batch.column(2))]
            prints = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            bits = _longs([_sketch(s) for s in sets])
            sims = np.fromiter(map(fold, sets), np.uint64, len(sets)).view(np.int64)
            starts = [prefix(s) for s in sets]
            rare = pa.array([r for _, r in starts], pa.int32())
            columns = [batch.column(0), batch.column(1), pa.array(prints), sizes, bits, pa.array(sims), rare, _longs([s for s, _ in starts])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp", "n", "bits", "sim", "rare", "prefix"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = a.values.to_numpy(), b.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(UNDER * both >= OVER * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _possible(a, b, both):
    """Whether sketches a, b of two sets of so many shingles allow similarity: they differ in (UNDER - OVER) / (UNDER + OVER) of both at most."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (UNDER + OVER) * apart <= (UNDER - OVER) * both


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sketches allow similarity."""
    x = classes.select(F.col("fp").alias("u"), F.col("bits").alias("a"), F.col("n").alias("n"))
    y = classes.select(F.col("fp").alias("v"), F.col("bits").alias("b"), F.col("n").alias("m"))
    return pairs.join(x, "u").join(y, "v").where(_possible("a", "b", F.col("n").cast("long") + F.col("m"))).select("u", "v")


def _checked(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that are similar, by their whole sets, made again from one document of each."""
    pairs = Table(pairs, "pairs").df
    asked = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    asked = Table(asked.join(classes, "fp").select("fp", "doc", "key", "copies"), "asked").df
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    texts = keyed.join(asked.withColumnRenamed("key", "key2"), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("key2"))).select("fp", "copies", "text")
    texts = texts.where("copies = 1").union(texts.where("copies > 1").dropDuplicates(["fp"])).select("fp", "text")
    held = Table(texts.mapInArrow(tidied(_sets), "id long, set array<long>"), "sets")
    sets = held.df
    one = sets.select(F.col("id").alias("u"), F.col("set").alias("a"))
    two = sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    out = Table(pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(tidied(_similar), "u long, v long"), "similar").df
    held.release()
    return out


def _fit(n, at, m, there):
    """Whether sets of n and m shingles whose prefixes first meet at these places (from 0) can be similar."""
    whole = UNDER * F.least(n, m) >= OVER * F.greatest(n, m)
    return whole & ((UNDER + OVER) * F.least(n - at, m - there) >= OVER * (n + m))


def _shared(prints: DataFrame) -> DataFrame:
    """fp, n, at, token of the prefix shingles that may make a pair.

    A shingle that is not listed as common meets its sets once, sorted in one shuffle, and goes if it has only one set or
    no set that has it early enough to be the smaller of a pair. The listed ones, which hold all hot keys, stay as they
    are: no window ever holds more than the most frequent shingle below them.
    """
    each = prints.select("fp", "n", "rare", F.posexplode("prefix").alias("at", "token"))
    all_ = Window.partitionBy("token")
    met = each.where("at < rare").select("fp", "n", "at", "token", F.min("fp").over(all_).alias("x"), F.max("fp").over(all_).alias("y"), F.min(_late()).over(all_).alias("late"))
    rare = met.where("x <> y and late <= 0").select("fp", "n", "at", "token").distinct()
    return rare.union(each.where("at >= rare").select("fp", "n", "at", "token").distinct())


def _late():
    """Above 0 if no set of this size or more can be similar to one whose prefix first meets it at this place; see `_fit`."""
    return (UNDER + OVER) * F.col("at").cast("long") - (UNDER - OVER) * F.col("n")


def _partners(shared: DataFrame, turn: int) -> DataFrame:
    """(u, v): each set with those of other groups it shares most prefix shingles with, PARTNERS at most.

    shared: fp, n, at, token, c (the group). A shingle offers a few of its sets, drawn anew each turn; per draw a set
    takes the one that most of its shingles offer.
    """
    drawn = [F.min(F.struct(F.xxhash64("fp", F.lit(turn * PARTNERS + k)).alias("h"), F.lit(k).alias("draw"), "fp", "n", "at", "c")) for k in range(PARTNERS)]
    offers = shared.groupBy("token").agg(F.array(*drawn).alias("f")).select("token", F.explode("f").alias("f"))
    met = shared.join(offers, "token").where((F.col("c") != F.col("f.c")) & _fit(F.col("n"), F.col("at"), F.col("f.n"), F.col("f.at")))
    often = met.groupBy("fp", "f.draw", "f.fp").count().toDF("u", "draw", "v", "count").groupBy("u", "draw").agg(F.max_by("v", F.struct("count", "v")).alias("v"))
    return often.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _open(shared: DataFrame, joined: DataFrame) -> Table:
    """fp, n, at, token, c of the shingles that sets of several groups share."""
    now = shared.select("fp", "n", "at", "token").join(joined, F.col("fp") == F.col("node"), "left").select("fp", "n", "at", "token", F.coalesce("component", "fp").alias("c"))
    mixed = now.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min(_late()).alias("late")).where("x <> y and late <= 0").select("token")
    return Table(now.join(mixed, "token"), "open")


def _simhashed(classes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v): the first set of each SimHash with the others of that SimHash and with the first sets of SimHashes near it.

    Links between SimHashes are thinned first, so a dense group of them has no more than its forests.
    """
    firsts = Table(classes.groupBy("sim").agg(F.min("fp").alias("first")), "simhashes").df
    same = classes.join(firsts, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    one, two = firsts.toDF("u", "a"), firsts.toDF("v", "b")
    met = thinned(near(firsts.select(F.col("sim").alias("fp")))).join(one, "u").join(two, "v").select("a", "b")
    return same.union(met).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def grouped(docs: DataFrame, fold: Callable[[np.ndarray], int], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, least, root): every distinct shingle set, its smallest doc_id and its group; similar sets share a group.

    fold: the SimHash of a set of shingles. near: links (u, v) between distinct SimHashes `fp`. What SimHash links is
    checked by whole sets and makes the first groups; the exact join that follows finds all other similar pairs.

    Sets are told apart by 64-bit hashes. Two sets of similarity 4/5 share a shingle among the first fifth of each, in
    any one order of all shingles (prefix filter); rare ones come first. In a few rounds each set is compared with some
    of other groups that it shares most such shingles with, so large groups become one without all their pairs; then all
    pairs that share such a shingle and are not in one group yet, and whose sizes and places allow it, are compared.
    None is lost. Null and empty texts have the empty set, in which they are copies of each other.
    """
    prepare(docs.sparkSession)
    index = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text").mapInArrow(tidied(_indexer(*_common(docs), fold)), INDEX)
    kept = Table(index, "prefixes")
    prints = kept.df
    rows = prints.groupBy("fp", F.col("doc_id").alias("doc"), "key").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sim").alias("sim"))
    one = F.min(F.struct(F.col("doc").isNull().alias("without"), "doc", "key", "copies", "n", "bits", "sim"))
    classes = Table(rows.groupBy("fp").agg(F.min("doc").alias("least"), one.alias("x")).select("fp", "least", "x.*"), "classes").df
    # Copies of one set need not go first: they share all their shingles and drop out with those of a single set.
    shared = Table(_shared(prints), "shared")
    kept.release()
    links = [_checked(_sketched(_simhashed(classes, near), classes), docs, classes)]
    open_ = _open(shared.df, components(thinned(links[0])))
    shared.release()
    for turn in range(ROUNDS):
        links.append(_checked(_sketched(_partners(open_.df, turn), classes), docs, classes))
        joined = components(thinned(reduce(DataFrame.union, links)))
        after = _open(open_.df, joined)
        open_.release()
        open_ = after
        if not links[-1].take(1):
            break
    # The sketches come along, so that a pair which they rule out never leaves the join.
    last = open_.df.join(classes.select("fp", "bits"), "fp")
    a, b = last.alias("a"), last.alias("b")
    fits = _fit(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at")) & _possible("a.bits", "b.bits", F.col("a.n").cast("long") + F.col("b.n"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.c") < F.col("b.c")) & fits).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
    links.append(_checked(pairs, docs, classes))
    open_.release()
    found = components(thinned(reduce(DataFrame.union, links)))
    return classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
