"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, scanned once over each text.

The automaton runs over word numbers: each word of the items is two letters of disjoint alphabets, so a word is found by
its number and a match begins and ends where words do.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, encoded, prepare, text_key, tidied

WINDOW = 10
#: Words of items in one automaton. A word adds up to 20 states of under 50 bytes, so a worker holds some 200 MB at most;
#: larger benchmarks are scanned in blocks, and an item over a block's size is cut with its windows whole.
BLOCK_WORDS = 1 << 18

#: A-Z to a-z; every other ASCII byte but digits and letters to a space; bytes over 0x7F stay (UTF-8 keeps them whole).
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

HITS = "array<struct<first:long,words:long,start:long,end:long,items:array<string>>>"
SCHEMA = f"doc_id long, n_words long, hits {HITS}"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_windows(words: list) -> list[tuple]:
    if len(words) <= WINDOW:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


class Matcher:
    """The automaton of all windows of items (item_id, words). Null ids go unlisted."""

    #: A word that no item has.
    OTHER = "\x00\x01"

    def __init__(self, items: list[tuple[str | None, list[bytes]]]) -> None:
        # Frequent words share the letters that the automaton tries first.
        ranked = [w for w, _ in Counter(w for _, words in items for w in words).most_common()]
        base = isqrt(len(ranked)) + 1
        self.letters = {w: chr(0x100 + i // base) + chr(0x8000 + i % base) for i, w in enumerate(ranked)}
        self.kinds: list[tuple[int, tuple]] = []
        found: dict[str, list] = {}
        for item, words in items:
            for window in item_windows(words):
                ids = found.setdefault(self.coded(window), [])
                if item is not None and item not in ids:
                    ids.append(item)
        known: dict[tuple[int, tuple], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for window, ids in found.items():
            self.automaton.add_word(window, known.setdefault((len(window) // 2, tuple(sorted(ids))), len(known)))
        self.kinds = list(known)
        self.automaton.make_automaton()
        self.some = bool(found)

    def coded(self, words) -> str:
        return "".join(map(self.letters.get, words, repeat(self.OTHER)))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, tuple]]:
        """(first word, words, item_ids) of each occurrence of a window, in the order of their ends."""
        if not self.some:
            return []
        found = []
        for at, kind in self.automaton.iter(self.coded(words)):
            n, ids = self.kinds[kind]
            found.append((at // 2 - n + 1, n, ids))
        return found

    def any(self, words: list[bytes]) -> bool:
        return self.some and next(self.automaton.iter(self.coded(words)), None) is not None


class Block:
    """A bounded part of a benchmark, broadcast; a worker builds its automaton once and keeps the last one it built."""

    held: tuple[str, Matcher] | None = None

    def __init__(self, items: Broadcast) -> None:
        self.items, self.key = items, uuid.uuid4().hex

    def matcher(self) -> Matcher:
        if Block.held is None or Block.held[0] != self.key:
            Block.held = None
            Block.held = self.key, Matcher(self.items.value)
        return Block.held[1]


def _original(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each normalised word starts and ends in the original text, in code points."""
    kept = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], kept.view(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]


_KIND = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("items", pa.list_(pa.string()))]))


def _hits(matcher: Matcher, text: bytes) -> tuple[int, list[dict]]:
    words = normal_words(text)
    found = matcher.scan(words)
    if not found:
        return len(words), []
    begin, end = _original(text)
    return len(words), [{"first": a, "words": n, "start": int(begin[a]), "end": int(end[a + n - 1]), "items": list(ids)} for a, n, ids in found]


def _scanner(block: Block):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = block.matcher()
        for batch in batches:
            sizes, hits = [], []
            for text in encoded(batch.column(1)):
                size, found = _hits(matcher, text)
                sizes.append(size)
                hits.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hits, _KIND)], ["doc_id", "n_words", "hits"])

    return tidied(scanned)


def _finder(block: Block):
    """(doc_id, key, hits) of rows (doc_id, key, text) with any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = block.matcher()
        for batch in batches:
            hits = [_hits(matcher, text)[1] for text in encoded(batch.column(2))]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, _KIND)], ["doc_id", "key", "hits"])
            yield out.filter(pa.array([bool(h) for h in hits], pa.bool_()))

    return tidied(found)


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark's items in blocks of bounded words, one at a time: a stated query set, held against all rows in blocks.

    Always at least one block; the driver holds no more than one.
    """
    sc = benchmark.sparkSession.sparkContext
    block, size, made = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = normal_words((row.text or "").encode())
        for at in range(0, max(1, len(words) - WINDOW + 1), max(1, BLOCK_WORDS - WINDOW + 1)):
            piece = words[at : at + max(BLOCK_WORDS, WINDOW)]
            if block and size + len(piece) > BLOCK_WORDS:
                yield Block(sc.broadcast(block))
                block, size, made = [], 0, True
            block.append((row.item_id, piece))
            size += len(piece)
    if block or not made:
        yield Block(sc.broadcast(block))


def _digest(hits: list[dict], words: int) -> tuple[int, int, str]:
    mask, ids = np.zeros(words + 1, np.int64), set()
    for h in hits:
        mask[h["first"]] += 1
        mask[h["first"] + h["words"]] -= 1
        ids.update(h["items"])
    return int((np.cumsum(mask)[:words] > 0).sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_digest(h, n) for h, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        n_hit, n_items, sha = ([r[k] for r in rows] for k in range(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")


def _found(docs: DataFrame, first: Block, second: Block, others: Iterator[Block]) -> DataFrame:
    """(doc_id, key, hits) of the distinct documents with hits, block after block, each block's hits written by themselves."""
    keyed, parts = _keyed(docs), []
    for block in chain((first, second), others):
        parts.append(Table(keyed.mapInArrow(_finder(block), f"doc_id long, key long, hits {HITS}").dropDuplicates(["doc_id", "key"]), "hits").df)
        block.items.destroy()
    return reduce(DataFrame.union, parts)


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(normal_words(text)) for text in encoded(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "key", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, hits) for each row of docs (doc_id, text).

    A hit is an occurrence of a window of benchmark words: its first word and length in the document's words, its span
    in the original text in code points (end exclusive), and the ids of the items that hold the window. Null and empty
    texts have no words; an empty benchmark has no hits; repeated rows each get a row; a null item_id's windows hit
    but name no item. A benchmark over the block limit is scanned block by block, a block's hits are written, and the
    rows' hits are gathered in the order of their places; only documents with hits are shuffled.
    """
    prepare(docs.sparkSession)
    blocks = benchmark_blocks(benchmark)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return docs.select("doc_id", "text").mapInArrow(_scanner(first), SCHEMA)
    each = _found(docs, first, second, blocks).groupBy("doc_id", "key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits")).alias("h")
    sized = _keyed(docs).mapInArrow(tidied(_size), "doc_id long, key long, n_words long").alias("d")
    joined = sized.join(each, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.key") == F.col("h.key")), "left")
    return joined.select("d.doc_id", "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a hit), n_items, items_sha256 (their ids, sorted, comma-joined), contaminated."""
    return contamination(docs, benchmark).mapInArrow(_digested, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark window; the others go. An empty benchmark keeps all."""
    prepare(docs.sparkSession)
    blocks = benchmark_blocks(benchmark)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return docs.mapInArrow(_keeper(first, docs.columns.index("text")), docs.schema)
    hit = _found(docs, first, second, blocks).select(F.col("doc_id").alias("of"), "key").distinct().alias("h")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("of_key"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("of")) & (F.col("of_key") == F.col("key")), "left_anti").select("row.*")


def _keeper(block: Block, at: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = block.matcher()
        for batch in batches:
            yield batch.filter(pa.array([not matcher.any(normal_words(text)) for text in encoded(batch.column(at))], pa.bool_()))

    return tidied(kept)
