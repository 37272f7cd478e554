"""Substring dedup: repeated passages found with suffix automata of reference shards and matching statistics.

A corpus is its own reference here, without a size bound, so its automata are not broadcast: shards are small groups of
passages that share an anchor, and the passages of a group meet in one task. A window of 50 words has one anchor, the
least hash of its 10-word shingles, which only its words decide. Consecutive windows with one anchor make a piece, and
equal windows of two documents lie in pieces of the same anchor:

1. pieces that equal a smaller document's piece are removed whole (one row per distinct piece, no automaton), which is
   how thousands of copies are dealt out; `shortcut=False` sends them through the automata too, with the same result;
2. distinct pieces of an anchor, in the order of doc_id, stream through the automaton of those of smaller documents;
3. an anchor with more distinct pieces than GROUP is too large a shard: its windows are cut anew by finer anchors, their
   least four shingle hashes together, then all 41, which name little but the window itself, and go back to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, encoded, prepare, text_key, tidied

WINDOW = 50
SHINGLE = 10
#: Distinct pieces that one automaton takes; larger groups are cut by finer anchors, of so many shingles of a window.
GROUP = 256
LEVELS = (4, WINDOW - SHINGLE + 1)
#: Words whose hashes a worker keeps, and windows looked at together.
CACHED, BLOCK = 1 << 17, 1 << 16

#: Bits of the filter that keeps texts without wanted pieces out of a shuffle: 2^17 rows of 64 at most are broadcast.
SIEVE = 1 << 23

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hash = _WordHash()


def shingles(words: list[bytes]) -> np.ndarray:
    """The hash of each shingle."""
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    grams = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        grams = grams * _MULTIPLIER + h[i : len(grams) + i]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return grams ^ (grams >> np.uint64(29))


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle, and for each window the index of its anchor: its least shingle, the first of equals."""
    grams = shingles(words)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - SHINGLE + 1)
    least = np.concatenate([view[i : i + BLOCK].argmin(axis=1) for i in range(0, len(view), BLOCK)])
    return grams, least + np.arange(len(least))


def pieces(words: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
    """(anchor, first window, windows, 128-bit hash of its words) of each piece of a text of 50 words or more."""
    grams, at = anchors(words)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(starts[1:], len(at))
    for a, b, anchor in zip(starts.tolist(), ends.tolist(), grams[at[starts]].view(np.int64).tolist(), strict=True):
        yield anchor, a, b - a, xxhash.xxh3_128_digest(b" ".join(words[a : b + WINDOW - 1]))


def finer(words: list[bytes], first: int, windows: int, level: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The same of the pieces into which the `level` least shingles of each window cut a piece."""
    words = words[first : first + windows + WINDOW - 1]
    least = np.sort(np.lib.stride_tricks.sliding_window_view(shingles(words), WINDOW - SHINGLE + 1), axis=1)[:, :level]
    names = np.zeros(windows, np.uint64)
    for k in range(level):
        names = (names ^ (names >> np.uint64(31))) * _MULTIPLIER + least[:, k]
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    for a, b, name in zip(starts.tolist(), [*starts[1:].tolist(), windows], names[starts].view(np.int64).tolist(), strict=True):
        yield name, first + a, b - a, xxhash.xxh3_128_digest(b" ".join(words[a : b + WINDOW - 1]))


PIECES = "doc_id long, key long, anchor long, first int, windows int, h1 long, h2 long"


def _pieces(batch: pa.RecordBatch, cut: Iterator[tuple[int, tuple]]) -> pa.RecordBatch:
    """The cut pieces (row of the batch, piece) with their documents' doc_id and key."""
    rows, anchor, first, windows, digests = [], [], [], [], []
    for i, (a, f, n, d) in cut:
        rows.append(i)
        anchor.append(a)
        first.append(f)
        windows.append(n)
        digests.append(d)
    h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    at = pa.array(rows, pa.int64())
    made = [pa.array(anchor, pa.int64()), pa.array(first, pa.int32()), pa.array(windows, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made], ["doc_id", "key", "anchor", "first", "windows", "h1", "h2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ((i, text.split()) for i, text in enumerate(encoded(batch.column(2))))
        yield _pieces(batch, ((i, piece) for i, words in texts if len(words) >= WINDOW for piece in pieces(words)))


def _recut(level: int):
    """The finer pieces of the wanted ones of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((i, text.split(), wanted) for i, (text, wanted) in enumerate(zip(encoded(batch.column(2)), batch.column(3).to_pylist(), strict=True)))
            yield _pieces(batch, ((i, piece) for i, words, wanted in texts for w in wanted for piece in finer(words, w["first"], w["windows"], level)))

    return tidied(run)


class SuffixAutomaton:
    """All substrings of the word sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, length: int, link: int, onward: dict[bytes, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state for the strings of q that are one longer than p's; q itself if those are all."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return self._split(last, q, word)
        state, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][word], word)
        return state

    def matching(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistics: at each word, the length of the longest known sequence that ends there."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            onward = self.next[state].get(word)
            state, size = (onward, size + 1) if onward is not None else (0, 0)
            yield size


def spans(words: list[bytes], known: SuffixAutomaton, least: int = WINDOW) -> list[tuple[int, int]]:
    """The maximal spans of words covered by known sequences of `least` words (end exclusive)."""
    found: list[tuple[int, int]] = []
    for i, size in enumerate(known.matching(words)):
        if size >= least:
            a = i + 1 - least
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((a, i + 1))
    return found


FETCHED = "doc_id long, key long, anchor long, firsts array<int>, words string"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted pieces of each text, equal pieces once."""
    for batch in batches:
        out: list[tuple] = []
        for doc_id, key, text, wanted in zip(*(c for c in batch.columns), strict=True):
            words = (text.as_py() or "").encode().split()
            places: dict[tuple, set[int]] = {}
            for w in wanted.as_py():
                a, n = w["first"], w["windows"]
                places.setdefault((w["anchor"], b" ".join(words[a : a + n + WINDOW - 1])), set()).add(a)
            out += [(doc_id.as_py(), key.as_py(), anchor, sorted(firsts), piece) for (anchor, piece), firsts in places.items()]
            if len(out) >= 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "key", "anchor", "firsts", "words"])


SPANS = "doc_id long, key long, start int, stop int"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and doc_id: each document's pieces meet the automaton of the smaller documents'."""
    out: list[tuple] = []

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[0]):
        known, held = SuffixAutomaton(), []
        for _, pieces_ in groupby(group, key=lambda r: r[1]):
            for words in held:
                known.add(words)
            held = []
            for _, doc_id, key, firsts, words in pieces_:
                tokens = words.encode().split(b" ")
                held.append(tokens)
                if len(known.link) > 1:
                    found = spans(tokens, known)
                    out += [(doc_id, key, first + a, first + b) for first in firsts for a, b in found]
        if len(out) >= 20_000:
            yield _spans(out)
            out = []
    yield _spans(out)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "key", "start", "stop"])


def _sieved(keyed: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """keyed without most rows that no row of wanted names by doc_id and key, and with all that one does."""
    at = F.pmod(F.xxhash64("doc_id", "key"), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    marks = wanted.select(F.shiftright(at, 6).alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    return keyed.join(F.broadcast(marks), (F.shiftright(at, 6) == F.col("_at")) & (bit.bitwiseAND(F.col("_bits")) != 0), "left_semi")


def _wanted(keyed: DataFrame, pieces_: DataFrame, *fields: str, bits: int = SIEVE) -> tuple[DataFrame, Table]:
    """(doc_id, key, text, wanted) of the texts that hold any of the pieces, and a table for release when they are written.

    Few texts do, so the others are kept out of the join's shuffle.
    """
    each = Table(pieces_.groupBy("doc_id", "key").agg(F.collect_set(F.struct(*fields)).alias("wanted")), "wanted")
    return _sieved(keyed, each.df, bits).join(each.df, ["doc_id", "key"]).select("doc_id", "key", "text", "wanted"), each


def repeated(keyed: DataFrame, group: int = GROUP, shortcut: bool = True) -> DataFrame:
    """Spans (doc_id, key, start, stop in words) to remove from keyed texts (doc_id, key, text); they may overlap."""
    cut = Table(keyed.where(F.col("doc_id").isNotNull()).mapInArrow(tidied(_cut), PIECES), "pieces")
    found: list[DataFrame] = []
    for level in (*LEVELS, None):
        # Tables on one side of a join leave Spark free to split hot keys of the other.
        shared = Table(cut.df.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared")
        met = Table(cut.df.join(shared.df, "anchor", "left_semi"), "met")
        cut.release()
        shared.release()
        same = ["anchor", "windows", "h1", "h2"]
        distinct = Table(met.df.groupBy(*same).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "distinct")
        kinds = Table(distinct.df.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
        known = distinct.df.join(kinds.df, "anchor").where("kinds > 1 or least < most").select(*same, "least", "kinds")
        stood = Table(met.df.join(known, same).select("doc_id", "key", "anchor", "first", "windows", "least", "kinds"), "stood").df
        for table in (met, distinct, kinds):
            table.release()
        if shortcut:
            found.append(stood.where("doc_id > least").select("doc_id", "key", F.col("first").alias("start"), (F.col("first") + F.col("windows") + WINDOW - 1).alias("stop")))
            stood = stood.where("doc_id = least and kinds > 1")
        small = F.lit(True) if level is None else F.col("kinds") <= group
        texts, wanted = _wanted(keyed, stood.where(small), "anchor", "first", "windows")
        fetched = Table(texts.mapInArrow(tidied(_fetch), FETCHED), "fetched").df
        wanted.release()
        sorted_ = fetched.select("anchor", "doc_id", "key", "firsts", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "firsts")
        found.append(sorted_.mapInArrow(tidied(_streamed), SPANS))
        crowded = stood.where(~small)
        if level is None or not crowded.take(1):
            return reduce(DataFrame.union, found)
        texts, wanted = _wanted(keyed, crowded, "first", "windows")
        cut = Table(texts.mapInArrow(_recut(level), PIECES), "pieces")
        wanted.release()
    raise AssertionError("the last level has no crowded anchors")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, kept = [], [], []
        for text, starts, stops in zip(encoded(batch.column(1)), batch.column(2), batch.column(3), strict=True):
            words = text.split()
            if starts.is_valid and len(starts):
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts.values.to_numpy(), 1)
                np.add.at(edge, stops.values.to_numpy(), -1)
                stay = np.cumsum(edge)[:-1] == 0
                left = [words[i] for i in np.flatnonzero(stay)]
            else:
                left = words
            sizes.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def stripped(docs: DataFrame, group: int = GROUP, shortcut: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of 50 consecutive words that holds it also starts in a document with a smaller doc_id,
    judged on the input. Words are separated by ASCII white space; null and empty texts have none. Rows that repeat a
    doc_id do not count as smaller than each other; rows without a doc_id lose nothing and take nothing from others.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), "text")
    found = repeated(keyed, group, shortcut).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = keyed.join(found, ["doc_id", "key"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    return joined.mapInArrow(tidied(_strip), "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    return stripped(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
