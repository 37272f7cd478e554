"""Token ids in wavelet-matrix shards: succinct bit-planes with access, counting and occurrence lookup from one file.

A file: the magic, a length-prefixed JSON header, then its sections: the table of documents (Arrow), the alphabet, and for each
bit of an id, highest first, the ranks of ones at every SAMPLE bits and the plane of bits in blocks of PLANE bytes. Each
section and each block is a zstd frame of its own, so a reader fetches and inflates only what a question needs.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Table, prepare, text_key, tidied

MAGIC = b"WVMX0002"
SAMPLE = 4096
#: Bytes of a plane that are compressed together: whole samples.
PLANE = 1 << 15
END = 0
#: A shard closes when it holds this many ids, which bounds what a task holds; a document is never split.
SHARD_IDS = 1 << 20
#: Bytes of an encoder's known words and their ids, words that it encodes in one call and in one line of it, and
#: characters of text that it splits at once.
#: Each lookup among the known words hashes them all: the more text a chunk holds, the fewer lookups.
CACHED, CALL, LINE, CHUNK = 24 << 20, 4096, 32, 1 << 23
#: A space that leads no word: the tokenizer may join it to the white space around it.
ODD = re.compile(r" (?:\s|$)")
#: A space that leads a word: the tokenizer always splits before it, whatever stands there.
LEAD = re.compile(r" (?=\S)")


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct space-led word once.

    The tokenizer always splits before a space that leads a word, so a text's ids are its words' ids in a row; white
    space that leads no word stays with the word before it. Strings of special tokens are text. Known words are bounded
    in bytes: when they pass CACHED, the half met less often is forgotten.
    """

    def __init__(self, definition: str) -> None:
        # The executor's cores all have a worker already; a pool of threads in each only takes memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        #: Ids that begin with the space (byte-level alphabet: U+0120), where a word begins in a row of words.
        self.leads = np.zeros(size, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        #: Known words, where each one's ids stand in one flat row, and how often each was met.
        self.words = pa.array([], pa.large_string())
        self.flat, self.begins, self.sizes, self.met = np.zeros(0, self.dtype), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def held(self) -> int:
        """Bytes of the known words and their ids."""
        return self.words.nbytes + self.flat.nbytes + self.begins.nbytes + self.sizes.nbytes + self.met.nbytes

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with a space before it, in a row, and how many each has."""
        ids = np.concatenate(self.whole([" " + " ".join(words[i : i + LINE]) for i in range(0, len(words), LINE)]))
        at = np.flatnonzero(self.leads[ids])
        if len(at) == len(words) and at[0] == 0:
            return ids, np.diff(at, append=len(ids))
        each = self.whole([" " + w for w in words])
        return np.concatenate(each), np.array([len(x) for x in each])

    def _gathered(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first `lengths` ids of the words at `places`, in a row."""
        ends = np.cumsum(lengths, dtype=np.int32)
        where = np.repeat(self.begins[places] - (ends - lengths), lengths)
        where += np.arange(len(where), dtype=np.int32)
        return self.flat[where]

    def _forget(self) -> None:
        """Keep the half of the known words met most often, and count their meetings half."""
        kept = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
        self.flat = self._gathered(kept, self.sizes[kept])
        self.words, self.sizes, self.met = self.words.take(pa.array(kept)), self.sizes[kept], self.met[kept] // 2
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def _places(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """The index of each of the distinct words, met so often, among the known ones, after learning the others."""
        if self.held() > CACHED:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        places = at.fill_null(0).to_numpy().astype(np.int32)
        if len(new):
            places[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new), dtype=np.int32)
            parts = [self._apart(new.slice(i, CALL).to_numpy(zero_copy_only=False).tolist()) for i in range(0, len(new), CALL)]
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.begins = np.concatenate([self.begins, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes.astype(np.int32)]), np.concatenate([self.flat, ids])
            self.words, self.met = pa.concat_arrays([self.words, new]), np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[places] += times.astype(np.int32)
        return places

    def _split(self, pieces: list[str], led: list[bool]) -> list[np.ndarray]:
        """The ids of each piece, whose white space leads words only; led: a space led its first word, which it is without."""
        split = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
        return self._row(split.flatten(), split.offsets.to_numpy(), led)

    def _row(self, words: pa.Array, offsets: np.ndarray, led: list[bool]) -> list[np.ndarray]:
        """The ids of each run of words between two offsets, with the space that leads a word."""
        starts, unled = offsets[:-1], ~np.array(led)
        # A text's first word has no space before it: it is encoded by itself, and its place below stays empty.
        bare = iter(self.whole(words.take(pa.array(starts[unled])).to_pylist()))
        coded = words.dictionary_encode()
        indices = coded.indices.to_numpy()
        places = self._places(coded.dictionary, np.bincount(indices, minlength=len(coded.dictionary)))[indices]
        lengths = self.sizes[places]
        lengths[starts[unled]] = 0
        bounds = np.concatenate([[0], np.cumsum(lengths)])[offsets[1:-1]]
        rows = np.split(self._gathered(places, lengths), bounds)
        return [rest if is_led else np.concatenate([next(bare), rest]) for rest, is_led in zip(rows, led, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; long texts are cut before spaces that lead words, and CHUNK characters or so are split at once."""
        made: list[list[np.ndarray]] = [[] for _ in texts]
        plain: list[tuple[int, str, bool]] = []
        odd: list[tuple[int, str, bool]] = []
        size = 0

        def flush() -> None:
            if plain:
                for (i, *_), ids in zip(plain, self._split([p for _, p, _ in plain], [x for *_, x in plain]), strict=True):
                    made[i].append(ids)
            if odd:
                cut = [LEAD.split(p) for _, p, _ in odd]
                words = pa.array(chain.from_iterable(cut), pa.large_string())
                for (i, *_), ids in zip(odd, self._row(words, np.cumsum([0, *map(len, cut)]), [x for *_, x in odd]), strict=True):
                    made[i].append(ids)

        for i, text in enumerate(texts):
            at, kind = 0, odd if ODD.search(text) else plain
            while at < len(text):
                cut = LEAD.search(text, at + CHUNK) if len(text) - at > CHUNK else None
                to = cut.start() if cut else len(text)
                is_led = at > 0
                piece = text[at + is_led : to]
                if size and size + len(piece) > CHUNK:
                    flush()
                    plain.clear()
                    odd.clear()
                    size = 0
                kind.append((i, piece, is_led))
                at, size = to, size + len(piece)
        flush()
        return [m[0] if len(m) == 1 else np.concatenate([np.zeros(0, self.dtype), *m]) for m in made]


@lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    return Encoder(definition)


class WaveletMatrix:
    """A sequence of ids below 2**width as `width` bit-planes, each stably sorted by the bits above it.

    ranks(k) gives the ones of plane k before every SAMPLE bits, block(k, b) its b-th PLANE bytes; both are asked for
    only when an answer needs them.
    """

    def __init__(self, n: int, zeros: list[int], dtype: str, ranks: Callable[[int], np.ndarray], block: Callable[[int, int], np.ndarray]) -> None:
        self.n, self.width, self.zeros, self.dtype = n, len(zeros), zeros, np.dtype(dtype)
        self.ranks, self.block = ranks, block

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, ranks, zeros, x = [], [], [], ids
        for b in range(width - 1, -1, -1):
            bit = x & x.dtype.type(1 << b) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            full = np.bitwise_count(packed[: len(packed) // (SAMPLE // 8) * (SAMPLE // 8)]).reshape(-1, SAMPLE // 8).sum(axis=1, dtype=np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(full)]).astype("<u4"))
            # By index: a mask costs several times as much where its bits are in no order.
            down = np.flatnonzero(~bit)
            x = np.concatenate([x.take(down), x.take(np.flatnonzero(bit))])
            zeros.append(len(down))
        return cls(len(ids), zeros, ids.dtype.str, ranks.__getitem__, lambda k, b: planes[k][b * PLANE : (b + 1) * PLANE])

    def blocks(self) -> int:
        """Blocks of each plane."""
        return -(-self.n // (8 * PLANE))

    def _ones(self, k: int, i: int) -> int:
        """Ones before position i of plane k."""
        at = i // SAMPLE
        a, b = at * (SAMPLE // 8), i // 8
        ones = int(self.ranks(k)[at])
        if i % SAMPLE:
            # A sample lies in one block.
            bits = self.block(k, a // PLANE)
            a, b = a % PLANE, b - a // PLANE * PLANE
            ones += int(np.bitwise_count(bits[a:b]).sum()) + (int(bits[b] >> (8 - i % 8)).bit_count() if i % 8 else 0)
        return ones

    def _bit(self, k: int, i: int) -> int:
        at, byte = divmod(i >> 3, PLANE)
        return int(self.block(k, at)[byte]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(self.width):
            bit = self._bit(k, i)
            value, ones = value << 1 | bit, self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _interval(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value before position i stand below the last plane."""
        a = 0
        for k in range(self.width):
            p, q = self._ones(k, a), self._ones(k, i)
            a, i = (self.zeros[k] + p, self.zeros[k] + q) if value >> (self.width - 1 - k) & 1 else (a - p, i - q)
        return a, i

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before position i."""
        a, b = self._interval(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence of value, from 0."""
        a, b = self._interval(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            at = self._seek(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _seek(self, k: int, bit: int, nth: int) -> int:
        """The position of the nth (from 0) such bit of plane k."""
        ones = self.ranks(k).astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * SAMPLE - ones
        sample = int(np.searchsorted(before, nth, side="right")) - 1
        at, byte = divmod(sample * (SAMPLE // 8), PLANE)
        bits = np.unpackbits(self.block(k, at)[byte : byte + SAMPLE // 8])
        return sample * SAMPLE + int(np.flatnonzero(bits == bit)[nth - int(before[sample])])

    def occurrences(self, value: int) -> Iterator[int]:
        return (self.select(value, k) for k in range(self.count(value)))

    def ids(self) -> np.ndarray:
        """The whole sequence."""
        x = np.zeros(self.n, self.dtype)
        for k in range(self.width - 1, -1, -1):
            plane = np.concatenate([self.block(k, b) for b in range(self.blocks())])
            bit = np.unpackbits(plane, count=self.n).view(bool)
            up = np.empty_like(x)
            up[np.flatnonzero(~bit)] = x[: self.zeros[k]]
            up[np.flatnonzero(bit)] = x[self.zeros[k] :] | x.dtype.type(1 << (self.width - 1 - k))
            x = up
        return x


def dump(ids: np.ndarray, docs: pa.Table) -> bytes:
    """The bytes of a file. docs: doc_id, n_tokens in the order of the ids.

    The matrix holds places in the file's alphabet, the sorted ids that occur, which needs fewer planes than the ids.
    """
    counts = np.bincount(ids, minlength=1)
    alphabet = np.flatnonzero(counts).astype(ids.dtype)
    place = np.zeros(len(counts), ids.dtype)
    place[alphabet] = np.arange(len(alphabet))
    matrix = WaveletMatrix.build(place[ids], max(1, (len(alphabet) - 1).bit_length()))
    press = zstandard.ZstdCompressor(level=1)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as out:
        out.write_table(docs)
    sections = [press.compress(sink.getvalue().to_pybytes()), press.compress(alphabet.tobytes())]
    for k in range(matrix.width):
        sections.append(press.compress(matrix.ranks(k).tobytes()))
        sections += [press.compress(matrix.block(k, b).tobytes()) for b in range(matrix.blocks())]
    header = json.dumps({"n": len(ids), "zeros": matrix.zeros, "dtype": ids.dtype.str, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """A file's ids, by the matrix of their places in its alphabet, and its documents.

    The file is any seekable binary file. Only the header is read when it is opened; `inflated` counts the frames that
    questions have needed since, the latest KEPT of which stay in memory.
    """

    KEPT = 256

    def __init__(self, file: BinaryIO) -> None:
        if file.read(8) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<I", file.read(4))
        header = json.loads(file.read(size))
        self._file, self._starts, self.inflated = file, np.cumsum([12 + size, *header["sections"]]).tolist(), 0
        self._frame = lru_cache(maxsize=self.KEPT)(self._read)
        n, zeros, self.dtype = header["n"], header["zeros"], np.dtype(header["dtype"])
        each = 1 + -(-n // (8 * PLANE))
        self.matrix = WaveletMatrix(n, zeros, header["dtype"], lambda k: np.frombuffer(self._frame(2 + k * each), "<u4"), lambda k, b: np.frombuffer(self._frame(3 + k * each + b), np.uint8))

    def _read(self, section: int) -> bytes:
        a, b = self._starts[section : section + 2]
        self._file.seek(a)
        self.inflated += 1
        return zstandard.decompress(self._file.read(b - a))

    @property
    def docs(self) -> pa.Table:
        """doc_id, n_tokens of the documents, in the order of their ids."""
        return pa.ipc.open_stream(self._frame(0)).read_all()

    @property
    def alphabet(self) -> np.ndarray:
        return np.frombuffer(self._frame(1), self.dtype)

    def _place(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def access(self, i: int) -> int:
        """The id at position i, from 0."""
        if not 0 <= i < self.matrix.n:
            raise IndexError(i)
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, token: int) -> int:
        at = self._place(token)
        return 0 if at is None else self.matrix.count(at)

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before position i."""
        at = self._place(token)
        return 0 if at is None else self.matrix.rank(at, i)

    def occurrences(self, token: int) -> Iterator[int]:
        """The token's positions, ascending."""
        at = self._place(token)
        return iter(()) if at is None else self.matrix.occurrences(at)

    def ids(self) -> np.ndarray:
        return self.alphabet[self.matrix.ids()]


def load(data: bytes) -> Shard:
    return Shard(io.BytesIO(data))


SHARDS = "part int, seq int, n_docs long, n_tokens long, file binary"
DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def _sharder(definition: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(definition), TaskContext.get().partitionId(), 0
        end = np.array([END], enc.dtype)
        ids, docs, held = [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = [len(x) for x in ids]
            table = pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(lengths, pa.int64())], schema=DOCS)
            file = dump(np.concatenate(ids), table)
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(docs)]), pa.array([sum(lengths)]), pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_docs", "n_tokens", "file"])

        for doc_ids, texts in _chunks(batches):
            for doc_id, coded in zip(doc_ids, enc.encode(texts), strict=True):
                ids.append(np.concatenate([coded, end]))
                docs.append(doc_id)
                held += len(ids[-1])
                if held >= shard_ids:
                    yield shard()
                    seq, ids, docs, held = seq + 1, [], [], 0
        if docs:
            yield shard()

    # The encoder stays for the worker's next task: its size is bounded by CACHED and the tokenizer's definition.
    return tidied(run)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Rows in chunks of CHUNK characters at most or one row, across batches: an encoder splits each at once."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            said = text.as_py() or ""
            if texts and size + len(said) > CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(said)
            size += len(said)
    if ids:
        yield ids, texts


def shards(docs: DataFrame, definition: str, shard_ids: int = SHARD_IDS) -> Table:
    """Encode docs (doc_id, text) in ascending doc_id order, nulls first, into shards: one row (part, seq, file) each.

    The rows (part, seq) order the shards. They go through Spark's committed writer to the shared folder, so a task
    that runs again leaves nothing twice; `write` makes lasting files of them. Null texts are empty; every document ends
    with id 0; rows that repeat a doc_id follow each other in the order of their texts' hashes and may be dealt to
    several tasks; no row, no shard.
    """
    prepare(docs.sparkSession)
    keys = ["doc_id", "key"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return Table(ordered.select("doc_id", "text").mapInArrow(_sharder(definition, shard_ids), SHARDS), "wavelet")


INDEX = "name string, part int, seq int, n_docs long, n_tokens long, start long"


def _name(part: int, seq: int) -> str:
    return f"shard-{part:06d}-{seq:06d}.wvmx"


def _saver(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystems.FileSystem.from_uri(path)
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                attempt = f"{folder}/.{_name(part, seq)}.{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(attempt) as out:
                    out.write(batch.column(2)[i].as_buffer())
                fs.move(attempt, f"{folder}/{_name(part, seq)}")
            yield batch.select([0, 1])

    return run


def write(docs: DataFrame, definition: str, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Leave the shards of docs as files below path, a URI of a file system that pyarrow knows, and return their index.

    The index (name, part, seq, n_docs, n_tokens, start: the ids of all shards before) is written last, as the Parquet
    table `index` beside the files: a folder with an index is complete. Files come from committed rows and are moved
    to their names when whole, so a repeated task leaves the same files. A folder that has an index is refused.
    """
    spark = docs.sparkSession
    uri = path if "://" in path else f"file://{os.path.abspath(path)}"
    fs, folder = filesystems.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{folder}/index").type != filesystems.FileType.NotFound:
        raise FileExistsError(f"{path} has an index already")
    fs.create_dir(folder)
    held = shards(docs, definition, shard_ids)
    held.df.select("part", "seq", "file").mapInArrow(tidied(_saver(uri)), "part int, seq int").write.format("noop").mode("overwrite").save()
    name = F.format_string("shard-%06d-%06d.wvmx", "part", "seq")
    index = _started(held.df).select(name.alias("name"), "part", "seq", "n_docs", "n_tokens", "start")
    index.write.parquet(f"{uri}/index")
    held.release()
    return spark.read.schema(INDEX).parquet(f"{uri}/index")


def open_shard(path: str, name: str) -> Shard:
    """A file of a folder that `write` made, read by the ranges that questions need."""
    fs, folder = filesystems.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return Shard(fs.open_input_file(f"{folder}/{name}"))


READ = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            shard = load(batch.column(2)[i].as_py())
            docs = shard.docs
            ids, lengths = shard.ids(), docs["n_tokens"].to_numpy()
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
            here = [pa.array(np.full(len(lengths), batch.column(k)[i].as_py(), np.int32)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*here, docs["doc_id"].combine_chunks(), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def _started(table: DataFrame) -> DataFrame:
    """The shards with `start`, the ids of all before: first within each part, then over one row a part."""
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = table.select("part", "seq", "n_docs", "n_tokens", inner.alias("inner"))
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # A row for each task of the encoding: as many as the shuffle has partitions.
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return each.join(before, "part").select("part", "seq", "n_docs", "n_tokens", (F.col("before") + F.col("inner")).alias("start"))


def read(table: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all read back from the shards' files."""
    prepare(table.sparkSession)
    rows = table.select("part", "seq", "file").mapInArrow(tidied(_reader), READ)
    return rows.join(_started(table).select("part", "seq", F.col("start").alias("first")), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, definition: str) -> DataFrame:
    return read(shards(docs, definition).df)
