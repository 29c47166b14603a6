"""Token ids as binary shards: one wavelet matrix a file, with rank and select.

A shard holds the ids of consecutive documents (ascending doc_id) as bit planes, top bit
first; each plane is stably sorted by the bits above.  From one file it answers:
the id at a position, how often an id occurs before a position, and where it occurs for the k-th time.

File (little endian): magic ``WMTX1``; then length-prefixed zstd frames: header
(tokens, documents, bits), the documents' ids, null flags and ends as 64-bit numbers, and for
each plane its zero count, the ones before each block, and blocks of 2**17 bits that are
compressed one by one, so that a look-up opens a block for each plane and no more.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import shared_folder, stored, text_of
from ledgerlark.llm.tokens import encoder, groups_of_texts

MAGIC = b"WMTX1"
BLOCK = 1 << 17
#: Ids that a shard is closed after (the last document is kept whole).
SHARD_TOKENS = 1 << 21


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def to_bytes(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of one shard; *ends*: where each document's ids end."""
    pack = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    frames = [pack(struct.pack("<qqq", len(ids), len(doc_ids), bits)), pack(doc_ids.astype("<i8").tobytes()), pack(nulls.astype(np.uint8).tobytes()), pack(ends.astype("<i8").tobytes())]
    for b in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << b)) != 0
        packed = np.packbits(one, bitorder="little")
        raw = packed.tobytes()
        blocks = [pack(raw[i:i + BLOCK // 8]) for i in range(0, len(raw), BLOCK // 8)]
        ones = np.array([np.bitwise_count(packed[i:i + BLOCK // 8]).sum(dtype=np.int64) for i in range(0, len(packed), BLOCK // 8)], np.int64)
        frames += [pack(struct.pack("<qq", len(ids) - int(ones.sum()), len(blocks))), pack(np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes()), *blocks]
        x = x[np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])]
    return MAGIC + b"".join(struct.pack("<I", len(f)) + f for f in frames)


class Shard:
    """Answers from the bytes of one file."""

    def __init__(self, data: bytes) -> None:
        if data[:5] != MAGIC:
            raise ValueError("not a shard file")
        self._open = zstandard.ZstdDecompressor().decompress
        frames, at = [], 5
        while at < len(data):
            size = struct.unpack_from("<I", data, at)[0]
            frames.append(data[at + 4:at + 4 + size])
            at += 4 + size
        self.n, docs, self.bits = struct.unpack("<qqq", self._open(frames[0]))
        self.doc_ids = np.frombuffer(self._open(frames[1]), "<i8")
        self.nulls = np.frombuffer(self._open(frames[2]), np.uint8).astype(bool)
        self.ends = np.frombuffer(self._open(frames[3]), "<i8")
        self._planes, k = [], 4
        for _ in range(self.bits):
            zeros, blocks = struct.unpack("<qq", self._open(frames[k]))
            self._planes.append((zeros, np.frombuffer(self._open(frames[k + 1]), "<i8"), frames[k + 2:k + 2 + blocks]))
            k += 2 + blocks
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._cache:
            if len(self._cache) > 256:
                self._cache.clear()
            self._cache[level, k] = np.unpackbits(np.frombuffer(self._open(self._planes[level][2][k]), np.uint8), bitorder="little")
        return self._cache[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones before position *i* of a plane."""
        k, rest = divmod(i, BLOCK)
        before = int(self._planes[level][1][k])
        return before + int(self._block(level, k)[:rest].sum()) if rest else before

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            ones = self._ones(level, i)
            i = self._planes[level][0] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of *token* before position *i*."""
        if token >> self.bits:
            return 0
        low, high = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = self._planes[level][0] + a, self._planes[level][0] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the *k*-th (from 0) *bit* in a plane."""
        before = self._planes[level][1]
        seen = before if bit else np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(seen, k, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(level, block)[:self.n - block * BLOCK] == bit)[k - int(seen[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the *k*-th (from 0) occurrence of *token*."""
        if k >= self.count(token):
            raise IndexError("fewer occurrences")
        low = 0
        for level in range(self.bits):
            ones = self._ones(level, low)
            low = self._planes[level][0] + ones if token >> (self.bits - 1 - level) & 1 else low - ones
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self._planes[level][0] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            zeros, _, blocks = self._planes[level]
            one = np.unpackbits(np.frombuffer(b"".join(map(self._open, blocks)), np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~one] = x[:zeros]
            up[one] = x[zeros:] | kind(1 << (self.bits - 1 - level))
            x = up
        return x


def _write(folder: str, end: int, path: str | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _store(folder)
        where.create_dir(base, recursive=True)
        part, nth = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth, held, docs
            ids, names, nulls, sizes = np.concatenate(held), *(np.concatenate([d[k] for d in docs]) for k in range(3))
            # each attempt has files of its own; the rows of the attempt that succeeds name the valid ones
            name = f"{base}/part-{part:06d}-{nth:06d}-{uuid.uuid4().hex}.wm"
            with where.open_output_stream(name) as out:
                out.write(to_bytes(ids, names, nulls, np.cumsum(sizes)))
            row = pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "file": [name], "docs": [len(names)], "tokens": [len(ids)]},
                                             pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            nth, held, docs = nth + 1, [], []
            return row

        for batch in batches:
            nulls = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            for first, last, texts in groups_of_texts(batch.column("text"), min(1 << 20, most)):
                flat, counts = encoder(path).encode(texts)
                held.append(np.insert(flat, np.cumsum(counts), end))
                docs.append((ids[first:last], nulls[first:last], counts + 1))
                if sum(map(len, held)) >= most:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer_path: str | None = None, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, append *end_id* to each, and write shards in ascending id order: a table
    ``part, nth, file, docs, tokens, first`` (the ids in all shards before) in the order of (part, nth).

    A null text is empty, a null id comes first, repeated rows are written as often as they
    are there, an empty table writes no file, other columns are ignored.  The default *folder*
    is a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = stored(ranged.mapInArrow(_write(folder, end_id, tokenizer_path, shard_tokens), "part long, nth long, file string, docs long, tokens long"))
    # one row for each shard, not for documents
    order = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return stored(shards.withColumn("first", F.coalesce(F.sum("tokens").over(order), F.lit(0))))


def _read(store_like: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _store(store_like)
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                with where.open_input_stream(file) as stream:
                    shard = Shard(stream.read())
                ids = shard.decode().astype("<u4")
                sizes = np.diff(shard.ends, prepend=0)
                raw, starts = memoryview(ids).cast("B"), shard.ends - sizes
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist())]
                columns = [pa.array(shard.doc_ids, mask=shard.nulls), pa.array(first + starts), pa.array(sizes), pa.array(np.array(crc, np.int64))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, shard.ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run


def read_shards(shards: DataFrame, *, with_ids: bool = True) -> DataFrame:
    """Per document of the files that :func:`write_shards` lists: ``doc_id, start, n_tokens, ids_crc32`` and its ``ids``."""
    many = shards.count()
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not many:
        return shards.sparkSession.createDataFrame([], kind)
    return shards.select("file", "first").repartition(many).mapInArrow(_read(shared_folder(shards.sparkSession), with_ids), kind)


def _ask(store_like: str, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _store(store_like)
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                with where.open_input_stream(file) as stream:
                    shard = Shard(stream.read())
                found = [first + shard.select(token, k) for k in range(shard.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["position"])

    return run


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``position`` of every occurrence of a token id, looked up in the files without decoding them."""
    return shards.select("file", "first").repartition(max(1, shards.count())).mapInArrow(_ask(shared_folder(shards.sparkSession), token), "position long")
