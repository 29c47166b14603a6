"""Sequence packing: shortest-pack-first over the histogram of lengths.

Texts longer than a sequence are cut into full pieces and a rest.  Only the histogram of
piece lengths (one count for each length up to the sequence's) reaches the driver.  Lengths
are placed longest first; a length goes to the packs with the fewest tokens, all packs with the
same pattern at once, so a pattern is a run of sequence numbers and splitting it
splits the run.  Every placement says which ranks of a length go to which run at
which offset; pieces are numbered within their length and look their placement up.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import stored, text_of
from ledgerlark.llm.tokens import encoder, groups_of_texts

#: Rows (of a partition number, a length and a count) up to which the ranks' offsets are broadcast.
BROADCAST_ROWS = 400_000


def placements(histogram: dict[int, int], sequence: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) of all placements, and the number of sequences in the last row.

    At most one pattern is split for each length, so there are at most two patterns for each
    length, whatever the counts.
    """
    out, packs, made = [], [], 0  # packs: (tokens in the pack, first sequence, number of sequences)
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if packs and packs[0][0] + length <= sequence:
                used, first, many = heapq.heappop(packs)
                taken = min(left, many)
                if taken < many:
                    heapq.heappush(packs, (used, first + taken, many - taken))
            else:
                used, first, taken = 0, made, left
                made += left
            out.append((length, rank, first, used))
            if used + length < sequence:
                heapq.heappush(packs, (used + length, first, taken))
            rank, left = rank + taken, left - taken
    return np.array([*out, (0, 0, made, 0)], np.int64)


def _cut(sequence: int, end: int, path: str | None, with_ids: bool, cache: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for first, last, texts in groups_of_texts(batch.column("text")):
                flat, counts = encoder(path).encode(texts, cache)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end).astype("<u4")
                total = counts + 1
                pieces = -(-total // sequence)
                doc = np.repeat(np.arange(last - first), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * sequence
                length = np.minimum(total[doc] - start, sequence)
                at = (np.cumsum(total) - total)[doc] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                rank = np.zeros(len(length), np.int64)
                order = np.argsort(length, kind="stable")
                new = np.append(True, np.diff(length[order]) != 0)
                begin = np.flatnonzero(new)
                sizes = np.diff(np.append(begin, len(order)))
                rank[order] = np.arange(len(order)) - np.repeat(begin, sizes) + seen[length[order]]
                seen[length[order][begin]] += sizes
                columns = [pa.array(np.where(null[first:last], 0, ids[first:last]).astype(np.int64)[doc], mask=null[first:last][doc]), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64)),
                           pa.array(total[doc]), pa.array(np.full(len(doc), part, np.int64)), pa.array(rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _look_up(before: np.ndarray, slots: np.ndarray):
    at = before[slots[:, 0]] + slots[:, 1]  # global rank of each placement's first piece
    order = np.argsort(at)
    at, first, offset = at[order], slots[order, 2], slots[order, 3]

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rank = before[length.to_numpy()] + rank.to_numpy()
        k = np.searchsorted(at, rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(first[k] + rank - at[k]), pa.array(offset[k])], ["sequence_id", "offset"])

    return place


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = True, cache: int | None = None) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, its ``ids``.

    Every text is encoded whole, *end_id* follows, and each id lies in exactly one piece of at
    most *sequence* ids.  ``offset`` is gapless from 0 in every sequence.

    A null text is an empty one: its piece is the end id.  A null id stays null.  Repeated rows
    are packed as often as they are there.  An empty table gives an empty table.  Other
    columns are ignored, whatever their names.  *cache*: pieces of text a Python worker holds with their ids.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long" + ", ids array<int>" * with_ids
    pieces = stored(docs.mapInArrow(_cut(sequence, end_id, tokenizer_path, with_ids, cache), kind))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most *sequence* rows
    before = np.zeros(sequence + 2, np.int64)
    for length, n in histogram.items():
        before[length + 1] = n
    slots = placements(histogram, sequence)[:-1]
    counts = counts.drop("n")
    if counts.count() <= BROADCAST_ROWS:  # 24 bytes a row; beyond that the planner joins as it sees fit
        counts = F.broadcast(counts)
    ranked = pieces.join(counts, ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    wanted = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    if not len(slots):
        return docs.sparkSession.createDataFrame([], kind)
    # a function of two numbers: the ids don't go through Python again
    return ranked.select(*wanted, _look_up(np.cumsum(before), slots)("length", "rank").alias("place")).select(*wanted, "place.sequence_id", "place.offset")
