"""Substring dedup on sliding spans of sentences.

A sentence ends at a word that ends in ``.``, ``!`` or ``?``, at a line end, or with the text.  A span is a run of
consecutive sentences that is just long enough: three or more with 20 words, or fewer that
have 30 words by themselves.  From every sentence the shortest such run forwards and the shortest
backwards is hashed.  All spans of all documents meet by hash; sentences covered by a span that occurred
before (in a smaller doc_id, or earlier in the text) are removed.

The first place of each hash is an aggregate, so copies meet on the map side.  Spans then look up their
hash's first place; a hash that holds more than one in SPLITS of all repeated spans (a line that a
third of all documents have) is looked up in as many parts, so no task gets its rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, _power_tables, mix, signed, slices, span_hashes, stored, text_of, words

SENTENCES, FEW_WORDS, MANY_WORDS = 3, 20, 30
#: No part of a look-up holds more than this fraction (one in ...) of the repeated spans.
SPLITS = 2000
_STOPS = np.zeros(256, bool)
_STOPS[np.frombuffer(b".!?", np.uint8)] = True


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """First words of the sentences (and the number of words at the end), their rows, the words' first bytes, and the words."""
    starts, ends, row = words(data, at)
    n = len(starts)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), starts, (starts, ends, row)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    last = _STOPS[data[ends - 1]]
    last[:-1] |= (breaks[starts[1:]] > breaks[ends[:-1]]) | (row[1:] != row[:-1])
    last[-1] = True
    first = np.concatenate([[0], np.flatnonzero(last) + 1])
    return first, row[first[:-1]], starts, (starts, ends, row)


def spans(first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) sentence of the shortest spans forwards and backwards."""
    n = len(row)
    i = np.arange(n)
    ends = np.minimum(np.maximum(i + SENTENCES - 1, np.searchsorted(first, first[:-1] + FEW_WORDS) - 1), np.searchsorted(first, first[:-1] + MANY_WORDS) - 1)
    begins = np.maximum(np.minimum(i - SENTENCES + 1, np.searchsorted(first, first[1:] - FEW_WORDS, "right") - 1), np.searchsorted(first, first[1:] - MANY_WORDS, "right") - 1)
    a, b = np.concatenate([i, begins]), np.concatenate([ends, i])
    ok = (a >= 0) & (b < n)
    a, b = a[ok], b[ok]
    ok = row[a] == row[b]
    pair = np.unique(a[ok] * (n + 1) + b[ok])
    return pair // (n + 1), pair % (n + 1)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, check = batch.column("doc_id"), batch.column("check").to_numpy()
        for lo, _, data, at in slices(batch.column("text")):
            first, row, _, (starts, ends, _) = sentences(data, at)
            if not len(row):
                continue
            h = span_hashes(LOWER[data], starts, ends)
            power, inverse = _power_tables(len(h))
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, 21) * power[:len(h)], dtype=np.uint64)])
            a, b = spans(first, row)
            size = first[b + 1] - first[a]
            value = mix((run[first[b + 1]] - run[first[a]]) * inverse[first[a]], 23) + size.astype(np.uint64)
            begin = np.searchsorted(row, row[a])  # number of the row's first sentence
            where = ((a - begin) << 32) | check[lo + row[a]]
            yield pa.RecordBatch.from_arrays([pa.array(signed(value)), ids.take(pa.array(lo + row[a])), pa.array(where), pa.array((b - a + 1).astype(np.int32))], ["h", "doc_id", "place", "n"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cuts = batch.column("cuts").to_pylist()
        for lo, hi, data, at in slices(batch.column("text")):
            first, row, starts, _ = sentences(data, at)
            bounds = np.searchsorted(row, np.arange(hi - lo + 1))
            texts, total, gone = [], [], []
            for k in range(hi - lo):
                a, b = bounds[k], bounds[k + 1]
                drop = np.zeros(b - a + 1, np.int64)
                for c in cuts[lo + k] or ():
                    drop[c["i"]] += 1
                    drop[c["i"] + c["n"]] -= 1
                drop = np.cumsum(drop)[:-1] > 0
                raw = data[at[k]:at[k + 1]]
                if drop.any():
                    edge = np.append(starts[first[a:b]], at[k + 1]) - at[k]
                    keep = np.ones(len(raw), bool)
                    for s in np.flatnonzero(drop):
                        keep[edge[s]:edge[s + 1]] = False
                    raw = raw[keep]
                texts.append(raw.tobytes().decode())
                total.append(b - a)
                gone.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array(np.array(total, np.int64)), pa.array(np.array(gone, np.int64))],
                                             ["doc_id", "text", "n_sentences", "n_removed"])


def _later(found: DataFrame) -> DataFrame:
    """The spans of *found* that are not at the first place of their hash."""
    place = F.struct("doc_id", "place")
    repeats = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows"))
    repeats = stored(repeats.filter(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first", "rows"))
    total = repeats.agg(F.sum("rows")).first()[0] or 1
    repeats = repeats.select("h", "first", F.ceil(F.col("rows") * SPLITS / total).alias("parts"))
    # hashes of more than one part are fewer than SPLITS, and their parts fewer than twice SPLITS
    hot = F.broadcast(repeats.filter("parts > 1").select("h", "parts"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")), F.lit(0)).alias("part")
    asked = found.join(hot, "h", "left").select("h", "doc_id", "place", "n", part)
    held = repeats.select("h", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return asked.join(held, ["h", "part"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "place", "n")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of *docs*: ``doc_id, text`` without repeated sentences, ``n_sentences, n_removed``.

    Letters A-Z and white space do not matter for equality.  Null texts are empty ones and come back
    empty; texts shorter than a span stay.  A null id counts as the smallest.  Rows with equal id and
    text are one document and stay alike; each row comes back.  An empty table gives an empty
    table; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("check", F.crc32("text"))
    found = docs.mapInArrow(_hashed, "h long, doc_id long, place long, n int")
    cuts = _later(found).select("doc_id", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("check"), F.struct(F.shiftright("place", 32).cast("int").alias("i"), "n").alias("cut"))
    cuts = stored(cuts.distinct().groupBy("doc_id", "check").agg(F.collect_list("cut").alias("cuts")))  # bounded by the document
    cuts = cuts.select(F.col("doc_id").alias("id"), F.col("check").alias("sum"), "cuts")
    out = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("check") == F.col("sum")), "left")
    return out.select("doc_id", "text", "cuts").mapInArrow(_without, "doc_id long, text string, n_sentences long, n_removed long")
