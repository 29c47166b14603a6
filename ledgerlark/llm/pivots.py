"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest reference points ("pivots"), in order of nearness;
that prefix of its permutation is all the index knows.  The inverted lists are kept for
triples of pivots: two vectors meet in a list exactly when they share at least
three of their nearest pivots, so the shared-pivot count is the retrieval rule, and lists
stay short (with 512 pivots there are 22 million triples for each label).  What
meets is verified by its cosine in double precision, once: in the list of the
first three pivots that a pair shares.

A list of any length is cut into chunks and pairs of chunks, tasks of their own;
inside one, links are counted and joined to a local component, so a group of mutual
neighbours gives a few rows for each member and never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import mix, signed, stored
from ledgerlark.llm.components import components

#: Reference points, nearest ones kept, rows in a chunk of a list.
PIVOTS, NEAREST, CHUNK = 512, 10, 512
#: Vectors in the bounded sample that reference points are taken from, and the cosine that no two of them reach.
SAMPLE, APART = 4 * PIVOTS, 0.6
_TRIPLES = np.array(list(combinations(range(NEAREST), 3)))


def _unit(flat: np.ndarray, width: int) -> np.ndarray:
    x = flat.reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each vector width in the batch."""
    column = batch.column("embedding")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, _unit(column.take(pa.array(rows)).flatten().to_numpy(), int(width))


def _apart(unit: np.ndarray) -> np.ndarray:
    """Points of *unit*, in order, that are not close to an earlier one: a dense group gives one, or its
    members would fill each other's permutations with near ties."""
    kept: list[int] = []
    near = unit @ unit.T >= APART
    for i in range(len(unit)):
        if len(kept) < PIVOTS and not near[i, kept].any():
            kept.append(i)
    return unit[kept]


def _describe(sample: dict[int, np.ndarray]):
    full: dict[int, np.ndarray] = {}

    def pivots_for(width: int) -> np.ndarray:
        """The sampled reference points, filled up with random directions."""
        if width not in full:
            x = np.random.default_rng(width).standard_normal((PIVOTS, width))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            full[width] = np.concatenate([sample.get(width, x[:0]), x])[:PIVOTS]
        return full[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                for rows, unit in _by_width(batch):
                    near = np.argsort(-(unit @ pivots_for(unit.shape[1]).T), axis=1, kind="stable")[:, :NEAREST].astype(np.int16)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, NEAREST, dtype=np.int32)), pa.array(near.reshape(-1)))],
                        ["node", "near"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each triple of a vector's nearest pivots."""
    for whole in batches:
        for i in range(0, whole.num_rows, 2000):
            batch = whole.slice(i, 2000)
            near = np.sort(batch.column("near").flatten().to_numpy().reshape(-1, NEAREST).astype(np.int64), axis=1)
            t = near[:, _TRIPLES]
            t = (t[..., 0] << 40) | (t[..., 1] << 20) | t[..., 2]
            key = mix(mix(batch.column("room").to_numpy().view(np.uint64), 9)[:, None] + t.astype(np.uint64), 4)
            nodes = np.repeat(batch.column("node").to_numpy(), t.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(signed(key.reshape(-1))), pa.array(t.reshape(-1)), pa.array(nodes)], ["key", "triple", "node"])


def _local_components(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == label).all():
            return label
        label = new


def _linked(group: dict[str, np.ndarray], vectors: np.ndarray, near: np.ndarray, cosine: float) -> np.ndarray:
    """Which members are linked, each pair only in the list of its first three shared pivots."""
    triple = int(group["triple"][0])
    t = [triple >> 40, (triple >> 20) & 0xFFFFF, triple & 0xFFFFF]
    linked = vectors @ vectors.T >= cosine
    np.fill_diagonal(linked, False)
    earlier = np.zeros((len(near), PIVOTS), np.float32)
    np.put_along_axis(earlier, near.astype(np.int64), 1, axis=1)
    earlier = np.delete(earlier[:, :t[2]], t[:2], axis=1)
    linked &= (earlier @ earlier.T) == 0
    low, high = group["lo"][0], group["hi"][0]
    if low != high:
        linked &= group["chunk"][:, None] != group["chunk"][None, :]
    return linked


def _verify(cosine: float):
    names = ["key", "lo", "hi", "chunk", "triple", "node", "vec_id", "copies"]

    def finish(group: dict[str, np.ndarray], vectors: np.ndarray, near: np.ndarray, out: list) -> None:
        linked = _linked(group, vectors, near, cosine)
        some = linked.any(axis=1)
        if some.any():
            label = _local_components(linked, group["vec_id"])
            out.append((group["node"][some], (linked[some] * group["copies"][None, :]).sum(axis=1), group["vec_id"][some], label[some]))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by (key, lo, hi); a group may go on in the next batch."""
        carry: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from _work(table if carry is None else pa.concat_tables([carry, table]), False, keep := [])
            carry = keep[0]
        if carry is not None and carry.num_rows:
            yield from _work(carry, True, [])

    def _work(table: pa.Table, last: bool, keep: list) -> Iterator[pa.RecordBatch]:
        cols = {n: table.column(n).to_numpy() for n in names}
        n = table.num_rows
        new = np.ones(n, bool)
        new[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["lo"][1:] != cols["lo"][:-1]) | (cols["hi"][1:] != cols["hi"][:-1])
        cuts = np.append(np.flatnonzero(new), n)
        done = n if last else int(cuts[-2])
        keep.append(table.slice(done))
        near = np.stack(table.column("near").combine_chunks().flatten().to_numpy().reshape(n, NEAREST)) if n else np.zeros((0, NEAREST))
        embedding = table.column("embedding").combine_chunks()
        sizes = embedding.value_lengths().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = embedding.flatten().to_numpy()
        out: list = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b <= done and b - a > 1:
                finish({k: v[a:b] for k, v in cols.items()}, _unit(flat[at[a]:at[b]], int(sizes[a])), near[a:b], out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(4)], ["node", "links", "a", "b"])

    return groups


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """Per row of *vectors*: ``vec_id, n_links, component_id, kept``.

    Vectors with equal labels are linked when their cosine is at least *cosine*; ``n_links``
    counts the other vectors linked directly, the component is the smallest vec_id reachable.
    Pairs that share fewer than three of their ten nearest pivots are not found (below one
    in a hundred at cosine 0.93, next to none above 0.95).

    Null, empty, zero vectors, those with null or non-finite components, and rows with a null
    label or id are linked with nothing.  Vectors of different widths are never linked.  Equal
    vectors are one node with a weight; a repeated row counts once and comes back as often as
    it is there.  An empty table gives an empty table; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = stored(rows.withColumn("embedding", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.transform("embedding", lambda x: x + F.lit(0.0)))))
    valid = rows.filter("embedding IS NOT NULL")
    copies = valid.distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = stored(copies.withColumn("node", F.monotonically_increasing_id()).withColumn("room", F.xxhash64("label", F.size("embedding"))))
    sample: dict[int, list] = {}
    for r in nodes.select("embedding").orderBy(F.xxhash64("node", F.lit(3))).limit(SAMPLE).collect():  # the bounded sample
        sample.setdefault(len(r["embedding"]), []).append(r["embedding"])
    fitted = {k: _apart(_unit(np.array(v), k)) for k, v in sample.items()}
    described = stored(nodes.select("node", "embedding").mapInArrow(_describe(fitted), "node long, near array<short>").join(nodes.select("node", "room"), "node"))
    lists = described.mapInArrow(_lists, "key long, triple long, node long")
    lists = stored(lists.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1"))
    chunks = F.ceil(F.col("c") / CHUNK)
    chunk = F.pmod(F.xxhash64("node"), chunks)
    pieces = lists.withColumns({"chunks": chunks, "chunk": chunk}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pieces = pieces.select("key", "triple", "node", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk")
    full = pieces.join(described.select("node", "near"), "node").join(nodes.select("node", "vec_id", "copies", "embedding"), "node")
    found = stored(full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_verify(cosine), "node long, links long, a long, b long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b"))
    named = nodes.join(links, "node", "left").select("label", "embedding", F.col("vec_id").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = named.join(labels, F.col("least") == F.col("node"), "left").select("label", "embedding", "links", F.coalesce("component", "least").alias("component"))
    out = rows.join(named, ["label", "embedding"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
