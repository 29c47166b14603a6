"""Near-duplicate documents: MinHash with tensored banding, every candidate confirmed on its whole set.

Classical banding needs ``tables * width`` minhashes.  Here two collections of ``half``
half keys, each of ``width`` minhashes, are drawn, and table (i, j) is keyed by the pair
(left half key i, right half key j): ``half**2`` tables from ``2 * half * width`` minhashes.
With 12 halves of 2, two sets of similarity 0.8 meet in no table with probability 1e-5.

How the work is dealt out
-------------------------
1. Equal sets collapse to the smallest doc_id (a grouped minimum), so exact copies cost one node.
2. Key rows of 16 bytes are counted per key; rows alone in their key go.  A group of copies
   that makes up a third of all rows fills one key per table, so a key holds at most
   1 / (3 * half**2) of the key rows.
3. Every node is tried against one hub: the best connected node of all its keys.
   Confirmed pairs become components; a key inside one component is finished.
4. Nodes around one hub that are not linked with it are compared with all nodes around it, in blocks
   of bounded size that give one link for each such node; the linked nodes are not compared with each other.
5. Nodes of different components and hubs that share a key are paired, unless their
   sizes or their 64-bit sketches rule a link out.

Tables with a row for each node, pair or key are joined by merging.  Their Parquet files are several
times smaller than the rows, and an explode counts for nothing in the planner's estimate, so a
broadcast by that estimate gathers in the driver what grows with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import LOWER, mix, run_hashes, signed, slices, span_hashes, stored, text_of, words
from ledgerlark.llm.components import components

HALF, WIDTH = 12, 2
#: Minhashes of the 64-bit sketch: the 48 of the keys and 16 more.
SKETCH = 64
#: Differing sketch bits up to which a pair may have similarity 0.8 (mean 6.4; more than 20 in two of a million).
FAR = 20
#: Nodes in a side of a block.
BLOCK = 128


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_731)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; fewer words than *size* make one shingle, none an empty set."""
    for first, last, data, at in slices(column):
        data = LOWER[data]
        starts, ends, row = words(data, at)
        h = span_hashes(data, starts, ends)
        runs, where = run_hashes(h, row, size)
        bounds = np.searchsorted(row[where], np.arange(last - first + 1))
        per_row = np.searchsorted(row, np.arange(last - first + 1))
        for i in range(last - first):
            if bounds[i + 1] > bounds[i]:
                x = np.sort(runs[bounds[i]:bounds[i + 1]])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield first + i, x[keep]
            elif per_row[i + 1] > per_row[i]:
                few = h[per_row[i]:per_row[i + 1]]
                yield first + i, run_hashes(few, np.zeros(len(few), np.int64), len(few))[0]
            else:
                yield first + i, np.zeros(0, np.uint64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, odd = _salts(SKETCH)
        for batch in batches:
            ids = batch.column("doc_id")
            rows, sets = [], []

            def flush():
                sizes = np.array([len(s) for s in sets], np.int64)
                full = sizes > 0
                one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                sig = np.zeros((len(sets), SKETCH), np.uint32)
                if full.any():
                    flat = np.concatenate(sets)
                    cuts = (np.cumsum(sizes) - sizes)[full]
                    one[full] = np.add.reduceat(mix(flat, 0xA5A5), cuts)
                    two[full] = np.add.reduceat(mix(flat, 0xC3C3C3), cuts)
                    x = (flat >> np.uint64(32)).astype(np.uint32)
                    for k in range(SKETCH):
                        v = (x ^ salt[k]) * odd[k]
                        sig[full, k] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), cuts)
                bits = (mix(sig.astype(np.uint64), 77) & np.uint64(1)) << np.arange(SKETCH, dtype=np.uint64)
                raw = np.ascontiguousarray(sig[:, :2 * HALF * WIDTH]).tobytes()
                step = 8 * HALF * WIDTH
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(sizes), pa.array(signed(one)), pa.array(signed(two)), pa.array(signed(np.bitwise_or.reduce(bits, axis=1))),
                     pa.array([raw[i * step:(i + 1) * step] for i in range(len(sets))], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch", "sig"])

            held = 0
            for row, found in shingle_sets(batch.column("text"), size):
                rows.append(row)
                sets.append(found)
                held += len(found) + 50
                if held > 300_000:
                    yield flush()
                    rows, sets, held = [], [], 0
            if rows:
                yield flush()

    return run


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            batch = whole.slice(i, 500)
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, 2, HALF, WIDTH).astype(np.uint64)
            half = np.zeros((n, 2, HALF), np.uint64)
            for w in range(WIDTH):
                half = mix(half * np.uint64(0x2545F4914F6CDD1D) + sig[..., w], w + 11)
            half += np.arange(2 * HALF, dtype=np.uint64).reshape(2, HALF) * np.uint64(0x9E3779B97F4A7C15)
            keys = mix(mix(half[:, 0, :, None], 3) + half[:, 1, None, :], 5)
            nodes = np.repeat(batch.column("node").to_numpy(), HALF * HALF)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.reshape(-1))), pa.array(nodes)], ["key", "node"])


def _as_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows, sets, held = [], [], 0
            for row, found in shingle_sets(batch.column("text"), size):
                rows.append(row)
                sets.append(found)
                held += len(found)
                if held > 300_000 or row == batch.num_rows - 1:
                    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    flat = pa.array(signed(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(cuts), flat)], ["doc_id", "members"])
                    rows, sets, held = [], [], 0

    return run


def _sets_of(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The whole sets of the documents whose ids *nodes* lists (column ``doc_id``)."""
    return stored(docs.join(nodes.distinct(), "doc_id", "left_semi").mapInArrow(_as_sets(size), "doc_id long, members array<long>"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate *pairs* (a, b), those whose whole sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return stored(pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").filter(100 * both >= percent * either).select("a", "b"))


def _overlaps(table: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, probes by table."""
    flat, owner = np.concatenate(table), np.repeat(np.arange(len(table)), [len(t) for t in table])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(probes), len(table)), np.int64)
    for i, p in enumerate(probes):
        low, high = np.searchsorted(flat, p), np.searchsorted(flat, p, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out[i] = np.bincount(owner[at], minlength=len(table))
    return out


def _blocks(percent: int):
    def links(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """One link for each ``out`` member: to the hub if its links lead to a node linked with the hub, else to its smallest."""
        probe, out, ids = (group.column(c).to_numpy() for c in ("probe", "out", "node"))
        sets = [np.asarray(x) for x in group.column("members").to_numpy()]
        p, t = np.flatnonzero(probe), np.flatnonzero(~probe)
        if not len(p) or not len(t):
            return ids[:0], ids[:0]
        sizes = np.array([len(x) for x in sets])
        both = _overlaps([sets[i] for i in t], [sets[i] for i in p])
        linked = (100 * both >= percent * (sizes[p][:, None] + sizes[t][None, :] - both)) & (ids[p][:, None] != ids[t][None, :])
        first, at = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # below and above every id: the hub's own component, and none
        one, two = ids[p].copy(), np.where(out[t], ids[t], first)
        while True:  # the smallest label spreads along the links
            new_one = np.minimum(one, np.where(linked, two[None, :], at).min(axis=1))
            new_two = np.minimum(two, np.where(linked, new_one[:, None], at).min(axis=0))
            if (new_one == one).all() and (new_two == two).all():
                break
            one, two = new_one, new_two
        node, label = np.concatenate([ids[p], ids[t][out[t]]]), np.concatenate([one, two[out[t]]])
        label = np.where(label == first, int(group.column("hub")[0].as_py()), label)
        return node[label != node], label[label != node]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (hub, t, p); a group may go on in the next batch."""
        carry = None
        for batch in _with_end(batches):
            table = carry if batch is None else pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            keys = np.stack([table.column(c).to_numpy() for c in ("hub", "t", "p")])
            cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), table.num_rows)
            done = len(cuts) - 1 if batch is None else len(cuts) - 2
            for k in range(done):
                a, b = links(table.slice(cuts[k], cuts[k + 1] - cuts[k]))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            carry = table.slice(cuts[done])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _around_hubs(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the nodes of *around* (``hub, node, out``) that are ``out`` with all they reach around the same hub.

    All pairs are compared, but a block gives one link for each of its ``out`` members, most of them the same one to the hub.
    """
    counts = around.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("ts"), F.ceil(F.count_if("out") / BLOCK).alias("ps")).filter("ps > 0")
    around = stored(around.join(counts, "hub"))
    t, p = F.pmod(F.xxhash64("node"), F.col("ts")), F.pmod(F.xxhash64("node", F.lit(7)), F.col("ps"))
    every = [F.sequence(F.lit(0).cast("long"), F.col(c) - 1) for c in ("ts", "ps")]
    rows = (around.select("hub", "node", "out", F.lit(False).alias("probe"), t.alias("t"), F.explode(every[1]).alias("p"))
            .unionByName(around.filter("out").select("hub", "node", "out", F.lit(True).alias("probe"), F.explode(every[0]).alias("t"), p.alias("p"))))
    full = rows.hint("merge").join(sets.withColumnRenamed("doc_id", "node"), "node")
    return stored(full.repartition("hub", "t", "p").sortWithinPartitions("hub", "t", "p").mapInArrow(_blocks(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of *docs*: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct *shingle*-word runs (A-Z lower-cased; fewer words make one run; *percent* at
    least 80).  The component is the smallest doc_id reachable.

    Null and wordless texts have an empty set and are linked with nothing.  A null id comes
    back with a null component and is kept.  Rows that repeat an id are one document, linked
    by any of their texts; each row comes back.  An empty table gives an empty table; other
    columns are ignored, whatever their names.
    """
    if percent < 80:
        raise ValueError("the tables are laid out for similarities of 0.8 and more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    drawn = stored(docs.mapInArrow(_sketches(shingle), "doc_id long, n_shingles long, f1 long, f2 long, sketch long, sig binary"))
    full = drawn.filter("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = stored(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("sig").alias("sig")))
    keys = nodes.mapInArrow(_table_keys, "key long, node long")
    shared = stored(keys.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1"))

    # one trial for each node: against the best connected node that shares a key with it
    degree = shared.groupBy("node").agg(F.sum("c").alias("degree"))
    ranked = shared.select("key", "node").join(degree, "node").select("key", "node", F.struct("degree", (-F.col("node")).alias("minus")).alias("rank"))
    hubs = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
    trials = stored(ranked.join(hubs, "key").filter(F.col("hub.minus") != -F.col("node")).groupBy("node").agg(F.max("hub").alias("hub"))
                    .select("node", (-F.col("hub.minus")).alias("hub")))
    pairs = trials.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # every node compared below shares a key, so this is the only time that texts are looked up
    sets = _sets_of(shared.select(F.col("node").alias("doc_id")), docs, shingle)
    links = _confirmed(pairs, sets, percent)
    near = trials.join(links.select(F.col("a").alias("node"), F.lit(False).alias("out")).hint("merge"), "node", "left").withColumn("out", F.coalesce("out", F.lit(True)))
    links = links.unionByName(_around_hubs(near.select("hub", "node", "out"), sets, percent))
    first = components(links)

    # keys that still hold several components: pairs across them, if size and sketch allow
    held = shared.select("key", "node").join(first.hint("merge"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    told = nodes.select("node", F.col("n_shingles").alias("n"), "sketch").join(trials.hint("merge"), "node", "left").withColumn("hub", F.coalesce("hub", "node"))
    left = stored(held.join(mixed, "key", "left_semi").join(told, "node"))
    x, y = left.alias("x"), left.alias("y")
    cross = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & (F.col("x.hub") != F.col("y.hub"))
                   & (F.col("x.hub") != F.col("y.node")) & (F.col("x.node") != F.col("y.hub"))
                   & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
                   & (F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= FAR))
    cross = stored(cross.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct())
    links = links.unionByName(_confirmed(cross, sets, percent))

    # an id whose rows have several sets joins their nodes
    named = full.select("doc_id", "f1", "f2", "n_shingles").join(nodes.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"])
    named = stored(named.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")))
    found = components(links.unionByName(named.filter("node < other").select(F.col("other").alias("a"), F.col("node").alias("b"))))
    labels = named.join(found.hint("merge"), "node", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "node").alias("component"))
    out = drawn.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
