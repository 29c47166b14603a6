"""A Merkle manifest of a dataset, folded from copied hash states.

A row is a leaf, rows of a source are a tree of runs of sixteen, and the sources' roots are a tree
of the same kind.  A parent's hash reads its children's digests one after the other; it retains a
copy of its state before each child slot.  What a changed child does to the root is then folded
upwards: the state before its slot goes on with the replacement and the right siblings only, the left
ones are never read again.

Trees are cut into blocks of 16**3 nodes, tasks of their own, so a source of any size is spread over
many tasks and three levels cost one shuffle of digests; texts stay in the stage that hashes them.
Block roots are the leaves of the next tier.  Proofs come down the same way: a block's path (its
siblings up to the root) is one row that meets the block's nodes, and the states of its ancestors
are made once a block and copied for each fold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import stored

FANOUT, LEVELS = 16, 3
#: Nodes that one task's tree starts from.
BLOCK = FANOUT**LEVELS
#: Rows of an output batch.
ROWS = 8192
_NODE = "key string, idx long, digest binary"


def row_digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the *values*: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in parts]), 256)


class Parent:
    """One run of children, with the state of the run's hash before each of them."""

    def __init__(self, children: list[str]) -> None:
        self.states, h = [], hashlib.sha256()
        for child in children:
            self.states.append(h.copy())
            h.update(child.encode())
        self.digest = h.hexdigest()
        self.text = "".join(children)

    def fold(self, slot: int, replacement: str) -> str:
        """The digest with another child at *slot*."""
        h = self.states[slot].copy()
        h.update((replacement + self.text[64 * (slot + 1):]).encode())
        return h.hexdigest()

    def others(self, slot: int) -> str:
        return self.text[:64 * slot] + self.text[64 * (slot + 1):]


class Ancestor:
    """The parent of a block's root or of a node above it, known by its slot and its other children."""

    def __init__(self, packed: bytes) -> None:
        slot, self.text = packed[0], packed[1:].hex()
        self.state = hashlib.sha256(self.text[:64 * slot].encode())
        self.right = self.text[64 * slot:]

    def fold(self, replacement: str) -> str:
        h = self.state.copy()
        h.update((replacement + self.right).encode())
        return h.hexdigest()


def climb(digests: list[str], levels: int | None = None) -> list[list[Parent]]:
    """The parents of *digests*, level by level, up to one node or through just as many *levels*."""
    out: list[list[Parent]] = []
    while len(digests) > 1 if levels is None else len(out) < levels:
        out.append([Parent(digests[i:i + FANOUT]) for i in range(0, len(digests), FANOUT)])
        digests = [p.digest for p in out[-1]]
    return out


def fold_proof(leaf: str, proof: list[bytes]) -> str:
    """The root that *leaf* (hex) leads to with the siblings of one ``proof`` of `manifest`."""
    for packed in proof:
        leaf = Ancestor(packed).fold(leaf)
    return leaf


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[str, int, list[tuple]]]:
    """(key, block, rows) of batches sorted by these."""
    rows = (row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True))
    for (key, block), group in groupby(rows, key=itemgetter(0, 1)):
        yield key, block, list(group)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _tree(block: int, digests: list[bytes]) -> list[list[Parent]]:
    """A later block always climbs its three levels; a first one that stands alone stops at one node."""
    return climb([d.hex() for d in digests], LEVELS if block else None)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each block: a node of the next tier."""
    def rows() -> Iterator[tuple]:
        for key, block, group in _blocks(batches, ["key", "block", "digest"]):
            tree = _tree(block, [r[2] for r in group])
            yield key, block, bytes.fromhex(tree[-1][0].digest) if tree else group[0][2]

    return _batches(rows(), pa.schema([("key", pa.string()), ("idx", pa.int64()), ("digest", pa.binary())]))


def _others(tree: list[list[Parent]], place: int) -> Iterator[tuple[Parent, int]]:
    """Parent and slot on the way up from a block's node."""
    for level in tree:
        place, slot = divmod(place, FANOUT)
        yield level[place], slot


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every node: its siblings in the block, then the block's own path, which comes first."""
    def rows() -> Iterator[tuple]:
        for key, block, group in _blocks(batches, ["key", "block", "idx", "digest", "path", "subroot"]):
            above, subroot = group[0][4], group[0][5]
            digests = [r[3] for r in group[1:]]
            tree = _tree(block, digests)
            for place, r in enumerate(group[1:]):
                yield key, r[2], r[3], [bytes([slot]) + bytes.fromhex(p.others(slot)) for p, slot in _others(tree, place)] + above, subroot

    return _batches(rows(), pa.schema([("key", pa.string()), ("idx", pa.int64()), ("digest", pa.binary()), ("path", pa.list_(pa.binary())), ("subroot", pa.binary())]))


def _proved(with_proof: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, block, group in _blocks(batches, ["key", "block", "digest", "new", "id", "path", "subroot"]):
                path, subroot = group[0][5], group[0][6].hex()
                above = [Ancestor(p) for p in path]
                tail = "".join(a.text for a in above)
                tree = _tree(block, [r[2] for r in group[1:]])
                shared: dict[int, str] = {}
                for place, (_, _, digest, new, id_, _, _) in enumerate(group[1:]):
                    way = list(_others(tree, place))
                    if place // FANOUT not in shared:  # what the children of one run have in common
                        shared = {place // FANOUT: "".join(p.others(s) for p, s in way[1:]) + tail}
                    proof = (way[0][0].others(way[0][1]) if way else "") + shared[place // FANOUT]
                    top = (new or digest).hex()
                    for parent, slot in way:
                        top = parent.fold(slot, top)
                    for a in above:
                        top = a.fold(top)
                    out = (id_, digest.hex(), subroot, hashlib.sha256(proof.encode()).hexdigest(), top)
                    yield (*out, [bytes([s]) + bytes.fromhex(p.others(s)) for p, s in way] + path) if with_proof else out

        first = next(batches, None)
        if first is not None:
            batches = chain([first], batches)
            fields = [("doc_id", first.schema.field("id").type), *[(n, pa.string()) for n in ("leaf", "subroot", "proof_sha256", "folded_root")]]
            yield from _batches(rows(), pa.schema(fields + [("proof", pa.list_(pa.binary()))] * with_proof))

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each key in a sorted partition from 0."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, places = batch.column("key"), []
        for key, n in _runs(keys):
            count = count if key == last else 0
            places.append(pa.array(range(count, count + n), pa.int64()))
            last, count = key, count + n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.concat_arrays(places)], [*batch.schema.names, "part", "place"])


def _runs(keys: pa.Array) -> Iterator[tuple[str, int]]:
    runs = pc.run_end_encode(keys)
    start = 0
    for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        yield key, end - start
        start = end


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """*nodes* with ``idx``, the place among the rows of equal ``key`` in *order*; no key is one task's.

    Rows are range-partitioned on the whole order.  Only a partition's first key can have begun
    before it, so one count per partition completes the numbers.
    """
    ranged = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    ranged = stored(ranged.mapInArrow(_places, f"{fields}, part int, place long"))
    ends = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max(F.struct("key", "place")).alias("last")).orderBy("part").collect()  # one row per partition
    carried, key, count = [], None, 0
    for r in ends:
        before = count if r["first"] == key else 0
        carried.append((r["part"], r["first"], before))
        key, count = r["last"]["key"], r["last"]["place"] + 1 + (before if r["last"]["key"] == r["first"] else 0)
    begun = nodes.sparkSession.createDataFrame(carried, "part int, first string, before long")
    whole = ranged.join(F.broadcast(begun), "part")
    return whole.withColumn("idx", F.col("place") + F.when(F.col("key") == F.col("first"), F.col("before")).otherwise(0)).drop("part", "place", "first", "before")


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK))


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", "idx")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and, tier by tier, the roots of their blocks, up to one node for each key."""
    out = [nodes]
    while len(out) == 1 or out[-1].agg(F.max("idx")).first()[0]:
        out.append(stored(_dealt(_blocked(out[-1].select("key", "idx", "digest"))).mapInArrow(_roots, _NODE)))
    return out


def _met(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes, and before those of each block the block's path."""
    heads = paths.select("key", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "path", "subroot")
    return _dealt(_blocked(nodes).unionByName(heads, allowMissingColumns=True))


def _down(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the last tier's nodes carried down to the nodes of the first."""
    for nodes in reversed(tiers):
        paths = _met(nodes.select("key", "idx", "digest"), paths).mapInArrow(_paths, f"{_NODE}, path array<binary>, subroot binary")
    return paths


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source",
             changed: Column | None = None, replaced: dict[str, Column] | None = None, with_proof: bool = False) -> DataFrame:
    """Per row of *docs*: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf hashes the row's *fields*; leaves of a source ascend by id (null first, then by digest), sources by their
    bytes (null first).  ``proof_sha256`` hashes the siblings from the leaf up to the root.  Where *changed* holds, ``folded_root``
    is the root after the row's *replaced* fields take their new values, else the root itself;
    ``verified`` says that both are equal.  *with_proof* adds the siblings: per level
    a byte for the slot and the other children's digests, as `fold_proof` reads them.

    Null fields are hashed as ``-``; a null source is a source of its own, a null id sorts first and a null *changed* is false.  Repeated rows are
    leaves of their own.  An empty table gives an empty table; other columns are ignored.
    """
    replaced = replaced or {}
    leaf = row_digest([F.col(c) for c in fields])
    new = row_digest([replaced.get(c, F.col(c)) for c in fields])
    leaves = stored(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key"), F.col(id_col).alias("id"), F.unhex(leaf).alias("digest"),
        (F.unhex(F.when(changed, new)) if changed is not None else F.lit(None).cast("binary")).alias("new"), F.monotonically_increasing_id().alias("row")))
    nodes = stored(_numbered(leaves, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("row")]).drop("row"))
    tiers = _tiers(nodes)
    tops = tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "digest")
    sources = stored(_numbered(tops, [F.col("name")]).select("key", "idx", "digest", "name"))
    upper = _tiers(sources)
    top = upper[-1].select("digest").first()  # the one root
    root = top["digest"].hex() if top else None
    start = upper[-1].select("key", "idx", F.array().cast("array<binary>").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    named = _down(upper[:-1], start).select("idx", "path").join(sources.select("idx", "name", "digest"), "idx")
    paths = _down(tiers[1:-1], named.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot")))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string" + (", proof array<binary>" if with_proof else "")
    out = _met(nodes, paths).mapInArrow(_proved(with_proof), schema)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"), *(["proof"] if with_proof else []))
