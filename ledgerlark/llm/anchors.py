"""Product codes for vectors: a small codebook for each part, fitted over metric trees.

Vectors are cut into chunks of bounded size, and each chunk gets a metric tree for each part
position.  Trees are built middle-out by the anchors hierarchy: about sqrt(n) anchors claim the
points next to them (a new anchor is the point farthest from its owner and takes only points that the
triangle inequality leaves open), anchors are merged upwards into balls, large anchors are split
again in the same way.  A ball caches the sum and the count of its points.

A round walks down all trees with lists of candidate entries.  A ball inherits its
parent's list and drops entries that cannot be nearest to any of its points; once one entry is
left, the ball is wholly owned and its cached sum and count are all that is read.  Balls at the
bottom compare their points with what is left of the list.  The result is that of comparing everything: components are whole
numbers, and floating distances only decide what to drop, with slack.

The trees are stored once.  A round reads them, sums within tasks, and brings one row for
each component of the codebook to the driver (entries x width, whatever the size of the table).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components that the vectors of one chunk have at most, and points of a ball that is not split further.
CHUNK_VALUES, LEAF = 1 << 18, 64
#: Times that an anchor's points are split again (outliers can leave nearly all points with one anchor).
DEEPEST = 8
_CODED = "vec_id long, label string, code string, error long"


def _claim(x: np.ndarray, wanted: int) -> np.ndarray:
    """The owner (0, 1, ...) of each point after at most *wanted* anchors have claimed theirs."""
    owner = np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    anchors = [0]
    while len(anchors) < wanted:
        new = int(far.argmax())
        if far[new] == 0:
            break
        gap = np.sqrt(((x[anchors] - x[new]) ** 2).sum(axis=1))
        open_ = np.flatnonzero(far > gap[owner] / 2)  # nearer points cannot be nearer to the new anchor
        to_new = np.sqrt(((x[open_] - x[new]) ** 2).sum(axis=1))
        taken = to_new < far[open_]
        owner[open_[taken]], far[open_[taken]] = len(anchors), to_new[taken]
        anchors.append(new)
    return owner


class _Forest:
    """The balls of a chunk's trees: part, first and last place in the part's order, children, radius and sum."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, int, int, int]] = []
        self.radius: list[float] = []
        self.sums: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        self.roots: list[int] = []

    def plant(self, part: int, x: np.ndarray) -> None:
        shape = _grow(x, np.arange(len(x)))
        places: list[np.ndarray] = []
        self.roots.append(self._lay(part, x, shape, places, 0)[0])
        self.order.append(np.concatenate(places))

    def _lay(self, part: int, x: np.ndarray, shape, places: list[np.ndarray], first: int) -> tuple[int, np.ndarray]:
        """Put the points of *shape* in order, children before parents; the node and its points."""
        if isinstance(shape, np.ndarray):
            places.append(shape)
            left = right = -1
            points = x[shape]
        else:
            left, a = self._lay(part, x, shape[0], places, first)
            right, b = self._lay(part, x, shape[1], places, first + len(a))
            points = np.concatenate([a, b])
        total = points.sum(axis=0)
        self.nodes.append((part, first, first + len(points), left, right))
        self.radius.append(float(np.sqrt(((points - total / len(points)) ** 2).sum(axis=1).max())))
        self.sums.append(total)
        return len(self.nodes) - 1, points


def _grow(x: np.ndarray, rows: np.ndarray, depth: int = 0):
    """The shape of a tree over *rows*: an array of rows, or a pair of shapes."""
    owner = _claim(x[rows], int(np.ceil(np.sqrt(len(rows))))) if len(rows) > LEAF and depth < DEEPEST else np.zeros(len(rows), np.int64)
    many = int(owner.max()) + 1
    if many == 1:
        return rows
    groups = [rows[owner == i] for i in range(many)]
    shapes = [_grow(x, g, depth + 1) if len(g) > LEAF else g for g in groups]
    centre = np.array([x[g].mean(axis=0) for g in groups])
    radius = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centre)])
    count = np.array([float(len(g)) for g in groups])
    size = (np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]) / 2
    np.fill_diagonal(size, np.inf)
    there = np.ones(many, bool)
    for _ in range(many - 1):  # the two balls that the smallest ball holds become one
        i, j = sorted(divmod(int(size.argmin()), many))
        both = count[i] + count[j]
        merged = (centre[i] * count[i] + centre[j] * count[j]) / both
        reach = max(np.sqrt(((centre[k] - merged) ** 2).sum()) + radius[k] for k in (i, j))
        shapes[i], shapes[j] = (shapes[i], shapes[j]), None
        centre[i], radius[i], count[i] = merged, reach, both
        line = (np.sqrt(((centre - merged) ** 2).sum(axis=1)) + radius + reach) / 2
        there[j] = False
        line[~there] = line[i] = np.inf
        size[i, :] = size[:, i] = line
        size[j, :] = size[:, j] = np.inf
    return shapes[int(there.argmax())]


class Chunk:
    """Whole-number vectors of one chunk and their trees."""

    def __init__(self, row: dict) -> None:
        self.n = len(row["ids"])
        self.wide = row["nodes"] is None
        if self.wide:
            flat = np.frombuffer(row["vectors"], np.float64)
            self.x = np.array([_whole(v) for v in flat.tolist()], dtype=object).reshape(self.n, PARTS, -1)
            return
        self.x = np.frombuffer(row["vectors"], np.int32).astype(np.float64).reshape(self.n, PARTS, -1)
        self.nodes = np.frombuffer(row["nodes"], np.int32).reshape(-1, 5)
        self.radius = np.frombuffer(row["radius"], np.float64)
        self.sums = np.frombuffer(row["sums"], np.float64).reshape(len(self.nodes), -1)
        self.order = np.frombuffer(row["order"], np.int32).reshape(PARTS, self.n)
        self.roots = np.frombuffer(row["roots"], np.int32)

    def walk(self, book: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(balls, entry) that are wholly owned, and (balls, lists) at the bottom that are not."""
        node, held = self.roots, np.ones((PARTS, book.shape[1]), bool)
        owned, mixed = [], []
        while len(node):
            part, first, last, left, right = self.nodes[node].T
            centre = self.sums[node] / (last - first)[:, None]
            gap = np.sqrt(((centre[:, None] - book[part]) ** 2).sum(axis=2))
            gap[~held] = np.inf
            least = gap.min(axis=1, keepdims=True)
            radius = self.radius[node][:, None]
            held = gap - least <= 2 * radius + 1e-9 * (1 + least + radius)
            one = held.sum(axis=1) == 1
            owned.append((node[one], held[one].argmax(axis=1)))
            bottom = ~one & (left < 0)
            mixed.append((node[bottom], held[bottom]))
            down = ~one & (left >= 0)
            node, held = np.concatenate([left[down], right[down]]), np.concatenate([held[down], held[down]])
        return tuple(tuple(np.concatenate(c) for c in zip(*found)) for found in (owned, mixed))

    def _compared(self, balls: np.ndarray, lists: np.ndarray, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, points, nearest entry of their ball's list), exactly; of ties the lower one."""
        for p in range(PARTS):
            mine = self.nodes[balls, 0] == p
            if mine.any():
                first, last = self.nodes[balls[mine], 1], self.nodes[balls[mine], 2]
                sizes = last - first
                place = np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                rows = self.order[p][place]
                x = self.x[rows, p]
                gap = (x ** 2).sum(axis=1)[:, None] - 2 * (x @ book[p].T) + (book[p] ** 2).sum(axis=1)[None]
                gap[~np.repeat(lists[mine], sizes, axis=0)] = np.inf
                yield p, rows, gap.argmin(axis=1)

    def totals(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the parts by position and nearest entry."""
        sums, counts = np.zeros(book.shape, self.x.dtype), np.zeros(book.shape[:2], np.int64)
        if self.wide:
            nearest = self.codes(book)
            for p in range(PARTS):
                np.add.at(sums[p], nearest[:, p], self.x[:, p])
                counts[p] += np.bincount(nearest[:, p], minlength=book.shape[1])
            return sums, counts
        (balls, entry), bottom = self.walk(book)
        part = self.nodes[balls, 0]
        np.add.at(sums, (part, entry), self.sums[balls])
        np.add.at(counts, (part, entry), self.nodes[balls, 2] - self.nodes[balls, 1])
        for p, rows, nearest in self._compared(*bottom, book):
            sums[p] += np.equal.outer(np.arange(book.shape[1]), nearest).astype(np.float64) @ self.x[rows, p]
            counts[p] += np.bincount(nearest, minlength=book.shape[1])
        return sums, counts

    def codes(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each vector's parts."""
        out = np.zeros((self.n, PARTS), np.int64)
        if self.wide:
            for p in range(PARTS):
                out[:, p] = ((self.x[:, p, None] - book[p][None]) ** 2).sum(axis=2).argmin(axis=1)
            return out
        (balls, entry), bottom = self.walk(book)
        for b, e in zip(balls, entry):
            part, first, last = self.nodes[b, :3]
            out[self.order[part, first:last], part] = e
        for p, rows, nearest in self._compared(*bottom, book):
            out[rows, p] = nearest
        return out

    def errors(self, book: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(((self.x[:, p] - book[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(PARTS))


def _whole(v: float) -> int:
    """floor(SCALE * v), exactly for any finite number (a number beyond 2**53 is whole)."""
    return int(v) * SCALE if abs(v) > 2.0**53 else int(np.floor(v * SCALE))


def _chunks(width: int, wide: bool):
    """Chunks of the partition's vectors, with their trees."""
    most = max(1, CHUNK_VALUES // width)

    def chunk(ids: list, labels: list, vectors: np.ndarray) -> pa.RecordBatch:
        row = {"ids": ids, "labels": labels, "vectors": vectors.tobytes(), "nodes": None, "radius": None, "sums": None, "order": None, "roots": None}
        if not wide:
            whole = np.floor(vectors * SCALE)
            forest, parts = _Forest(), whole.reshape(len(ids), PARTS, -1)
            for p in range(PARTS):
                forest.plant(p, parts[:, p])
            row |= {"vectors": whole.astype(np.int32).tobytes(), "nodes": np.array(forest.nodes, np.int32).tobytes(), "radius": np.array(forest.radius).tobytes(), "sums": np.array(forest.sums).tobytes(),
                    "order": np.array(forest.order, np.int32).tobytes(), "roots": np.array(forest.roots, np.int32).tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=_CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        labels: list = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy().reshape(-1, width)
            at, ids_, labels_ = 0, batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            while at < len(flat):
                to = min(len(flat), at + most - len(ids))
                ids, labels = ids + ids_[at:to], labels + labels_[at:to]
                vectors.append(flat[at:to])
                at = to
                if len(ids) == most:
                    yield chunk(ids, labels, np.concatenate(vectors))
                    ids, labels, vectors = [], [], []
        if ids:
            yield chunk(ids, labels, np.concatenate(vectors))

    return run


_CHUNK_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *[(n, pa.binary()) for n in ("vectors", "nodes", "radius", "sums", "order", "roots")]])
_CHUNK = "ids array<long>, labels array<string>, vectors binary, nodes binary, radius binary, sums binary, order binary, roots binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _book(book: list[list[list[int]]], wide: bool) -> np.ndarray:
    return np.array(book, dtype=object if wide else np.float64)


def _sums(book: list[list[list[int]]], wide: bool):
    """A task's sums and counts, one row for each component of the codebook."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _book(book, wide)
        sums, counts = np.zeros(entries.shape, object), np.zeros(entries.shape[:2], np.int64)
        for row in _rows(batches):
            s, n = Chunk(row).totals(entries)
            sums += s if wide else s.astype(np.int64).astype(object)
            counts += n
        if counts.any():
            part, entry, place = (a.reshape(-1) for a in np.indices(entries.shape))
            total = pa.array([Decimal(int(v)) for v in sums.reshape(-1)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), total, pa.array(counts[part, entry])], ["part", "entry", "place", "total", "n"])

    return run


def _coded(book: list[list[list[int]]], wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _book(book, wide)
        for row in _rows(batches):
            chunk = Chunk(row)
            codes = chunk.codes(entries)
            text = codes.astype(np.uint8).tobytes().hex()
            error = [int(e) if e < 1 << 63 else None for e in chunk.errors(entries, codes)]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    return run


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """``vec_id, label, code, error`` of the kept vectors, and the codebooks (part, entry, component).

    A component x becomes floor(4096 * x).  Codebooks start as the parts of the 16 smallest vec_ids (ties by the vector) and are
    moved *rounds* times to the floor of their parts' mean; an entry without parts stays.  ``code`` has two
    hex digits for each part, ``error`` sums the squared distances.

    Vectors that are null or hold null or non-finite components are dropped.  Kept vectors whose width is not that of the
    smallest vec_id (or no multiple of 8), and all of them if every vec_id is null, have a null code and error; so has an
    error beyond a long.  Rows with a null vec_id are coded but never start a codebook.  Repeated rows are rows of their own.
    Components from 2**30 on are counted with Python's whole numbers (up to sums of 38 digits).  An empty table gives an empty table and codebooks; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = kept.filter("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(ENTRIES).collect()  # the codebooks' start
    width = len(first[0]["embedding"]) if first else 0
    uncoded = [F.col("vec_id"), F.col("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    if not width or width % PARTS:
        return stored(kept.select(*uncoded)), []
    fitting = kept.filter(F.size("embedding") == width)
    largest = fitting.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] * SCALE + 1
    wide = width // PARTS * (2 * largest) ** 2 >= 2.0**53 or largest >= 2.0**31  # beyond, doubles and stored integers are not exact
    start = [[_whole(v) for v in r["embedding"]] for r in first if len(r["embedding"]) == width]
    size = width // PARTS
    book = [[v[p * size:(p + 1) * size] for v in start] for p in range(PARTS)]
    chunks = stored(fitting.mapInArrow(_chunks(width, wide), _CHUNK))
    for _ in range(rounds):
        found = chunks.mapInArrow(_sums(book, wide), "part int, entry int, place int, total decimal(38,0), n long")
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # ENTRIES x width rows
            if r["n"]:
                book[r["part"]][r["entry"]][r["place"]] = int(r["total"]) // r["n"]
    coded = chunks.mapInArrow(_coded(book, wide), _CODED)
    return stored(coded.unionByName(kept.filter(F.size("embedding") != width).select(*uncoded))), book


def codes(vectors: DataFrame, **kind) -> DataFrame:
    """Per kept vector ``vec_id, code, error, label_error, codebooks_sha256``; arguments and odd rows as in `compress`.

    ``label_error`` sums the errors of equal labels (nulls together, null errors left out), ``codebooks_sha256`` hashes the final entries'
    components in order, joined by commas.
    """
    coded, book = compress(vectors, **kind)
    digest = hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()
    totals = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")  # the planner knows the totals' size
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
