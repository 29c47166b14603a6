"""Stored tables, and words of whole Arrow text columns as numpy arrays."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scale import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on (a longer text is a step of its own).
STEP_BYTES = 1 << 21
#: Words are runs of anything else: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = np.zeros(256, dtype=bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Removes shuffle files when the query that wrote them ends; all reuse goes through stored tables.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session (what ``--py-files`` does for a job)."""
    if spark.sparkContext.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir``; one is invented in local mode only."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write *df* as Parquet to the shared folder and read it back: cut lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about *most* bytes of text; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words in *data*; *at* holds the rows' offsets."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~WORD_SPACE[data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = at[:-1][np.diff(at) > 0]
    begins[edge] = inside[edge]
    edge = edge[1:] - 1
    closes[edge] = inside[edge]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        for i, base in enumerate((_ODD, _INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[i] = np.cumprod(out, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, the same wherever a span stands: differences of one running polynomial."""
    power, inverse = _power_tables(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * inverse[starts]
    return mix(h, 0x5851F42D4C957F2D) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def run_hashes(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of *size* words inside a row, and the position of its first word."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + h[i:i + n], i + 1)
    same = np.flatnonzero(row[:n] == row[size - 1:])
    return out[same], same


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def rebatch(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut large record batches, so that no single one has to be held twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, most):
            yield batch.slice(i, most)


def row_column(df: DataFrame, wanted: str) -> str:
    """A column name based on *wanted* that *df* does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
