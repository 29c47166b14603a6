"""Column identities c = a x b and c = a + b that hold on most rows, found without trying every triple on the data.

A triple can only hold on a share of the rows if the columns' distributions allow it.  Say that it holds
on 75 % of them and that |a| exceeds A on few rows and |b| exceeds B on few: then on nearly 75 % of the
rows |c| cannot exceed A x B (and a tolerance).  If more rows than that have a larger |c|, the triple is out, whatever the rows
look like; likewise from below, and for sums.  The counts behind this are exact, linear in the columns,
and nothing is sampled: what is dropped cannot reach the share.  What is left is measured on
all rows in one pass, batch by batch in numpy, however many triples there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as tx

#: Share of the rows below which no identity is of interest, and the relative tolerance.
LEAST_SHARE, TOLERANCE = 0.75, 0.01
#: Shares of the rows at which a column is cut.
CUTS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995)
#: Triples up to which bounding them would cost more passes than it saves.
FEW = 64
SHARES = "position int, operator string, result string, left string, right string, n long, hits long, share double"

Triple = tuple[str, int, int, int]  # operator, result, left, right


def numbers_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles; texts are read as numbers, NaN is missing."""
    kinds = dict(df.select(*columns).dtypes)
    read = {c: tx.parse_number(c, ".") if kinds[c] == "string" else F.col(c).cast("double") for c in columns}
    return df.select(*[F.nanvl(v, F.lit(None).cast("double")).alias(f"c{i}") for i, v in enumerate(read.values())])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns by rows, missing as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_columns else np.zeros((0, batch.num_rows))


def _counted(cuts: np.ndarray):
    """Per column and kind (0: value, 1: size) how many rows lie below, and at or below, each cut; then rows, missing, zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cuts), 2, 2, len(CUTS)), np.int64)
        rest = np.zeros((len(cuts), 3), np.int64)
        for batch in batches:
            for i, v in enumerate(_matrix(batch)):
                there = v[~np.isnan(v)]
                rest[i] += (len(v), len(v) - len(there), np.count_nonzero(there == 0))
                for kind, values in enumerate((there, np.abs(there))):
                    values = np.sort(values)
                    total[i, kind, 0] += np.searchsorted(values, cuts[i, kind], "left")
                    total[i, kind, 1] += np.searchsorted(values, cuts[i, kind], "right")
        flat = np.concatenate([total.reshape(len(cuts), -1), rest], axis=1).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "n"])

    return run


class Bounds:
    """Exact counts of a table's columns at cut points, and which triples they leave open."""

    def __init__(self, numbers: DataFrame, least: float) -> None:
        asked = F.array(*map(F.lit, CUTS))
        row = numbers.agg(*[F.struct(F.percentile_approx(c, asked, F.lit(1000)).alias("v"), F.percentile_approx(F.abs(c), asked, F.lit(1000)).alias("s")).alias(c) for c in numbers.columns]).first()
        none = [0.0] * len(CUTS)
        self.cuts = np.array([[row[c]["v"] or none, row[c]["s"] or none] for c in numbers.columns])
        found = numbers.mapInArrow(_counted(self.cuts), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # some numbers for each column
        width = 4 * len(CUTS) + 3
        flat = np.zeros(len(self.cuts) * width, np.int64)
        for r in found:
            flat[r["place"]] = r["n"]
        whole = flat.reshape(-1, width)
        counts = whole[:, :-3].reshape(-1, 2, 2, len(CUTS))
        self.rows, self.missing, self.zeros = whole[:, -3], whole[:, -2], whole[:, -1]
        self.there = self.rows - self.missing
        self.under, self.upto = counts[:, :, 0], counts[:, :, 1]
        self.over = self.there[:, None, None] - self.upto
        self.least = least

    def _larger(self, c: int, kind: int, bound: np.ndarray) -> np.ndarray:
        """Rows of column *c* that lie above *bound* at least."""
        at = np.searchsorted(self.cuts[c, kind], bound, "left")
        return np.append(self.over[c, kind], 0)[at]

    def _smaller(self, c: int, kind: int, bound: np.ndarray) -> np.ndarray:
        """Rows of column *c* that lie below *bound* at least."""
        at = np.searchsorted(self.cuts[c, kind], bound, "right")
        return np.insert(self.under[c, kind], 0, 0)[at]

    def open(self, triple: Triple) -> bool:
        """Whether the identity can hold on the least share of the rows where all three are there and the result is not 0."""
        op, c, a, b = triple
        kind = int(op == "*")
        live = min(self.there[a], self.there[b], self.there[c] - self.zeros[c])
        if live <= 0:
            return True
        spare = (1 - self.least) * live * (1 + 1e-9) + self.missing[a] + self.missing[b]
        x, y = self.cuts[a, kind], self.cuts[b, kind]
        with np.errstate(invalid="ignore", over="ignore"):
            both = np.multiply.outer(x, y) if kind else np.add.outer(x, y)
        low, high = (1 - TOLERANCE) * (1 - 1e-9), (1 + TOLERANCE) * (1 + 1e-9)
        # a hit has |expected - c| <= tolerance * |c|, so c lies between expected / high and expected / low (the other way round below 0)
        none, zeros = np.isnan(both), self.zeros[c]  # rows where the result is 0 are not live, whatever side of a bound they lie on
        most = np.where(none, np.inf, np.where(both >= 0, both / low, both / high))
        above = np.add.outer(self.over[a, kind], self.over[b, kind])
        if (self._larger(c, kind, most) - np.where(most < 0, zeros, 0) > spare + above).any():
            return False
        fewest = np.where(none, -np.inf, np.where(both >= 0, both / high, both / low))
        below = np.add.outer(self.under[a, kind], self.under[b, kind])
        return not (self._smaller(c, kind, fewest) - np.where(fewest > 0, zeros, 0) > spare + below).any()


def _measured(triples: list[Triple]):
    """Rows where all three are there and the result is not 0, and those on which the identity holds, for each triple."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = np.zeros(len(triples), np.int64), np.zeros(len(triples), np.int64)
        for batch in batches:
            x = _matrix(batch)
            with np.errstate(all="ignore"):
                size = np.abs(x)
                for i, (op, c, a, b) in enumerate(triples):
                    expected = x[a] * x[b] if op == "*" else x[a] + x[b]
                    n[i] += np.count_nonzero(~(np.isnan(x[a]) | np.isnan(x[b]) | np.isnan(x[c])) & (x[c] != 0))
                    hits[i] += np.count_nonzero(np.abs(expected - x[c]) / size[c] <= TOLERANCE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(triples))), pa.array(n), pa.array(hits)], ["i", "n", "hits"])

    return run


def all_triples(columns: list[str]) -> list[Triple]:
    places = {c: i for i, c in enumerate(columns)}
    return [(op, places[r], places[a], places[b]) for op in ("*", "+") for r in columns for a, b in combinations(sorted(c for c in columns if c != r), 2)]


def identity_shares(df: DataFrame, columns: list[str], *, least: float = LEAST_SHARE) -> DataFrame:
    """Share of rows on which c = a x b and c = a + b hold within 1 % of c, for every triple that can reach *least*.

    Rows count where all three numbers are there and c is not 0.  Every triple with a share of *least* or more is among the rows;
    others may be.  ``position`` is that of the result in *columns*.
    """
    numbers, triples = numbers_of(df, columns), all_triples(columns)
    if len(triples) > FEW:
        bounds = Bounds(numbers, least)
        triples = [t for t in triples if bounds.open(t)]
    if not triples:
        return df.sparkSession.createDataFrame([], SHARES)
    found = numbers.mapInArrow(_measured(triples), "i long, n long, hits long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    named = [(i, c, op, columns[c], columns[a], columns[b]) for i, (op, c, a, b) in enumerate(triples)]
    names = df.sparkSession.createDataFrame(named, "i long, position int, operator string, result string, left string, right string")
    share = F.coalesce(F.col("hits") / F.nullif("n", F.lit(0)), F.lit(0.0))
    return names.join(found, "i", "left").select("position", "operator", "result", "left", "right", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"), share.alias("share"))
