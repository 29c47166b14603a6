"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

A document's evidence is the log-likelihood ratio of its binned features under good and bad labels, calibrated on the labels.
Expected good documents are then summed by path and by host (grouped aggregates over all
documents, labelled or not); a host's rate is shrunk to the rate of all documents, a path's to its host's,
with a strength that follows from how much the sites really differ.  The path's posterior rate is the
prior of its documents: a sparse site falls back on the level above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import slices, span_hashes, stored, text_of, words
from ledgerlark.llm.rules import SYMBOLS, per_row

#: A feature is a share, put into bins of octaves; 0 has a bin of its own.
FEATURES = ["words with symbols", "words in capitals", "shouted words", "bars", "repeated words", "long words"]
BINS = 12
#: Bounds of the prior strength, in documents, and of a site's rate.
STRENGTH, RATE = (1.0, 1e6), (0.02, 0.98)


def _bin(share: np.ndarray) -> np.ndarray:
    out = np.zeros(len(share), np.int64)
    some = share > 0
    out[some] = np.clip(np.floor(np.log2(share[some])).astype(np.int64) + BINS - 2, 1, BINS - 1)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep = ["doc_id", "host", "path"]
    for batch in batches:
        for first, last, data, at in slices(batch.column("text")):
            n = last - first
            starts, ends, row = words(data, at)
            h = span_hashes(data, starts, ends)
            count = np.bincount(row, minlength=n)
            some, chars = np.maximum(count, 1), np.maximum(np.diff(at), 1)
            same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])

            def in_words(flags: np.ndarray) -> np.ndarray:
                run = np.concatenate([[0], np.cumsum(flags)])
                return run[ends] - run[starts]

            def share(which: np.ndarray) -> np.ndarray:
                return np.bincount(row[which], minlength=n) / some

            shares = [
                share(in_words(SYMBOLS[data]) >= 3),
                share((in_words((data >= 65) & (data <= 90)) >= 2) & (in_words((data >= 97) & (data <= 122)) == 0)),
                share(in_words(data == ord("!")) >= 2),
                per_row(data == ord("|"), at) / chars,
                np.bincount(row[1:][same], minlength=n) / some,
                share(ends - starts > 20),
            ]
            bins = np.stack([_bin(s) for s in shares], axis=1).astype(np.int16)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bins.size + 1, bins.shape[1], dtype=np.int32)), pa.array(bins.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, n) for c in keep], flat], [*keep, "bins"])


def _strength(sites: DataFrame, mean: Column) -> float:
    """Beta prior strength of rates ``s / n`` around *mean*, by moments weighted with *n*."""
    r = sites.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("v"), F.sum(F.col("n") * mean * (1 - mean)).alias("b")).first()
    if not r["n"] or r["b"] is None:
        return STRENGTH[1]
    within = r["b"] / r["n"]
    between = r["v"] / r["n"] - within * r["k"] / r["n"]
    return min(STRENGTH[1], max(STRENGTH[0], within / between - 1)) if between > 0 else STRENGTH[1]


def _evidence(features: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Log ratio for each feature bin (key: feature * BINS + bin), and the labelled share of good documents."""
    known = features.join(labels, "doc_id").select("good", F.posexplode("bins"))
    counts = known.groupBy("pos", "col", "good").count().collect()  # at most 2 * features * BINS rows
    total = {g: sum(r["count"] for r in counts if r["pos"] == 0 and r["good"] == g) for g in (True, False)}
    if not total[True] or not total[False]:
        return {}, 0.5 if not sum(total.values()) else float(total[True] > 0) * 0.98 + 0.01
    seen = {(r["pos"], r["col"], r["good"]): r["count"] for r in counts}
    ratio = {p * BINS + b: math.log((seen.get((p, b, True), 0) + 0.5) / (total[True] + 0.5 * BINS)) - math.log((seen.get((p, b, False), 0) + 0.5) / (total[False] + 0.5 * BINS))
             for p in range(len(FEATURES)) for b in range(BINS)}
    return ratio, total[True] / (total[True] + total[False])


def _calibrated(known: DataFrame, share: float) -> tuple[float, float]:
    """Slope and offset that turn summed ratios, which count related features twice, into a log-likelihood ratio.

    A logistic curve through the labelled documents on a grid of the evidence (a few hundred rows at
    most), with a weak pull to slope 1 and offset 0.
    """
    rows = known.groupBy(F.round(F.col("evidence") * 4).alias("cell"), "good").count().collect()
    if not rows:
        return 1.0, 0.0
    e, good, n = (np.array([r[c] for r in rows], float) for c in ("cell", "good", "count"))
    x = np.stack([e / 4, np.ones(len(e))], axis=1)
    first, w = math.log(share / (1 - share)), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + first, -30, 30)))
        slope = x.T @ (n * (good - p)) - (w - [1.0, 0.0])
        w = w + np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(2), slope)
    return float(w[0]), float(w[1])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(RATE[0])), F.lit(RATE[1]))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source", path_col: str | Column = "lang",
             label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """Per row of *docs*: ``doc_id, host, path, evidence, path_rate, p_good, kept``.

    *labels* (``doc_id`` and *label_col*, 1 good and 0 bad) may cover some documents; an id
    labelled both ways takes the majority, good on a tie; null labels count for nothing.
    With no labels of one kind there is no evidence and everything follows the prior.

    Null and empty texts have the features of an empty text.  A null host or path is a site of its own; a
    null id is never labelled.  Repeated rows are judged alike and each comes back.  An empty table
    gives an empty table; other columns are ignored.
    """
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host_col, path_col))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), text_of(text_col).alias("text"))
    features = stored(docs.mapInArrow(_features, "doc_id long, host string, path string, bins array<short>"))
    labels = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(label_col) >= 0.5).alias("good"))
    ratio, share = _evidence(features, labels)
    table = F.lit([ratio.get(k, 0.0) for k in range(len(FEATURES) * BINS)])
    evidence = F.aggregate(F.transform("bins", lambda b, i: F.element_at(table, (i * BINS + b + 1).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    first = math.log(share / (1 - share))
    features = features.withColumn("evidence", evidence)
    slope, offset = _calibrated(features.join(labels, "doc_id").select("evidence", "good"), share)
    features = features.withColumn("evidence", slope * F.col("evidence") + offset).withColumn("p", 1 / (1 + F.exp(-F.col("evidence") - first)))

    paths = stored(features.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg((F.sum("s") / F.sum("n")).alias("m")).first()["m"]
    whole = F.lit(share if whole is None else whole)
    k = _strength(hosts, whole)
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * whole) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k = _strength(paths, F.col("host_rate"))
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))
    out = features.drop("p").join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    p = 1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("path_rate"))))
    return out.select("doc_id", "host", "path", "evidence", "path_rate", p.alias("p_good"), (p >= threshold).alias("kept"))
