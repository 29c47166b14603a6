"""Quality rules per document, judged together for each host.

Every rule gives a failure for each document.  Failures are summed by host, and a host's rate is
shrunk towards the rate of all documents by a beta prior whose strength comes from how much
hosts really differ (method of moments).  A host is rejected when, for any rule, its shrunk
rate lies above the limit by two posterior standard deviations; its verdict is joined to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import WORD_SPACE, mix, run_hashes, slices, span_hashes, stored, text_of, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Host rate of a rule above which a host is rejected.
LIMIT = 0.5
#: Document-level rules; the first two are the base.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "10 * n_dup_lines > 9 * greatest(n_lines, 1)",
}


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[at[1:]] - run[at[:-1]]


def repeated(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which values occur twice or more in their row."""
    mixed = mix(values + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    same = mixed[order][1:] == mixed[order][:-1]
    out = np.zeros(len(values), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return out


def line_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, of every row."""
    rows = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([at[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    row = np.searchsorted(at, starts, "right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], at[row + 1])
    inside = np.concatenate([[0], np.cumsum(~WORD_SPACE[data])])
    full = inside[ends] > inside[starts]
    row, h = row[full], span_hashes(data, starts[full], ends[full])
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row, minlength=rows), np.bincount(row[order][1:][again], minlength=rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, at in slices(batch.column("text")):
            n = last - first
            starts, ends, row = words(data, at)
            h = span_hashes(data, starts, ends)
            runs, where = run_hashes(h, row, 5)
            covered = np.zeros(len(h) + 1, np.int64)
            hit = where[repeated(runs, row[where])]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + 5, -1)
            lines, again = line_counts(data, at)
            counts = [
                np.bincount(row, minlength=n),
                per_row(~WORD_SPACE[data] & ((data & 0xC0) != 0x80), at),
                per_row(SYMBOLS[data], at),
                again,
                np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n),
                lines,
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("host").slice(first, n), *[pa.array(c.astype(np.int64)) for c in counts]],
                                             ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def host_of(url: str | Column) -> Column:
    """The lower-case host of a URL column."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def host_rates(counts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``host, docs`` and for each rule its shrunk failure rate and the rate's posterior deviation."""
    hosts = counts.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("docs"), *[F.count_if(F.expr(e)).alias(f"f_{r}") for r, e in rules.items()])
    hosts = stored(hosts)
    means = hosts.agg(F.sum("docs").alias("n"), F.count("*").alias("h"), *[(F.sum(f"f_{r}") / F.sum("docs")).alias(r) for r in rules]).first()
    if not means["h"]:
        return hosts.select("host", "docs", *[F.lit(0.0).alias(f"{k}_{r}") for r in rules for k in ("rate", "sd")])
    spread = hosts.agg(*[(F.sum(F.col("docs") * F.pow(F.col(f"f_{r}") / F.col("docs") - means[r], 2)) / means["n"]).alias(r) for r in rules]).first()
    out = [F.col("host"), F.col("docs")]
    for r in rules:
        m, noise = means[r], means[r] * (1 - means[r]) * means["h"] / means["n"]
        between = max(spread[r] - noise, 1e-6)
        strength = max(m * (1 - m) / between - 1, 1.0)
        rate = (F.col(f"f_{r}") + m * strength) / (F.col("docs") + strength)
        out += [rate.alias(f"rate_{r}"), F.sqrt(rate * (1 - rate) / (F.col("docs") + strength + 1)).alias(f"sd_{r}")]
    return hosts.select(*out)


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str | Column = "source", limit: float = LIMIT) -> DataFrame:
    """Per row of *docs*: ``doc_id, host``, its counts, ``base_failed, host_failed, kept``.

    Null and empty texts have no words and fail the base.  Rows with a null host have no host
    verdict.  Every row is judged on its own, repeated ones too, and each comes back; an
    empty table gives an empty table; other columns are ignored.
    """
    host = F.col(host_col) if isinstance(host_col, str) else host_col
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), text_of(text_col).alias("text"))
    kind = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    counts = stored(docs.mapInArrow(_counts, kind))
    failed = F.lit(False)
    for r in RULES:
        failed = failed | (F.col(f"rate_{r}") - 2 * F.col(f"sd_{r}") > limit)
    verdicts = host_rates(counts, RULES).select("host", failed.alias("host_failed"))
    base = F.expr(f"({RULES['short']}) OR ({RULES['repeats']})")
    out = counts.join(verdicts, "host", "left").withColumn("base_failed", base).withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
