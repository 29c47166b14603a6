"""Scoring texts with a hidden Markov language model, next to an add-one unigram score.

Latent states emit word classes: the most frequent words are classes of their own, all others share
the classes of their last two bytes and are then drawn inside the class by add-one counts of
the whole training corpus.  Expected transition and emission counts (Baum-Welch) are summed in
every partition and then across partitions; the driver holds the model alone, whose size is fixed
by its parameters.  Training cuts sequences into windows that cover every token; scoring runs
the scaled forward recursion over each whole text, so the likelihood is exact.

Counts of frequent words are looked up in a table of bounded size that each task has, all
other words meet the counts of the whole vocabulary in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import LOWER, mix, signed, slices, span_hashes, stored, text_of, words

#: States, rounds of Baum-Welch, words that are classes, suffix classes, words looked up in memory, tokens in a training window.
STATES, ROUNDS, OWN, SUFFIXES, HEAD, WINDOW = 8, 5, 4096, 1024, 200_000, 256
END = np.uint64(0x3C6EF372FE94F82B)
CLASSES = OWN + SUFFIXES + 1
_PENDING = 3_000_000


def _words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, suffix classes and rows of the lower-cased words."""
    data = LOWER[data]
    starts, ends, row = words(data, at)
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    return span_hashes(data, starts, ends), (mix(before << np.uint64(8) | last, 31) % np.uint64(SUFFIXES)).astype(np.int64), row


def held_out(ids: pa.Array) -> np.ndarray:
    """crc32 of the id as text leaves 2 when divided by 7; a null id is a training row."""
    return np.fromiter((i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids.to_pylist()), bool, len(ids))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of training rows, summed over a few million tokens at a time."""
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, suffix, n = (np.concatenate([p[k] for p in pending]) for k in range(3))
        order = np.argsort(h, kind="stable")
        h, suffix = h[order], suffix[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(suffix[first].astype(np.int32)), pa.array(np.add.reduceat(n[order], first).astype(np.int64))], ["h", "suffix", "c"])

    held = 0
    for batch in batches:
        train = ~held_out(batch.column("doc_id"))
        for lo, hi, data, at in slices(batch.column("text")):
            h, suffix, row = _words_of(data, at)
            use = train[lo:hi][row]
            values, first, n = np.unique(h[use], return_index=True, return_counts=True)
            ends = int(train[lo:hi].sum())
            pending.append((np.append(values, END), np.append(suffix[use][first], -1), np.append(n, ends)))
            held += len(values)
            if held > _PENDING:
                yield flush()
                pending, held = [], 0
    if pending:
        yield flush()


def _sequences(heads: np.ndarray, counts: np.ndarray, own: np.ndarray, base_den: float, inner_den: np.ndarray):
    """Class sequences and what is known without the whole vocabulary; *heads* are sorted hashes, *own* their class or -1."""
    base = np.log10((counts + 1) / base_den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            out_of = held_out(batch.column("doc_id"))
            for lo, hi, data, at in slices(batch.column("text")):
                n = hi - lo
                h, suffix, row = _words_of(data, at)
                k = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
                known = heads[k] == h
                cls = np.where(known & (own[k] >= 0), own[k], OWN + suffix)
                score = np.bincount(row, weights=np.where(known, base[k], 0.0), minlength=n).astype(np.float64)
                inside = known & (own[k] < 0)
                inner = np.bincount(row, weights=np.where(inside, np.log10((counts[k] + 1) / inner_den[suffix]), 0.0), minlength=n).astype(np.float64)
                found = np.bincount(row[known], minlength=n)
                sizes = np.bincount(row, minlength=n)
                e = int(np.searchsorted(heads, END))
                end_known = e < len(heads) and heads[e] == END
                seq = np.insert(cls, np.cumsum(sizes), CLASSES - 1).astype(np.uint16)
                at_seq = np.concatenate([[0], np.cumsum(sizes + 1)])
                raw = seq.tobytes()
                rest = ~known
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + np.arange(n)), batch.column("doc_id").slice(lo, n), pa.array(out_of[lo:hi]), pa.array(sizes + 1), pa.array(found + int(end_known)),
                    pa.array(score + (base[e] if end_known else np.log10(1 / base_den))), pa.array(inner),
                    pa.array([raw[2 * a:2 * b] for a, b in zip(at_seq[:-1].tolist(), at_seq[1:].tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(h[rest]))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(suffix[rest].astype(np.int32)))],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "seq", "rest", "suffix"])
                number += n

    return run


class Model:
    """Start, window start, transition and emission probabilities (emission: class by state)."""

    def __init__(self, start: np.ndarray, again: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.again, self.move, self.emit = start, again, move, emit

    @classmethod
    def drawn(cls, shares: np.ndarray, states: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * np.exp(rng.normal(0, 0.5, (len(shares), states)))
        move = np.full((states, states), 0.2 / max(1, states - 1))
        np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
        even = np.full(states, 1 / states)
        return cls(even, even, move, emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, flat: np.ndarray, states: int, prior: np.ndarray) -> Model:
        """Maximum likelihood, smoothed so that nothing is impossible: one count for a start and a move, and
        as many emissions as there are classes, spread as the corpus has them."""
        s = states
        start, again, move, emit = flat[:s] + 1, flat[s:2 * s] + 1, flat[2 * s:2 * s + s * s].reshape(s, s) + 1, flat[2 * s + s * s:].reshape(-1, s) + len(prior) * prior[:, None]
        return cls(start / start.sum(), again / again.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def expected_counts(model: Model, seqs: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected counts of padded class sequences, sorted by falling length; *first*: begins a text."""
    n, steps = seqs.shape
    s = len(model.start)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    live = np.searchsorted(-sizes, -np.arange(steps), "left")  # sequences longer than t
    forward, scale, given = np.zeros((steps, n, s), np.float32), np.ones((steps, n, 1), np.float32), []
    a = np.where(first[:, None], model.start, model.again).astype(np.float32)
    for t in range(steps):
        k = live[t]
        given.append(emit[seqs[:k, t]])
        a = (a[:k] if t == 0 else a[:k] @ move) * given[t]
        c = a.sum(axis=1, keepdims=True)
        a /= c
        forward[t, :k], scale[t, :k] = a, c
    moves, emitted = np.zeros((s, s)), np.zeros((len(emit), s))
    b = np.ones((n, s), np.float32)
    gammas, classes = [], []
    for t in range(steps - 1, -1, -1):
        k = live[t]
        gammas.append(forward[t, :k] * b[:k])
        classes.append(seqs[:k, t])
        if t:
            x = given[t] * b[:k] / scale[t, :k]
            moves += forward[t - 1, :k].T @ x
            b[:k] = x @ move.T
    g, where = np.concatenate(gammas), np.concatenate(classes)
    for i in range(s):
        emitted[:, i] = np.bincount(where, weights=g[:, i], minlength=len(emit))
    opening = gammas[-1]
    return np.concatenate([opening[first[:len(opening)]].sum(axis=0), opening[~first[:len(opening)]].sum(axis=0), (moves * model.move).reshape(-1), emitted.reshape(-1)])


def _padded(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pieces])
    out = np.zeros((len(pieces), int(sizes.max())), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(pieces)
    return out, sizes


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None

        def add(pieces: list[tuple[np.ndarray, bool]]) -> None:
            nonlocal total
            pieces.sort(key=lambda p: -len(p[0]))
            got = expected_counts(model, *_padded([p[0] for p in pieces]), np.array([p[1] for p in pieces]))
            total = got if total is None else total + got

        pieces: list[tuple[np.ndarray, bool]] = []
        for batch in batches:
            for raw in batch.column("seq").to_pylist():
                seq = np.frombuffer(raw, np.uint16)
                pieces += [(seq[i:i + WINDOW], i == 0) for i in range(0, len(seq), WINDOW)]
                if len(pieces) >= 2048:
                    add(pieces)
                    pieces = []
        if pieces:
            add(pieces)
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["at", "value"])

    return run


def log10_likelihood(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probabilities of class sequences, by the scaled forward recursion."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    sizes = np.array([len(seqs[i]) for i in order])
    flat, at = np.concatenate([seqs[i] for i in order]).astype(np.int64), np.cumsum(sizes) - sizes
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
    out = np.zeros(len(seqs))
    a = np.broadcast_to(model.start, (len(seqs), len(model.start)))
    for t in range(int(sizes[0])):
        k = live[t]
        a = (a[:k] if t == 0 else a[:k] @ model.move) * model.emit[flat[at[:k] + t]]
        c = a.sum(axis=1)
        out[:k] += np.log10(c)
        a = a / c[:, None]
    back = np.zeros(len(seqs))
    back[order] = out
    return back


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [np.frombuffer(x, np.uint16) for x in batch.column("seq").to_pylist()]
            order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
            scores = np.zeros(len(seqs))
            for i in range(0, len(order), 1024):
                group = order[i:i + 1024]
                scores[group] = log10_likelihood(model, [seqs[j] for j in group])
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside")], pa.array(scores)],
                                             ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "chain"])

    return run


def train(sequences: DataFrame, prior: np.ndarray, *, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Baum-Welch over the ``seq`` column; every round is one pass that covers all rows."""
    model = Model.drawn(prior, states, seed)
    for _ in range(rounds):
        summed = sequences.select("seq").mapInArrow(_expect(model), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        flat = np.zeros(2 * states + states * states + len(prior) * states)
        for r in summed.collect():  # the model's own size
            flat[r["at"]] = r["value"]
        model = Model.from_counts(flat, states, prior)
    return model


def most_frequent(counts: DataFrame, wanted: int) -> pd.DataFrame:
    """The *wanted* words of the highest counts (ties by hash) as ``h, c, suffix``, in that order.

    The least count among them is found by histograms of counts, and where more words have it than
    are wanted, the largest hash by a histogram of the hashes' upper bits.  So the driver gets the
    wanted words and at most one in 65,536 of the words that tie with the last, not that many from every partition.
    """
    bits, part = F.length(F.bin("c")), F.shiftright("h", 48)

    def histogram(of: Column, rows: DataFrame) -> dict[int, int]:
        return {r["x"]: r["n"] for r in rows.groupBy(of.alias("x")).agg(F.count("*").alias("n")).collect()}

    def reached(found: dict[int, int], order: list[int], need: int) -> tuple[int, int] | None:
        """The value at which the running number reaches *need*, and what came before it."""
        before = 0
        for x in order:
            if before + found[x] >= need:
                return x, before
            before += found[x]
        return None

    sizes = histogram(bits, counts)  # 64 rows at most
    size = reached(sizes, sorted(sizes, reverse=True), wanted)
    chosen = counts
    if size:
        alike = histogram(F.col("c"), counts.filter(bits == size[0]))  # no more than that many bits can tell apart, nor than words of that size
        least, before = reached(alike, sorted(alike, reverse=True), wanted - size[1])
        places = histogram(part, counts.filter(F.col("c") == least))  # 65,536 rows at most
        last, _ = reached(places, sorted(places), wanted - size[1] - before)
        chosen = counts.filter((F.col("c") > least) | ((F.col("c") == least) & (part <= last)))
    return chosen.select("h", "c", "suffix").toPandas().sort_values(["c", "h"], ascending=[False, True]).head(wanted)


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of *docs*: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Both scores are log10 probabilities of the lower-cased words and one end.  A text that
    is null or has no word is its end alone.  A null id is a training row.  Repeated rows count
    and come back as often as they are there.  Without training rows every word is unknown.
    An empty table gives an empty table; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counts = docs.mapInArrow(_counts, "h long, suffix int, c long").groupBy("h").agg(F.max("suffix").alias("suffix"), F.sum("c").alias("c"))
    counts = stored(counts.filter("c > 0"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    base_den = total["n"] + total["v"] + 1
    top = most_frequent(counts, HEAD)
    heads, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    own = np.full(len(heads), -1)
    is_word = heads != END
    own[np.flatnonzero(is_word)[:OWN]] = np.arange(min(OWN, int(is_word.sum())))
    # what the suffix classes hold: everything that is no class of its own
    n_in, v_in = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts.filter("suffix >= 0").groupBy("suffix").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most SUFFIXES rows
        n_in[r["suffix"]], v_in[r["suffix"]] = r["n"], r["v"]
    suffix = top["suffix"].to_numpy(np.int64)
    np.subtract.at(n_in, suffix[own >= 0], c[own >= 0])
    np.subtract.at(v_in, suffix[own >= 0], 1)
    inner_den = n_in + v_in + 1
    prior = np.zeros(CLASSES)
    prior[own[own >= 0]] = c[own >= 0]
    prior[OWN:OWN + SUFFIXES] = n_in
    prior[-1] = c[~is_word].sum()
    prior = (prior + 0.1) / (prior + 0.1).sum()
    order = np.argsort(heads)
    heads, c, own = heads[order], c[order], own[order]
    if not len(heads):
        heads, c, own = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.full(1, -1)
    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, seq binary, rest array<long>, suffix array<int>"
    drawn = stored(docs.mapInArrow(_sequences(heads, c, own, float(base_den), inner_den), kind))
    model = train(drawn.filter("NOT held_out"), prior, states=states, rounds=rounds)

    rest = drawn.select("row", F.explode(F.arrays_zip("rest", "suffix")).alias("w")).select("row", F.col("w.rest").alias("h"), F.col("w.suffix").alias("s"))
    rest = rest.groupBy("row", "h", "s").agg(F.count("*").alias("times")).join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    inside = F.element_at(F.lit(inner_den.tolist()), F.col("s") + 1)
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(base_den)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / inside)).alias("more_inside"))
    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, chain double"
    scored = drawn.drop("rest", "suffix").mapInArrow(_score(model), kind)
    out = scored.join(rest, "row", "left")

    def plus(a: str, b: str):
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
                      plus("base", "more_base").alias("base_score"), (F.col("chain") + plus("inside", "more_inside")).alias("score"))
