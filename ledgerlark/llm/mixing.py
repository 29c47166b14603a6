"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies of its documents that brings its text to the wanted
share.  A document's count inverts the Poisson distribution of that mean at a
uniform number drawn from a hash of its id and the seed, so it depends on nothing but these.
A mean above MOST is drawn as a sum of equal Poisson parts of MOST at most, each at a uniform number of its own.
Copies are put in the order of another hash: a global shuffle that is the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import row_column, stored, text_of

#: Weights follow the natural shares to this power: 1 keeps them, 0 makes sources equal.
TEMPERATURE = 0.5
SEED = 17
#: Beyond this mean the inversion would lose its first term to underflow; larger ones are sums of parts.
MOST = 500.0
#: Copies that one row of a source with several parts gives in one go; its blocks are dealt out.
BLOCK = 1000
#: Numbers (of 8 bytes) that the table of sources may hold to be sent to all tasks; a larger one is joined in salted parts.
BROADCAST = 1 << 20
SALTS = 32


def _hashed(*parts: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, epochs: float) -> tuple[DataFrame, float]:
    """``source, rate, parts, steps`` and the largest rate: per source its mean, the number of equal Poisson
    parts it is the sum of, and a part's cumulative probabilities to compare with.

    The table has a row for each source.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(text_of(text_col)) + 1).alias("size"))
    if weights is None:
        wanted = F.pow("size", F.lit(TEMPERATURE))
    else:
        wanted = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.select("source", F.col("size").cast("double"), wanted.cast("double").alias("weight"))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"), F.max(F.col("weight") / F.col("size")).alias("most"))
    one = total.first()
    scale = epochs * (one["all_size"] or 0.0) / (one["all_weight"] or 1.0)
    mean = F.col("weight") / (one["all_weight"] or 1.0) * epochs * (one["all_size"] or 0.0) / F.col("size")
    parts = F.greatest(F.ceil(F.col("rate") / MOST), F.lit(1))
    top = F.ceil(F.col("part") + 12 * F.sqrt("part") + 30).cast("int")
    start = F.struct(F.exp(-F.col("part")).alias("p"), F.exp(-F.col("part")).alias("c"), F.array(F.exp(-F.col("part"))).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("part") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["steps"], F.array(acc["c"] + p)).alias("steps"))

    table = sizes.select("source", mean.alias("rate")).withColumn("parts", parts).withColumn("part", F.col("rate") / F.col("parts"))
    return table.select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["steps"]).alias("steps")), scale * (one["most"] or 0.0)


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None,
                epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """All columns of *docs* with ``copy`` (from 0), ``n_copies``, ``rate`` and ``shuffle_key``, in shuffled order.

    *weights*: share of each source in the result (others get none); without it shares to the
    power TEMPERATURE.  *epochs*: expected size of the result in sizes of the input (characters,
    one more for each document).  Documents with a count of 0 do not occur: that is the method.

    A null text has size 1; null sources are one source of their own (never one of *weights*).  A
    null id hashes as an empty one; rows with equal ids share their count.  An empty table gives an empty
    table.  The four new columns get a leading underscore where *docs* has such a name.
    """
    table, largest = rates(docs, source_col, text_col, weights, epochs)
    table = stored(table.select(*[F.col(c).alias(f"__{c}") for c in ("source", "rate", "parts", "steps")]))
    few = (table.agg(F.sum(F.size("__steps") + 8)).first()[0] or 0) <= BROADCAST
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))

    def uniform(*more: Column) -> Column:
        return _hashed(key, F.lit(seed), F.lit("count"), *more, digits=13) / F.lit(float(1 << 52))

    def count(us: Column) -> Column:
        return F.aggregate(us, F.lit(0).cast("long"), lambda n, u: n + F.size(F.filter("__steps", lambda c: u >= c)))

    def drawn(chosen: DataFrame, us: Column) -> DataFrame:
        if few:
            joined = docs.join(F.broadcast(chosen), docs[source_col].eqNullSafe(F.col("__source")))
        else:  # a source's documents are dealt to several tasks, its row goes to all of them
            salted = docs.withColumn("__salt", F.pmod(F.xxhash64(key, text_col), F.lit(SALTS)))
            chosen = chosen.withColumn("__of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            joined = salted.join(chosen, salted[source_col].eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__of"))).drop("__salt", "__of")
        return joined.withColumn("__u", us).withColumn("__n", count(F.col("__u"))).drop("__u", "__steps").filter("__n > 0")

    zero = F.lit(0).cast("long")
    out = drawn(table.filter("__parts = 1"), F.array(uniform())).withColumn("__copy", F.explode(F.sequence(zero, F.col("__n") - 1)))
    if largest > MOST / 2:  # a bound that rounding cannot miss; without such a source the second half has no row
        us = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__parts")), lambda j: uniform(j))
        many = drawn(table.filter("__parts > 1"), us).withColumn("__block", F.explode(F.sequence(zero, F.floor((F.col("__n") - 1) / BLOCK))))
        many = many.repartition(F.xxhash64(key, "__block"))
        last = F.least(F.col("__n"), (F.col("__block") + 1) * BLOCK) - 1
        out = out.unionByName(many.withColumn("__copy", F.explode(F.sequence(F.col("__block") * BLOCK, last))).drop("__block"))
    out = out.withColumn("__order", _hashed(key, F.col("__copy"), F.lit(seed), F.lit("order"), digits=15))
    new = {row_column(docs, n): F.col(c) for n, c in (("copy", "__copy"), ("n_copies", "__n"), ("rate", "__rate"), ("shuffle_key", "__order"))}
    return out.orderBy("__order", id_col, "__copy").select(*[docs[c] for c in docs.columns], *[c.alias(n) for n, c in new.items()])
