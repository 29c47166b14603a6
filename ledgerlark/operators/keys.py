"""Primary-key detection and the integrity gate of a set of tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.numbers import rnd
from ledgerlark.functions.scale import union_all
from ledgerlark.operators.detect import column_values
from ledgerlark.operators.quality import duplicate_counts, type_label

# Endings of key names.
KEY_ENDINGS = ("_id", "_fk", "_ref")
CANDIDATE_FLOOR, PAIR_CEILING, MAX_PAIR_COLUMNS = 0.5, 0.9, 6

KEY_RESULT = ("table_name string, status string, columns array<string>, is_composite boolean, uniqueness double, null_count long, "
              "duplicate_count long")


def key_like(column: str) -> bool:
    name = column.strip().lower()
    return name == "id" or name.endswith(KEY_ENDINGS)


def column_uniqueness(df: DataFrame) -> DataFrame:
    """Per column: share of distinct values, nulls, rows that share a value, mixed form.

    One estimating pass leaves out the columns that are far from unique; the rest
    are counted exactly, each (column, value) pair summed map-side first.
    """
    fields = {f.name: f for f in df.schema.fields if not f.name.startswith("_") and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    names = list(fields)
    rough = df.agg(*[F.struct(F.count(c).alias("n"), F.approx_count_distinct(c, 0.03).alias("d")).alias(c) for c in names]).first()
    close = [c for c in names if rough[c]["n"] and rough[c]["d"] >= 0.8 * CANDIDATE_FLOOR * rough[c]["n"]]
    if not close:
        close = [c for c in names if rough[c]["n"]][:1]
    texts = [c for c in close if type_label(fields[c].dataType) == "string"]
    counted = column_values(df, close).withColumn(
        "numeric", F.when(F.col("column_name").isin(texts), F.trim("value").try_cast("double").isNotNull()))
    per = counted.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.bool_and("numeric") | ~F.bool_or("numeric"), F.lit(True)).alias("stable"))
    order = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    likes = F.col("column_name").isin([c for c in names if key_like(c)])
    return per.where("present > 0").select(
        "column_name", F.try_element_at(order, F.col("column_name")).alias("position"), likes.alias("key_like"),
        (F.col("distinct") / F.col("present")).alias("uniqueness"), "null_count", "duplicate_count", "stable")


def _best(stats: DataFrame):
    rows = stats.orderBy(F.desc("key_like"), F.desc("uniqueness"), F.asc("null_count"), F.asc("position")).limit(1).collect()
    return rows[0] if rows else None


def primary_key(name: str, df: DataFrame) -> DataFrame:
    """Confirmed, candidate or no key of one table, as one row."""
    stats = column_uniqueness(df).persist()
    row = (name, "none", [], False, 0.0, 0, 0)
    sure = _best(stats.where("uniqueness = 1.0 and null_count = 0 and stable"))
    maybe = _best(stats.where(F.col("uniqueness") >= CANDIDATE_FLOOR))
    if sure is not None:
        row = (name, "confirmed", [sure["column_name"]], False, 1.0, 0, 0)
    else:
        pair = composite_key(df, stats) if maybe is None or maybe["uniqueness"] < PAIR_CEILING else None
        if pair is not None:
            row = (name, "confirmed", list(pair), True, 1.0, 0, 0)
        elif maybe is not None:
            row = (name, "candidate", [maybe["column_name"]], False, round(maybe["uniqueness"], 4), maybe["null_count"], maybe["duplicate_count"])
    stats.unpersist()
    return df.sparkSession.createDataFrame([row], KEY_RESULT)


def composite_key(df: DataFrame, stats: DataFrame | None = None) -> tuple[str, str] | None:
    """The first pair of columns that is unique together and never missing.

    Estimates rule pairs out first; what is left is proved on the whole table.
    """
    names = [f.name for f in df.schema.fields if not f.name.startswith("_") and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    likes = [c for c in names if key_like(c)]
    others = [c for c in names if c not in likes]
    shares = df.agg(*[(F.approx_count_distinct(c, 0.02) / F.nullif(F.count(c), F.lit(0))).alias(c) for c in others]).first().asDict() if others else {}
    exact = {r["column_name"]: r["uniqueness"] for r in stats.collect()} if stats is not None else {}  # one row per column
    ranked = sorted(others, key=lambda c: (-(exact.get(c) or shares[c] or 0.0), names.index(c)))
    chosen = (likes + ranked)[:MAX_PAIR_COLUMNS]
    pairs = list(combinations(chosen, 2))
    if not pairs:
        return None
    rough = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.struct(a, b), 0.02).alias(f"p{i}") for i, (a, b) in enumerate(pairs)],
                   *[F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in chosen]).first().asDict()
    for i, (a, b) in enumerate(pairs):
        if rough[f"null:{a}"] or rough[f"null:{b}"] or rough[f"p{i}"] < 0.9 * rough["n"]:
            continue
        if df.groupBy(a, b).count().where("count > 1").limit(1).count() == 0:
            return a, b
    return None


def primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    return union_all([primary_key(name, df) for name, df in tables.items()])


def dtype_issues(tables: dict[str, DataFrame]) -> DataFrame:
    """Text columns of which 90 to 99 percent look like numbers."""
    out = []
    for name, df in tables.items():
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
        if not texts:
            continue
        cells = [F.struct(F.lit(c).alias("column_name"), F.avg(F.when(F.col(c).isNotNull(), F.trim(c).try_cast("double").isNotNull().cast("int"))).alias("share"),
                          F.count_if(F.col(c).isNotNull() & F.trim(c).try_cast("double").isNull()).alias("mismatches")) for c in texts]
        out.append(df.agg(F.array(*cells).alias("s")).select(F.lit(name).alias("table_name"), F.inline("s")).where("share >= 0.9 and share < 1.0"))
    return union_all(out).select("table_name", "column_name", rnd(F.col("share"), 4).alias("numeric_share"), "mismatches")


def key_issues(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Confirmed keys held against the tables again: rows sharing a key, rows missing a part."""
    out = []
    for name, columns in keys.items():
        df = tables[name]
        missing = F.lit(False)
        for c in columns:
            missing = missing | F.col(c).isNull()
        copies = duplicate_counts(df, columns).select("all_copies").scalar()
        out.append(df.agg(F.count_if(missing).alias("null_count")).select(
            F.lit(name).alias("table_name"), F.array(*map(F.lit, columns)).alias("columns"), copies.alias("duplicate_count"), "null_count"))
    return union_all(out).where("duplicate_count > 0 or null_count > 0")


def confirmed(results: DataFrame) -> dict[str, list[str]]:
    """Key columns of the tables with a confirmed key (one row per table)."""
    return {r["table_name"]: list(r["columns"]) for r in results.where("status = 'confirmed'").collect()}


def integrity_report(tables: dict[str, DataFrame], relationships: list) -> DataFrame:
    """The gate: passes when no confirmed key and no enforced relationship is broken."""
    from ledgerlark.operators.relations import relationship_checks

    keys = confirmed(primary_keys(tables))
    spark = next(iter(tables.values())).sparkSession
    broken_keys = key_issues(tables, keys).count() if keys else 0
    checks = relationship_checks(tables, relationships, keys) if relationships else None
    blocking = checks.where("blocking").count() if checks is not None else 0
    duplicates = sum(1 for df in tables.values() if duplicate_counts(df).first()["all_copies"] > 0)
    return spark.createDataFrame(
        [(not broken_keys and not blocking, len(keys), broken_keys, len(relationships), blocking, duplicates)],
        "passed boolean, confirmed_keys int, key_issues int, relationships int, blocking_relationships int, tables_with_duplicate_rows int")
