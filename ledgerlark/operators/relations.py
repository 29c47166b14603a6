"""Relationships between tables: discovery, joins along them, orphans and cardinality."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as tx
from ledgerlark.functions.scale import union_all
from ledgerlark.operators.clean import keep_one
from ledgerlark.operators.keys import key_like
from ledgerlark.operators.quality import type_label


@dataclass(frozen=True)
class Relationship:
    """table_a.column_a (the many side) refers to table_b.column_b."""

    table_a: str
    column_a: str
    table_b: str
    column_b: str
    confidence: float = 1.0
    source: str = "given"


RELATIONSHIP = ("table_a string, column_a string, table_b string, column_b string, confidence double, evidence map<string,double>, source string")


def name_similarity(a: str, b: str) -> float:
    a, b = a.strip().lower(), b.strip().lower()
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


# --- fact view ----------------------------------------------------------------


def largest_table(tables: dict[str, DataFrame]) -> DataFrame:
    counts = union_all([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])
    return counts.agg(F.max_by("table_name", F.struct("rows", "table_name")).alias("table_name"), F.max("rows").alias("rows"))


def rank_fact_tables(tables: dict[str, DataFrame], relationships: list[Relationship]) -> DataFrame:
    """Non-empty tables by how often they are the many side."""
    spark = next(iter(tables.values())).sparkSession
    filled = [n for n, df in tables.items() if not df.isEmpty()]
    uses = spark.createDataFrame([(r.table_a,) for r in relationships] or [], "table_name string").groupBy("table_name").agg(F.count(F.lit(1)).alias("uses"))
    names = spark.createDataFrame([(n,) for n in filled], "table_name string")
    return names.join(uses, "table_name", "left").select("table_name", F.coalesce("uses", F.lit(0)).alias("uses"))


def fact_view(tables: dict[str, DataFrame], relationships: list[Relationship], fact: str) -> DataFrame:
    """The fact table left-joined to every directly related table.

    The key of the other side is dropped and clashing columns carry its name.
    No broadcast is forced: whether a side is small enough is decided by its size.
    """
    out, taken, joined = tables[fact], set(tables[fact].columns), {fact}
    for r in relationships:
        if r.table_a != fact or r.table_b in joined or r.table_b not in tables:
            continue
        dim = tables[r.table_b]
        if r.column_a not in taken or r.column_b not in dim.columns:
            continue
        renamed = {c: c if c not in taken else f"{r.table_b}_{c}" for c in dim.columns if c != r.column_b}
        side = dim.select(F.col(r.column_b).alias("__key"), *[F.col(c).alias(n) for c, n in renamed.items()])
        out = out.join(side, F.col(r.column_a) == F.col("__key"), "left").drop("__key")
        taken |= set(renamed.values())
        joined.add(r.table_b)
    return out


# --- combining files ----------------------------------------------------------


def lowered(df: DataFrame) -> dict[str, str]:
    return {c.strip().lower(): c for c in df.columns}


def join_key_tests(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Per shared column: uniqueness in the dimension and share of fact values found there."""
    shared = [(lowered(fact)[low], c) for low, c in lowered(dim).items() if low in lowered(fact)]
    out = []
    for fc, dc in shared:
        values = dim.where(F.col(dc).isNotNull()).groupBy(F.col(dc).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        unique = values.agg(F.count(F.lit(1)) / F.sum("n")).scalar()
        # fact values are counted before the join, so a common value is one row
        seen = fact.where(F.col(fc).isNotNull()).groupBy(F.col(fc).alias("f")).agg(F.count(F.lit(1)).alias("m"))
        hit = seen.join(values, F.col("f") == F.col("v"), "left")
        out.append(hit.agg((F.sum(F.when(F.col("v").isNotNull(), F.col("m")).otherwise(0)) / F.sum("m")).alias("coverage")).select(
            F.lit(dc).alias("column_name"), unique.alias("uniqueness"), "coverage"))
    if not out:
        return fact.sparkSession.createDataFrame([], "column_name string, uniqueness double, coverage double, accepted boolean")
    return union_all(out).withColumn("accepted", (F.col("uniqueness") >= 0.95) & (F.col("coverage") >= 0.5))


def join_key(fact: DataFrame, dim: DataFrame) -> str | None:
    rows = join_key_tests(fact, dim).where("accepted").orderBy(F.desc(F.col("uniqueness") + F.col("coverage")), "column_name").limit(1).collect()
    return rows[0]["column_name"] if rows else None


@dataclass(frozen=True)
class CombinePlan:
    strategy: str  # single, append, join or separate
    primary: str
    joins: tuple[tuple[str, str], ...] = ()
    ignored: tuple[str, ...] = ()


def plan_combination(tables: dict[str, DataFrame], primary: str | None = None) -> CombinePlan:
    names = list(tables)
    if len(names) == 1:
        return CombinePlan("single", names[0])
    if len({frozenset(lowered(df)) for df in tables.values()}) == 1:
        return CombinePlan("append", names[0])
    fact = primary or largest_table(tables).first()["table_name"]
    keys = {n: join_key(tables[fact], tables[n]) for n in names if n != fact}
    joins = tuple((n, k) for n, k in keys.items() if k)
    return CombinePlan("join" if joins else "separate", fact, joins, tuple(n for n, k in keys.items() if not k))


def append_files(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack files of one schema in the first file's spelling, with their name."""
    canon = lowered(next(iter(tables.values())))
    return union_all([df.toDF(*[canon.get(c.strip().lower(), c) for c in df.columns]).withColumn("_source_file", F.lit(n)) for n, df in tables.items()])


def star_join(fact: DataFrame, dim: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Left join to one row per key (the first in the given order); overlapping columns of the dimension are dropped."""
    fact_key = lowered(fact)[key.strip().lower()]
    numbered = dim.withColumn("_rid", F.struct(*order))
    one = keep_one(numbered, [key]).drop("_rid")
    kept = [c for c in one.columns if c == key or c.strip().lower() not in lowered(fact)]
    side = one.select(*[F.col(c).alias("__key") if c == key else F.col(c) for c in kept])
    return fact.join(side, F.col(fact_key) == F.col("__key"), "left").drop("__key")


def combine(tables: dict[str, DataFrame], plan: CombinePlan) -> DataFrame:
    if plan.strategy == "append":
        return append_files(tables)
    out = tables[plan.primary]
    for name, key in plan.joins:
        out = star_join(out, tables[name], key, tables[name].columns)
    return out


# --- discovery ----------------------------------------------------------------


def plausible_pairs(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str, float]]:
    """Column pairs whose names allow a relationship; decided from names alone."""
    names, out = list(tables), []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            for ca in tables[a].columns:
                for cb in tables[b].columns:
                    s = name_similarity(ca, cb)
                    if s >= 0.5 or key_like(ca) or key_like(cb):
                        out.append((a, ca, b, cb, s))
    return out


def _family(df: DataFrame, c: str) -> tuple[str, Column]:
    kind = type_label(df.schema[c].dataType)
    if kind in ("integer", "float"):
        return "number", F.col(c).cast("decimal(38,6)").cast("string")
    return kind, F.col(c).cast("string")


def find_relationships(tables: dict[str, DataFrame]) -> DataFrame:
    """The best column pair of every two tables, from one shuffle of all candidate columns.

    Values of all columns are counted together; then every value is one row that
    knows in which columns it occurs, and all pairs are sums over those rows.
    """
    pairs = plausible_pairs(tables)
    spark = next(iter(tables.values())).sparkSession
    wanted = sorted({(a, ca) for a, ca, *_ in pairs} | {(b, cb) for _, _, b, cb, _ in pairs})
    if not pairs:
        return spark.createDataFrame([], RELATIONSHIP)
    ids = {col: i for i, col in enumerate(wanted)}
    parts, family = [], {}
    for name, df in tables.items():
        mine = [(t, c) for t, c in wanted if t == name]
        if not mine:
            continue
        cells = []
        for t, c in mine:
            kind, value = _family(df, c)
            family[t, c] = kind
            cells.append(F.struct(F.lit(ids[t, c]).alias("col"), F.lit(kind).alias("family"), value.alias("value")))
        parts.append(df.select(F.inline(F.array(*cells))).where("value is not null").groupBy("col", "family", "value").agg(F.count(F.lit(1)).alias("n")))
    presence = union_all(parts).groupBy("family", "value").agg(*[F.sum(F.when(F.col("col") == i, F.col("n"))).alias(f"n{i}") for i in ids.values()])
    sums = [F.sum(f"n{i}").alias(f"total{i}") for i in ids.values()] + [F.count(f"n{i}").alias(f"distinct{i}") for i in ids.values()]
    both = sorted({(ids[x], ids[y]) for a, ca, b, cb, _ in pairs for x, y in (((a, ca), (b, cb)), ((b, cb), (a, ca)))})
    sums += [F.sum(F.when(F.col(f"n{y}").isNotNull(), F.col(f"n{x}"))).alias(f"hit{x}_{y}") for x, y in both]
    row = presence.agg(*sums).first().asDict()  # a few numbers per column pair
    unique = {i: row[f"distinct{i}"] / row[f"total{i}"] if row[f"total{i}"] else 0.0 for i in ids.values()}
    best: dict[tuple[str, str], tuple] = {}
    for a, ca, b, cb, sim in pairs:
        x, y = ids[a, ca], ids[b, cb]
        # the more unique side is the key side
        fk, pk, fx, px = ((b, cb), (a, ca), y, x) if unique[x] >= unique[y] else ((a, ca), (b, cb), x, y)
        if unique[px] < 0.5:
            continue
        numeric = [family[c] == "number" for c in (fk, pk)]
        dtype = 1.0 if numeric[0] == numeric[1] else 0.6 if _both_numeric(tables, fk, pk) else 0.0
        coverage = (row[f"hit{fx}_{px}"] or 0) / row[f"total{fx}"] if row[f"total{fx}"] else 0.0
        confidence = 0.25 * sim + 0.15 * dtype + 0.30 * unique[px] + 0.30 * coverage
        evidence = {"name_similarity": round(sim, 3), "dtype_compatibility": dtype, "pk_uniqueness": round(unique[px], 3), "fk_coverage": round(coverage, 3)}
        if (a, b) not in best or round(confidence, 4) > best[a, b][4]:
            best[a, b] = (*fk, *pk, round(confidence, 4), evidence, "heuristic")
    return spark.createDataFrame(list(best.values()), RELATIONSHIP)


def _both_numeric(tables: dict[str, DataFrame], *columns: tuple[str, str]) -> bool:
    return all(tables[t].agg(tx.all_numeric(F.col(c).cast("string"))).first()[0] for t, c in columns)


def bucketed(candidates: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return candidates.withColumn("bucket", F.when(c >= 0.85, "auto").when(c >= 0.5, "review").otherwise("manual"))


def review_stats(candidates: DataFrame) -> DataFrame:
    e = F.col("evidence")
    return candidates.select(
        "table_a", "column_a", "table_b", "column_b", e["pk_uniqueness"].alias("pk_uniqueness"), e["fk_coverage"].alias("fk_coverage"),
        F.round(1 - e["fk_coverage"], 3).alias("orphan_ratio"), (e["dtype_compatibility"] >= 0.6).alias("dtype_compatible"))


# --- orphans and cardinality --------------------------------------------------


def _normal(df: DataFrame, c: str, numeric: bool) -> DataFrame:
    form = tx.key_number(c) if numeric else tx.key_text(c)
    return df.select(form.alias("k"), F.col(c).cast("string").alias("raw")).where("k is not null")


def is_numeric_key(df: DataFrame, c: str) -> bool:
    if type_label(df.schema[c].dataType) in ("integer", "float"):
        return True
    return bool(df.agg(tx.all_numeric(c)).first()[0])


def orphans(fk: DataFrame, fc: str, pk: DataFrame, pc: str, *, exact: bool = False) -> DataFrame:
    """Values of the key without a match, with how many rows hold each.

    Key values are counted before the join, so a value held by a third of the
    rows is one row there.
    """
    if exact:
        left = fk.select(F.col(fc).alias("k"), F.col(fc).cast("string").alias("raw")).where("k is not null")
        right = pk.select(F.col(pc).alias("k")).where("k is not null")
    else:
        left, right = _normal(fk, fc, is_numeric_key(fk, fc)), _normal(pk, pc, is_numeric_key(pk, pc)).select("k")
    counted = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw"))
    return counted.join(right, "k", "left_anti")


def orphan_rate(fk: DataFrame, fc: str, pk: DataFrame, pc: str, *, exact: bool = False) -> DataFrame:
    lost = orphans(fk, fc, pk, pc, exact=exact)
    total = fk.agg(F.count(fc)).scalar()
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
        "orphans", F.coalesce(F.round(F.col("orphans") / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("orphan_rate"))


def orphan_sample(fk: DataFrame, fc: str, pk: DataFrame, pc: str, limit: int = 10, *, exact: bool = False) -> DataFrame:
    return orphans(fk, fc, pk, pc, exact=exact).select("raw").orderBy("raw").limit(limit)


def reconcile(relationships: list[Relationship], raw: dict[str, DataFrame], cleaned: dict[str, DataFrame], tolerance: float = 0.02) -> DataFrame:
    """Orphan rate of the raw against the cleaned tables; it may grow by the tolerance at most."""
    out = []
    for r in relationships:
        before, after = (orphan_rate(t[r.table_a], r.column_a, t[r.table_b], r.column_b).select("orphan_rate").scalar() for t in (raw, cleaned))
        spark = raw[r.table_a].sparkSession
        out.append(spark.range(1).select(F.lit(r.table_a).alias("table_a"), F.lit(r.column_a).alias("column_a"), F.lit(r.table_b).alias("table_b"),
                                         before.alias("rate_before"), after.alias("rate_after")))
    delta = F.round(F.col("rate_after") - F.col("rate_before"), 4)
    return union_all(out).withColumn("delta", delta).withColumn("within_tolerance", F.col("delta") <= tolerance)


def normalised_keys(tables: dict[str, DataFrame], relationships: list[Relationship]) -> dict[str, DataFrame]:
    """The tables with the key columns of all relationships in normal form."""
    out = dict(tables)
    for r in relationships:
        for t, c in ((r.table_a, r.column_a), (r.table_b, r.column_b)):
            form = tx.key_number(c) if is_numeric_key(out[t], c) else tx.key_text(c)
            out[t] = out[t].withColumn(c, form)
    return out


def relationship_checks(tables: dict[str, DataFrame], relationships: list[Relationship], keys: dict[str, list[str]]) -> DataFrame:
    """Orphans, cardinality, bridge need, and whether the relationship blocks the save."""
    out = []
    for r in relationships:
        a, b = tables[r.table_a], tables[r.table_b]
        lost = orphan_rate(a, r.column_a, b, r.column_b)
        enforced = keys.get(r.table_b) == [r.column_b]
        if enforced and not (is_numeric_key(a, r.column_a) or is_numeric_key(b, r.column_b)):
            exact = orphan_rate(a, r.column_a, b, r.column_b, exact=True)
            if exact.first()["orphans"]:
                lost = exact
        unique = [t.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)) == 1).scalar()
                  for t, c in ((a, r.column_a), (b, r.column_b))]
        out.append(lost.select(
            F.lit(r.table_a).alias("table_a"), F.lit(r.column_a).alias("column_a"), F.lit(r.table_b).alias("table_b"), F.lit(r.column_b).alias("column_b"),
            "orphans", "orphan_rate", unique[0].alias("a_unique"), unique[1].alias("b_unique"), F.lit(enforced).alias("fk_will_be_enforced")))
    card = (F.when(F.col("a_unique") & F.col("b_unique"), "one_to_one").when(F.col("b_unique"), "one_to_many")
            .when(F.col("a_unique"), "many_to_one").otherwise("many_to_many"))
    return union_all(out).withColumn("cardinality", card).select(
        "table_a", "column_a", "table_b", "column_b", "orphans", "orphan_rate", "cardinality", (F.col("cardinality") == "many_to_many").alias("needs_bridge_table"),
        "fk_will_be_enforced", (F.col("fk_will_be_enforced") & (F.col("orphans") > 0)).alias("blocking"))


# --- identifiers --------------------------------------------------------------


def sanitize_identifier(name: str) -> str:
    """A safe column or table name; letters of any script stay."""
    words = re.findall(r"\w+", name.lower())
    safe = "_".join(words).strip("_") or "column"
    return "_" + safe if safe[0].isdigit() else safe


def sanitized_names(names: list[str]) -> dict[str, str]:
    """Old to new names; a name already taken gets a number."""
    out: dict[str, str] = {}
    for name in names:
        base = new = sanitize_identifier(name)
        k = 2
        while new in out.values():
            new = f"{base}_{k}"
            k += 1
        out[name] = new
    return out


def sanitize_all(tables: dict[str, DataFrame], relationships: list[Relationship], keys: dict[str, list[str]] | None = None):
    """Tables, relationships and keys under safe names."""
    names = sanitized_names(list(tables))
    columns = {t: sanitized_names(df.columns) for t, df in tables.items()}
    renamed = {names[t]: df.toDF(*[columns[t][c] for c in df.columns]) for t, df in tables.items()}
    related = [Relationship(names[r.table_a], columns[r.table_a][r.column_a], names[r.table_b], columns[r.table_b][r.column_b], r.confidence, r.source)
               for r in relationships]
    return renamed, related, {names[t]: [columns[t][c] for c in cols] for t, cols in (keys or {}).items()}


def relationships_frame(spark, relationships: list[Relationship]) -> DataFrame:
    rows = [(r.table_a, r.column_a, r.table_b, r.column_b, r.confidence, {}, r.source) for r in relationships]
    return spark.createDataFrame(rows, RELATIONSHIP)


