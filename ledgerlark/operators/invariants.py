"""What a cleaning run did, held against what its plan allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.clean import OPERATORS, RID, Step, cell_diff
from ledgerlark.operators.quality import duplicate_counts

VIOLATION = "rule string, column_name string, n long"


def permissions(steps: list[Step], columns: list[str]) -> dict[str, set[str] | bool]:
    """The union of what the steps' operators may do, per column."""
    allowed: dict = {k: set() for k in ("touch", "rewrite", "fill", "null", "dtype", "drop", "key_safe")}
    allowed.update(add=False, remove=False, subsets=[])
    for step in steps:
        if step.op not in OPERATORS:
            continue
        spec = OPERATORS[step.op][0]
        named = [step.params.get(k) for k in ("left", "right", "result")]
        targets = set(step.columns) | {c for c in named if c in columns}
        allowed["touch"] |= targets
        for flag, bucket in (("may_rewrite_values", "rewrite"), ("may_fill_nulls", "fill"), ("may_introduce_nulls", "null"),
                             ("may_change_dtype", "dtype"), ("may_drop_columns", "drop"), ("key_safe", "key_safe")):
            if getattr(spec, flag):
                allowed[bucket] |= targets
        allowed["add"] |= spec.may_add_columns
        if spec.may_remove_rows:
            allowed["remove"] = True
            allowed["subsets"].append(sorted(targets))
    return allowed


def unjustified_removals(raw: DataFrame, clean: DataFrame, subsets: list[list[str]], rid: str = RID) -> DataFrame:
    """Removed rows that are no copy of a surviving row on any of the dedupe keys."""
    left = raw.join(clean.select(rid), rid, "left_anti")
    survivors = raw.join(clean.select(rid), rid, "left_semi")
    shared = [c for c in raw.columns if c in clean.columns and c != rid]
    for subset in subsets or [[]]:
        keys = [c for c in subset if c in shared] or shared
        names = [f"__k{i}" for i in range(len(keys))]
        # one row per key: a key with many copies does not multiply the join
        kept = survivors.groupBy(*[F.col(k).cast("string").alias(n) for n, k in zip(names, keys, strict=True)]).agg(F.lit(1))
        same = [F.col(k).cast("string").eqNullSafe(F.col(n)) for n, k in zip(names, keys, strict=True)]
        left = left.join(kept.select(*names), same, "left_anti")
    return left


def invented_rows(raw: DataFrame, clean: DataFrame, rid: str = RID) -> DataFrame:
    """Rows of the output that were not in the input."""
    return clean.join(raw.select(rid), rid, "left_anti")


def check_invariants(raw: DataFrame, clean: DataFrame, steps: list[Step], *, keys: set[str] = frozenset(), rid: str = RID,
                     declared_removals: int | None = None) -> DataFrame:
    """Violations as rows; an empty result means the run passed."""
    columns = [c for c in raw.columns if c != rid]
    allowed = permissions(steps, columns)
    found: list[tuple[str, str | None, int]] = []

    def add(rule: str, column: str | None, n: int) -> None:
        if n > 0:
            found.append((rule, column, n))

    before = raw.count()
    after = clean.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(rid).alias("d")).first()
    add("row_identity", None, after["n"] - after["d"])
    add("rows_invented", None, invented_rows(raw, clean, rid).count())
    removed = before - after["n"]
    add("rows_added", None, -removed)
    if removed > 0 and not allowed["remove"]:
        add("unauthorized_row_removal", None, removed)
    elif removed > 0:
        if declared_removals is not None and declared_removals != removed:
            add("row_removal_mismatch", None, abs(removed - declared_removals))
        add("rows_removed_that_were_not_duplicates", None, unjustified_removals(raw, clean, allowed["subsets"], rid).count())
    add("empty_output", None, before if before and not after["n"] else 0)
    for c in columns:
        if c not in clean.columns and c not in allowed["drop"]:
            add("unauthorized_column_drop", c, 1)
    if not allowed["add"]:
        for c in clean.columns:
            if c not in raw.columns:
                add("unauthorized_column_add", c, 1)
    old, new = dict(raw.dtypes), dict(clean.dtypes)
    for c in columns:
        if c in new and new[c] != old[c] and c not in allowed["dtype"]:
            add("unauthorized_dtype_change", c, 1)
    for row in cell_diff(raw, clean, rid).collect():  # one row per column
        c = row["column_name"]
        if c not in allowed["rewrite"]:
            add("unauthorized_value_change", c, row["rewrote"])
        if c not in allowed["fill"]:
            add("unauthorized_null_fill", c, row["filled"])
        if c not in allowed["null"]:
            add("unauthorized_null_introduction", c, row["nulled"])
        if c in keys and c not in allowed["key_safe"]:
            add("join_key_modified", c, row["changed"])
    for k in sorted(keys & set(clean.columns) & set(columns)):
        copies = [duplicate_counts(t.where(F.col(k).isNotNull()), [k]).first()["later_copies"] for t in (raw, clean)]
        add("key_uniqueness_regression", k, copies[1] - copies[0])
    return raw.sparkSession.createDataFrame(found, VIOLATION)


def warnings(raw: DataFrame, clean: DataFrame, rid: str = RID) -> DataFrame:
    """Large row loss and columns of which a fifth could not be parsed."""
    lost = raw.agg(F.count(F.lit(1)).alias("a")).first()[0], clean.count()
    share = 1 - lost[1] / lost[0] if lost[0] else 0.0
    loss = raw.sparkSession.createDataFrame(
        [("large_row_loss", None, lost[0] - lost[1])] if share > 0.2 else [], VIOLATION)
    failed = cell_diff(raw, clean, rid).where("nulled >= before_present * 0.2 and nulled > 0").select(
        F.lit("high_parse_failure").alias("rule"), "column_name", F.col("nulled").alias("n"))
    return loss.unionByName(failed)


def validation_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows, nulls and duplicates before and after: a row per column and one for the table."""
    def wide(df: DataFrame, tag: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias(tag)) for c in df.columns if c != RID]
        return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))

    per = wide(raw, "nulls_before").join(wide(clean, "nulls_after"), "column_name").withColumn(
        "nulls_reduced", F.col("nulls_before") - F.col("nulls_after"))
    shared = [[c for c in df.columns if c != RID] for df in (raw, clean)]
    a, b = (duplicate_counts(df, cols).first() for df, cols in zip((raw, clean), shared, strict=True))
    whole = per.agg(*[F.sum(c).alias(c) for c in ("nulls_before", "nulls_after", "nulls_reduced")]).select(
        F.lit("(table)").alias("column_name"), "nulls_before", "nulls_after", "nulls_reduced",
        F.lit(a["rows"]).alias("rows_before"), F.lit(b["rows"]).alias("rows_after"),
        F.lit(a["later_copies"]).alias("duplicates_before"), F.lit(b["later_copies"]).alias("duplicates_after"))
    return whole.unionByName(per, allowMissingColumns=True)
