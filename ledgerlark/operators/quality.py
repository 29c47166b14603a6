"""Data quality of a table as findings rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.scale import exact_quantiles, union_all


def type_label(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "boolean" if isinstance(kind, T.BooleanType) else "string"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if type_label(f.dataType) in ("integer", "float")]


def graded(share: Column, high: float = 10.0, medium: float = 3.0) -> Column:
    return F.when(share > high, "high").when(share > medium, "medium").otherwise("low")


def row_hashes(columns: list[str]) -> list[Column]:
    """128 bits of a row; equal rows agree, unlike ones nearly never."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(0x5DEECE66D), *columns[::-1])]


def duplicate_counts(df: DataFrame, columns: list[str] | None = None, hashes: Callable[[list[str]], list[Column]] = row_hashes) -> DataFrame:
    """Rows that repeat an earlier one, and rows that have any copy; nulls are equal.

    Hashes of rows are counted first; only rows whose hash repeats are compared whole, so a clean
    table moves 16 bytes a row, and a collision of hashes changes nothing.
    """
    columns = columns or df.columns
    if len(columns) <= 2:  # hardly wider than their hash
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        total = F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
        return groups.agg(total, *_copies())
    keyed = df.select(*columns, *[h.alias(f"__h{i}") for i, h in enumerate(hashes(columns))])
    keys = [c for c in keyed.columns if c.startswith("__h")]
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    again = keyed.join(counted.where("n > 1").select(*keys), keys, "left_semi")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return again.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(*_copies()).select(rows.scalar().alias("rows"), "later_copies", "all_copies")


def _copies() -> list[Column]:
    return [F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("later_copies"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("all_copies")]


def quality_report(
    df: DataFrame, *, money: list[str], quantity: str | None, outlier_factor: float = 3.0, min_rows: int = 5
) -> DataFrame:
    """(check_name, column_name, n, pct, severity) for missing, duplicates, outliers, signs, types."""
    numbers = numeric_columns(df)
    quartiles = exact_quantiles(df, numbers, [0.25, 0.75])
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in df.columns]
    for c in numbers:
        q1, q3 = quartiles[c]
        if q1 is None or q3 == q1:
            continue
        lo, hi = q1 - outlier_factor * (q3 - q1), q3 + outlier_factor * (q3 - q1)
        counts.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"outliers:{c}"))
    counts += [F.count_if(F.col(c) < 0).alias(f"negative:{c}") for c in money]
    if quantity:
        counts.append(F.count_if(F.col(quantity) == 0).alias(f"zero:{quantity}"))
    copies = duplicate_counts(df).select("later_copies").scalar()
    row = df.agg(*counts).select("*", copies.alias("duplicates")).first().asDict()
    return df.sparkSession.createDataFrame(
        _findings(row, df, numbers, money, quantity, min_rows),
        "check_name string, column_name string, n long, pct double, severity string",
    )


def _findings(row: dict, df: DataFrame, numbers: list[str], money: list[str], quantity: str | None, min_rows: int):
    """Grade the counts of one aggregate row; a handful of rows per column."""
    rows, cells = row["rows"], row["rows"] * len(df.columns)

    def pct(n: int, whole: int) -> float:
        return round(n / whole * 100, 2) if whole else 0.0

    def grade(p: float) -> str:
        return "high" if p > 10 else "medium" if p > 3 else "low"

    missing = sum(row[f"null:{c}"] for c in df.columns)
    yield "missing_values", None, missing, pct(missing, cells), grade(pct(missing, cells))
    for c in df.columns:
        if row[f"null:{c}"]:
            yield "missing_in_column", c, row[f"null:{c}"], pct(row[f"null:{c}"], rows), "info"
    copies = row["duplicates"]
    yield "duplicate_rows", None, copies, pct(copies, rows), grade(pct(copies, rows))
    for c in numbers:
        present = rows - row[f"null:{c}"]
        p = pct(row.get(f"outliers:{c}", 0), present)
        if present >= min_rows and p > 1:
            yield "outliers", c, row[f"outliers:{c}"], p, grade(p)
    for c in money:
        if row[f"negative:{c}"]:
            p = pct(row[f"negative:{c}"], rows - row[f"null:{c}"])
            yield "negative_values", c, row[f"negative:{c}"], p, "high" if p > 5 else "low"
    if quantity and row[f"zero:{quantity}"]:
        yield "zero_quantity", quantity, row[f"zero:{quantity}"], pct(row[f"zero:{quantity}"], rows), "low"
    for field in df.schema.fields:
        yield "column_type_" + type_label(field.dataType), field.name, None, None, "info"


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every table."""
    return union_all([
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.items()
    ])
