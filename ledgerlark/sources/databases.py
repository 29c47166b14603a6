"""Tables of a linked database over JDBC.

None of this is exercised against a live database in the tests: they check what
is asked of Spark, not a connection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.operators.relations import Relationship

#: declared foreign keys, as every database with an information schema lists them
FOREIGN_KEYS = """SELECT k.table_name AS table_a, k.column_name AS column_a, p.table_name AS table_b, p.column_name AS column_b
FROM information_schema.key_column_usage k
JOIN information_schema.referential_constraints r ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema
JOIN information_schema.key_column_usage p ON r.unique_constraint_name = p.constraint_name AND k.position_in_unique_constraint = p.ordinal_position"""


def checked_select(sql: str) -> str:
    """The statement, when it is a single SELECT; anything else is refused."""
    text = re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.DOTALL).strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", text) or ";" in text:
        raise ValueError("only a single SELECT may be passed through")
    if re.search(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant)\b", re.sub(r"'[^']*'", "''", text)):
        raise ValueError("only a reading statement may be passed through")
    return text


def table_options(url: str, table: str, *, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 32,
                  properties: dict[str, str] | None = None) -> dict[str, str]:
    """Reader options: with a numeric column and its bounds the table is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **(properties or {})}
    if partition_column and bounds:
        options.update(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return options


def read_table(spark: SparkSession, url: str, table: str, *, row_limit: int | None = None, **options) -> DataFrame:
    df = spark.read.format("jdbc").options(**table_options(url, table, **options)).load()
    return df.limit(row_limit) if row_limit else df  # the limit is pushed to the database


def sample_tables(spark: SparkSession, url: str, tables: list[str], row_limit: int, **options) -> dict[str, DataFrame]:
    return {t: read_table(spark, url, t, row_limit=row_limit, **options) for t in tables}


def select(spark: SparkSession, url: str, sql: str, properties: dict[str, str] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=checked_select(sql), **(properties or {})).load()


def declared_relationships(spark: SparkSession, url: str, sql: str = FOREIGN_KEYS, properties: dict[str, str] | None = None) -> list[Relationship]:
    """Foreign keys of the database, with full confidence (a row per key column)."""
    rows = select(spark, url, sql, properties).collect()
    return [Relationship(r[0], r[1], r[2], r[3], 1.0, "declared") for r in rows]
