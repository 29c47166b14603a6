"""From raw documents to packed sequences: five stages, each a table of its own.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` stores each stage's result as Parquet in the shared folder before
the next one reads it.  A row stays or goes by its own verdict, whatever other rows share its doc_id
(null or not): the first two stages number the rows and store them with their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import minhash, mixing, packing, quality, secrets
from ledgerlark.llm.common import row_column, ship, stored


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """*docs*, stored with a number for each row, and that column's name."""
    row = row_column(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps."""
    ship(spark)
    rows, row = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    labels = rows.select(row, "doc_id").join(labels, "doc_id").select(row, "quality")
    rejected = quality.classify(rows, labels, id_col=row).filter("NOT kept")
    return rows.join(rejected.select(F.col("doc_id").alias(row)), row, "left_anti").drop(row)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest doc_id, nulls last.

    Texts without a word are linked with nothing; of these, rows with an id that are equal in all columns become one.
    """
    ship(spark)
    rows, row = _numbered(docs)
    found = minhash.near_duplicates(rows, id_col=row, shingle=5).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    found = stored(found.join(rows.select(row, F.col("doc_id").alias("id")), row))
    best = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", F.col(row).alias("number"))).alias("best"))
    empty = found.filter("n_shingles = 0")
    equal = rows.join(empty.filter("id IS NOT NULL").select(row), row, "left_semi").groupBy(*docs.columns).agg(F.min(row).alias("__first"))
    kept = best.select(F.col("best.number").alias(row)).unionAll(equal.select("__first")).unionAll(empty.filter("id IS NULL").select(row))
    return rows.join(kept, row, "left_semi").drop(row)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what the secret scan reports is masked, and n_chars follows the text."""
    masked = secrets.redact(secrets.scan(docs), spans_col=row_column(docs, "spans"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, shuffled globally."""
    return mixing.mix_sources(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and their places in sequences of at most 2048 ids."""
    ship(spark)
    return packing.pack(docs, cache=250_000)  # the executors' memory is that of the stages before, too


STAGES = [("quality", good_quality), ("near duplicates", one_of_each_group), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: Tokenizing and the hashes of the classifier have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
