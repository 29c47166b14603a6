"""Parquet tables that runs are written to and read from."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.monitor import snapshot_before
from ledgerlark.operators.relations import RELATIONSHIP


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


# --- project tables: staged, then published by one manifest row ----------------

_MANIFEST = "run_id string, saved_at timestamp, tables array<string>, relationships long"


def save_project(root: str, tables: dict[str, DataFrame], relationships: DataFrame | None = None, *, gate_passed: bool = True, saved_at: datetime) -> str:
    """Write all tables of a project as one unit.

    Every table goes to a folder of this run; the run counts only once its row is
    in the manifest, so readers never see half of it.
    """
    if not gate_passed:
        raise ValueError("the integrity gate did not pass; nothing was saved")
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/runs/{run}/{name}")
    n = 0
    if relationships is not None:
        relationships.write.mode("overwrite").parquet(f"{root}/runs/{run}/_relationships")
        n = spark.read.parquet(f"{root}/runs/{run}/_relationships").count()
    spark.createDataFrame([(run, saved_at, sorted(tables), n)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return run


def published_run(spark: SparkSession, root: str) -> str:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").agg(F.max_by("run_id", "saved_at")).first()[0]


def load_project(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    run = published_run(spark, root)
    names = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").where(F.col("run_id") == run).first()["tables"]
    return {n: spark.read.parquet(f"{root}/runs/{run}/{n}") for n in names}


def add_new_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns either lacks are NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


# --- snapshots and runs ---------------------------------------------------------


def replace_snapshot(path: str, state: DataFrame, column: str = "snapshot_date") -> None:
    """Replace just the dates in *state*; running it again changes nothing."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_run(path: str, rows: DataFrame, run_id: str) -> None:
    """Add the rows of one run; a repeated run replaces its own rows."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def save_churn_run(root: str, scores: DataFrame, summary: DataFrame, run_id: str) -> None:
    append_run(f"{root}/churn_scores", scores, run_id)
    append_run(f"{root}/churn_runs", summary, run_id)


def save_marketing_run(root: str, segments: DataFrame, campaigns: DataFrame, summary: DataFrame, run_id: str) -> None:
    append_run(f"{root}/marketing_segments", segments, run_id)
    append_run(f"{root}/marketing_campaigns", campaigns, run_id)
    append_run(f"{root}/marketing_runs", summary, run_id)


def save_forecast_run(root: str, actual: DataFrame, forecast: DataFrame, evaluations: DataFrame, run_id: str) -> None:
    """Actual and forecast rows in one table, told apart by ``kind``."""
    both = actual.withColumn("kind", F.lit("actual")).unionByName(forecast.withColumn("kind", F.lit("forecast")), allowMissingColumns=True)
    append_run(f"{root}/forecast_history", both, run_id)
    append_run(f"{root}/forecast_evaluations", evaluations, run_id)


def append_alerts(path: str, findings: DataFrame, run_date: date, run_id: str) -> None:
    findings.withColumns({"run_date": F.lit(run_date), "run_id": F.lit(run_id)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_date", "run_id").parquet(path)


# --- metric snapshots -------------------------------------------------------------

_SNAPSHOT = "project string, kind string, captured_at timestamp, metric string, value double"


def append_snapshot(path: str, metrics: DataFrame, captured_at: datetime, kind: str = "kpi") -> None:
    """(project, metric, value) rows of one moment."""
    rows = metrics.select("project", F.lit(kind).alias("kind"), F.lit(captured_at).cast("timestamp").alias("captured_at"), "metric", "value")
    rows.withColumn("day", F.to_date("captured_at")).write.mode("append").partitionBy("day").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SNAPSHOT).parquet(path) if exists(spark, path) else spark.createDataFrame([], _SNAPSHOT)


def capture(path: str, metrics: DataFrame, captured_at: datetime) -> list:
    """Record this run and return what was recorded before it.

    The earlier values are read out before anything is written: the other way
    round a run would be held against itself.
    """
    spark = metrics.sparkSession
    before = snapshot_before(read_snapshots(spark, path), captured_at).collect()  # a few metrics per project
    append_snapshot(path, metrics, captured_at)
    return before


# --- relationships ----------------------------------------------------------------


def replace_relationships(path: str, project: str, approved: DataFrame) -> None:
    rows = approved.withColumns({"project": F.lit(project), "status": F.lit("approved")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def load_relationships(spark: SparkSession, path: str, project: str) -> DataFrame:
    schema = RELATIONSHIP + ", status string, project string"
    return spark.read.schema(schema).parquet(path).where((F.col("project") == project) & (F.col("status") == "approved"))
