"""The data work behind scheduled runs, as Structured Streaming jobs.

Event times are cast to TIMESTAMP: a watermark is refused on one without zone.
All sinks are files keyed by batch id, so a replayed batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions.numbers import fingerprint
from ledgerlark.sources.buckets import Buckets, newest
from ledgerlark.sources.store import exists


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run(writer, path: str) -> StreamingQuery:
    """Process what there is and stop; state and progress live under *path*."""
    query = writer.option("checkpointLocation", f"{path}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def metric_windows(events: DataFrame, *, ts: str = "ts", value: str = "value", group: str = "event_type", delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Metrics per tumbling window; rows later than the delay are dropped and counted."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
        .groupBy(F.window(ts, width), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(ts).alias("newest"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "n", "total", "newest"))


def keep_windows(windows: DataFrame, path: str, group: str = "event_type") -> StreamingQuery:
    """Every batch replaces the windows it changed, open ones too; buckets of other windows are left alone."""
    keys = ["start", "end", group]

    def store(batch: DataFrame, batch_id: int) -> None:
        Buckets(batch.sparkSession, f"{path}/windows", keys).upsert(batch, batch_id, newest(keys))

    return run(windows.writeStream.outputMode("update").foreachBatch(store), path)


def current_windows(spark: SparkSession, path: str, group: str = "event_type") -> DataFrame:
    return Buckets(spark, f"{path}/windows", ["start", "end", group]).read()


def _deliverable(cooldown: int):
    """Of rows sorted by fingerprint and time, those a cooldown after the last delivered one; the fold keeps one time stamp."""

    def run(batches):
        import pyarrow as pa

        about, last = None, None
        for batch in batches:
            taken = []
            for fingerprint, at, before in zip(*[batch.column(c).to_pylist() for c in ("fingerprint", "__at", "__last")], strict=True):
                if fingerprint != about:
                    about, last = fingerprint, before
                taken.append(last is None or at - last >= cooldown)
                last = at if taken[-1] else last
            yield batch.filter(pa.array(taken, pa.bool_()))

    return run


def deliver_alerts(alerts: DataFrame, path: str, *, ts: str = "ts", cooldown_seconds: int = 86_400, delay_seconds: int = 0) -> StreamingQuery:
    """Write an alert to ``<path>/alerts`` unless its fingerprint was delivered less than a cooldown before.

    Alerts are judged in time order.  *delay_seconds* holds the newest ones back until the newest alert seen is that much
    younger, so files may come in any order within the delay and give the same deliveries; without a delay the order holds within a batch.
    The last deliveries are a bucketed table: a batch reads the buckets of its fingerprints, and entries too old
    to hold anything back are dropped from them.

    An alert older than the last delivery of its fingerprint is not delivered.  One that comes more than a cooldown
    behind what has been judged is late: dropped, and counted (`late_alerts`).
    """
    cooldown, delay = cooldown_seconds * 1_000_000, delay_seconds * 1_000_000

    def batch(fresh: DataFrame, number: int) -> None:
        spark = fresh.sparkSession
        last = Buckets(spark, f"{path}/last", ["fingerprint"])
        found = last.published(number)
        facts = found[2] if found else {}
        at = F.unix_micros(F.col(ts).cast("timestamp"))
        held = fresh.persist()
        rows = held.withColumn("__at", at)
        judged = int(facts["judged"]) if "judged" in facts else None
        seen = rows.agg(F.max("__at").alias("newest"), F.count_if(F.col("__at") < (judged - cooldown if judged is not None else None)).alias("late")).first()
        mark = max(m for m in (judged, seen["newest"] - delay if seen["newest"] is not None else None, -(1 << 62)) if m is not None)
        if judged is not None:
            rows = rows.where(F.col("__at") >= judged - cooldown)
        if found and exists(spark, f"{path}/waiting/batch={found[0]}"):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/waiting/batch={found[0]}"))
        rows.where(F.col("__at") > mark).write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        ready = rows.where(F.col("__at") <= mark)
        before = last.rows_around(ready, number)
        ready = ready.join(before, "fingerprint", "left") if before is not None else ready.withColumn("__last", F.lit(None).cast("long"))
        ordered = ready.repartition("fingerprint").sortWithinPartitions("fingerprint", "__at", *[c for c in alerts.columns if c not in ("fingerprint", ts)])
        ordered.mapInArrow(_deliverable(cooldown), ordered.schema).drop("__at", "__last").write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
        sent = spark.read.schema(alerts.schema).parquet(f"{path}/alerts/batch={number}").withColumn("__at", at)
        # an alert still to come is at most a cooldown older than the mark, so an older entry than this holds nothing back
        kept = lambda both: both.groupBy("fingerprint").agg(F.max("__last").alias("__last")).where(F.col("__last") > mark - 2 * cooldown)
        told = {"judged": str(mark), "late": str(int(facts.get("late", 0)) + seen["late"])}
        last.upsert(sent.groupBy("fingerprint").agg(F.max("__at").alias("__last")), number, kept, facts=told)
        held.unpersist()

    return run(alerts.writeStream.foreachBatch(batch), path)


def late_alerts(spark: SparkSession, path: str) -> int:
    """Alerts that came too late to be judged."""
    found = Buckets(spark, f"{path}/last", ["fingerprint"]).published()
    return int(found[2].get("late", 0)) if found else 0


def alerts_of(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", fingerprint("event", F.col("user_id"), F.col("event_type")).alias("fingerprint"))


def customer_counters(events: DataFrame, *, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Newest event and number of events per customer, kept up to date (update mode)."""
    return events.groupBy(F.col(key).alias("customer")).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"))


def keep_counters(counters: DataFrame, path: str) -> StreamingQuery:
    """Every batch replaces the customers it changed; buckets without any of them are left alone."""
    def store(batch: DataFrame, batch_id: int) -> None:
        Buckets(batch.sparkSession, f"{path}/counters", ["customer"]).upsert(batch, batch_id, newest(["customer"]))

    return run(counters.writeStream.outputMode("update").foreachBatch(store), path)


def current_counters(spark: SparkSession, path: str) -> DataFrame:
    return Buckets(spark, f"{path}/counters", ["customer"]).read().select("customer", "last", "events")


def keep_distinct_orders(events: DataFrame, path: str, *, key: str, order: str) -> StreamingQuery:
    """All (customer, order) pairs; a batch reads the buckets of its customers, not what was seen of others."""
    def store(batch: DataFrame, batch_id: int) -> None:
        pairs = batch.select(F.col(key).alias("customer"), F.col(order).alias("order")).distinct()
        Buckets(batch.sparkSession, f"{path}/pairs", ["customer"]).upsert(pairs, batch_id, lambda both: both.select("customer", "order").distinct())

    return run(events.writeStream.foreachBatch(store), path)


def distinct_orders(spark: SparkSession, path: str) -> DataFrame:
    return Buckets(spark, f"{path}/pairs", ["customer"]).read().groupBy("customer").agg(F.count(F.lit(1)).alias("orders"))


def append_files(stream: DataFrame, path: str) -> StreamingQuery:
    """New files with their name; columns an older file lacks are NULL on read."""
    named = stream.withColumn("_source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    return run(named.writeStream.foreachBatch(store), path)


def appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{path}/rows").drop("batch")


def watch_freshness(events: DataFrame, path: str, as_of: Callable[[int], datetime], *, ts: str = "ts", warn_days: int = 3, critical_days: int = 7) -> StreamingQuery:
    """Per batch the age of its newest row at the batch's as-of time."""
    def store(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max(ts).cast("timestamp").alias("newest"))
        days = F.date_diff(F.lit(as_of(batch_id)).cast("date"), F.to_date("newest"))
        level = F.when(days >= critical_days, "critical").when(days >= warn_days, "high").otherwise("fresh")
        newest.select("newest", days.alias("days"), level.alias("severity")).coalesce(1).write.mode("overwrite").parquet(f"{path}/checks/batch={batch_id}")

    return run(events.writeStream.foreachBatch(store), path)
