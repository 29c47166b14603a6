"""Queries that write and read back: sinks, snapshots and streams.

Each run works in a fresh folder below the session's checkpoint folder.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerlark.functions.numbers import rnd
from ledgerlark.functions.scale import ensure_checkpoint_dir, materialise
from ledgerlark.operators import relations
from ledgerlark.plans.customers import _snapshots as customer_snapshots
from ledgerlark.plans.customers import _SNAPSHOTS
from ledgerlark.plans.registry import query
from ledgerlark.plans.relations import LINE_RELATIONS, _discover_sql, _discover_tables
from ledgerlark.plans.tables import FACT_SQL, fact, table
from ledgerlark.sources import files, store
from ledgerlark.streaming import streams

W = f"WITH {FACT_SQL}"


def run_folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


_ORDER_SUMS = "SELECT o_orderpriority AS priority, count(*) AS rows, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1"


def _order_sums(orders):
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.sum(F.col("o_totalprice").cast("double"))).alias("total"), F.count_distinct(F.col("o_custkey").cast("long")).alias("customers"))


@query("A1_read_delimited", _ORDER_SUMS)
def read_delimited(spark, sf):
    path = run_folder(spark)
    table(spark, sf, "orders").write.option("header", True).csv(path)
    return _order_sums(files.read_delimited(spark, path, sep=","))


@query("A2_encoding_fallback", "SELECT p_type || ' مرحبا' AS ptype, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def encoding_fallback(spark, sf):
    """A table in two files of unlike encodings reads as one."""
    path = run_folder(spark)
    parts = table(spark, sf, "part").select("p_partkey", F.concat("p_type", F.lit(" مرحبا")).alias("ptype"), "p_retailprice")
    odd, even = parts.where("p_partkey % 2 = 1"), parts.where("p_partkey % 2 = 0")
    odd.write.option("header", True).option("sep", ";").csv(f"{path}/b")
    as_bytes = F.translate("ptype", files.ARABIC, files.LATIN)  # ISO-8859-1 writes the bytes of windows-1256
    even.withColumn("ptype", as_bytes).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{path}/a")
    read = files.read_delimited(spark, [f"{path}/a", f"{path}/b"], sep=";")
    return read.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(F.col("p_retailprice").cast("double"))).alias("price"))


@query("A3_sniff_delimiter", _ORDER_SUMS)
def sniff_delimiter(spark, sf):
    path = run_folder(spark)
    table(spark, sf, "orders").write.option("header", True).option("sep", "|").csv(path)
    return _order_sums(files.read_delimited(spark, path))


@query("A4_read_json", _ORDER_SUMS)
def read_json(spark, sf):
    """A customer's orders in one envelope a line, each with a nested object."""
    path = run_folder(spark)
    nested = F.struct("o_orderkey", F.struct("o_orderpriority", "o_totalprice").alias("terms"))
    table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_custkey", nested.alias("order"))).alias("records")).select("records").write.json(path)
    return _order_sums(files.read_json(spark, path).withColumnsRenamed({"order.terms.o_orderpriority": "o_orderpriority", "order.terms.o_totalprice": "o_totalprice"}))


@query("A11_save_project", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def save_project(spark, sf):
    root = run_folder(spark)
    tables = {t: table(spark, sf, t) for t in ("orders", "customer")}
    found = relations.relationships_frame(spark, LINE_RELATIONS[3:])
    store.save_project(root, {"orders": tables["customer"]}, saved_at=datetime(2024, 1, 1))
    store.save_project(root, tables, found, saved_at=datetime(2024, 1, 2))
    loaded = store.load_project(spark, root)
    out = None
    for name, df in loaded.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("A12_add_new_columns", """SELECT o_orderstatus AS status, count(*) AS rows, count(priority) AS with_priority FROM (SELECT o_orderstatus, NULL AS priority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def add_new_columns(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    both = store.add_new_columns(o.where("status = 'F'").drop("priority"), o.where("status <> 'F'"))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count("priority").alias("with_priority"))


@query("A13_replace_snapshot", f"{_SNAPSHOTS} SELECT snapshot_date, count(*) AS customers, round(sum(monetary), 2) AS monetary FROM states GROUP BY 1")
def replace_snapshot(spark, sf):
    path = run_folder(spark)
    states = customer_snapshots(spark, sf)
    store.replace_snapshot(path, states)
    newest = states.agg(F.max("snapshot_date")).scalar()
    store.replace_snapshot(path, states.where(F.col("snapshot_date") == newest))  # again: replaces one date by itself
    return spark.read.parquet(path).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("customers"), rnd(F.sum("monetary")).alias("monetary"))


@query("A14_append_runs", f"{_SNAPSHOTS} SELECT CAST(snapshot_date AS VARCHAR) AS run, count(*) AS scores FROM states GROUP BY 1")
def append_runs(spark, sf):
    root = run_folder(spark)
    states = customer_snapshots(spark, sf)
    for r in states.select("snapshot_date").distinct().orderBy("snapshot_date").collect():  # six cutoffs
        day = r["snapshot_date"]
        mine = states.where(F.col("snapshot_date") == F.lit(day)).select("customer_id", "recency_days")
        store.save_churn_run(root, mine, mine.agg(F.count(F.lit(1)).alias("customers")), f"run {day}")
    return spark.read.parquet(f"{root}/churn_scores").groupBy(F.substring("run_id", 5, 10).alias("run")).agg(F.count(F.lit(1)).alias("scores"))


@query("A15_append_marketing_run", f"{W} SELECT mktsegment AS segment, count(DISTINCT customer_id) AS customers FROM fact WHERE mktsegment IS NOT NULL GROUP BY 1")
def append_marketing(spark, sf):
    root = run_folder(spark)
    segments = fact(spark, sf, "mktsegment", "customer_id").where("mktsegment is not null").groupBy(F.col("mktsegment").alias("segment")).agg(F.count_distinct("customer_id").alias("customers"))
    campaigns = segments.select("segment", F.concat(F.lit("win back "), "segment").alias("campaign"))
    for _ in range(2):  # a repeated run replaces itself
        store.save_marketing_run(root, segments, campaigns, segments.agg(F.sum("customers").alias("customers")), "run 1")
    return spark.read.parquet(f"{root}/marketing_segments").select("segment", "customers")


@query("A16_append_forecast_run", f"{W} SELECT kind, count(*) AS rows, round(sum(y), 2) AS total FROM (SELECT 'actual' AS kind, brand, date_trunc('month', ts), sum(revenue) AS y FROM fact GROUP BY 2, 3 UNION ALL SELECT 'forecast', brand, NULL, avg(revenue) FROM fact GROUP BY 2) GROUP BY 1")
def append_forecast(spark, sf):
    root = run_folder(spark)
    lines = fact(spark, sf, "brand", "ts", "revenue")
    actual = lines.groupBy(F.col("brand").alias("series"), F.trunc("ts", "month").alias("ds")).agg(F.sum("revenue").alias("y"))
    forecast = lines.groupBy(F.col("brand").alias("series")).agg(F.avg("revenue").alias("y"))
    store.save_forecast_run(root, actual, forecast, forecast.select("series", F.lit(0.0).alias("mae")), "run 1")
    return spark.read.parquet(f"{root}/forecast_history").groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), rnd(F.sum("y")).alias("total"))


@query("A17_append_metric_snapshot", "SELECT event_type AS metric, count(*) AS rows FROM (SELECT DISTINCT event_type, d FROM events, (SELECT unnest([1, 2]) AS d)) GROUP BY 1")
def append_snapshot(spark, sf):
    path = run_folder(spark)
    metrics = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.sum("value").alias("value")).withColumn("project", F.lit("p"))
    for day in (1, 2):
        store.append_snapshot(path, metrics, datetime(2024, 2, day))
    return store.read_snapshots(spark, path).groupBy("metric").agg(F.count(F.lit(1)).alias("rows"))


@query("M6_capture", "SELECT event_type AS metric, round(sum(value), 2) AS previous FROM events GROUP BY 1")
def capture(spark, sf):
    path = run_folder(spark)
    now = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.sum("value").alias("value")).withColumn("project", F.lit("p"))
    first = store.capture(path, now, datetime(2024, 2, 1))
    second = store.capture(path, now.withColumn("value", F.col("value") * 2), datetime(2024, 2, 2))
    if first:
        raise AssertionError("the first run has nothing before it")
    return spark.createDataFrame([(r["metric"], r["value"]) for r in second], "metric string, previous double").withColumn("previous", rnd("previous"))


@query("A20_append_alerts", "SELECT DATE '2024-02-01' AS run_date, count(*) AS alerts FROM (SELECT DISTINCT user_id, event_type FROM events)")
def append_alerts(spark, sf):
    path = run_folder(spark)
    found = streams.alerts_of(table(spark, sf, "events")).select("fingerprint").distinct()
    for _ in range(2):  # a repeated run replaces its own rows
        store.append_alerts(path, found, date(2024, 2, 1), "run 1")
    return spark.read.parquet(path).groupBy("run_date").agg(F.count(F.lit(1)).alias("alerts"))


@query("A21_replace_relationships", f"WITH {_discover_sql()} SELECT table_a, column_a, table_b, column_b, confidence FROM rel WHERE confidence >= 0.5")
def replace_relationships(spark, sf):
    """What discovery finds in the tables replaces what was stored before, for this project alone."""
    path = run_folder(spark)
    found = materialise(relations.find_relationships(_discover_tables(spark, sf)))
    store.replace_relationships(path, "b", found.limit(1))
    store.replace_relationships(path, "a", found.where("confidence < 0.5"))
    store.replace_relationships(path, "a", found.where("confidence >= 0.5"))
    return store.load_relationships(spark, path, "a").select("table_a", "column_a", "table_b", "column_b", "confidence")


@query("D38_customer_refresh", f"{_SNAPSHOTS} SELECT count(*) AS customers, round(sum(monetary), 2) AS monetary, max(snapshot_date) AS snapshot_date FROM states WHERE snapshot_date = (SELECT max(snapshot_date) FROM states)")
def customer_refresh(spark, sf):
    """Features, segments and stage of the newest cutoff, stored as that day's snapshot."""
    from ledgerlark.operators import churn, customers
    from ledgerlark.plans.customers import ROLES, lines

    first, last = churn.history(fact(spark, sf, "ts"), ROLES)
    cutoff = churn.training_cutoffs(first, last, churn.horizon_for(first, last))[0]
    rows = lines(spark, sf, "customer_name").where(F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz"))
    path = run_folder(spark)
    store.replace_snapshot(path, customers.customer_state(rows, ROLES, as_of=cutoff).drop("contact"))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("customers"), rnd(F.sum("monetary")).alias("monetary"), F.max("snapshot_date").alias("snapshot_date"))


# --- streams ----------------------------------------------------------------------


def _events(spark, sf):
    return streams.file_stream(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")


@query("O1_metric_windows", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def metric_windows(spark, sf):
    path = run_folder(spark)
    streams.keep_windows(streams.metric_windows(_events(spark, sf)), path)
    return streams.current_windows(spark, path).select(F.to_date("start").alias("day"), "event_type", "n", rnd("total").alias("total"))


@query("O2_alert_cooldown", """WITH RECURSIVE a AS (SELECT left(sha1('event|' || user_id || '|' || event_type), 32) AS fingerprint, ts FROM events),
d AS (SELECT fingerprint, min(ts) AS ts FROM a GROUP BY 1 UNION ALL SELECT fingerprint, min(a.ts) FROM d JOIN a USING (fingerprint) WHERE a.ts >= d.ts + INTERVAL 1 DAY GROUP BY 1)
SELECT fingerprint, count(*) AS alerts FROM d GROUP BY 1""")
def alert_cooldown(spark, sf):
    path = run_folder(spark)
    streams.deliver_alerts(streams.alerts_of(_events(spark, sf)), path)
    return spark.read.parquet(f"{path}/alerts").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("alerts"))


@query("O3_customer_counters", "SELECT user_id AS customer, max(ts) AS last, count(*) AS events FROM events GROUP BY 1")
def customer_counters(spark, sf):
    path = run_folder(spark)
    streams.keep_counters(streams.customer_counters(_events(spark, sf)), path)
    return streams.current_counters(spark, path)


@query("O3_distinct_orders", "SELECT user_id AS customer, count(DISTINCT event_type) AS orders FROM events GROUP BY 1")
def distinct_orders(spark, sf):
    path = run_folder(spark)
    streams.keep_distinct_orders(_events(spark, sf), path, key="user_id", order="event_type")
    return streams.distinct_orders(spark, path)


@query("O4_append_files", "SELECT 'events.parquet' AS _source_file, count(*) AS rows FROM events")
def append_files(spark, sf):
    path = run_folder(spark)
    streams.append_files(_events(spark, sf), path)
    return streams.appended(spark, path).groupBy("_source_file").agg(F.count(F.lit(1)).alias("rows"))


@query("O5_freshness_per_batch", "SELECT DATE '2024-02-04' - CAST(max(ts) AS DATE) AS days, 'high' AS severity FROM events")
def freshness_per_batch(spark, sf):
    path = run_folder(spark)
    streams.watch_freshness(_events(spark, sf), path, lambda batch: datetime(2024, 2, 4))
    return spark.read.parquet(f"{path}/checks").select("days", "severity")


