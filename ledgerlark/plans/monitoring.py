"""Figures, findings, snapshots, usage, calendar and number-claim queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerlark.functions import numbers as nm
from ledgerlark.functions.calendar import RAMADAN, event_columns
from ledgerlark.functions.numbers import rnd
from ledgerlark.functions.scale import exact_quantiles, materialise
from ledgerlark.operators import claims as cl
from ledgerlark.operators import decision as dm
from ledgerlark.operators import kpi, monitor, quality
from ledgerlark.plans import metrics as mq
from ledgerlark.plans.metrics import BRIDGE_SQL, DAILY_SQL, DISCOUNT_SQL, GRAIN_SQL, MARGIN_SQL, PERIODS_SQL, REPEAT_SQL, WEEKDAY_SQL, _pareto_sql
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import FACT_SQL, ROLES, fact, sales, table

W = f"WITH {FACT_SQL}"

# --- scalar functions ---------------------------------------------------------


@query("H13_rounding_and_shares", f"{W}, t AS (SELECT brand, sum(revenue) AS r, sum(sum(revenue)) OVER () AS w FROM fact GROUP BY 1) SELECT brand, round(r, 2) AS revenue, round(r / w * 100, 1) AS share_pct, NULL::DOUBLE AS no_whole FROM t")
def rounding(spark, sf):
    per = fact(spark, sf, "brand", "revenue").groupBy("brand").agg(F.sum("revenue").alias("r"))
    whole = per.agg(F.sum("r")).scalar()
    return per.select("brand", nm.rounded(F.col("r")).alias("revenue"), nm.share_pct(F.col("r"), whole).alias("share_pct"), nm.share_pct(F.col("r"), F.lit(0.0)).alias("no_whole"))


_SEV = "CASE WHEN {m} / {r} >= 0.2 THEN 'critical' WHEN {m} / {r} >= 0.08 THEN 'high' WHEN {m} / {r} >= 0.03 THEN 'medium' WHEN {m} / {r} >= 0.01 THEN 'low' ELSE 'info' END"


@query("H14_severity", f"{W}, t AS (SELECT brand, nation, sum(revenue) AS r FROM fact GROUP BY 1, 2), w AS (SELECT nation, sum(r) AS w FROM t GROUP BY 1) SELECT brand, nation, {_SEV.format(m='r', r='w')} AS severity FROM t JOIN w USING (nation)")
def severity(spark, sf):
    per = fact(spark, sf, "brand", "nation", "revenue").groupBy("brand", "nation").agg(F.sum("revenue").alias("r"))
    whole = per.groupBy("nation").agg(F.sum("r").alias("w"))
    return per.join(whole, "nation").select("brand", "nation", nm.severity_from_share(F.col("r"), F.col("w")).alias("severity"))


@query("H15_fingerprint", "SELECT DISTINCT p_brand AS brand, p_type AS kind, left(sha1('momentum|' || p_brand || '|' || p_type), 32) AS fingerprint FROM part")
def fingerprint(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).distinct().withColumn(
        "fingerprint", nm.fingerprint("momentum", F.col("brand"), F.col("kind")))


@query("H20_number_formats", """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS money, format('{:,}', CAST(o_custkey AS BIGINT)) AS n, format('{:,.1f}', o_custkey / 16.0) || '%' AS pct,
CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '' END || 'EGP ' || CASE WHEN o_totalprice >= 1000 THEN format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) ELSE format('{:,.2f}', o_totalprice) END AS signed_money FROM orders""")
def number_formats(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", nm.figure_text(F.col("o_totalprice"), F.lit("currency")).alias("money"), nm.figure_text(F.col("o_custkey").cast("double"), F.lit("count")).alias("n"),
        nm.figure_text(F.col("o_custkey") / 16.0, F.lit("percent")).alias("pct"), nm.amount_text(F.expr("if(o_custkey % 2 = 0, -o_totalprice, o_totalprice)"), "EGP").alias("signed_money"))


@query("H22_calendar_events", "WITH d AS (SELECT DISTINCT CAST(o_orderdate + INTERVAL 300 MONTH AS DATE) AS day FROM orders), r(s) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in RAMADAN) + """)
SELECT day, max(CASE WHEN day - s BETWEEN -7 AND -1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pre_ramadan, max(CASE WHEN day - s BETWEEN 0 AND 28 THEN 1.0 ELSE 0.0 END)::DOUBLE AS ramadan,
  max(CASE WHEN day - s BETWEEN 29 AND 32 THEN 1.0 ELSE 0.0 END)::DOUBLE AS eid_fitr, max(CASE WHEN day - s BETWEEN 99 AND 102 THEN 1.0 ELSE 0.0 END)::DOUBLE AS eid_adha,
  max(CASE WHEN day - s BETWEEN 33 AND 42 THEN 1.0 ELSE 0.0 END)::DOUBLE AS post_eid, round(max(CASE WHEN day - s BETWEEN 0 AND 28 THEN (day - s) / 28.0 ELSE 0.0 END), 6) AS ramadan_ramp FROM d, r GROUP BY day""")
def calendar_events(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date(F.add_months(F.to_date("o_orderdate"), 300)).alias("day")).distinct()
    cols = event_columns(F.col("day"))
    return days.select("day", *[(rnd(c, 6) if name == "ramadan_ramp" else c).alias(name) for name, c in cols.items()])


@query("H23_quiet_hours", "SELECT event_type, hour(ts) >= 22 OR hour(ts) < 7 AS quiet, count(*) AS n FROM events GROUP BY 1, 2")
def quiet_hours(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", nm.in_quiet_hours(F.hour("ts"), 22, 7).alias("quiet")).agg(F.count(F.lit(1)).alias("n"))


@query("H24_json_metrics", "SELECT 'k' AS metric, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) AS total FROM events")
def json_metrics(spark, sf):
    return monitor.json_metrics(table(spark, sf, "events"), "props").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("D37_numeric_leaves", """SELECT 'brand.' || 'count' AS path, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY p_brand UNION ALL
SELECT 'brand.' || 'prices.' || i, v FROM (SELECT unnest([min(p_retailprice), max(p_retailprice)]) AS v, unnest([0, 1]) AS i FROM part GROUP BY p_brand)""")
def numeric_leaves(spark, sf):
    nested = table(spark, sf, "part").groupBy("p_brand").agg(
        F.struct(F.struct(F.count(F.lit(1)).alias("count"), F.array(F.min("p_retailprice"), F.max("p_retailprice")).alias("prices")).alias("brand")).alias("r"))
    return monitor.numeric_leaves(nested, "r")


# --- usage, charts, snapshots -------------------------------------------------


@query("D35_usage_rollup", """SELECT user_id AS "user", CAST(ts AS DATE) AS day, count(*) AS events, round(sum(value), 2) AS total, count(*) FILTER (WHERE value = 0) AS unknown,
  CAST(grouping(user_id) * 2 + grouping(CAST(ts AS DATE)) AS INT) AS level FROM events GROUP BY ROLLUP (user_id, CAST(ts AS DATE))""")
def usage(spark, sf):
    return monitor.usage_rollup(table(spark, sf, "events"), "user_id", "ts", "value")


@query("D33_order_value_histogram", f"""{W}, o AS (SELECT order_id, sum(revenue) AS v FROM fact WHERE order_id IS NOT NULL GROUP BY 1), q AS (SELECT quantile_cont(v, 0.99) AS p FROM o)
SELECT CAST(least(40, floor(v / p * 40) + 1) AS BIGINT) AS bin, count(*) AS orders FROM o, q WHERE v <= p GROUP BY 1""")
def histogram(spark, sf):
    per = fact(spark, sf, "order_id", "revenue").where("order_id is not null").groupBy("order_id").agg(F.sum("revenue").alias("v"))
    p99 = exact_quantiles(per, ["v"], [0.99])["v"][0]
    return monitor.order_value_histogram(per, "v", p99)


@query("D33_chart_series", f"""{W}, {DAILY_SQL}, m AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, sum(revenue) AS r FROM fact GROUP BY 1)
SELECT 'monthly' AS chart, CAST(month AS VARCHAR) AS x, round(r, 2) AS y FROM m UNION ALL SELECT 'weekday', dayname(day), round(avg(y), 2) FROM daily GROUP BY 2
UNION ALL SELECT 'by_brand', brand, round(sum(revenue), 2) FROM fact GROUP BY 2""")
def chart_series(spark, sf):
    lines = fact(spark, sf, "ts", "revenue", "brand")
    monthly = kpi.monthly_revenue(lines.select(F.to_date("ts").alias("day"), "revenue")).select(F.lit("monthly").alias("chart"), F.col("month").cast("string").alias("x"), rnd("revenue").alias("y"))
    days = dm.weekday_days(lines, ROLES).select(F.lit("weekday").alias("chart"), F.col("day_name").alias("x"), rnd("mean").alias("y"))
    brands = lines.groupBy("brand").agg(F.sum("revenue").alias("r")).select(F.lit("by_brand").alias("chart"), F.col("brand").alias("x"), rnd("r").alias("y"))
    return monthly.unionByName(days).unionByName(brands)


@query("C16_as_of_join", """SELECT p.event_id, round(s.value, 4) AS value_before FROM (SELECT * FROM events WHERE event_type = 'click') p
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') s ON p.user_id = s.user_id AND s.ts < p.ts""")
def as_of(spark, sf):
    e = table(spark, sf, "events")
    out = monitor.as_of_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value")
    return out.select("event_id", rnd(F.col("value_before"), 4).alias("value_before"))


_SNAPS = """snaps AS (SELECT nation AS project, 'kpi' AS kind, date_trunc('month', ts) AS captured_at, count(DISTINCT order_id) AS orders, sum(revenue) AS revenue, count(DISTINCT customer_id) AS total_customers,
  sum(revenue) / count(DISTINCT order_id) AS aov FROM fact WHERE nation IS NOT NULL GROUP BY 1, 3),
long AS (SELECT project, kind, captured_at, metric, value FROM (SELECT project, kind, captured_at, CAST(orders AS DOUBLE) AS orders, revenue, CAST(total_customers AS DOUBLE) AS total_customers, aov FROM snaps) UNPIVOT (value FOR metric IN (orders, revenue, total_customers, aov)))"""


def _snapshots(spark, sf):
    return _snapshots_of(fact(spark, sf, "nation", "ts", "order_id", "customer_id", "revenue"))


def _snapshots_of(lines):
    """A snapshot of the headline metrics of every nation and month, from lines or a rollup of them per order."""
    per = lines.where("nation is not null").groupBy(
        F.col("nation").alias("project"), F.date_trunc("month", F.col("ts")).cast("timestamp_ntz").alias("captured_at"), "order_id", "customer_id").agg(F.sum("revenue").alias("r"))
    wide = per.groupBy("project", "captured_at").agg(
        F.count_distinct("order_id").cast("double").alias("orders"), F.sum("r").alias("revenue"), F.count_distinct("customer_id").cast("double").alias("total_customers"))
    wide = wide.withColumn("aov", F.col("revenue") / F.col("orders"))
    return wide.unpivot(["project", "captured_at"], ["orders", "revenue", "total_customers", "aov"], "metric", "value").withColumn("kind", F.lit("kpi"))


@query("C16_snapshot_before", f"{W}, {_SNAPS} SELECT project, metric, round(arg_max(value, captured_at), 2) AS value, max(captured_at) AS captured_at FROM long WHERE captured_at < TIMESTAMP '2001-07-01' GROUP BY 1, 2")
def snapshot_before(spark, sf):
    return monitor.snapshot_before(_snapshots(spark, sf), datetime(2001, 7, 1)).select("project", "metric", rnd("value").alias("value"), "captured_at")


@query("C15_latest_prior_run", f"""{W} SELECT brand AS metric, CAST(ts AS DATE) AS ds, round(sum(revenue), 2) AS yhat FROM fact WHERE date_trunc('month', ts) = TIMESTAMP '2001-07-01' GROUP BY 1, 2""")
def latest_prior(spark, sf):
    history = fact(spark, sf, "brand", "ts", "revenue").groupBy(
        F.col("brand").alias("metric"), F.date_format("ts", "'run-'yyyy-MM").alias("run_id"), F.to_date("ts").alias("ds")).agg(F.sum("revenue").alias("yhat")).withColumn("kind", F.lit("forecast"))
    runs = history.groupBy("metric", "run_id").agg(F.max("ds").alias("created_at"))
    return monitor.latest_prior_run(runs, history, exclude="run-2001-08").select("metric", "ds", rnd("yhat").alias("yhat"))


# --- figures and evidence -----------------------------------------------------

_SPEC = {
    "kpi": [("revenue_total", "total revenue", "revenue", "currency", "sum of line revenue"), ("orders_total", "orders", "orders", "count", "distinct orders"),
            ("aov", "average order value", "aov", "currency", "revenue / orders"), ("customers_total", "customers", "total_customers", "count", "distinct customers")],
    "month": [("mon_revenue_change", "revenue change", "revenue_change", "currency", "current - prior"), ("mon_revenue_change_pct", "revenue change in percent", "revenue_change_pct", "percent", "change / prior"),
              ("mon_volume_effect", "volume effect", "volume_effect", "currency", "orders change x prior order value"), ("mon_basket_effect", "basket effect", "basket_effect", "currency", "order value change x prior orders")],
    "products": [("top_product_share", "share of the top product", "top1_share", "percent", "top product / total"), ("top_product_revenue", "revenue of the top product", "top1_revenue", "currency", "sum"),
                 ("products_for_80pct", "products for 80 percent", "count_for_80pct", "count", "cumulative share"), ("products_total", "products", "total_count", "count", "distinct products")],
    "customers": [("top_decile_customer_share", "share of the top tenth of customers", "top_decile_share", "percent", "cumulative share")],
    "margin": [("gross_margin_pct", "gross margin", "gross_margin_pct", "percent", "profit / revenue"), ("gross_profit", "gross profit", "gross_profit", "currency", "revenue - cost"),
               ("margin_drag_uplift", "uplift of low margins", "margin_drag_uplift", "currency", "sum of gaps")],
    "discount": [("discount_given", "discount given", "discount_given", "currency", "gross - net"), ("discount_share_of_gross", "discount share", "discount_share_of_gross", "percent", "given / gross")],
    "repeat": [("repeat_rate_pct", "repeat rate", "repeat_rate_pct", "percent", "repeat / customers"), ("repeat_revenue", "revenue of repeat customers", "repeat_revenue", "currency", "sum")],
    "weekday": [("best_weekday_uplift_pct", "best weekday", "best_day_vs_avg_pct", "percent", "best / average - 1"), ("weak_weekday_uplift", "weak weekday uplift", "worst_day_gap_total", "currency", "gap x days")],
}


def _figures(spark, sf):
    return _figures_of(sales(spark, sf).stored())


def _figures_of(r):
    """All sections from one stored rollup: the lines are scanned twice, for orders and for products."""
    sections = {
        "kpi": mq._kpis(r), "month": mq._bridge(r).where("basis = 'last_month'"), "products": mq._pareto(r, "product"), "customers": mq._pareto(r, "customer"),
        "margin": mq._margin(r), "discount": mq._discount(r), "repeat": mq._repeat(r), "weekday": mq._weekday(r)}
    out = None
    for name, section in sections.items():
        part = monitor.figures(section, _SPEC[name])
        out = part if out is None else out.unionByName(part)
    return materialise(out)  # some dozen rows that every rule reads


_SOURCE = {"kpi": "kpi1", "month": "bridge", "products": "pareto_product", "customers": "pareto_customer", "margin": "margin", "discount": "disc", "repeat": "repeat_e", "weekday": "weekday"}
_KPI1 = """kpi1 AS (SELECT (SELECT round(sum(revenue), 2) FROM fact) AS revenue, count(*) AS orders, round(avg(rev), 2) AS aov, (SELECT count(*) FROM customers_t) AS total_customers FROM orders_t)"""
_FIG = f"""{W}, {DAILY_SQL}, {GRAIN_SQL}, {PERIODS_SQL}, {BRIDGE_SQL}, {_pareto_sql('product', 'product')}, {_pareto_sql('customer_id', 'customer')}, {MARGIN_SQL}, {DISCOUNT_SQL}, {WEEKDAY_SQL}, {REPEAT_SQL}, {_KPI1},
fig AS (""" + " UNION ALL ".join(
    f"SELECT '{k}' AS key, '{label}' AS label, CAST({col} AS DOUBLE) AS value, '{unit}' AS unit, '{formula}' AS formula, 'all data' AS period FROM {_SOURCE[s]}" + (" WHERE basis = 'last_month'" if s == "month" else "")
    for s, spec in _SPEC.items() for k, label, col, unit, formula in spec) + ")"


@query("M9_figures_table", f"{_FIG} SELECT * FROM fig WHERE value IS NOT NULL")
def figures_table(spark, sf):
    return _figures(spark, sf)


def _f(key: str) -> str:
    return f"(SELECT value FROM fig WHERE key = '{key}')"


_EV = f"""{_FIG}, ev AS (SELECT * FROM (
SELECT 'period_move' AS key, CASE WHEN {_f('mon_revenue_change')} < 0 THEN 'THREAT' ELSE 'OPPORTUNITY' END AS tag, 'what_changed' AS section, abs({_f('mon_revenue_change')}) AS money, true AS is_event, abs({_f('mon_revenue_change_pct')}) >= 5 AS ok
UNION ALL SELECT 'period_stable', 'STRENGTH', 'what_changed', abs({_f('mon_revenue_change')}), true, abs({_f('mon_revenue_change_pct')}) < 5
UNION ALL SELECT 'product_concentration', 'RISK', 'concentration', {_f('top_product_revenue')}, false, {_f('top_product_share')} >= 25
UNION ALL SELECT 'product_pareto', 'RISK', 'concentration', {_f('revenue_total')} * 0.2, false, {_f('top_product_share')} < 25
UNION ALL SELECT 'customer_concentration', 'RISK', 'concentration', {_f('revenue_total')} * {_f('top_decile_customer_share')} / 100, false, {_f('top_decile_customer_share')} >= 40
UNION ALL SELECT 'gross_margin', CASE WHEN {_f('gross_margin_pct')} >= 30 THEN 'STRENGTH' ELSE 'THREAT' END, 'standing', abs({_f('gross_profit')}), false, true
UNION ALL SELECT 'margin_drag', 'LEAK', 'decisions', {_f('margin_drag_uplift')}, true, {_f('margin_drag_uplift')} > 0
UNION ALL SELECT 'discount_leak', 'LEAK', 'decisions', {_f('discount_given')}, true, {_f('discount_share_of_gross')} >= 3
UNION ALL SELECT 'strong_repeat', 'STRENGTH', 'working', {_f('repeat_revenue')}, false, {_f('repeat_rate_pct')} >= 60
UNION ALL SELECT 'weekday_rhythm', 'OPPORTUNITY', 'decisions', abs({_f('weak_weekday_uplift')}), true, abs({_f('best_weekday_uplift_pct')}) >= 15) WHERE ok)"""


@query("F5_evidence_order", f"""{_EV} SELECT key, tag, section, round(money, 2) AS money, is_event, row_number() OVER (ORDER BY CASE tag WHEN 'THREAT' THEN 0 WHEN 'LEAK' THEN 1 WHEN 'RISK' THEN 2
  WHEN 'OPPORTUNITY' THEN 3 WHEN 'STRENGTH' THEN 4 ELSE 5 END, money DESC, key) AS position FROM ev""")
def evidence_order(spark, sf):
    return monitor.ordered_evidence(monitor.evidence(_figures(spark, sf))).select("key", "tag", "section", rnd("money").alias("money"), "is_event", "position")


@query("M5_evidence_findings", f"""{_EV}, s AS (SELECT *, CASE {_SEV.format(m='money', r=_f('revenue_total'))[5:-4]} END AS s0 FROM ev WHERE tag NOT IN ('STRENGTH', 'CAVEAT')),
r AS (SELECT *, list_position(['critical', 'high', 'medium', 'low', 'info'], s0) AS k, CASE WHEN tag IN ('THREAT', 'LEAK') THEN 3 ELSE 4 END AS fl, CASE tag WHEN 'RISK' THEN 3 WHEN 'OPPORTUNITY' THEN 4 ELSE 1 END AS ce FROM s)
SELECT 'evidence.' || lower(tag) AS rule, section AS metric, ['critical', 'high', 'medium', 'low', 'info'][greatest(least(k, fl), ce)] AS severity, round(money, 2) AS money_at_stake, is_event,
  left(sha1('evidence|' || tag || '|' || section || '|' || key), 32) AS fingerprint FROM r""")
def evidence_findings(spark, sf):
    table_ = _figures(spark, sf)
    revenue = table_.where("key = 'revenue_total'").select("value").scalar()
    out = monitor.evidence_findings(monitor.evidence(table_), revenue)
    return out.select("rule", "metric", "severity", rnd("money_at_stake").alias("money_at_stake"), "is_event", "fingerprint")


# --- findings -----------------------------------------------------------------


@query("M1_freshness", f"""{W} SELECT CASE WHEN DATE '2001-08-06' - CAST(max(ts) AS DATE) >= 7 THEN 'critical' ELSE 'high' END AS severity, CAST(DATE '2001-08-06' - CAST(max(ts) AS DATE) AS DOUBLE) AS current_value, 0 AS sort_priority
FROM fact HAVING DATE '2001-08-06' - CAST(max(ts) AS DATE) >= 3""")
def freshness(spark, sf):
    last = fact(spark, sf, "ts").agg(F.max("ts").alias("last"))
    return monitor.freshness_findings(last, date(2001, 8, 6)).select("severity", "current_value", "sort_priority")


_DELTA = f"""{W}, {_SNAPS}, cur AS (SELECT project, metric, value FROM long WHERE captured_at = TIMESTAMP '2001-07-01'), prv AS (SELECT project, metric, value AS prior FROM long WHERE captured_at = TIMESTAMP '2001-06-01'),
tot AS (SELECT sum(value) AS rev FROM cur WHERE metric = 'revenue'),
dl AS (SELECT *, (value - prior) / abs(prior) * 100 AS change, CASE WHEN metric IN ('revenue', 'aov') AND value < prior THEN abs(value - prior) ELSE 0 END AS money FROM cur JOIN prv USING (project, metric)),
df AS (SELECT project, metric, CASE WHEN change > 0 THEN 'info' WHEN money > 0 THEN {_SEV.format(m='money', r='rev')} ELSE 'low' END AS severity, money, change,
  left(sha1('snapshot_delta|' || metric || '|' || CASE WHEN change < 0 THEN 'down' ELSE 'up' END), 32) AS fingerprint, value, prior FROM dl, tot WHERE abs(change) >= 10)"""


def _delta(spark, sf):
    snaps = materialise(_snapshots(spark, sf))
    now = snaps.where(F.col("captured_at") == F.lit(datetime(2001, 7, 1)).cast("timestamp_ntz"))
    before = snaps.where(F.col("captured_at") == F.lit(datetime(2001, 6, 1)).cast("timestamp_ntz"))
    revenue = now.where("metric = 'revenue'").agg(F.sum("value")).scalar()
    return monitor.delta_findings(now.select("project", "metric", "value"), before, revenue), now, revenue


@query("M2_snapshot_delta", f"{_DELTA} SELECT project, metric, severity, round(money, 2) AS money_at_stake, round(change, 2) AS change_pct, fingerprint FROM df")
def snapshot_delta(spark, sf):
    return _delta(spark, sf)[0].select("project", "metric", "severity", rnd("money_at_stake").alias("money_at_stake"), rnd("change_pct").alias("change_pct"), "fingerprint")


@query("M3_targets", f"""{_DELTA}, tg(metric, bound, lim) AS (VALUES ('revenue', 'min', 1500000.0), ('orders', 'max', 12.0), ('aov', 'min', 90000.0))
SELECT project, metric, CASE WHEN metric IN ('revenue', 'aov') THEN {_SEV.format(m='abs(value - lim)', r='rev')} ELSE 'high' END AS severity, round(CASE WHEN metric IN ('revenue', 'aov') THEN abs(value - lim) ELSE 0 END, 2) AS money_at_stake,
  round((value - lim) / lim * 100, 2) AS change_pct FROM cur JOIN tg USING (metric), tot WHERE CASE bound WHEN 'min' THEN value < lim ELSE value > lim END""")
def targets(spark, sf):
    _, now, revenue = _delta(spark, sf)
    spec = spark.createDataFrame([("revenue", "min", 1500000.0), ("orders", "max", 12.0), ("aov", "min", 90000.0)], "metric string, bound string, limit double")
    return monitor.target_findings(now.select("project", "metric", "value"), spec, revenue).select(
        "project", "metric", "severity", rnd("money_at_stake").alias("money_at_stake"), rnd("change_pct").alias("change_pct"))


@query("M4_quality_findings", """WITH t AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_discount END AS d FROM lineitem), c AS (SELECT count(*) FILTER (WHERE d IS NULL) AS k, count(*) AS n FROM t),
u AS (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dup)
SELECT 'missing_values' AS metric, 'medium' AS severity, round(k / (n * 3) * 100, 2) AS current_value FROM c WHERE k / (n * 3) * 100 > 3 UNION ALL SELECT 'duplicate_rows', 'medium', CAST(dup AS DOUBLE) FROM u, c WHERE dup / n * 100 > 3""")
def quality_findings(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.expr("if(l_discount < 0.02, null, l_discount)").alias("d"))
    return monitor.quality_findings(quality.quality_report(t, money=[], quantity=None)).select("metric", "severity", "current_value")


_ORDER = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, money DESC, fingerprint"


@query("F4_findings_order", f"{_DELTA} SELECT project, fingerprint, row_number() OVER (PARTITION BY project ORDER BY {_ORDER}) AS position FROM df")
def findings_order(spark, sf):
    return monitor.ordered(_delta(spark, sf)[0]).select("project", "fingerprint", "position")


@query("B7_deliver_findings", f"""{_DELTA}, rec AS (SELECT left(sha1('snapshot_delta|aov|down'), 32) AS fingerprint), h AS (SELECT df.*, CASE WHEN severity IN ('info') THEN 'below the severity floor' WHEN fingerprint IN (SELECT fingerprint FROM rec) THEN 'inside the cooldown' END AS held FROM df)
SELECT project, fingerprint, severity, coalesce(held, CASE WHEN row_number() OVER (PARTITION BY project, held IS NULL ORDER BY {_ORDER}) > 1 THEN 'over the limit of the run' END) AS held_reason FROM h""")
def deliver(spark, sf):
    recent = spark.range(1).select(nm.fingerprint("snapshot_delta", "aov", "down").alias("fingerprint"))
    return monitor.deliver(_delta(spark, sf)[0], recent, min_severity="low", limit=1).select("project", "fingerprint", "severity", "held_reason")


@query("M7_money_at_stake", f"{_DELTA} SELECT project, count(*) AS findings, count(*) AS events, round(sum(money), 2) AS money_at_stake FROM df GROUP BY 1")
def money_at_stake(spark, sf):
    return monitor.money_at_stake(_delta(spark, sf)[0])


def _of_month(r, month):
    return r["snapshots"].where(F.col("captured_at") == F.lit(datetime(2001, month, 1)).cast("timestamp_ntz")).select("project", "metric", "value")


#: What the rules of one run ask for; everything about orders and products starts from one stored rollup.
def _inputs(spark, sf):
    def doubtful(_):
        lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.expr("if(l_discount < 0.02, null, l_discount)").alias("d"))
        return quality.quality_report(lines, money=[], quantity=None)

    return monitor.Inputs({
        "as_of": lambda r: date(2001, 8, 6), "rollup": lambda r: sales(spark, sf, "nation").stored(), "figures": lambda r: _figures_of(r["rollup"]),
        "last": lambda r: r["rollup"].orders.agg(F.max("ts").alias("last")), "evidence": lambda r: monitor.evidence(r["figures"]),
        "revenue": lambda r: r["figures"].where("key = 'revenue_total'").select("value").scalar(), "snapshots": lambda r: materialise(_snapshots_of(r["rollup"].orders)),
        "metrics": lambda r: _of_month(r, 7), "previous": lambda r: _of_month(r, 6), "quality": doubtful,
        "targets": lambda r: spark.sql("select * from values ('revenue', 'min', 1500000.0d), ('orders', 'max', 12.0d), ('aov', 'min', 90000.0d) as t(metric, bound, limit)")})


_RUN_SQL = f"""{_EV}, {_SNAPS},
es AS (SELECT *, CASE {_SEV.format(m='money', r=_f('revenue_total'))[5:-4]} END AS s0 FROM ev WHERE tag NOT IN ('STRENGTH', 'CAVEAT')),
er AS (SELECT *, list_position(['critical', 'high', 'medium', 'low', 'info'], s0) AS k, CASE WHEN tag IN ('THREAT', 'LEAK') THEN 3 ELSE 4 END AS fl, CASE tag WHEN 'RISK' THEN 3 WHEN 'OPPORTUNITY' THEN 4 ELSE 1 END AS ce FROM es),
cur AS (SELECT project, metric, value FROM long WHERE captured_at = TIMESTAMP '2001-07-01'), prv AS (SELECT project, metric, value AS prior FROM long WHERE captured_at = TIMESTAMP '2001-06-01'),
dl AS (SELECT *, (value - prior) / abs(prior) * 100 AS change, CASE WHEN metric IN ('revenue', 'aov') AND value < prior THEN abs(value - prior) ELSE 0 END AS money FROM cur JOIN prv USING (project, metric)),
tg(metric, bound, lim) AS (VALUES ('revenue', 'min', 1500000.0), ('orders', 'max', 12.0), ('aov', 'min', 90000.0)),
td AS (SELECT project, metric, bound, value, lim, CASE WHEN metric IN ('revenue', 'aov') THEN abs(value - lim) ELSE 0 END AS money FROM cur JOIN tg USING (metric) WHERE CASE bound WHEN 'min' THEN value < lim ELSE value > lim END),
qt AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_discount < 0.02 THEN NULL ELSE l_discount END AS d FROM lineitem), qc AS (SELECT count(*) FILTER (WHERE d IS NULL) AS k, count(*) AS n FROM qt),
qu AS (SELECT (SELECT count(*) FROM qt) - (SELECT count(*) FROM (SELECT DISTINCT * FROM qt)) AS dup)
SELECT 'data_freshness' AS rule, 'default' AS project, CASE WHEN DATE '2001-08-06' - CAST(max(ts) AS DATE) >= 7 THEN 'critical' ELSE 'high' END AS severity, 'data_freshness' AS metric, 0.0 AS money_at_stake,
  left(sha1('freshness|default'), 32) AS fingerprint FROM fact HAVING DATE '2001-08-06' - CAST(max(ts) AS DATE) >= 3
UNION ALL SELECT 'evidence.' || lower(tag), 'default', ['critical', 'high', 'medium', 'low', 'info'][greatest(least(k, fl), ce)], section, round(money, 2), left(sha1('evidence|' || tag || '|' || section || '|' || key), 32) FROM er
UNION ALL SELECT 'snapshot_delta', project, CASE WHEN change > 0 THEN 'info' WHEN money > 0 THEN {_SEV.format(m='money', r=_f('revenue_total'))} ELSE 'low' END, metric, round(money, 2),
  left(sha1('snapshot_delta|' || metric || '|' || CASE WHEN change < 0 THEN 'down' ELSE 'up' END), 32) FROM dl WHERE abs(change) >= 10
UNION ALL SELECT 'target_breach', project, CASE WHEN metric IN ('revenue', 'aov') THEN {_SEV.format(m='money', r=_f('revenue_total'))} ELSE 'high' END, metric, round(money, 2), left(sha1('target|' || metric || '|' || bound), 32) FROM td
UNION ALL SELECT 'data_quality', 'default', 'medium', 'missing_values', 0.0, left(sha1('quality|missing_values'), 32) FROM qc WHERE k / (n * 3) * 100 > 3
UNION ALL SELECT 'data_quality', 'default', 'medium', 'duplicate_rows', 0.0, left(sha1('quality|duplicate_rows'), 32) FROM qu, qc WHERE dup / n * 100 > 3"""


@query("P3_monitoring_run", _RUN_SQL)
def monitoring_run(spark, sf):
    """All rules of a run over shared inputs."""
    found = monitor.evaluate(_inputs(spark, sf))
    return found.select("rule", "project", "severity", "metric", rnd("money_at_stake").alias("money_at_stake"), "fingerprint")


# --- number claims ------------------------------------------------------------


def _known(spark, sf):
    """Figures the texts are held against: the counts of the documents themselves, per language and source."""
    d = table(spark, sf, "documents")
    per = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    rows = per.select("lang", F.concat_ws("_", "lang", "source").alias("k"), F.expr("stack(2, 'documents', cast(n as double), 'characters', cast(chars as double)) as (what, figure)"))
    return rows.select(F.concat_ws(" ", F.lower("lang"), "what").alias("label"), F.concat_ws("_", "k", "what").alias("key"), "figure",
                       F.xxhash64("k", "what").alias("position"))


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("N1_extract_claims")
def extract_claims(spark, sf):
    return cl.extract_claims(_docs(spark, sf), "doc_id", "text")


@query("N2_label_verdicts")
def label_verdicts(spark, sf):
    labels = _known(spark, sf).select("label", F.col("figure").alias("expected"))
    words = spark.createDataFrame([("the", 3.0), ("of", 10.0), ("and", 5.0), ("de", 2.0)], "label string, expected double")
    return cl.label_verdicts(cl.material_numbers(_docs(spark, sf), "doc_id", "text"), labels.unionByName(words))


def _sig_sql(v: str, digits: int) -> str:
    power = f"pow(10.0, {digits - 1} - floor(log10(abs({v}))))"
    return f"round_even({v} * {power}, 0) / {power}"


@query("C20_figure_to_source", f"""WITH k AS (SELECT c_nationkey AS position, avg(c_acctbal) AS figure FROM customer GROUP BY 1), c AS (SELECT DISTINCT round(s_acctbal, 2) AS value FROM supplier UNION SELECT round(c_acctbal, 2) FROM customer)
SELECT value, round(arg_min(figure, position), 4) AS matched_value FROM (SELECT value, figure, position FROM c LEFT JOIN k ON abs(value - figure) <= greatest(0.5, 0.02 * greatest(abs(value), abs(figure)))
  OR abs(value - {_sig_sql('figure', 2)}) <= 1e-9 OR abs(value - {_sig_sql('figure', 3)}) <= 1e-9) GROUP BY value""")
def figure_to_source(spark, sf):
    known = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("position")).agg(F.avg("c_acctbal").alias("figure"))
    stated = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("v")).unionByName(table(spark, sf, "customer").select(F.col("c_acctbal").alias("v")))
    claims = stated.select(F.lit("number").alias("kind"), rnd("v").alias("value")).distinct()
    return cl.match_figures(claims, known).select("value", rnd("matched_value", 4).alias("matched_value"))


@query("N1_figures_in_texts")
def figures_in_texts(spark, sf):
    known = _known(spark, sf).select("position", "figure")
    return cl.match_figures(cl.extract_claims(_docs(spark, sf), "doc_id", "text"), known).select("doc", "kind", "value", "matched_value")


@query("N3_text_verdicts")
def text_verdicts(spark, sf):
    docs, known = _docs(spark, sf), _known(spark, sf)
    checked = cl.check_texts(docs, "doc_id", "text", known.select("position", "figure"), known.select("label", F.col("figure").alias("expected")))
    return cl.verdicts(docs, "doc_id", checked).select("doc", "claims", "verified", "semantic", "coverage", "status")


@query("N4_exact_roundings")
def exact_roundings(spark, sf):
    return cl.exact_matches(cl.extract_claims(_docs(spark, sf), "doc_id", "text"), _known(spark, sf).select("position", "key", "figure"))


_BRIEF = "'Revenue of ' || p_brand || ' fell by {{' || replace(p_brand, '#', '_') || '_rev}} on {{ ' || replace(p_brand, '#', '_') || '_n }} lines, see {{nothing}}.'"


@query("N5_render_citations", f"""{W}, b AS (SELECT brand, replace(brand, '#', '_') AS k, sum(revenue) AS r, count(*) AS n FROM fact GROUP BY 1)
SELECT p_partkey AS doc, 'Revenue of ' || p_brand || ' fell by ' || format('{{:,.2f}}', round(r, 2)) || ' on ' || format('{{:,}}', n) || ' lines, see [figure unavailable: nothing].' AS text, 'nothing' AS unknown
FROM part JOIN b ON p_brand = brand""")
def render_citations(spark, sf):
    per = fact(spark, sf, "brand", "revenue").groupBy(F.translate("brand", "#", "_").alias("k")).agg(F.sum("revenue").alias("r"), F.count(F.lit(1)).alias("n"))
    displays = per.select(F.inline(F.array(
        F.struct(F.concat("k", F.lit("_rev")).alias("key"), nm.figure_text(rnd(F.col("r")), F.lit("currency")).alias("display")),
        F.struct(F.concat("k", F.lit("_n")).alias("key"), nm.figure_text(F.col("n").cast("double"), F.lit("count")).alias("display")))))
    docs = table(spark, sf, "part").select("p_partkey", F.expr(_BRIEF).alias("text"))
    return cl.render_citations(docs, "p_partkey", "text", displays).select("doc", "text", F.array_join("unknown", ",").alias("unknown"))


@query("N6_wrong_signs", f"""{W}, {PERIODS_SQL}, b AS (SELECT brand, replace(brand, '#', '_') || '_rev' AS key, sum(revenue) FILTER (WHERE side = 'current') - sum(revenue) FILTER (WHERE side = 'prior') AS figure
  FROM fact JOIN periods ON ts >= "start" AND ts < "end" + 1 AND basis = 'last_month' GROUP BY 1)
SELECT p_partkey AS doc, 'fell by' AS verb, key, round(figure, 2) AS figure FROM part JOIN b ON p_brand = brand WHERE figure < 0""")
def wrong_signs(spark, sf):
    chosen = {(p.basis, p.side): p for p in mq._periods(spark, sf)}
    cur, pri = chosen["last_month", "current"], chosen["last_month", "prior"]
    ts = F.col("ts")
    known = fact(spark, sf, "brand", "revenue", "ts").where(cur.holds(ts) | pri.holds(ts)).groupBy(F.concat(F.translate("brand", "#", "_"), F.lit("_rev")).alias("key")).agg(
        (F.sum(F.when(cur.holds(ts), F.col("revenue"))) - F.sum(F.when(pri.holds(ts), F.col("revenue")))).alias("figure"))
    docs = table(spark, sf, "part").select("p_partkey", F.expr(_BRIEF).alias("text"))
    return cl.wrong_signs(docs, "p_partkey", "text", known).select("doc", "verb", "key", rnd("figure").alias("figure"))


_WORTH = "'- **What its worth:** ' || CASE p_partkey % 4 WHEN 0 THEN 'a lot' WHEN 1 THEN '{{brand_total}} a year' WHEN 2 THEN '{{size_' || p_size || '_change}}' ELSE '{{brand_change}} of {{brand_total}}' END"


@query("N6_uncited_values", """SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 1 THEN 'cites a level' ELSE 'no figure cited' END AS problem FROM part WHERE p_partkey % 4 < 3""")
def uncited_values(spark, sf):
    """Of four kinds of line one cites a change, one a level, one an unknown figure and one nothing."""
    docs = table(spark, sf, "part").select("p_partkey", F.expr(_WORTH).alias("text"))
    known = spark.createDataFrame([("brand_total",), ("brand_change",)], "key string")
    return cl.uncited_values(docs, "p_partkey", "text", known).select("doc", "problem")
