"""KPI, series, quality and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions.numbers import rnd
from ledgerlark.operators import decision as dm
from ledgerlark.operators import kpi, quality, series
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import COSTED, FACT_SQL, ROLES, fact, sales, table

WITH = f"WITH {FACT_SQL}"

DAILY_SQL = """sums AS (SELECT CAST(ts AS DATE) AS day, sum(revenue) AS y FROM fact WHERE ts IS NOT NULL GROUP BY 1),
daily AS (
  SELECT s.day, coalesce(y, 0) AS y
  FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM sums) s
  LEFT JOIN sums USING (day)
)"""

GRAIN_SQL = """orders_t AS (SELECT order_id, sum(revenue) AS rev, sum(quantity) AS qty FROM fact WHERE order_id IS NOT NULL GROUP BY 1),
customers_t AS (SELECT customer_id, sum(revenue) AS rev, count(DISTINCT order_id) AS n FROM fact WHERE customer_id IS NOT NULL GROUP BY 1),
months_t AS (SELECT date_trunc('month', ts) AS month, sum(revenue) AS rev FROM fact WHERE ts IS NOT NULL GROUP BY 1),
growth_t AS (SELECT rev / nullif(lag(rev) OVER (ORDER BY month), 0) - 1 AS g FROM months_t)"""


@query("D2_kpi_block", f"""{WITH}, {GRAIN_SQL}
SELECT (SELECT round(sum(revenue), 2) FROM fact) AS revenue,
       (SELECT round(avg(revenue), 2) FROM fact) AS avg_revenue_per_row,
       (SELECT count(*) FROM orders_t) AS orders,
       (SELECT round(avg(rev), 2) FROM orders_t) AS aov,
       (SELECT round(quantile_cont(rev, 0.5), 2) FROM orders_t) AS aov_median,
       (SELECT round(min(rev), 2) FROM orders_t) AS min_order_value,
       (SELECT round(max(rev), 2) FROM orders_t) AS max_order_value,
       (SELECT round(avg(qty), 2) FROM orders_t) AS items_per_order_avg,
       (SELECT round(quantile_cont(qty, 0.5), 2) FROM orders_t) AS items_per_order_median,
       (SELECT count(*) FROM customers_t) AS total_customers,
       (SELECT round(avg(rev), 2) FROM customers_t) AS revenue_per_customer_avg,
       (SELECT round(quantile_cont(rev, 0.5), 2) FROM customers_t) AS revenue_per_customer_median,
       (SELECT count(*) FILTER (WHERE n >= 2) FROM customers_t) AS returning_customers,
       (SELECT count(*) FILTER (WHERE n < 2) FROM customers_t) AS one_time_customers,
       (SELECT round(count(*) FILTER (WHERE n >= 2) / count(*) * 100, 1) FROM customers_t) AS returning_customer_pct,
       (SELECT round(avg(g), 4) FROM growth_t) AS monthly_growth_avg,
       (SELECT round(stddev_samp(g), 4) FROM growth_t) AS monthly_growth_std,
       (SELECT round(min(g), 4) FROM growth_t) AS monthly_growth_min,
       (SELECT round(max(g), 4) FROM growth_t) AS monthly_growth_max,
       (SELECT CASE WHEN avg(g) > 0.01 THEN 'up' WHEN avg(g) < -0.01 THEN 'down' ELSE 'flat' END FROM growth_t)
         AS growth_trend_direction,
       (SELECT count(DISTINCT product) FROM fact) AS product_count""")
def kpi_block(spark, sf):
    return _kpis(sales(spark, sf))


def _kpis(r):
    return kpi.kpi_block(r.orders, ROLES, r.products)


@query("A5_read_parquet", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2""")
def read_parquet(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("quantity"))


@query("D1_line_revenue", """SELECT l_returnflag, round(sum(l_extendedprice / l_quantity * l_quantity), 2) AS from_unit_price,
round(sum(l_extendedprice), 2) AS from_line_total FROM lineitem GROUP BY 1""")
def line_revenue(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", F.expr("l_extendedprice / l_quantity").alias("unit_price"),
        F.col("l_extendedprice").alias("line_total"), F.col("l_quantity").alias("quantity"))
    return lines.groupBy("l_returnflag").agg(
        rnd(F.sum(kpi.line_revenue("unit_price", "quantity")), 2).alias("from_unit_price"),
        rnd(F.sum(kpi.line_revenue("line_total", "quantity")), 2).alias("from_line_total"))


@query("D3_returning_customers", f"""{WITH}, {GRAIN_SQL}
SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS returning, count(*) FILTER (WHERE n < 2) AS one_time,
       round(count(*) FILTER (WHERE n >= 2) / count(*) * 100, 1) AS returning_pct FROM customers_t""")
def returning(spark, sf):
    return kpi.returning_customers(fact(spark, sf, "customer_id", "order_id"), ROLES)


@query("D4_monthly_growth", f"""{WITH}, {GRAIN_SQL}
SELECT round(avg(g), 4) AS monthly_growth_avg, round(stddev_samp(g), 4) AS monthly_growth_std,
       round(min(g), 4) AS monthly_growth_min, round(max(g), 4) AS monthly_growth_max,
       CASE WHEN round(avg(g), 4) > 0.01 THEN 'up' WHEN round(avg(g), 4) < -0.01 THEN 'down' ELSE 'flat' END
         AS growth_trend_direction FROM growth_t""")
def monthly_growth(spark, sf):
    return kpi.growth_summary(_monthly(spark, sf))


def _monthly(spark, sf):
    days = fact(spark, sf, "ts", "revenue").select(F.to_date("ts").alias("day"), "revenue")
    return kpi.monthly_revenue(days)


@query("E8_month_over_month", f"""{WITH}, {GRAIN_SQL}
SELECT CAST(month AS DATE) AS month, round(rev, 2) AS revenue,
       round(rev / nullif(lag(rev) OVER (ORDER BY month), 0) - 1, 6) AS growth FROM months_t""")
def month_over_month(spark, sf):
    return kpi.month_over_month(_monthly(spark, sf)).select(
        "month", rnd("revenue", 2).alias("revenue"), rnd("growth", 6).alias("growth"))


_DIMS = {"brand": "brand", "ptype": "ptype", "mktsegment": "mktsegment", "nation": "nation", "priority": "priority"}
_BY_DIM = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, sum(revenue) AS rev FROM fact WHERE {d} IS NOT NULL GROUP BY {d}" for d in _DIMS)


def _top_by_dimension(top: int) -> str:
    return f"""{WITH}, d AS ({_BY_DIM}), r AS (
      SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY rev DESC, value) AS rank,
             sum(rev) OVER (PARTITION BY dimension) AS total FROM d)
    SELECT dimension, value, round(rev, 2) AS revenue, round(rev / total * 100, 1) AS revenue_pct, rank
    FROM r WHERE rank <= {top}"""


@query("D5_category_revenue", _top_by_dimension(20))
def category_revenue(spark, sf):
    return _by_dimension(sales(spark, sf, *_DIMS), 20)


def _by_dimension(r, top):
    """The dimensions of a product from the sums per product, the others from those per order."""
    return kpi.revenue_by_dimensions(r.products, ROLES, ["brand", "ptype"], top, (r.orders, ["mktsegment", "nation", "priority"]))


@query("D21_channel_performance", _top_by_dimension(8))
def channel_performance(spark, sf):
    return _by_dimension(sales(spark, sf, *_DIMS), 8)


@query("F1_ranked_products", f"""{WITH}, p AS (SELECT product, sum(revenue) AS rev FROM fact GROUP BY 1)
SELECT 'top' AS side, row_number() OVER (ORDER BY rev DESC, product) AS rank, product, round(rev, 2) AS revenue FROM p QUALIFY rank <= 10
UNION ALL
SELECT 'bottom', row_number() OVER (ORDER BY rev, product DESC) AS rank, product, round(rev, 2) FROM p QUALIFY rank <= 10""")
def ranked_products(spark, sf):
    return kpi.ranked_products(fact(spark, sf, "product", "revenue"), ROLES)


_LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_NUMS = _LINE_COLS[:8]
_GRADE = "CASE WHEN {0} > 10 THEN 'high' WHEN {0} > 3 THEN 'medium' ELSE 'low' END"


def _quality_sql() -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _LINE_COLS)
    parts = [
        f"""SELECT 'missing_values' AS check_name, NULL AS column_name, {nulls} AS n,
        round(({nulls}) / (count(*) * {len(_LINE_COLS)}) * 100, 2) AS pct, {_GRADE.format('pct')} AS severity FROM t""",
        f"""SELECT 'duplicate_rows', NULL, n2, p2, {_GRADE.format('p2')} FROM (
          SELECT n - d AS n2, round((n - d) / n * 100, 2) AS p2 FROM (SELECT count(*) AS n FROM t), (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM t)))""",
        """SELECT 'zero_quantity', 'l_quantity', count(*) FILTER (WHERE l_quantity = 0) AS n3, round(n3 / count(*) * 100, 2),
        'low' FROM t HAVING n3 > 0""",
    ]
    for c in _LINE_COLS:
        kind = "integer" if c in _LINE_COLS[:4] else "float" if c in _LINE_NUMS else "datetime" if "date" in c else "string"
        parts.append(f"SELECT 'column_type_{kind}', '{c}', NULL, NULL, 'info'")
        parts.append(f"""SELECT 'missing_in_column', '{c}', count(*) FILTER (WHERE {c} IS NULL) AS k, round(k / count(*) * 100, 2),
        'info' FROM t HAVING k > 0""")
    for c in _LINE_NUMS:
        parts.append(f"""SELECT 'outliers', '{c}', k, p, {_GRADE.format('p')} FROM (
          SELECT count(*) FILTER (WHERE {c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) AS k, round(k / count({c}) * 100, 2) AS p
          FROM t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM t)) WHERE p > 1""")
    parts.append("""SELECT 'negative_values', 'l_extendedprice', k, p, CASE WHEN p > 5 THEN 'high' ELSE 'low' END FROM (
      SELECT count(*) FILTER (WHERE l_extendedprice < 0) AS k, round(k / count(*) * 100, 2) AS p FROM t) WHERE k > 0""")
    return "WITH t AS (SELECT * FROM lineitem) " + " UNION ALL ".join(parts)


@query("D6_quality_report", _quality_sql())
def quality_report(spark, sf):
    return quality.quality_report(table(spark, sf, "lineitem"), money=["l_extendedprice"], quantity="l_quantity")


@query("D27_duplicate_rows", """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS later_copies,
CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS all_copies
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def duplicate_rows(spark, sf):
    return quality.duplicate_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@query("D36_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS columns FROM {t}" for t in _TABLES))
def row_counts(spark, sf):
    return quality.row_counts({t: table(spark, sf, t) for t in _TABLES})


@query("D8_series_stats", f"""{WITH}, {DAILY_SQL},
weekly AS (SELECT CAST(date_trunc('week', day) AS DATE) + 6 AS week, sum(y) AS y FROM daily GROUP BY 1)
SELECT 'daily' AS grain, count(*) AS periods, min(day) AS first, max(day) AS last, round(avg(y), 2) AS mean,
       round(stddev_samp(y), 2) AS std, round(min(y), 2) AS min, round(max(y), 2) AS max FROM daily
UNION ALL SELECT 'weekly', count(*), min(week), max(week), round(avg(y), 2), round(stddev_samp(y), 2), round(min(y), 2),
       round(max(y), 2) FROM weekly""")
def series_stats(spark, sf):
    return series.series_stats(_daily(spark, sf))


def _daily(spark, sf):
    return series.daily_series(fact(spark, sf, "ts", "revenue"), ROLES)


@query("D9_trend", f"""{WITH}, {DAILY_SQL}
SELECT round(regr_slope(y, x), 4) AS trend_slope,
       CASE WHEN round(regr_slope(y, x), 4) > 0 THEN 'up' WHEN round(regr_slope(y, x), 4) < 0 THEN 'down' ELSE 'flat' END
         AS trend_direction
FROM (SELECT y, row_number() OVER (ORDER BY day) - 1 AS x FROM daily)""")
def trend(spark, sf):
    return series.trend(_daily(spark, sf))


@query("E4_rolling_means", f"""{WITH}, {DAILY_SQL}, r AS (SELECT day, row_number() OVER (ORDER BY day) AS n,
  avg(y) OVER (ORDER BY day ROWS 6 PRECEDING) AS a, avg(y) OVER (ORDER BY day ROWS 13 PRECEDING) AS b,
  avg(y) OVER (ORDER BY day ROWS 29 PRECEDING) AS c FROM daily)
SELECT day, CASE WHEN n >= 7 THEN round(a, 2) END AS mean_7, CASE WHEN n >= 14 THEN round(b, 2) END AS mean_14,
       CASE WHEN n >= 30 THEN round(c, 2) END AS mean_30 FROM r ORDER BY day DESC LIMIT 30""")
def rolling_means(spark, sf):
    return series.rolling_means(_daily(spark, sf))


@query("E5_structural_breaks", f"""{WITH}, {DAILY_SQL}, r AS (SELECT day,
  avg(y) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, count(y) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS nb,
  avg(y) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a, count(y) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS na
  FROM daily)
SELECT day, round(b, 2) AS before_avg, round(a, 2) AS after_avg, round((a - b) / abs(b) * 100, 2) AS change_pct
FROM r WHERE na = 3 AND nb = 3 AND b <> 0 AND abs((a - b) / abs(b) * 100) > 20""")
def structural_breaks(spark, sf):
    return series.structural_breaks(_daily(spark, sf))


@query("E6_z_anomalies", f"""{WITH}, {DAILY_SQL}, s AS (SELECT avg(y) AS m, stddev_samp(y) AS sd FROM daily)
SELECT day, round(y, 2) AS y, round((y - m) / sd, 4) AS z,
       CASE WHEN y > m * 1.5 THEN 'spike' WHEN y < m * 0.5 THEN 'drop' ELSE 'anomaly' END AS kind
FROM daily, s WHERE abs((y - m) / sd) > 2.5""")
def z_anomalies(spark, sf):
    return series.z_anomalies(_daily(spark, sf))


@query("E7_iqr_anomalies", f"""{WITH}, {DAILY_SQL}, q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM daily)
SELECT day, round(y, 2) AS y, round(a - 1.5 * (b - a), 2) AS lower, round(b + 1.5 * (b - a), 2) AS upper
FROM daily, q WHERE b > a AND (y < a - 1.5 * (b - a) OR y > b + 1.5 * (b - a))""")
def iqr_anomalies(spark, sf):
    return series.iqr_anomalies(_daily(spark, sf))


# --- decision measures -------------------------------------------------------

PERIODS_SQL = """bounds AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM fact),
months AS (SELECT CASE WHEN hi = last_day(hi) THEN CAST(date_trunc('month', hi) AS DATE)
                       ELSE CAST(date_trunc('month', hi) - INTERVAL 1 MONTH AS DATE) END AS m FROM bounds),
periods AS (
  SELECT 'rolling_30d' AS basis, 'current' AS side, hi - 29 AS "start", hi AS "end" FROM bounds
  UNION ALL SELECT 'rolling_30d', 'prior', hi - 59, hi - 30 FROM bounds
  UNION ALL SELECT 'last_month', 'current', m, last_day(m) FROM months
  UNION ALL SELECT 'last_month', 'prior', CAST(m - INTERVAL 1 MONTH AS DATE), m - 1 FROM months),
stats AS (SELECT basis, side, "start", "end", "end" - "start" + 1 AS days, coalesce(sum(revenue), 0) AS revenue,
  count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, coalesce(sum(quantity), 0) AS units,
  sum(revenue) / nullif(count(DISTINCT order_id), 0) AS aov, count(ts) AS rows
  FROM periods LEFT JOIN fact ON ts >= "start" AND ts < "end" + 1 GROUP BY ALL)"""


def _periods(spark, sf):
    return dm.comparison_periods(*dm.date_bounds(fact(spark, sf, "ts"), "ts"))


def _period_stats(orders):
    return dm.period_stats(orders, ROLES, dm.comparison_periods(*dm.date_bounds(orders, "ts")))


@query("D10_period_stats", f"""{WITH}, {PERIODS_SQL}
SELECT basis, side, "start", "end", days, round(revenue, 2) AS revenue, orders, customers, round(units, 2) AS units,
       round(aov, 2) AS aov, rows FROM stats""")
def period_stats(spark, sf):
    return dm.rounded_period_stats(_period_stats(fact(spark, sf, "order_id", "customer_id", "ts", "revenue", "quantity")))


BRIDGE_SQL = """b AS (SELECT c.basis, c.revenue AS rc, p.revenue AS rp, c.orders AS oc, p.orders AS op, c.aov AS ac, p.aov AS ap,
  c.customers AS cc, p.customers AS cp FROM stats c JOIN stats p ON c.basis = p.basis AND c.side = 'current' AND p.side = 'prior'),
bridge AS (SELECT basis, round(rc - rp, 2) AS revenue_change, round((rc - rp) / abs(rp) * 100, 1) AS revenue_change_pct,
  round((oc - op) * ap, 2) AS volume_effect, round((ac - ap) * op, 2) AS basket_effect,
  round((oc - op) * (ac - ap), 2) AS interaction_effect,
  round(rc - rp - ((oc - op) * ap + (ac - ap) * op + (oc - op) * (ac - ap)), 2) + 0.0 AS residual,
  CASE WHEN abs((oc - op) * ap) >= abs((ac - ap) * op) THEN 'volume' ELSE 'basket size' END AS primary_driver,
  oc - op AS orders_change, round(ac - ap, 2) AS aov_change, cc - cp AS customers_change FROM b)"""


@query("D11_revenue_bridge", f"{WITH}, {PERIODS_SQL}, {BRIDGE_SQL} SELECT * FROM bridge")
def revenue_bridge(spark, sf):
    return dm.bridge(_period_stats(fact(spark, sf, "order_id", "customer_id", "ts", "revenue", "quantity")))


def _bridge(r):
    return dm.bridge(_period_stats(r.orders))


def _pareto_sql(entity: str, kind: str) -> str:
    return f"""per_{kind} AS (SELECT {entity} AS entity, sum(revenue) AS rev FROM fact WHERE {entity} IS NOT NULL GROUP BY 1 HAVING sum(revenue) > 0),
r_{kind} AS (SELECT *, row_number() OVER (ORDER BY rev DESC, entity) AS rn, sum(rev) OVER (ORDER BY rev DESC, entity ROWS UNBOUNDED PRECEDING) AS cum,
  sum(rev) OVER () AS total, count(*) OVER () AS n,
  greatest(1, CAST(round_even(count(*) OVER () * 0.1, 0) AS BIGINT)) AS dec FROM per_{kind}),
pareto_{kind} AS (SELECT '{kind}' AS kind, count(*) AS total_count, round(any_value(total), 2) AS total_revenue,
  min(rn) FILTER (WHERE cum / total >= 0.8) AS count_for_80pct,
  round(min(rn) FILTER (WHERE cum / total >= 0.8) / count(*) * 100, 1) AS count_for_80pct_share_of_base,
  min(rn) FILTER (WHERE cum / total >= 0.5) AS count_for_50pct,
  max(CAST(entity AS VARCHAR)) FILTER (WHERE rn = 1) AS top1_name, round(max(rev) FILTER (WHERE rn = 1), 2) AS top1_revenue,
  round(max(rev) FILTER (WHERE rn = 1) / any_value(total) * 100, 1) AS top1_share,
  CASE WHEN count(*) >= 5 THEN round(sum(rev) FILTER (WHERE rn <= 5) / any_value(total) * 100, 1) END AS top5_share,
  CASE WHEN count(*) >= 10 THEN round(sum(rev) FILTER (WHERE rn <= 10) / any_value(total) * 100, 1) END AS top10_share,
  any_value(dec) AS top_decile_count, round(sum(rev) FILTER (WHERE rn <= dec) / any_value(total) * 100, 1) AS top_decile_share,
  round(sum(rev) FILTER (WHERE rn > n // 2) / any_value(total) * 100, 1) AS bottom_half_share FROM r_{kind})"""


@query("D12_concentration", f"""{WITH}, {_pareto_sql('product', 'product')}, {_pareto_sql('customer_id', 'customer')}
SELECT * FROM pareto_product UNION ALL SELECT * FROM pareto_customer""")
def concentration(spark, sf):
    r = sales(spark, sf)
    return _pareto(r, "product").unionByName(_pareto(r, "customer"))


def _pareto(r, kind):
    if kind == "product":
        return dm.concentration(r.products, "product", "revenue", kind)
    return dm.concentration(r.orders, "customer_id", "revenue", kind)


def _momentum_side(label: str, sign: str, order: str) -> str:
    return f"""SELECT '{label}' AS side, row_number() OVER (ORDER BY delta {order}, product) AS rank, product,
round(cur, 2) AS current_revenue, round(pri, 2) AS prior_revenue, round(delta, 2) AS change,
round(delta / nullif(pri, 0) * 100, 1) AS change_pct, pri = 0 AS is_new, cur = 0 AS is_lost
FROM m, f WHERE abs(delta) >= floor AND delta {sign} 0 QUALIFY rank <= 5"""


@query("C12_momentum", f"""{WITH}, {PERIODS_SQL},
pp AS (SELECT max("start") FILTER (WHERE side = 'current') AS cs, max("end") FILTER (WHERE side = 'current') AS ce,
  max("start") FILTER (WHERE side = 'prior') AS ps, max("end") FILTER (WHERE side = 'prior') AS pe FROM periods WHERE basis = 'last_month'),
m AS (SELECT product, coalesce(sum(revenue) FILTER (WHERE ts >= cs AND ts < ce + 1), 0) AS cur,
  coalesce(sum(revenue) FILTER (WHERE ts >= ps AND ts < pe + 1), 0) AS pri, cur - pri AS delta FROM fact, pp
  WHERE ts >= ps AND ts < ce + 1 AND product IS NOT NULL GROUP BY product),
f AS (SELECT greatest(sum(cur), sum(pri)) * 0.005 AS floor FROM m)
{_momentum_side('riser', '>', 'DESC')} UNION ALL {_momentum_side('faller', '<', 'ASC')}""")
def momentum(spark, sf):
    chosen = {(p.basis, p.side): p for p in _periods(spark, sf)}
    return dm.momentum(fact(spark, sf, "product", "ts", "revenue"), ROLES,
                       chosen["last_month", "current"], chosen["last_month", "prior"])


def _with_cost(**given):
    from dataclasses import replace

    return replace(ROLES, **given)


@query("D13_profit_gate", f"""{WITH}
SELECT 'line cost' AS case_name, NULL::DOUBLE AS profit_share, round(avg(CASE WHEN cost <= revenue + 0.01 THEN 1.0 ELSE 0.0 END), 3) AS line_cost_share,
  round(avg(CASE WHEN cost * quantity <= revenue + 0.01 THEN 1.0 ELSE 0.0 END), 3) AS unit_cost_share,
  CASE WHEN avg(CASE WHEN cost <= revenue + 0.01 THEN 1.0 ELSE 0.0 END) >= 0.95 THEN 'line cost' ELSE 'not proven' END AS basis FROM fact
UNION ALL
SELECT 'retail as cost', NULL, round(avg(CASE WHEN retail * quantity <= revenue + 0.01 THEN 1.0 ELSE 0.0 END), 3),
  round(avg(CASE WHEN retail * quantity * quantity <= revenue + 0.01 THEN 1.0 ELSE 0.0 END), 3), 'not proven' FROM fact
UNION ALL
SELECT 'profit column', round(avg(CASE WHEN abs((revenue - cost) - (revenue - cost)) <= greatest(abs(revenue - cost) * 0.01, 0.01) THEN 1.0 ELSE 0.0 END), 3),
  round(avg(CASE WHEN cost <= revenue + 0.01 THEN 1.0 ELSE 0.0 END), 3),
  round(avg(CASE WHEN cost * quantity <= revenue + 0.01 THEN 1.0 ELSE 0.0 END), 3), 'profit column' FROM fact""")
def profit_gate(spark, sf):
    lines = fact(spark, sf, "revenue", "quantity", "cost", "retail").withColumns(
        {"profit": F.expr("revenue - cost"), "retail_cost": F.expr("retail * quantity")})
    cases = {"line cost": _with_cost(cost="cost"), "retail as cost": _with_cost(cost="retail_cost"),
             "profit column": _with_cost(cost="cost", profit="profit")}
    out = None
    for name, roles in cases.items():
        one = dm.profit_gate(lines, roles).select(F.lit(name).alias("case_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


MARGIN_SQL = """mp AS (SELECT product, sum(revenue) AS rev, sum(revenue - cost) AS profit FROM fact GROUP BY 1),
mt AS (SELECT sum(rev) AS trev, sum(profit) AS tprofit, sum(profit) / sum(rev) * 100 AS overall FROM mp),
mm AS (SELECT *, profit / rev * 100 AS pct FROM mp, mt WHERE rev > 0),
margin AS (SELECT round(any_value(trev), 2) AS revenue, round(any_value(tprofit), 2) AS gross_profit,
  round(any_value(tprofit) / any_value(trev) * 100, 1) AS gross_margin_pct,
  count(*) FILTER (WHERE rev >= trev * 0.01 AND pct < overall - 2) AS margin_drag_products,
  round(coalesce(sum(rev) FILTER (WHERE rev >= trev * 0.01 AND pct < overall - 2), 0), 2) AS margin_drag_revenue,
  round(coalesce(sum(rev) FILTER (WHERE rev >= trev * 0.01 AND pct < overall - 2), 0) / any_value(trev) * 100, 1) AS margin_drag_share,
  round(sum(rev * overall / 100 - profit) FILTER (WHERE rev >= trev * 0.01 AND pct < overall - 2), 2) AS margin_drag_uplift FROM mm)"""


def _product_profit(r):
    return dm.product_profit(r.products, COSTED)


@query("D14_margin_summary", f"{WITH}, {MARGIN_SQL} SELECT * FROM margin")
def margin_summary(spark, sf):
    return _margin(sales(spark, sf))


def _margin(r):
    return dm.margin_summary(_product_profit(r))


def _margin_list(label: str, keep: str, order: str) -> str:
    return f"""SELECT '{label}' AS list, row_number() OVER (ORDER BY {order}, product) AS rank, product, round(rev, 2) AS revenue,
round(profit, 2) AS gross_profit, round(pct, 1) AS margin_pct, round(rev / trev * 100, 1) AS revenue_share
FROM mm WHERE product IS NOT NULL AND {keep} QUALIFY rank <= 5"""


@query("D14_margin_products", f"""{WITH}, {MARGIN_SQL} {" UNION ALL ".join([
    _margin_list('best', 'rev >= trev * 0.01', 'pct DESC'), _margin_list('worst', 'rev >= trev * 0.01', 'pct'),
    _margin_list('loss_making', 'profit < 0', 'profit'),
    _margin_list('drag', 'rev >= trev * 0.01 AND pct < overall - 2', 'rev DESC')])}""")
def margin_products(spark, sf):
    return dm.margin_products(_product_profit(sales(spark, sf)))


DISCOUNT_SQL = """g AS (SELECT count(*) AS n, sum(unit_price * quantity) AS gross, sum(revenue) AS net,
  count(*) FILTER (WHERE discount > 0) AS k, avg(discount) FILTER (WHERE discount > 0) AS a, max(discount) AS mx,
  avg(CASE WHEN abs(revenue - unit_price * quantity * (1 - discount)) <= greatest(abs(unit_price * quantity * (1 - discount)) * 0.01, 0.01) THEN 1.0 ELSE 0.0 END) AS f,
  avg(CASE WHEN abs(revenue - unit_price * quantity * (1 - discount / 100)) <= greatest(abs(unit_price * quantity * (1 - discount / 100)) * 0.01, 0.01) THEN 1.0 ELSE 0.0 END) AS p
  FROM fact),
disc AS (SELECT CASE WHEN p >= 0.95 THEN 'percent' ELSE 'fraction' END AS scale, round(f, 3) AS identity_share,
  round(gross, 2) AS gross_before_discount, round(net, 2) AS revenue_after_discount, round(gross - net, 2) AS discount_given,
  round((gross - net) / gross * 100, 1) AS discount_share_of_gross, k AS lines_discounted,
  round(k / n * 100, 1) AS lines_discounted_pct, round(a * 100, 1) AS avg_discount_on_discounted_lines_pct,
  round(mx * 100, 1) AS max_discount_pct FROM g WHERE p >= 0.95 OR f >= 0.95)"""


@query("D15_discount_given", f"{WITH}, {DISCOUNT_SQL} SELECT * FROM disc")
def discount_given(spark, sf):
    return _discount(sales(spark, sf))


def _discount(r):
    return dm.discount_given(r.products, ROLES)


WEEKDAY_SQL = """wd AS (SELECT dayname(day) AS d, avg(y) AS m, count(*) AS k, sum(y) AS s FROM daily GROUP BY 1),
wo AS (SELECT sum(s) / sum(k) AS o, sum(k) AS n, min(k) AS fewest FROM wd),
wb AS (SELECT d AS bd, m AS bm FROM wd ORDER BY m DESC, d DESC LIMIT 1), ww AS (SELECT d AS wdn, m AS wm, k AS wk FROM wd ORDER BY m, d LIMIT 1),
weekday AS (SELECT round(n / 7, 1) AS weeks_covered, round(o, 2) AS avg_daily_revenue, bd AS best_day, round(bm, 2) AS best_day_avg,
  round((bm - o) / o * 100, 1) AS best_day_vs_avg_pct, wdn AS worst_day, round(wm, 2) AS worst_day_avg,
  round((wm - o) / o * 100, 1) AS worst_day_vs_avg_pct, wk AS worst_day_count, round((o - wm) * wk, 2) AS worst_day_gap_total
  FROM wo, wb, ww WHERE fewest >= 4)"""


@query("D16_weekday_rhythm", f"{WITH}, {DAILY_SQL}, {WEEKDAY_SQL} SELECT * FROM weekday")
def weekday(spark, sf):
    return dm.weekday_rhythm(dm.weekday_days(fact(spark, sf, "ts", "revenue"), ROLES))


def _weekday(r):
    return dm.weekday_rhythm(dm.weekday_days(r.orders, ROLES))


REPEAT_SQL = """repeat_e AS (SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeat_customers,
  round(count(*) FILTER (WHERE n >= 2) / count(*) * 100, 1) AS repeat_rate_pct, count(*) FILTER (WHERE n < 2) AS one_time_customers,
  round(count(*) FILTER (WHERE n < 2) / count(*) * 100, 1) AS one_time_rate_pct,
  round(coalesce(sum(rev) FILTER (WHERE n >= 2), 0), 2) AS repeat_revenue,
  round(coalesce(sum(rev) FILTER (WHERE n >= 2), 0) / sum(rev) * 100, 1) AS repeat_revenue_share,
  round(coalesce(sum(rev) FILTER (WHERE n < 2), 0), 2) AS one_time_revenue, round(avg(n), 2) AS avg_orders_per_customer,
  round(avg(rev) FILTER (WHERE n >= 2), 2) AS avg_revenue_per_repeat_customer,
  round(avg(rev) FILTER (WHERE n < 2), 2) AS avg_revenue_per_one_time_customer,
  (SELECT round(quantile_cont(rev, 0.5), 2) FROM orders_t) AS median_order_value FROM customers_t)"""


@query("D17_repeat_economics", f"{WITH}, {GRAIN_SQL}, {REPEAT_SQL} SELECT * FROM repeat_e")
def repeat_economics(spark, sf):
    return _repeat(sales(spark, sf))


def _repeat(r):
    return dm.repeat_economics(r.orders, ROLES)


SCENARIOS_SQL = """scen AS (
SELECT 'decline_recovery' AS key, abs(revenue_change) AS value, 'demand / traffic recovery' AS action FROM bridge
  WHERE basis = 'last_month' AND revenue_change < 0
UNION ALL SELECT 'weak_weekday_uplift', worst_day_gap_total, 'staffing, stock and promotion timing' FROM weekday WHERE worst_day_gap_total <> 0
UNION ALL SELECT 'second_purchase_upside', round(one_time_customers * median_order_value, 2), 'retention / reactivation campaign'
  FROM repeat_e WHERE one_time_customers > 0
UNION ALL SELECT 'top_product_dependency', top1_revenue, 'supply / supplier risk review for the top seller' FROM pareto_product
UNION ALL SELECT 'margin_normalisation_upside', margin_drag_uplift, 'pricing / sourcing review on the named products'
  FROM margin WHERE margin_drag_uplift <> 0
UNION ALL SELECT 'discount_recapture', discount_given, 'discount-policy review' FROM disc WHERE discount_given <> 0)"""


@query("D18_scenarios", f"""{WITH}, {DAILY_SQL}, {GRAIN_SQL}, {PERIODS_SQL}, {BRIDGE_SQL}, {_pareto_sql('product', 'product')},
{MARGIN_SQL}, {DISCOUNT_SQL}, {WEEKDAY_SQL}, {REPEAT_SQL}, {SCENARIOS_SQL} SELECT * FROM scen""")
def scenarios(spark, sf):
    r = sales(spark, sf).stored()
    return dm.scenarios(bridges=_bridge(r), weekday=_weekday(r), repeat=_repeat(r), products=_pareto(r, "product"), margin=_margin(r), discount=_discount(r))


@query("D19_coverage", f"""{WITH} SELECT CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date,
  CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1 AS days_span, count(DISTINCT CAST(ts AS DATE)) AS days_with_data,
  CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1 - count(DISTINCT CAST(ts AS DATE)) AS days_without_data, count(*) AS rows,
  count(*) FILTER (WHERE ts IS NULL) AS rows_without_date,
  round((CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1) / 30.44, 1) AS months_span FROM fact""")
def coverage(spark, sf):
    return dm.coverage(fact(spark, sf, "ts"), ROLES)


@query("F6_movers_with_floor", f"""{WITH}, {PERIODS_SQL},
pp AS (SELECT max("start") FILTER (WHERE side = 'current') AS cs, max("end") FILTER (WHERE side = 'current') AS ce,
  max("start") FILTER (WHERE side = 'prior') AS ps, max("end") FILTER (WHERE side = 'prior') AS pe FROM periods WHERE basis = 'rolling_30d'),
m AS (SELECT product, coalesce(sum(revenue) FILTER (WHERE ts >= cs AND ts < ce + 1), 0) AS cur,
  coalesce(sum(revenue) FILTER (WHERE ts >= ps AND ts < pe + 1), 0) AS pri, cur - pri AS delta FROM fact, pp
  WHERE ts >= ps AND ts < ce + 1 AND product IS NOT NULL GROUP BY product),
f AS (SELECT greatest(sum(cur), sum(pri)) * 0.005 AS floor FROM m)
{_momentum_side('riser', '>', 'DESC')} UNION ALL {_momentum_side('faller', '<', 'ASC')}""")
def movers(spark, sf):
    chosen = {(p.basis, p.side): p for p in _periods(spark, sf)}
    return dm.momentum(fact(spark, sf, "product", "ts", "revenue"), ROLES,
                       chosen["rolling_30d", "current"], chosen["rolling_30d", "prior"])


@query("D34_kpi_cards", f"""{WITH}, {GRAIN_SQL}, c AS (
  SELECT 1 AS position, 'Total revenue' AS label, round(sum(revenue), 2) AS value FROM fact
  UNION ALL SELECT 2, 'Orders', count(*) FROM orders_t UNION ALL SELECT 3, 'Average order value', round(avg(rev), 2) FROM orders_t
  UNION ALL SELECT 4, 'Customers', count(*) FROM customers_t UNION ALL SELECT 5, 'Products', count(DISTINCT product) FROM fact)
SELECT position, label, CAST(value AS DOUBLE) AS value FROM c""")
def kpi_cards(spark, sf):
    return kpi.kpi_cards(kpi_block(spark, sf))
