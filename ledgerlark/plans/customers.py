"""Customer features, RFM, lifecycle, state and churn queries."""

from __future__ import annotations



from pyspark.sql import functions as F

from ledgerlark.functions.numbers import risk_tier, rnd
from ledgerlark.functions.scale import materialise
from ledgerlark.operators import churn, customers
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import FACT_SQL, ROLES, fact

W = f"WITH {FACT_SQL}"
_COLUMNS = ["order_id", "customer_id", "ts", "product", "brand", "revenue", "quantity", "discount"]


def lines(spark, sf, *extra):
    return fact(spark, sf, *_COLUMNS, *extra, bounded=True)


def _features_sql(cutoffs: str, label: str = "") -> str:
    """Feature rows per (cutoff, customer) from a relation of cutoffs."""
    return f"""cut AS ({cutoffs}),
fx AS (SELECT cut.cutoff, customer_id AS customer, min(ts) AS first_order, max(ts) AS last_order,
  greatest(date_diff('day', max(ts), cut.cutoff), 0) AS recency_days, count(DISTINCT order_id) AS frequency, sum(revenue) AS monetary,
  greatest(date_diff('day', min(ts), cut.cutoff), 0) AS tenure_days,
  count(DISTINCT order_id) FILTER (WHERE ts > cut.cutoff - INTERVAL 30 DAY) AS orders_last_30,
  count(DISTINCT order_id) FILTER (WHERE ts > cut.cutoff - INTERVAL 60 DAY) AS orders_last_60,
  count(DISTINCT order_id) FILTER (WHERE ts > cut.cutoff - INTERVAL 90 DAY) AS orders_last_90,
  coalesce(sum(revenue) FILTER (WHERE ts > cut.cutoff - INTERVAL 90 DAY), 0) AS spend_last_90,
  count(DISTINCT product) AS distinct_products, count(DISTINCT brand) AS distinct_categories, sum(quantity) AS total_quantity,
  coalesce(avg(discount), 0) AS avg_discount
  FROM cut JOIN fact ON ts <= cut.cutoff WHERE customer_id IS NOT NULL GROUP BY 1, 2),
feats AS (SELECT *, coalesce(monetary / nullif(frequency, 0), 0) AS avg_order_value, tenure_days / greatest(frequency, 1) AS avg_interpurchase_days,
  coalesce(spend_last_90 / nullif(monetary, 0), 0) AS spend_trend{label} FROM fx)"""


_LAST = "SELECT max(ts) AS cutoff FROM fact"
_ROUNDED = {"monetary": 2, "avg_order_value": 2, "avg_interpurchase_days": 4, "spend_last_90": 2, "spend_trend": 4, "total_quantity": 2, "avg_discount": 4}
_FEATURE_COLS = ["customer", "first_order", "last_order", *customers.FEATURES]
_FEATURE_SELECT = ", ".join(f"round({c}, {_ROUNDED[c]}) AS {c}" if c in _ROUNDED else c for c in _FEATURE_COLS)


def _shown(df, *extra):
    return df.select(*extra, *[rnd(F.col(c), _ROUNDED[c]).alias(c) if c in _ROUNDED else F.col(c) for c in _FEATURE_COLS])


def _span(spark, sf):
    return churn.history(fact(spark, sf, "ts", bounded=True), ROLES)


def _last(spark, sf):
    return _span(spark, sf)[1]


@query("D23_customer_features", f"{W}, {_features_sql(_LAST)} SELECT {_FEATURE_SELECT} FROM feats")
def customer_features(spark, sf):
    return _shown(customers.features(lines(spark, sf), ROLES, _last(spark, sf)))


_RFM_SQL = """base AS (SELECT customer_id AS customer, date_diff('day', max(ts), (SELECT max(ts) FROM fact) + INTERVAL 1 DAY) AS recency,
  count(DISTINCT order_id) AS frequency, sum(revenue) AS monetary FROM fact WHERE customer_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
ranked AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency, customer) - 1 AS rr,
  row_number() OVER (ORDER BY frequency, customer) - 1 AS rf, row_number() OVER (ORDER BY monetary, customer) - 1 AS rm FROM base),
scored AS (SELECT customer, recency, frequency, monetary, CAST(6 - greatest(1, ceil(rr * 5 / (n - 1))) AS INT) AS r,
  CAST(greatest(1, ceil(rf * 5 / (n - 1))) AS INT) AS f, CAST(greatest(1, ceil(rm * 5 / (n - 1))) AS INT) AS m FROM ranked),
rfm0 AS (SELECT *, CAST(round_even((f + m) / 2, 0) AS INT) AS fm FROM scored),
grid(r, fm, segment) AS (VALUES """ + ", ".join(f"({r}, {fm}, '{s.replace(chr(39), chr(39) * 2)}')" for (r, fm), s in customers.SEGMENTS.items()) + """),
rfm AS (SELECT rfm0.*, segment FROM rfm0 JOIN grid USING (r, fm))"""


@query("E1_rfm_scores", f"{W}, {_RFM_SQL} SELECT customer, r, f, m FROM rfm")
def rfm_scores(spark, sf):
    return _rfm(spark, sf).select("customer", "r", "f", "m")


def _rfm(spark, sf):
    return customers.rfm(fact(spark, sf, "customer_id", "order_id", "ts", "revenue"), ROLES)


@query("E2_combined_score", f"{W}, {_RFM_SQL} SELECT fm, count(*) AS customers FROM rfm GROUP BY 1")
def combined(spark, sf):
    return _rfm(spark, sf).groupBy("fm").agg(F.count(F.lit(1)).alias("customers"))


@query("E3_segments", f"{W}, {_RFM_SQL} SELECT customer, recency, frequency, round(monetary, 2) AS monetary, segment FROM rfm")
def segments(spark, sf):
    return _rfm(spark, sf).select("customer", "recency", "frequency", rnd(F.col("monetary")).alias("monetary"), "segment")


@query("D22_segment_summary", f"""{W}, {_RFM_SQL} SELECT segment, count(*) AS customers, round(count(*) / (SELECT count(*) FROM rfm) * 100, 1) AS customer_pct,
  round(sum(monetary), 2) AS revenue, round(sum(monetary) / (SELECT sum(monetary) FROM rfm) * 100, 1) AS revenue_pct, round(avg(recency), 1) AS avg_recency_days,
  round(avg(frequency), 2) AS avg_frequency, round(avg(monetary), 2) AS avg_monetary, round(avg(r + f + m), 2) AS avg_rfm_score FROM rfm GROUP BY 1""")
def segment_summary(spark, sf):
    return customers.segment_summary(_rfm(spark, sf))


def _in(names):
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


@query("D20_marketing_kpis", f"""{W}, {_RFM_SQL} SELECT count(*) AS customers, round(count(*) FILTER (WHERE frequency >= 2) / count(*) * 100, 1) AS repeat_purchase_rate,
  round(count(*) FILTER (WHERE frequency < 2) / count(*) * 100, 1) AS one_time_buyer_rate, count(*) FILTER (WHERE segment IN {_in(customers.RISK_SEGMENTS)}) AS churn_risk_customers,
  round(count(*) FILTER (WHERE segment IN {_in(customers.RISK_SEGMENTS)}) / count(*) * 100, 1) AS churn_risk_pct,
  round(coalesce(sum(monetary) FILTER (WHERE segment IN {_in(customers.RISK_SEGMENTS)}), 0), 2) AS revenue_at_risk,
  count(*) FILTER (WHERE segment IN {_in(customers.GROWTH_SEGMENTS)}) AS growth_segment_customers,
  count(*) FILTER (WHERE segment IN {_in(customers.HIGH_VALUE_SEGMENTS)}) AS high_value_customers FROM rfm""")
def marketing_kpis(spark, sf):
    return customers.marketing_kpis(_rfm(spark, sf))


_RULES_SQL = """rules AS (SELECT CASE WHEN count(*) FILTER (WHERE frequency > 1) >= 10 AND quantile_cont(avg_interpurchase_days, 0.5) FILTER (WHERE frequency > 1) > 0
  THEN round(quantile_cont(avg_interpurchase_days, 0.5) FILTER (WHERE frequency > 1), 1) ELSE 60.0 END AS cadence,
  CASE WHEN count(*) FILTER (WHERE frequency > 1) >= 10 THEN 'median_interpurchase_days' ELSE 'default_no_repeat_buyers' END AS basis FROM feats)"""
_STAGE = """CASE WHEN recency_days > round(cadence * 3.0, 1) THEN 'Churned' WHEN recency_days > round(cadence * 1.5, 1) THEN 'Dormant'
  WHEN tenure_days <= 90 AND frequency <= 1 THEN 'New' WHEN tenure_days > 0 AND orders_last_90 / (frequency * 90.0 / tenure_days) >= 1.2 THEN 'Growing'
  WHEN tenure_days > 0 AND orders_last_90 / (frequency * 90.0 / tenure_days) <= 0.6 THEN 'Declining' ELSE 'Established' END"""


@query("D25_stage_rules", f"""{W}, {_features_sql(_LAST)}, {_RULES_SQL} SELECT cadence AS cadence_days, basis AS cadence_basis,
  round(cadence * 1.5, 1) AS dormant_after_days, round(cadence * 3.0, 1) AS churned_after_days, 90 AS new_within_days FROM rules""")
def stage_rules(spark, sf):
    return customers.stage_rules(customers.features(lines(spark, sf), ROLES, _last(spark, sf)))


@query("H19_lifecycle_stage", f"{W}, {_features_sql(_LAST)}, {_RULES_SQL} SELECT customer, {_STAGE} AS stage FROM feats, rules")
def lifecycle(spark, sf):
    table = customers.features(lines(spark, sf), ROLES, _last(spark, sf))
    rules = customers.stage_rules(table).first().asDict()
    return table.select("customer", customers.lifecycle_stage(rules).alias("stage"))


_SCORES_SQL = """bounds AS (SELECT min(ts) AS lo, max(ts) AS hi, least(90, greatest(7, date_diff('day', min(ts), max(ts)) // 3)) AS h FROM fact),
scores AS (SELECT feats.*, round(least(1, greatest(0, recency_days / (SELECT h FROM bounds))), 4) AS p FROM feats)"""
_SCORED = f"{W}, {_features_sql(_LAST)}, {_SCORES_SQL}"


def _scores(spark, sf):
    return churn.heuristic_scores(lines(spark, sf), ROLES)


@query("K7_recency_heuristic", f"{_SCORED} SELECT customer, p AS churn_probability FROM scores")
def recency_heuristic(spark, sf):
    return _scores(spark, sf).select("customer", "churn_probability")


@query("H17_risk_tier", f"{_SCORED} SELECT CASE WHEN p >= 0.7 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END AS tier, count(*) AS customers FROM scores GROUP BY 1")
def tiers(spark, sf):
    return _scores(spark, sf).groupBy(risk_tier(F.col("churn_probability")).alias("tier")).agg(F.count(F.lit(1)).alias("customers"))


@query("D24_risk_summary", f"""{_SCORED} SELECT count(*) AS customers_scored, count(*) FILTER (WHERE p >= 0.7) AS high, count(*) FILTER (WHERE p >= 0.4 AND p < 0.7) AS medium,
  count(*) FILTER (WHERE p < 0.4) AS low, round(coalesce(sum(monetary) FILTER (WHERE p >= 0.5), 0), 2) AS revenue_at_risk,
  round(sum(p * monetary), 2) AS expected_revenue_at_risk FROM scores""")
def risk_summary(spark, sf):
    return churn.risk_summary(_scores(spark, sf))


@query("F2_at_risk_ranking", f"""{_SCORED} SELECT customer, p AS churn_probability, CASE WHEN p >= 0.7 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_tier,
  recency_days, frequency, round(monetary, 2) AS monetary, round(p * monetary, 2) AS expected_loss FROM scores ORDER BY p * monetary DESC, p DESC, customer LIMIT 200""")
def at_risk(spark, sf):
    return churn.at_risk(_scores(spark, sf))


@query("C14_risk_by_segment", f"""{_SCORED}, {_RFM_SQL} SELECT segment, count(*) AS customers_scored, round(avg(p), 3) AS avg_churn_probability,
  count(*) FILTER (WHERE p >= 0.7) AS high_risk_count, round(count(*) FILTER (WHERE p >= 0.7) / count(*) * 100, 1) AS high_risk_pct
  FROM scores JOIN rfm USING (customer) GROUP BY 1""")
def risk_by_segment(spark, sf):
    return churn.risk_by_segment(_scores(spark, sf), _rfm(spark, sf))


@query("C14_target_lists", f"{_SCORED} SELECT CASE WHEN p >= 0.7 THEN 'high_risk' ELSE 'medium_risk' END AS list, customer, p AS churn_probability FROM scores WHERE p >= 0.4")
def target_lists(spark, sf):
    return churn.target_lists(_scores(spark, sf))


@query("B4_parse_time", f"{W} SELECT count(ts) AS rows, CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last FROM fact WHERE priority <> '5-LOW'")
def parse_time(spark, sf):
    text = fact(spark, sf, "ts", "priority").withColumn(
        "ts", F.when(F.col("priority") == "5-LOW", "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return customers.parse_time(text, "ts").agg(F.count(F.lit(1)).alias("rows"), F.min("_dt").alias("first"), F.max("_dt").alias("last"))


# --- training data ------------------------------------------------------------

_CUTOFFS = """SELECT hi - INTERVAL (h) DAY - INTERVAL (i * greatest(7, h // 2)) DAY AS cutoff, CAST(i AS INT) AS position, h FROM
  (SELECT min(ts) AS lo, max(ts) AS hi, least(90, greatest(7, date_diff('day', min(ts), max(ts)) // 3)) AS h FROM fact), range(6) t(i)
  WHERE hi - INTERVAL (h) DAY - INTERVAL (i * greatest(7, h // 2)) DAY >= lo + INTERVAL 14 DAY"""
_LABEL = """, CAST(NOT EXISTS (SELECT 1 FROM fact f, cut k WHERE k.cutoff = fx.cutoff AND f.customer_id = fx.customer AND f.ts > fx.cutoff
  AND f.ts <= fx.cutoff + INTERVAL (k.h) DAY) AS INT) AS churned"""


@query("K1_training_cutoffs", f"{W}, cut AS ({_CUTOFFS}) SELECT position, cutoff, cutoff + INTERVAL (h) DAY AS horizon_end FROM cut")
def training_cutoffs(spark, sf):
    return churn.cutoffs_table(fact(spark, sf, "ts"), ROLES)


def _panel(spark, sf):
    first, last = _span(spark, sf)
    horizon = churn.horizon_for(first, last)
    return customers.feature_panel(lines(spark, sf), ROLES, churn.training_cutoffs(first, last, horizon), horizon)


@query("K2_feature_panel", f"{W}, {_features_sql(_CUTOFFS, _LABEL)} SELECT cutoff, churned, {_FEATURE_SELECT} FROM feats")
def feature_panel(spark, sf):
    return _shown(_panel(spark, sf), "cutoff", "churned")


@query("C17_churn_label", f"{W}, {_features_sql(_CUTOFFS, _LABEL)} SELECT cutoff, customer, churned FROM feats")
def churn_label(spark, sf):
    return _panel(spark, sf).select("cutoff", "customer", "churned")


@query("G5_stacked_panels", f"{W}, {_features_sql(_CUTOFFS, _LABEL)} SELECT cutoff, count(*) AS customers, CAST(sum(churned) AS BIGINT) AS churned FROM feats GROUP BY 1")
def stacked_panels(spark, sf):
    return _panel(spark, sf).groupBy("cutoff").agg(F.count(F.lit(1)).alias("customers"), F.sum("churned").alias("churned"))


def _trained(spark, sf):
    older, newest, validation = churn.split_panel(lines(spark, sf), ROLES)
    model, columns = churn.train(older)
    return model, columns, newest, validation


@query("K3_train_model")
def train_model(spark, sf):
    model, columns, newest, validation = _trained(spark, sf)
    return churn.with_probability(model, newest).agg(
        F.lit(validation).alias("validation"), F.count(F.lit(1)).alias("rows"), F.avg("p").alias("mean_probability"))


@query("K4_model_metrics")
def model_metrics(spark, sf):
    model, _, newest, validation = _trained(spark, sf)
    return churn.metrics(churn.with_probability(model, newest), validation)


@query("K5_calibration")
def calibration(spark, sf):
    model, _, newest, _ = _trained(spark, sf)
    scored = churn.with_probability(model, newest)
    sigmoid = churn.calibrate(scored)
    if sigmoid is None:
        return scored.select("customer", "p", F.col("p").alias("calibrated_p"))
    from pyspark.ml.functions import vector_to_array

    return sigmoid.transform(scored).select("customer", "p", F.round(vector_to_array("calibrated")[1], 4).alias("calibrated_p"))


@query("K6_permutation_importance")
def permutation_importance(spark, sf):
    model, columns, newest, _ = _trained(spark, sf)
    return churn.permutation_importance(model, newest, columns)


@query("K8_score_customers")
def score_customers(spark, sf):
    return churn.score_customers(lines(spark, sf), ROLES).select("customer", "churn_probability", "monetary")


# --- customer state -----------------------------------------------------------

_STATE_SQL = f"""{_SCORED}, {_RULES_SQL}, {_RFM_SQL.replace("+ INTERVAL 1 DAY)", ")")},
people AS (SELECT customer_id AS customer, arg_min(customer_name, (ts, customer_name)) AS display_name FROM fact WHERE customer_name IS NOT NULL GROUP BY 1),
state AS (SELECT CAST(scores.customer AS VARCHAR) AS customer_id, (SELECT CAST(max(ts) AS DATE) FROM fact) AS snapshot_date, display_name, recency_days, scores.frequency,
  round(scores.monetary, 2) AS monetary, tenure_days, round(avg_order_value, 2) AS avg_order_value, CAST(first_order AS DATE) AS first_order_date,
  CAST(last_order AS DATE) AS last_order_date, segment AS rfm_segment, r AS r_score, f AS f_score, m AS m_score, {_STAGE.replace('frequency', 'scores.frequency')} AS lifecycle_stage,
  p AS churn_probability, CASE WHEN p >= 0.7 THEN 'High' WHEN p >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_tier, NULL::DOUBLE AS predicted_clv,
  round(p * round(scores.monetary, 2), 2) AS value_at_risk, 'historical_monetary' AS value_basis
  FROM scores JOIN rfm USING (customer) LEFT JOIN people USING (customer), rules)"""
_STATE_COLS = ("customer_id, snapshot_date, display_name, recency_days, frequency, monetary, tenure_days, avg_order_value, first_order_date, last_order_date, "
               "rfm_segment, r_score, f_score, m_score, lifecycle_stage, churn_probability, risk_tier, predicted_clv, value_at_risk, value_basis")


def state(spark, sf):
    rows, span = lines(spark, sf, "customer_name", "nation"), _span(spark, sf)
    table = materialise(customers.features(rows, ROLES, span[1]))
    scores = churn.heuristic_scores(rows, ROLES, span=span, table=table)
    return customers.customer_state(rows, ROLES, as_of=span[1], scores=scores, contacts={"country": "nation"}, table=table)


@query("M8_customer_state", f"{_STATE_SQL} SELECT {_STATE_COLS} FROM state")
def customer_state(spark, sf):
    return state(spark, sf).drop("contact")


@query("H18_value_at_risk", f"{_STATE_SQL} SELECT customer_id, value_at_risk, value_basis FROM state")
def value_at_risk(spark, sf):
    return state(spark, sf).select("customer_id", "value_at_risk", "value_basis")


@query("C19_names_and_contacts", f"""{W} SELECT customer_id AS customer, arg_min(customer_name, (ts, customer_name)) AS display_name, arg_min(nation, (ts, nation)) AS country
  FROM fact WHERE customer_id IS NOT NULL GROUP BY 1""")
def names_and_contacts(spark, sf):
    return customers.names(fact(spark, sf, "customer_id", "ts", "customer_name", "nation"), ROLES, {"display_name": "customer_name", "country": "nation"})


@query("B2_strip_personal", f"{_STATE_SQL} SELECT {_STATE_COLS.replace('display_name, ', '')} FROM state")
def strip_personal(spark, sf):
    return customers.strip_personal(state(spark, sf).withColumn("_internal", F.lit(1)))


@query("B6_customer_search", f"""{_STATE_SQL} SELECT customer_id, display_name, lifecycle_stage, risk_tier, monetary FROM state
WHERE lifecycle_stage = 'Declining' AND (customer_id ILIKE '%12%' OR display_name ILIKE '%12%')""")
def customer_search(spark, sf):
    return customers.matching(state(spark, sf), stage="Declining", search="12").select("customer_id", "display_name", "lifecycle_stage", "risk_tier", "monetary")


@query("F3_customer_page", f"{_STATE_SQL} SELECT customer_id, value_at_risk FROM state ORDER BY value_at_risk DESC NULLS LAST, customer_id LIMIT 50 OFFSET 50")
def customer_page(spark, sf):
    return customers.page(state(spark, sf), limit=50, offset=50).select("customer_id", "value_at_risk")


@query("D26_portfolio_summary", f"""{_STATE_SQL} SELECT count(*) AS customers, round(sum(monetary), 2) AS total_monetary, round(sum(value_at_risk), 2) AS total_value_at_risk,
  round(avg(churn_probability), 4) AS avg_churn_probability, count(churn_probability) AS customers_scored, count(predicted_clv) AS customers_with_clv,
  count(monetary) AS customers_with_monetary, count(value_at_risk) AS customers_with_value_at_risk FROM state""")
def portfolio_summary(spark, sf):
    return customers.portfolio_summary(state(spark, sf))


@query("D26_portfolio_breakdown", f"{_STATE_SQL} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS customers FROM state WHERE {d} IS NOT NULL GROUP BY 2"
    for d in ("rfm_segment", "lifecycle_stage", "risk_tier", "value_basis")))
def portfolio_breakdown(spark, sf):
    return customers.portfolio_breakdown(state(spark, sf))


@query("G2_ranking_overlap", f"""{_STATE_SQL}, a AS (SELECT customer_id, value_at_risk FROM state ORDER BY churn_probability DESC NULLS LAST, customer_id LIMIT 10),
b AS (SELECT customer_id, value_at_risk FROM state ORDER BY value_at_risk DESC NULLS LAST, customer_id LIMIT 10)
SELECT 10 AS top_n, (SELECT count(*) FROM a WHERE customer_id IN (SELECT customer_id FROM b)) AS overlap,
  round((SELECT sum(value_at_risk) FROM a), 2) AS value_covered_by_risk, round((SELECT sum(value_at_risk) FROM b), 2) AS value_covered_by_value_at_risk,
  round((SELECT sum(value_at_risk) FROM b) - (SELECT sum(value_at_risk) FROM a), 2) AS difference""")
def ranking_overlap(spark, sf):
    return customers.ranking_overlap(state(spark, sf))


_SNAPSHOTS = f"""{W}, {_features_sql(_CUTOFFS)}, states AS (SELECT CAST(customer AS VARCHAR) AS customer_id, CAST(cutoff AS DATE) AS snapshot_date, recency_days, frequency,
  round(monetary, 2) AS monetary FROM feats)"""


def _snapshots(spark, sf):
    return _panel(spark, sf).select(
        F.col("customer").cast("string").alias("customer_id"), F.to_date("cutoff").alias("snapshot_date"), "recency_days", "frequency",
        rnd(F.col("monetary")).alias("monetary"))


@query("E10_customer_timelines", f"""{_SNAPSHOTS} SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_date DESC) <= 4""")
def timelines(spark, sf):
    return customers.timelines(_snapshots(spark, sf), last=4)


@query("B13_customer_at_date", f"{_SNAPSHOTS} SELECT * FROM states WHERE customer_id = '7' ORDER BY snapshot_date DESC LIMIT 1")
def customer_at(spark, sf):
    return customers.customer_at(_snapshots(spark, sf), "7")


