"""Root-cause queries: the change of the last complete month against the one before."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ledgerlark.functions.numbers import rnd
from ledgerlark.operators import decision as dm
from ledgerlark.operators import rootcause as rc
from ledgerlark.plans.metrics import PERIODS_SQL, _with_cost
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import FACT_SQL, ROLES, fact

W = f"WITH {FACT_SQL}"
DIMS = ["brand", "mktsegment", "nation", "priority", "ptype"]


def _lines(spark, sf, *extra):
    return fact(spark, sf, "order_id", "customer_id", "ts", "revenue", "quantity", *DIMS, *extra)


def _bounds(spark, sf):
    return dm.date_bounds(fact(spark, sf, "ts"), "ts")


def _setup(spark, sf, key="revenue"):
    current, prior = rc.windows(*_bounds(spark, sf))
    work = rc.in_window(_lines(spark, sf), ROLES, current, prior)
    work, m = rc.measure(work, ROLES, key)
    cell = rc.materialise(rc.cells(work, m, DIMS))
    return work, m, cell, rc.totals(cell, m)


def _slices(spark, sf, key="revenue"):
    work, m, cell, whole = _setup(spark, sf, key)
    return work, m, cell, whole, rc.slices(cell, m, DIMS, whole)


# --- oracle -------------------------------------------------------------------

_LIST = "list_filter([" + ", ".join(f"CASE WHEN grouping({d}) = 0 THEN '{d}=' || {d} END" for d in DIMS) + "], lambda x: x IS NOT NULL)"


def _sets(depth: int) -> str:
    return ", ".join("(" + ", ".join(c) + ")" for c in combinations(DIMS, depth))


def _level(depth: int, values: str) -> str:
    return f"SELECT {_LIST} AS conds, {depth} AS depth, {values} FROM work GROUP BY GROUPING SETS ({_sets(depth)})"


_ADD = """coalesce(sum(v) FILTER (WHERE p = 0), 0) AS v0, coalesce(sum(v) FILTER (WHERE p = 1), 0) AS v1, count(*) FILTER (WHERE p = 0) AS rows0, count(*) FILTER (WHERE p = 1) AS rows1,
coalesce(sum(v * v) FILTER (WHERE p = 0), 0) AS sq0, coalesce(sum(v * v) FILTER (WHERE p = 1), 0) AS sq1"""
_DISTINCT = """count(DISTINCT k) FILTER (WHERE p = 0) AS v0, count(DISTINCT k) FILTER (WHERE p = 1) AS v1, count(*) FILTER (WHERE p = 0) AS rows0, count(*) FILTER (WHERE p = 1) AS rows1"""


def _work(value: str) -> str:
    named = ", ".join(f"coalesce(CAST({d} AS VARCHAR), '(missing)') AS {d}" for d in DIMS)
    return f"""{PERIODS_SQL}, work AS (SELECT {named}, CASE side WHEN 'current' THEN 1 ELSE 0 END AS p, {value} AS v, CAST(customer_id AS VARCHAR) AS k, CAST(order_id AS VARCHAR) AS o, ts
  FROM fact JOIN periods ON ts >= "start" AND ts < "end" + 1 AND basis = 'last_month')"""


def _search_sql(value: str = "revenue", additive: bool = True) -> str:
    values = _ADD if additive else _DISTINCT
    total = ("SELECT sum(v) FILTER (WHERE p = 0) AS t0, sum(v) FILTER (WHERE p = 1) AS t1, count(*) AS n FROM work" if additive else
             "SELECT count(DISTINCT k) FILTER (WHERE p = 0) AS t0, count(DISTINCT k) FILTER (WHERE p = 1) AS t1, count(*) AS n FROM work")
    keep = "rows0 + rows1 >= 12 AND greatest(v1, v0) >= abs(t1 - t0) * 0.04"
    return f"""{_work(value)}, tot AS ({total}),
l1 AS (SELECT l.* FROM ({_level(1, values)}) l, tot WHERE {keep}),
l2a AS (SELECT l.* FROM ({_level(2, values)}) l, tot WHERE {keep}),
l2 AS (SELECT l2a.* FROM l2a JOIN (SELECT c.conds, max(p.rows0 + p.rows1) AS pr FROM (SELECT conds, unnest(conds) AS gone FROM l2a) c
   JOIN l1 p ON p.conds = list_filter(c.conds, lambda x: x <> c.gone) GROUP BY 1) q USING (conds) WHERE rows0 + rows1 < 0.98 * pr),
l3a AS (SELECT l.* FROM ({_level(3, values)}) l, tot WHERE {keep}),
l3 AS (SELECT l3a.* FROM l3a JOIN (SELECT c.conds, max(p.rows0 + p.rows1) AS pr FROM (SELECT conds, unnest(conds) AS gone FROM l3a) c
   JOIN l2 p ON p.conds = list_filter(c.conds, lambda x: x <> c.gone) GROUP BY 1) q USING (conds) WHERE rows0 + rows1 < 0.98 * pr),
slices AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


_JS = "(CASE WHEN v0 > 0 THEN 0.5 * (v0 / t0) * log2((v0 / t0) / ((v0 / t0 + v1 / t1) / 2)) ELSE 0 END + CASE WHEN v1 > 0 THEN 0.5 * (v1 / t1) * log2((v1 / t1) / ((v0 / t0 + v1 / t1) / 2)) ELSE 0 END)"
_EXPLAIN = f"""ex AS (SELECT array_to_string(conds, ' & ') AS slice, conds, depth, v0 AS prior, v1 AS current, v1 - v0 AS delta, (v1 - v0) / nullif(v0, 0) * 100 AS change_pct,
  (v1 - v0) / (t1 - t0) AS power, v1 - v0 * t1 / t0 AS excess, (v1 - v0 * t1 / t0) / (t1 - t0) AS excess_share, (rows0 + rows1) / n AS rows_share, {_JS} AS surprise,
  abs(v1 - v0 * t1 / t0) / sqrt(nullif(sq1 + (t1 / t0) * (t1 / t0) * sq0, 0)) AS signal, (t1 - v1) - (t0 - v0) AS rest_delta, t0, t1 FROM slices, tot),
sc AS (SELECT *, abs(power) / rows_share AS concentration, least(abs(power), 2) * (0.5 + 0.5 * least(abs(excess_share), 1)) / (1 + 0.15 * (depth - 1))
  * (0.35 + 0.65 * least(abs(power) / rows_share / 15, 1)) AS score FROM ex)"""
_T = "(1 / (1 + 0.3275911 * (least(signal, 40) / sqrt(2))))"
_P = f"{_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-(least(signal, 40) / sqrt(2)) * (least(signal, 40) / sqrt(2)))"
_TESTED = f"""mat AS (SELECT * FROM sc WHERE sign(delta) = sign(t1 - t0) AND abs(power) >= 0.08),
tst AS (SELECT *, {_P} AS p_value, {_P} <= 0.05 / (SELECT count(*) FROM mat) AS robust FROM mat WHERE signal >= 2)"""


# --- queries ------------------------------------------------------------------


@query("B5_window_predicate", f"""{W}, {PERIODS_SQL} SELECT side, count(*) AS rows, round(sum(revenue), 2) AS revenue FROM fact JOIN periods
ON ts >= "start" AND ts < "end" + 1 AND basis = 'last_month' GROUP BY side""")
def window_predicate(spark, sf):
    current, prior = rc.windows(*_bounds(spark, sf))
    work = rc.in_window(fact(spark, sf, "ts", "revenue"), ROLES, current, prior)
    return work.groupBy(F.when(F.col("_p") == 1, "current").otherwise("prior").alias("side")).agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.sum("revenue")).alias("revenue"))


_B8 = ["brand", "ptype", "mktsegment", "nation", "priority", "product", "customer_id", "order_id", "linenumber", "quantity", "price", "ts", "status"]


def _b8_sql() -> str:
    out = []
    for c in _B8:
        n = f"count(DISTINCT {c})"
        if c in ("ts", "quantity", "order_id"):
            out.append(f"SELECT '{c}' AS column_name, false AS usable, NULL AS kind, CASE WHEN '{c}' = 'order_id' AND {n} <= 300 THEN {n} END AS n_values, 'date, quantity or order key' AS reason FROM fact")
        elif c == "price":
            out.append(f"SELECT '{c}', false, NULL, NULL, 'continuous measurement'")
        elif c in ("customer_id", "linenumber"):
            out.append(f"SELECT '{c}', {n} <= 50, CASE WHEN {n} <= 50 THEN 'numeric_code' END, CASE WHEN {n} <= 300 THEN {n} END, CASE WHEN {n} > 50 THEN 'numeric with too many values' END FROM fact")
        else:
            out.append(f"SELECT '{c}', {n} <= 300, CASE WHEN {n} <= 300 THEN 'categorical' END, CASE WHEN {n} <= 300 THEN {n} END, CASE WHEN {n} > 300 THEN 'too many values' END FROM fact")
    named = "WITH r(column_name, usable, kind, n_values, reason) AS ("
    return "SELECT * FROM (" + named + " UNION ALL ".join(out) + ") SELECT * FROM r)"


@query("B8_sliceable_columns", f"{W} {_b8_sql()}")
def sliceable(spark, sf):
    return rc.dimensions(fact(spark, sf, *_B8), ROLES)


@query("B9_slicing_keys", f"{W} SELECT coalesce(CAST(linenumber AS VARCHAR), '(missing)') AS line, coalesce(nullif(priority, '5-LOW'), '(missing)') AS priority, coalesce(dayname(ts), '(unknown)') AS weekday, count(*) AS n FROM fact GROUP BY 1, 2, 3")
def slicing_keys(spark, sf):
    d = fact(spark, sf, "linenumber", "priority", "ts").withColumn("priority", F.expr("nullif(priority, '5-LOW')")).withColumn("linenumber", F.col("linenumber").cast("double"))
    return d.groupBy(rc.slicing_key(d, "linenumber").alias("line"), rc.slicing_key(d, "priority").alias("priority"), rc.weekday(F.col("ts")).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("L1_measures", f"""{W} SELECT * FROM (VALUES ('revenue', 'currency', true, true), ('units', 'count', true, true), ('gross_profit', 'currency', true, true), ('orders', 'count', false, true),
  ('customers', 'count', false, true), ('transactions', 'count', true, true)) t(measure, unit, additive, available)
  WHERE (SELECT avg(CASE WHEN cost <= revenue + 0.01 THEN 1.0 ELSE 0.0 END) FROM fact) >= 0.95 OR measure <> 'gross_profit'
UNION ALL SELECT 'gross_profit', NULL, NULL, false WHERE (SELECT avg(CASE WHEN cost <= revenue + 0.01 THEN 1.0 ELSE 0.0 END) FROM fact) < 0.95""")
def measures(spark, sf):
    return rc.available_measures(_lines(spark, sf, "cost"), _with_cost(cost="cost"))


@query("L2_windows", f"""{W}, {PERIODS_SQL}, h AS (SELECT lo, hi, (hi - lo + 1) // 2 AS half FROM bounds)
SELECT 'auto' AS mode, basis, side, "start", "end" FROM periods WHERE basis = 'last_month' UNION ALL SELECT basis, basis, side, "start", "end" FROM periods
UNION ALL SELECT 'halves', 'halves', 'current', CAST(lo + CAST(half AS INT) AS DATE), hi FROM h UNION ALL SELECT 'halves', 'halves', 'prior', lo, CAST(lo + CAST(half AS INT) - 1 AS DATE) FROM h""")
def windows_table(spark, sf):
    return rc.windows_table(spark, *_bounds(spark, sf))


@query("L3_all_slices", f"""{W}, {_work('revenue')} SELECT array_to_string(conds, ' & ') AS slice, depth, round(v0, 2) AS prior, round(v1, 2) AS current, rows0 AS prior_rows, rows1 AS current_rows
FROM ({_level(1, _ADD)} UNION ALL {_level(2, _ADD)} UNION ALL {_level(3, _ADD)})""")
def all_slices(spark, sf):
    _, m, cell, _ = _setup(spark, sf)
    found = rc.union_all([rc._sliced(cell, m, DIMS, d).withColumn("depth", F.lit(d)) for d in (1, 2, 3)])
    return found.select(rc.slice_label().alias("slice"), "depth", rnd(F.col("v0")).alias("prior"), rnd(F.col("v1")).alias("current"),
                        F.col("rows0").alias("prior_rows"), F.col("rows1").alias("current_rows"))


@query("L4_pruned_slices", f"{W}, {_search_sql()} SELECT array_to_string(conds, ' & ') AS slice, depth, round(v0, 2) AS prior, round(v1, 2) AS current FROM slices")
def pruned_slices(spark, sf):
    _, _, _, _, found = _slices(spark, sf)
    return found.select(rc.slice_label().alias("slice"), "depth", rnd(F.col("v0")).alias("prior"), rnd(F.col("v1")).alias("current"))


@query("L3_distinct_slices", f"""{W}, {_search_sql(additive=False)} SELECT array_to_string(conds, ' & ') AS slice, depth, v0 AS prior, v1 AS current FROM slices""")
def distinct_slices(spark, sf):
    _, _, _, _, found = _slices(spark, sf, "customers")
    return found.select(rc.slice_label().alias("slice"), "depth", F.col("v0").cast("long").alias("prior"), F.col("v1").cast("long").alias("current"))


@query("L5_beam", f"""{W}, {_search_sql()}, {_EXPLAIN}, l AS (SELECT sc.*, greatest(sc.current, sc.prior) AS bound FROM sc WHERE depth = 1),
m AS (SELECT slice FROM l ORDER BY bound DESC, slice LIMIT 12), s AS (SELECT slice FROM l WHERE slice NOT IN (SELECT slice FROM m) ORDER BY score DESC, slice LIMIT 12)
SELECT slice FROM m UNION ALL SELECT slice FROM s""")
def beam(spark, sf):
    _, m, cell, whole = _setup(spark, sf)
    level = rc.slices(cell, m, DIMS, whole, max_depth=1)
    return rc._beam(level, whole, 24).select(rc.slice_label().alias("slice"))


def _explained(spark, sf):
    work, m, cell, whole, found = _slices(spark, sf)
    return work, m, cell, whole, rc.explain(found, whole)


@query("L6_explanations", f"""{W}, {_search_sql()}, {_EXPLAIN} SELECT slice, depth, round(delta, 2) AS delta, round(change_pct, 2) AS change_pct, round(power, 4) AS power, round(excess, 2) AS excess,
  round(excess_share, 4) AS excess_share, round(rows_share, 4) AS rows_share, round(surprise, 6) AS surprise, round(concentration, 3) AS concentration, round(rest_delta, 2) AS rest_delta,
  round(score, 4) AS score FROM sc""")
def explanations(spark, sf):
    *_, table = _explained(spark, sf)
    digits = {"delta": 2, "change_pct": 2, "power": 4, "excess": 2, "excess_share": 4, "rows_share": 4, "surprise": 6, "concentration": 3, "rest_delta": 2, "score": 4}
    return table.select("slice", "depth", *[rnd(F.col(c), d).alias(c) for c, d in digits.items()])


@query("L7_signal_to_noise", f"""{W}, {_search_sql()}, {_EXPLAIN}, {_TESTED} SELECT slice, round(signal, 4) AS signal, round(p_value, 6) AS p_value, robust FROM tst""")
def signal(spark, sf):
    *_, whole, table = _explained(spark, sf)
    return rc.tested(table, whole).select("slice", rnd(F.col("signal"), 4).alias("signal"), rnd(F.col("p_value"), 6).alias("p_value"), "robust")


_RANK = "ORDER BY CASE WHEN robust THEN 0 ELSE 1 END, score DESC, slice"
_CHOSEN = f"""left_over AS (SELECT 0 AS k, slice, conds, concentration, power, score, robust FROM tst UNION ALL
SELECT k + 1, slice, conds, concentration, power, score, robust FROM (SELECT *, first_value(conds) OVER w AS best, first_value(concentration) OVER w AS focus FROM left_over WHERE k < {rc.TOP_K} WINDOW w AS ({_RANK}))
WHERE NOT (len(list_intersect(conds, best)) = len(conds) OR (len(list_intersect(conds, best)) = len(best) AND len(conds) > len(best) AND concentration <= focus * {rc.REFINEMENT_GAIN})))"""


@query("L8_select_top", f"""{W.replace('WITH', 'WITH RECURSIVE', 1)}, {_search_sql()}, {_EXPLAIN}, {_TESTED}, {_CHOSEN} SELECT k + 1 AS rank, slice, round(power * 100, 1) AS power_pct, round(score, 4) AS score, robust
FROM left_over WHERE k < {rc.TOP_K} QUALIFY row_number() OVER (PARTITION BY k {_RANK}) = 1""")
def select_top(spark, sf):
    *_, whole, table = _explained(spark, sf)
    return rc.select_top(rc.tested(table, whole)).select("rank", "slice", rnd(F.col("power") * 100, 1).alias("power_pct"), rnd(F.col("score"), 4).alias("score"), "robust")


_BEST = f"""{W}, {_search_sql()}, {_EXPLAIN}, {_TESTED}, best AS (SELECT * FROM tst ORDER BY CASE WHEN robust THEN 0 ELSE 1 END, score DESC, slice LIMIT 1)"""


@query("L9_drill_path", f"""{_BEST}, pre AS (SELECT unnest(range(1, len(conds) + 1)) AS step, conds AS full_conds FROM best),
every AS (SELECT array_to_string(conds, ' & ') AS slice, conds, v0, v1, rows0, rows1 FROM ({_level(1, _ADD)} UNION ALL {_level(2, _ADD)} UNION ALL {_level(3, _ADD)}))
SELECT 1 AS rank, step, slice, round(v1 - v0, 2) AS delta, round((v1 - v0) / (t1 - t0) * 100, 1) AS power_pct, round((rows0 + rows1) / n * 100, 1) AS rows_share_pct,
  round(abs((v1 - v0) / (t1 - t0)) / ((rows0 + rows1) / n), 2) AS concentration FROM pre JOIN every ON every.conds = full_conds[1:step], tot""")
def drill_path(spark, sf):
    _, m, cell, whole, table = _explained(spark, sf)
    chosen = rc.select_top(rc.tested(table, whole), k=1)
    return rc.drill_path(chosen, cell, m, DIMS, whole)


@query("L10_per_dimension", f"""{W}, {_work('revenue')}, tot AS (SELECT sum(v) FILTER (WHERE p = 0) AS t0, sum(v) FILTER (WHERE p = 1) AS t1 FROM work),
s AS (SELECT split_part(conds[1], '=', 1) AS dimension, conds[1][len(split_part(conds[1], '=', 1)) + 2:] AS value, v0, v1, v1 - v0 AS d, sign(v1 - v0) = sign(t1 - t0) AS same, {_JS} AS js, t0, t1
  FROM ({_level(1, _ADD)}), tot),
r AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN same THEN abs(d) ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM s WINDOW w AS (PARTITION BY dimension ORDER BY same DESC, abs(d) DESC, value))
SELECT dimension, count(*) AS n_values, round(sum(js), 5) AS divergence, coalesce(min(rn) FILTER (WHERE same AND run >= abs(t1 - t0) * 2 / 3), nullif(count(*) FILTER (WHERE same), 0)) AS elements_for_two_thirds,
  arg_min(value, rn) FILTER (WHERE same) AS top_element, count(*) FILTER (WHERE NOT same AND d <> 0) AS offsetting_elements FROM r GROUP BY dimension""")
def per_dimension(spark, sf):
    _, m, cell, whole = _setup(spark, sf)
    return rc.per_dimension(cell, m, DIMS, whole)


_INSIDE = " AND ".join(f"({d} = list_filter(conds, lambda x: starts_with(x, '{d}='))[1][{len(d) + 2}:] OR len(list_filter(conds, lambda x: starts_with(x, '{d}='))) = 0)" for d in DIMS)


@query("L11_slice_bridge", f"""{_BEST}, b AS (SELECT slice, count(DISTINCT o) FILTER (WHERE p = 0) AS op, count(DISTINCT o) FILTER (WHERE p = 1) AS oc, sum(v) FILTER (WHERE p = 0) AS rp, sum(v) FILTER (WHERE p = 1) AS rcur
  FROM work, best WHERE {_INSIDE} GROUP BY slice)
SELECT 1 AS rank, slice, op AS orders_prior, oc AS orders_current, round(rp / op, 2) AS aov_prior, round(rcur / oc, 2) AS aov_current, round((oc - op) * rp / op, 2) AS volume_effect,
  round((rcur / oc - rp / op) * op, 2) AS basket_effect, round((oc - op) * (rcur / oc - rp / op), 2) AS interaction_effect,
  CASE WHEN abs((oc - op) * rp / op) >= abs((rcur / oc - rp / op) * op) THEN 'order count' ELSE 'order size' END AS primary_driver FROM b WHERE op > 0 AND oc > 0""")
def slice_bridge(spark, sf):
    work, _, _, whole, table = _explained(spark, sf)
    return rc.slice_bridge(work, ROLES, rc.select_top(rc.tested(table, whole), k=1))


@query("L12_weekday_imbalance", f"""{W}, {_work('revenue')} SELECT dayname(ts) AS day_name, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE p = 1) AS current_days,
  count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE p = 0) AS prior_days FROM work GROUP BY 1 HAVING current_days <> prior_days""")
def weekday_imbalance(spark, sf):
    current, prior = rc.windows(*_bounds(spark, sf))
    return rc.weekday_imbalance(rc.in_window(fact(spark, sf, "ts"), ROLES, current, prior), ROLES)


@query("L13_whole_analysis", f"""{W}, {_work('revenue')} SELECT 'revenue' AS measure, 'last_month' AS basis, round(sum(v) FILTER (WHERE p = 0), 2) AS prior, round(sum(v) FILTER (WHERE p = 1), 2) AS current,
  count(*) FILTER (WHERE p = 0) AS prior_rows, count(*) FILTER (WHERE p = 1) AS current_rows,
  concat_ws('; ', CASE WHEN least(count(*) FILTER (WHERE p = 0), count(*) FILTER (WHERE p = 1)) < 20 THEN 'too few rows in one of the periods' END,
  CASE WHEN EXISTS (SELECT 1 FROM work GROUP BY dayname(ts) HAVING count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE p = 1) <> count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE p = 0))
    THEN 'the periods hold different numbers of some weekdays' END) AS warnings FROM work""")
def whole_analysis(spark, sf):
    result = rc.analyse(_lines(spark, sf), ROLES, dims=DIMS)
    return result["summary"].select("measure", "basis", rnd(F.col("prior")).alias("prior"), rnd(F.col("current")).alias("current"), "prior_rows", "current_rows",
                                    F.array_join("warnings", "; ").alias("warnings"))
