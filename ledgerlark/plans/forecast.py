"""Forecast queries: a monthly panel of brands, back-tested on rolling origins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions.numbers import rnd
from ledgerlark.functions.scale import materialise
from ledgerlark.operators.forecast import backtest as bt
from ledgerlark.operators.forecast import models as fm
from ledgerlark.operators.forecast import panel as fp
from ledgerlark.plans.registry import query
from ledgerlark.plans.tables import FACT_SQL, fact

W = f"WITH {FACT_SQL}"
H = 6


def _panel(spark, sf, freq="monthly", series="brand", value="revenue", agg="sum"):
    rows = fact(spark, sf, "ts", value, *([series] if series else []))
    return fp.build_panel(rows, "ts", value, freq, series=F.col(series) if series else None, agg=agg)


def panel_sql(freq: str = "monthly", series: str = "brand", value: str = "revenue", agg: str = "sum", name: str = "panel") -> str:
    label = {"daily": "CAST(ts AS DATE)", "weekly": "CAST(date_trunc('week', ts) AS DATE) + 6", "monthly": "CAST(date_trunc('month', ts) AS DATE)"}[freq]
    step = {"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH"}[freq]
    keep = {"daily": "true", "weekly": "d - 6 >= lo AND d <= hi", "monthly": "d >= lo AND last_day(d) <= hi"}[freq]
    fill = "coalesce(v, 0)" if agg == "sum" else """coalesce(v, CASE WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE coalesce(pv, nv) END)"""
    src = series if series else "'all'"
    return f"""{name}_r AS (SELECT {src} AS series, CAST(ts AS DATE) AS day, {label} AS d, {value} AS v FROM fact WHERE ts IS NOT NULL AND {value} IS NOT NULL AND {src} IS NOT NULL),
{name}_s AS (SELECT series, d, {'sum' if agg == 'sum' else 'avg'}(v) AS v FROM {name}_r GROUP BY 1, 2),
{name}_e AS (SELECT series, min(d) AS a, max(d) AS b, min(day) AS lo, max(day) AS hi FROM {name}_r GROUP BY 1),
{name}_c AS (SELECT series, CAST(unnest(generate_series(a, b, {step})) AS DATE) AS d, lo, hi FROM {name}_e),
{name}_f AS (SELECT c.series, c.d AS ds, v, row_number() OVER (PARTITION BY c.series ORDER BY c.d) - 1 AS t, count(*) OVER (PARTITION BY c.series) AS n
  FROM {name}_c c LEFT JOIN {name}_s s ON s.series = c.series AND s.d = c.d WHERE {keep.replace('d ', 'c.d ').replace('(d)', '(c.d)')}),
{name}_g AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w AS pt,
  first_value(v IGNORE NULLS) OVER x AS nv, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER x AS nt FROM {name}_f
  WINDOW w AS (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT series, ds, t, n, {fill} AS y, v IS NOT NULL AS observed FROM {name}_g)"""


P = f"{W}, {panel_sql()}"


@query("J1_build_panel", f"""{W}, {panel_sql()}, {panel_sql('weekly', 'mktsegment', name='wk')}, {panel_sql('daily', 'priority', 'discount', 'mean', 'dy')}
SELECT 'monthly' AS freq, series, ds, CAST(t AS INT) AS t, CAST(n AS INT) AS n, round(y, 2) AS y, observed FROM panel UNION ALL SELECT 'weekly', series, ds, t, n, round(y, 2), observed FROM wk
UNION ALL SELECT 'daily', series, ds, t, n, round(y, 6), observed FROM dy""")
def build_panel(spark, sf):
    a = _panel(spark, sf).withColumn("y", rnd(F.col("y"))).withColumn("freq", F.lit("monthly"))
    b = _panel(spark, sf, "weekly", "mktsegment").withColumn("y", rnd(F.col("y"))).withColumn("freq", F.lit("weekly"))
    c = _panel(spark, sf, "daily", "priority", "discount", "mean").withColumn("y", rnd(F.col("y"), 6)).withColumn("freq", F.lit("daily"))
    return a.unionByName(b).unionByName(c)


_PULSES = "fact AS (SELECT * REPLACE (CASE WHEN quantity > 49 THEN revenue ELSE 0 END AS revenue) FROM fact0)"
_PULSE_FACT = FACT_SQL.replace("fact AS (", "fact0 AS (", 1) + ", " + _PULSES


@query("J2_intermittent", f"""WITH {_PULSE_FACT}, {panel_sql('daily', 'mktsegment')}, g AS (SELECT series, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM panel WHERE y <> 0)
SELECT series, round(avg(gap), 4) AS mean_gap, avg(gap) > 1.32 OR count(*) < 2 AS intermittent FROM g GROUP BY 1""")
def intermittent(spark, sf):
    rows = fact(spark, sf, "ts", "revenue", "quantity", "mktsegment").withColumn("revenue", F.expr("case when quantity > 49 then revenue else 0.0D end"))
    return fp.intermittent(fp.build_panel(rows, "ts", "revenue", "daily", series=F.col("mktsegment")))


@query("J3_frequency", f"""{W}, {panel_sql('weekly', 'mktsegment', name='wk')}, {panel_sql('monthly', 'mktsegment', name='mo')}, {panel_sql('daily', 'mktsegment', name='dy')},
x AS (SELECT 'w-' || series AS series, ds FROM wk UNION ALL SELECT 'm-' || series, ds FROM mo UNION ALL SELECT 'd-' || series, ds FROM dy),
g AS (SELECT series, ds - lag(ds) OVER (PARTITION BY series ORDER BY ds) AS gap FROM x)
SELECT series, quantile_cont(gap, 0.5) AS median_gap, CASE WHEN quantile_cont(gap, 0.5) <= 2 THEN 'daily' WHEN quantile_cont(gap, 0.5) <= 10 THEN 'weekly' ELSE 'monthly' END AS frequency FROM g GROUP BY 1""")
def frequency(spark, sf):
    parts = [_panel(spark, sf, f, "mktsegment").select(F.concat(F.lit(f[0] + "-"), "series").alias("series"), F.col("ds").alias("day")) for f in ("daily", "weekly", "monthly")]
    return fp.frequency(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("J4_forecastable", f"{P} SELECT series, count(*) AS periods, count(*) FILTER (WHERE NOT observed) AS filled_periods, count(*) >= 6 AS forecastable FROM panel GROUP BY 1")
def forecastable(spark, sf):
    return fp.forecastable(_panel(spark, sf), "monthly")


def _repair_sql(source: str, keys: str, span: int, name: str) -> str:
    return f"""{name}_l AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY {keys} ORDER BY t ROWS {span - 1} PRECEDING) AS lvl FROM {source}),
{name}_d AS (SELECT {keys}, quantile_cont(y - lvl, 0.5) AS mid, stddev_pop(y - lvl) AS sd FROM {name}_l GROUP BY {keys}),
{name}_m AS (SELECT {keys}, quantile_cont(abs(y - lvl - mid), 0.5) * 1.4826 AS mad, max(sd) AS sd FROM {name}_l JOIN {name}_d USING ({keys}) GROUP BY {keys}),
{name}_z AS (SELECT l.*, CASE WHEN mad > 1e-9 THEN mad WHEN sd > 1e-9 THEN sd END AS sc, abs(y - lvl) / CASE WHEN mad > 1e-9 THEN mad WHEN sd > 1e-9 THEN sd END AS z FROM {name}_l l JOIN {name}_m USING ({keys})),
{name}_a AS (SELECT *, coalesce(z > 4 AND n >= 12 AND row_number() OVER (PARTITION BY {keys} ORDER BY z DESC NULLS LAST, t DESC) <= greatest(1, floor(n * 0.1)), false) AS anomaly FROM {name}_z),
{name} AS (SELECT *, CASE WHEN anomaly THEN lvl + sign(y - lvl) * 4 * sc ELSE y END AS fixed FROM {name}_a)"""


@query("J5_repair_anomalies", f"{W}, {panel_sql('daily', 'mktsegment')}, {_repair_sql('panel', 'series', 14, 'rep')} SELECT series, ds, round(z, 3) AS z, round(fixed, 2) AS fixed FROM rep WHERE anomaly")
def repair(spark, sf):
    out = fp.repair(_panel(spark, sf, "daily", "mktsegment"), ["series"], "daily")
    return out.where("anomaly").select("series", "ds", rnd(F.col("z"), 3).alias("z"), rnd(F.col("fixed")).alias("fixed"))


@query("E9_local_level", f"{P}, {_repair_sql('panel', 'series', 6, 'rep')} SELECT series, ds, round(lvl, 2) AS level FROM rep")
def local_level(spark, sf):
    return fp.repair(_panel(spark, sf), ["series"], "monthly").select("series", "ds", rnd(F.col("level")).alias("level"))


@query("J6_level_shift", f"""{P}, s AS (SELECT series, t, n, avg(y) OVER a AS ml, var_pop(y) OVER a AS vl, avg(y) OVER b AS mr, var_pop(y) OVER b AS vr FROM panel
  WINDOW a AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT series, t, abs(mr - ml) / sqrt((vl + vr) / 2) AS score FROM s WHERE t >= greatest(8, n // 2) AND t < n - 8 AND n >= 24 AND sqrt((vl + vr) / 2) > 1e-9)
SELECT series, CASE WHEN max(score) >= 2 THEN CAST(arg_max(t, (score, -t)) AS INT) END AS shift_at, round(max(score), 3) AS score FROM q GROUP BY 1""")
def level_shift(spark, sf):
    return fp.level_shift(_panel(spark, sf))


# --- models on the whole history ----------------------------------------------


def _waves_sql() -> str:
    """The ridge regression on trend and waves of monthly series, solved by elimination, one column at a time."""
    pairs = ", ".join(f"{f}(2 * pi() * {k} * {{t}} / 12)" for k in (1, 2, 3) for f in ("sin", "cos"))
    design = f"[1.0::DOUBLE, ({{t}})::DOUBLE / n] || CASE WHEN n >= 24 THEN [{pairs}] ELSE CAST([] AS DOUBLE[]) END"
    steps = ", ".join(f"""hr_{p} AS (SELECT {{keys}}, n, CASE WHEN len(a) < {p} THEN a ELSE list_transform(a, lambda r, i: CASE WHEN i = {p} THEN list_transform(r, lambda x: x / r[{p}])
  ELSE list_transform(r, lambda x, j: x - r[{p}] * a[{p}][j] / a[{p}][{p}]) END) END AS a FROM hr_{p - 1})""" for p in range(1, 9))
    return f"""hr_x AS (SELECT {{keys}}, n, y, {design.replace('{t}', 't')} AS x FROM {{src}} WHERE n >= 12),
hr_s AS (SELECT {{keys}}, n, i, j, sum(x[i] * CASE WHEN j > len(x) THEN y ELSE x[j] END) + CASE WHEN i = j AND i > 1 THEN 0.001 * n ELSE 0 END AS v
  FROM hr_x, (SELECT unnest(range(1, 9)) AS i), (SELECT unnest(range(1, 10)) AS j) WHERE i <= len(x) AND j <= len(x) + 1 GROUP BY {{keys}}, n, i, j),
hr_0 AS (SELECT {{keys}}, n, list(r ORDER BY i) AS a FROM (SELECT {{keys}}, n, i, list(v ORDER BY j) AS r FROM hr_s GROUP BY {{keys}}, n, i) GROUP BY {{keys}}, n),
{steps},
hr AS (SELECT {{keys}}, step, list_dot_product(list_transform(a, lambda r: r[len(a) + 1]), {design.replace('{t}', '(n - 1 + step)')}) AS yhat
  FROM hr_8, (SELECT unnest(range(1, 7)) AS step))"""


_STATS = """st_m AS (SELECT *, CASE WHEN n <= 12 THEN greatest(1, n // 2) ELSE 12 END AS m, n - 1 - t AS back FROM {src}),
st_k AS (SELECT *, greatest(3, least(n, greatest(4, n // 8, m))) AS ak FROM st_m),
st AS (SELECT {keys}, max(n) AS n, max(m) AS m, max(y) FILTER (WHERE t = 0) AS first, max(y) FILTER (WHERE back = 0) AS last, avg(y) AS mean_all, avg(y) FILTER (WHERE back < m) AS mean_1,
  avg(y) FILTER (WHERE back < 2 * m) AS mean_2, avg(y) FILTER (WHERE back < 4 * m) AS mean_4, avg(y) FILTER (WHERE back < greatest(m, n // 3)) AS mean_long, regr_slope(y, t) AS slope,
  regr_intercept(y, t) AS icept, max(ak) AS ak, avg(y) FILTER (WHERE back < ak) AS anchor, list(y ORDER BY t) FILTER (WHERE back < m) AS recent FROM st_k GROUP BY {keys}),
pu AS (SELECT {keys}, y, row_number() OVER w AS j, t - lag(t) OVER w AS gap, count(*) OVER (PARTITION BY {keys}) AS k FROM {src} WHERE y <> 0 WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
cr AS (SELECT {keys}, max(k) AS k, sum(y * w) AS z, sum(CASE WHEN j = 1 THEN 1.0 ELSE gap END * w) AS p FROM (SELECT *, CASE WHEN j = 1 THEN 1.0 ELSE 0.1 END * pow(0.9, k - j) AS w FROM pu) GROUP BY {keys}),
pf_w AS (SELECT *, avg(y) OVER w AS lv, count(y) OVER w AS cn FROM st_m WINDOW w AS (PARTITION BY {keys} ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
pf_p AS (SELECT {keys}, t % 12 AS phase, coalesce(quantile_cont(CASE WHEN cn >= 6 AND abs(lv) > 1e-9 THEN y / lv END, 0.5), 1.0) AS r FROM pf_w WHERE n >= 24 GROUP BY ALL),
pf AS (SELECT {keys}, avg(r) AS mr, list(r ORDER BY phase) AS prof FROM pf_p GROUP BY {keys}),
pr AS (SELECT st.*, prof, mr, s.step FROM st LEFT JOIN pf USING ({keys}), (SELECT unnest(range(1, 7)) AS step) s),
""" + _waves_sql() + """,
pred AS (
  SELECT {keys}, step, 'Harmonic Regression' AS model, yhat FROM hr UNION ALL SELECT {keys}, step, 'Naive' AS model, last AS yhat FROM pr UNION ALL SELECT {keys}, step, 'Drift', last + (last - first) / (n - 1) * step FROM pr
  UNION ALL SELECT {keys}, step, 'Seasonal Naive', recent[(step - 1) % m + 1] FROM pr UNION ALL SELECT {keys}, step, 'Moving Average', mean_1 FROM pr
  UNION ALL SELECT {keys}, step, 'Mean (2 seasons)', mean_2 FROM pr UNION ALL SELECT {keys}, step, 'Mean (4 seasons)', mean_4 FROM pr
  UNION ALL SELECT {keys}, step, 'Mean (long window)', mean_long FROM pr UNION ALL SELECT {keys}, step, 'Linear Trend', icept + slope * (n - 1 + step) FROM pr
  UNION ALL SELECT {keys}, step, 'Damped Drift', last + (last - first) / (n - 1) * 0.9 * (1 - pow(0.9, step)) / 0.1 FROM pr
  UNION ALL SELECT {keys}, step, 'Damped Trend', anchor + slope * ak / 2.0 + slope * 0.9 * (1 - pow(0.9, step)) / 0.1 FROM pr
  UNION ALL SELECT {keys}, step, 'Croston', CASE WHEN coalesce(k, 0) < 2 THEN mean_all ELSE 0.95 * z / greatest(p, 1e-9) END FROM pr LEFT JOIN cr USING ({keys}) WHERE n >= 8
  UNION ALL SELECT {keys}, step, 'Seasonal Profile', CASE WHEN prof IS NULL THEN mean_1 ELSE mean_4 * prof[(n + step - 1) % 12 + 1] / mr END FROM pr)"""


def _whole() -> str:
    return f"{P}, {_STATS.format(src='panel', keys='series')}"


def _predictions(spark, sf):
    panel = _panel(spark, sf)
    models = [m for m in fm.MODELS if m not in ("Croston", fm.HARMONIC)]
    return fm.predict(fm.fit(panel, ["series"], "monthly", models), ["series"], H, models)


def _model_query(name: str, models: list[str]):
    listed = ", ".join(f"'{m}'" for m in models)

    def fn(spark, sf):
        return _predictions(spark, sf).where(F.col("model").isin(models)).select("series", "model", "step", rnd(F.col("yhat"), 2).alias("yhat"))

    query(name, f"{_whole()} SELECT series, model, CAST(step AS INT) AS step, round(yhat, 2) AS yhat FROM pred WHERE model IN ({listed})")(fn)


_model_query("J7_naive", ["Naive"])
_model_query("J8_drift", ["Drift"])
_model_query("J9_means", ["Moving Average", "Mean (2 seasons)", "Mean (4 seasons)", "Mean (long window)"])
_model_query("J10_seasonal_naive", ["Seasonal Naive"])
_model_query("J11_linear_trend", ["Linear Trend"])
_model_query("J12_damped", ["Damped Drift", "Damped Trend"])
_model_query("J13_seasonal_profile", ["Seasonal Profile"])


@query("J14_harmonic_regression", f"{_whole()} SELECT series, CAST(step AS INT) AS step, round(yhat, 2) AS yhat FROM pred WHERE model = 'Harmonic Regression'")
def harmonic(spark, sf):
    return fm.harmonic_forecast(_panel(spark, sf), "monthly", H).select("series", "step", rnd(F.col("yhat"), 2).alias("yhat"))


@query("J15_croston", f"""WITH {_PULSE_FACT}, {panel_sql('daily', 'mktsegment')}, {_STATS.format(src='panel', keys='series')}
SELECT series, round(yhat, 4) AS rate FROM pred WHERE model = 'Croston' AND step = 1""")
def croston(spark, sf):
    rows = fact(spark, sf, "ts", "revenue", "quantity", "mktsegment").withColumn("revenue", F.expr("case when quantity > 49 then revenue else 0.0D end"))
    panel = fp.build_panel(rows, "ts", "revenue", "daily", series=F.col("mktsegment"))
    return fm.predict(fm.fit(panel, ["series"], "daily", ["Croston"]), ["series"], 1, ["Croston"]).select("series", rnd(F.col("yhat"), 4).alias("rate"))


@query("J16_candidate_models", f"""{P}, s AS (SELECT series, count(*) AS n, avg(gap) > 1.32 OR count(*) FILTER (WHERE y <> 0) < 2 AS inter FROM
  (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM panel WHERE y <> 0) GROUP BY 1),
m(model, min_n, only_pulse, for_pulse) AS (VALUES """ + ", ".join(
    f"('{n}', {m.min_n}, {str(m.intermittent_only).lower()}, {str(n in fm.FOR_INTERMITTENT).lower()})" for n, m in fm.MODELS.items())
       + ") SELECT series, model FROM s, m WHERE n >= min_n AND CASE WHEN inter THEN for_pulse ELSE NOT only_pulse END")
def candidate_models(spark, sf):
    panel = _panel(spark, sf)
    shapes = panel.groupBy("series").agg(F.max("n").alias("n")).join(fp.intermittent(panel).select("series", "intermittent"), "series")
    return fm.candidates(shapes)


# --- back-test ----------------------------------------------------------------

_MODELS = ", ".join(f"('{n}', {m.min_n}, {str(m.intermittent_only).lower()}, {str(n in fm.FOR_INTERMITTENT).lower()})" for n, m in fm.MODELS.items())
_FOLDS = f"""fo AS (SELECT series, n, CASE WHEN n <= 12 THEN greatest(1, n // 2) ELSE 12 END AS m0, greatest(2, least(CASE WHEN n >= 180 THEN 6 WHEN n >= 90 THEN 5 WHEN n >= 60 THEN 4 ELSE 3 END,
  greatest(1, n // {2 * H}))) AS want FROM (SELECT series, max(n) AS n FROM panel GROUP BY 1)),
folds AS (SELECT series, CAST(k AS INT) AS fold, n - k * {H} AS ts FROM (SELECT *, greatest(least(2 * m0, n // 2), 8, {H}) AS mt FROM fo), (SELECT unnest(range(1, 7)) AS k)
  WHERE k <= greatest(1, least(want, (n - mt) // {H})) AND n - k * {H} >= mt),
tr0 AS (SELECT series, fold, t, ts AS n, y FROM panel JOIN folds USING (series) WHERE t < ts),
te AS (SELECT series, fold, t - ts + 1 AS step, y FROM panel JOIN folds USING (series) WHERE t >= ts AND t < ts + {H})"""
_BT = f"""{P}, {_FOLDS}, {_repair_sql('tr0', 'series, fold', 6, 'fx')}, tr AS (SELECT series, fold, t, n, fixed AS y FROM fx), {_STATS.format(src='tr', keys='series, fold')},
shape AS (SELECT series, any_value(n) AS n, coalesce(avg(gap) > 1.32, false) OR count(*) FILTER (WHERE y <> 0) < 2 AS inter FROM (SELECT series, n, y, NULL AS gap FROM panel WHERE y = 0
  UNION ALL SELECT series, n, y, t - lag(t) OVER (PARTITION BY series ORDER BY t) FROM panel WHERE y <> 0) GROUP BY 1),
cand AS (SELECT series, model FROM shape, (VALUES {_MODELS}) AS m(model, min_n, only_pulse, for_pulse) WHERE n >= min_n AND CASE WHEN inter THEN for_pulse ELSE NOT only_pulse END),
resid AS (SELECT series, model, fold, step, te.y, yhat FROM pred JOIN te USING (series, fold, step) JOIN cand USING (series, model)),
sc AS (SELECT series, avg(abs(d)) AS scale, sqrt(avg(d * d)) AS sq FROM (SELECT series, y - lag(y, 12) OVER (PARTITION BY series ORDER BY t) AS d FROM panel) GROUP BY 1),
pf_e AS (SELECT series, model, fold, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse, (sum(yhat) - sum(y)) / abs(sum(y)) AS gap FROM resid GROUP BY ALL),
pfe AS (SELECT p.*, mae / scale AS mase, rmse / sq AS rmsse, row_number() OVER (PARTITION BY series, fold ORDER BY rmse / sq, model) AS place FROM pf_e p JOIN sc USING (series)),
board AS (SELECT r.series, r.model, r.mae, r.rmse, r.mape, r.mae / scale AS mase, r.rmse / sq AS rmsse, rank_score, agg_bias, agg_ape, folds, r.rmse / sq * (1 + agg_ape) AS prim FROM
  (SELECT series, model, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) ** 2)) AS rmse, avg(CASE WHEN abs(y) > 1e-9 THEN abs((y - yhat) / y) END) * 100 AS mape FROM resid GROUP BY ALL) r
  JOIN sc USING (series) JOIN (SELECT series, model, quantile_cont(place, 0.5) AS rank_score, avg(gap) AS agg_bias, avg(abs(gap)) AS agg_ape, count(*) AS folds FROM pfe GROUP BY ALL) USING (series, model))"""


def _bt(spark, sf):
    panel = materialise(_panel(spark, sf))  # a row per series and month
    resid = bt.residuals(panel, H, "monthly")
    return panel, resid, bt.scales(panel, "monthly")


@query("J17_backtest", f"{_BT} SELECT series, model, fold, CAST(step AS INT) AS step, round(y, 2) AS y, round(yhat, 2) AS yhat FROM resid")
def backtest(spark, sf):
    _, resid, _ = _bt(spark, sf)
    return resid.select("series", "model", "fold", "step", rnd(F.col("y")).alias("y"), rnd(F.col("yhat")).alias("yhat"))


@query("J18_error_metrics", f"""{_BT} SELECT series, model, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 2) AS mape, round(mase, 4) AS mase, round(rmsse, 4) AS rmsse FROM board""")
def error_metrics(spark, sf):
    _, resid, scale = _bt(spark, sf)
    digits = {"mae": 2, "rmse": 2, "mape": 2, "mase": 4, "rmsse": 4}
    return bt.leaderboard(resid, scale).select("series", "model", *[rnd(F.col(c), d).alias(c) for c, d in digits.items()])


@query("J19_ranking_score", f"{_BT} SELECT series, model, round(agg_bias, 4) AS agg_bias, round(agg_ape, 4) AS agg_ape, folds, round(prim, 4) AS primary_error FROM board")
def ranking_score(spark, sf):
    _, resid, scale = _bt(spark, sf)
    return bt.leaderboard(resid, scale).select("series", "model", rnd(F.col("agg_bias"), 4).alias("agg_bias"), rnd(F.col("agg_ape"), 4).alias("agg_ape"), "folds",
                                               rnd(F.col("primary"), 4).alias("primary_error"))


@query("E15_median_fold_rank", f"{_BT} SELECT series, model, rank_score FROM board")
def median_rank(spark, sf):
    _, resid, scale = _bt(spark, sf)
    return bt.leaderboard(resid, scale).select("series", "model", "rank_score")


@query("F8_leaderboard_order", f"{_BT} SELECT series, row_number() OVER (PARTITION BY series ORDER BY prim, rank_score, mape, rmse, model) AS place, model FROM board")
def leaderboard_order(spark, sf):
    _, resid, scale = _bt(spark, sf)
    return bt.ordered(bt.leaderboard(resid, scale)).select("series", "place", "model")


_CX = "(VALUES " + ", ".join(f"('{n}', {m.complexity})" for n, m in fm.MODELS.items()) + ") cx(model, c)"
_PICK = f"""best AS (SELECT series, model AS best, prim AS bp FROM board QUALIFY row_number() OVER (PARTITION BY series ORDER BY prim, rank_score, mape, rmse, model) = 1),
dif AS (SELECT a.series, a.model, count(*) AS pairs, avg(a.rmsse - b.rmsse) AS mean, stddev_samp(a.rmsse - b.rmsse) / sqrt(count(*)) AS se, max(abs(a.rmsse - b.rmsse)) AS widest
  FROM pfe a JOIN best USING (series) JOIN pfe b ON b.series = a.series AND b.model = best AND b.fold = a.fold GROUP BY 1, 2),
kept AS (SELECT board.*, best, c FROM board JOIN best USING (series) JOIN dif USING (series, model) JOIN {_CX} USING (model) WHERE board.model = best OR (prim <= bp * 1.04 AND
  CASE WHEN pairs < 3 THEN prim <= bp * 1.03 WHEN widest <= 1e-8 THEN true WHEN se <= 1e-12 THEN mean <= 0 ELSE mean <= se END)),
sel AS (SELECT series, model AS selected, best, prim, mase, mape, mae, folds FROM kept QUALIFY row_number() OVER (PARTITION BY series ORDER BY c, prim, rank_score, mape, rmse, model) = 1)"""


def _selected(spark, sf):
    panel, resid, scale = _bt(spark, sf)
    board = materialise(bt.leaderboard(resid, scale))
    return panel, resid, board, bt.pick(board, bt.fold_errors(resid, scale))


@query("J20_simplest_tied_model", f"{_BT}, {_PICK} SELECT series, selected, best FROM sel")
def simplest_tied(spark, sf):
    *_, selected = _selected(spark, sf)
    return selected.select("series", "selected", "best")


def _transforms_sql() -> str:
    """The fast models back-tested on three folds under each transform."""
    forward = {"none": "y", "log1p": "ln(1 + greatest(y, 0))", "sqrt": "sqrt(greatest(y, 0))"}
    inverse = {"none": "yhat", "log1p": "exp(least(700, greatest(-700, yhat + 0.5 * sigma * sigma))) - 1", "sqrt": "pow(greatest(yhat, 0), 2) + sigma * sigma"}
    fast = ", ".join(f"'{m}'" for m in fm.SCREENING)
    parts = ", ".join(f"""z_{k} AS (SELECT series, fold, t, n, {forward[k]} AS y FROM tr),
s_{k} AS (SELECT series, fold, stddev_pop(d) / sqrt(2) AS sigma FROM (SELECT series, fold, y - lag(y) OVER (PARTITION BY series, fold ORDER BY t) AS d FROM z_{k}) GROUP BY ALL),
p_{k} AS (WITH {_STATS.format(src=f'z_{k}', keys='series, fold')} SELECT '{k}' AS transform, {i} AS ord, series, model, fold, step, {inverse[k]} AS yhat FROM pred JOIN s_{k} USING (series, fold) WHERE model IN ({fast}))"""
                      for i, k in enumerate(fm.TRANSFORMS))
    every = " UNION ALL ".join(f"SELECT * FROM p_{k}" for k in fm.TRANSFORMS)
    return f"""{_BT.replace('least(want, ', 'least(3, ')}, {parts}, ev AS ({every}),
err AS (SELECT series, transform, ord, model, sqrt(avg((te.y - ev.yhat) ** 2)) AS e FROM ev JOIN te USING (series, fold, step) JOIN cand USING (series, model) GROUP BY ALL),
low AS (SELECT series, transform, ord, min(e * CASE WHEN transform = 'none' THEN 0.98 ELSE 1 END) AS e FROM err GROUP BY ALL),
may AS (SELECT series, count(*) >= 8 AND min(y) >= 0 AND avg(y) > 0 AND stddev_pop(y) / avg(y) >= 0.05 AS ok FROM panel GROUP BY 1)
SELECT series, transform FROM low JOIN may USING (series) WHERE ok OR transform = 'none' QUALIFY row_number() OVER (PARTITION BY series ORDER BY e, ord) = 1"""


@query("J21_choose_transform", _transforms_sql())
def choose_transform(spark, sf):
    return bt.best_transform(materialise(_panel(spark, sf)), H, "monthly")


@query("J22_ensemble", f"""{_BT}, tp AS (SELECT series, model, 1 / greatest(prim, 1e-6) AS inv FROM board QUALIFY row_number() OVER (PARTITION BY series ORDER BY prim, rank_score, mape, rmse, model) <= 3),
wt AS (SELECT series, model, CAST(round(CAST(inv / sum(inv) OVER (PARTITION BY series) AS DECIMAL(38, 12)), 4) AS DOUBLE) AS w FROM tp)
SELECT series, fold, CAST(step AS INT) AS step, round(sum(w * yhat) / sum(w), 1) AS yhat FROM resid JOIN wt USING (series, model) GROUP BY 1, 2, 3""")
def ensemble(spark, sf):
    _, resid, scale = _bt(spark, sf)
    return bt.ensemble(resid, bt.leaderboard(resid, scale)).select("series", "fold", "step", rnd(F.col("yhat"), 1).alias("yhat"))


@query("J23_skill", f"{_BT}, {_PICK}, nv AS (SELECT series, min(prim) AS naive FROM board WHERE model IN ('Naive', 'Seasonal Naive', 'Moving Average') GROUP BY 1) SELECT series, selected, round(1 - prim / naive, 3) AS skill FROM sel JOIN nv USING (series)")
def skill(spark, sf):
    _, _, board, selected = _selected(spark, sf)
    return bt.skill(board, selected)


_BAND = f"""ch AS (SELECT r.series, r.fold, r.step, r.y - r.yhat AS r FROM resid r JOIN sel ON sel.series = r.series AND sel.selected = r.model),
full_m AS (SELECT *, CASE WHEN n <= 12 THEN greatest(1, n // 2) ELSE 12 END AS m, n - 1 - t AS back FROM panel),
pool AS (SELECT series, count(*) AS pk, quantile_cont(r, 0.1) AS ql, quantile_cont(r, 0.9) AS qh, avg(step) AS ref FROM ch GROUP BY 1),
bnd AS (SELECT series, step, min(ql * sqrt(step / greatest(ref, 1))) OVER w AS lo, max(qh * sqrt(step / greatest(ref, 1))) OVER w AS hi FROM pool, (SELECT unnest(range(1, {H + 1})) AS step)
  WINDOW w AS (PARTITION BY series ORDER BY step ROWS UNBOUNDED PRECEDING))"""


def _chosen(spark, sf):
    panel, resid, board, selected = _selected(spark, sf)
    mine = resid.join(selected.select("series", F.col("selected").alias("model")), ["series", "model"])
    forecast = fm.predict(fm.fit(panel, ["series"], "monthly"), ["series"], H).join(
        selected.select("series", F.col("selected").alias("model")), ["series", "model"]).select("series", "step", "yhat")
    return panel, board, selected, materialise(mine), materialise(forecast)


@query("J24_prediction_bands", f"{_BT}, {_PICK}, {_BAND} SELECT series, CAST(step AS INT) AS step, round(lo, 2) AS below, round(hi, 2) AS above FROM bnd")
def prediction_bands(spark, sf):
    *_, mine, forecast = _chosen(spark, sf)
    out = bt.bands(forecast, mine, non_negative=False)
    return out.select("series", "step", rnd(F.col("lower") - F.col("yhat")).alias("below"), rnd(F.col("upper") - F.col("yhat")).alias("above"))


@query("E16_widths_never_shrink", f"{_BT}, {_PICK}, {_BAND} SELECT series, count(*) FILTER (WHERE hi < ph OR lo > pl) AS shrinking FROM (SELECT *, lag(hi) OVER (PARTITION BY series ORDER BY step) AS ph, lag(lo) OVER (PARTITION BY series ORDER BY step) AS pl FROM bnd) GROUP BY 1")
def widths(spark, sf):
    from pyspark.sql.window import Window

    *_, mine, forecast = _chosen(spark, sf)
    w = Window.partitionBy("series").orderBy("step")
    out = bt.bands(forecast, mine, non_negative=False).withColumn("up", F.col("upper") - F.col("yhat")).withColumn("down", F.col("lower") - F.col("yhat"))
    shrink = (F.col("up") < F.lag("up").over(w) - 1e-6) | (F.col("down") > F.lag("down").over(w) + 1e-6)
    return out.withColumn("s", shrink).groupBy("series").agg(F.count_if("s").alias("shrinking"))


@query("J24_measured_coverage", f"""{_BT}, {_PICK}, {_BAND}, ids AS (SELECT series, r, row_number() OVER (PARTITION BY series ORDER BY r, fold, step) AS id FROM ch),
loo AS (SELECT a.series, a.id, a.r, quantile_cont(b.r, 0.1) AS lo, quantile_cont(b.r, 0.9) AS hi FROM ids a JOIN ids b ON a.series = b.series AND a.id <> b.id GROUP BY 1, 2, 3)
SELECT series, round(avg(CASE WHEN r BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 3) AS coverage FROM loo GROUP BY 1""")
def measured_coverage(spark, sf):
    *_, mine, _ = _chosen(spark, sf)
    return bt.coverage(mine)




def _ahead_sql() -> str:
    """The chosen model refitted on the whole history, beside the back-test."""
    stats = _STATS.format(src="panel", keys="series")
    return f"w_pred AS (WITH {stats} SELECT * FROM pred), aw AS (SELECT p.series, p.step, p.yhat FROM w_pred p JOIN sel ON sel.series = p.series AND sel.selected = p.model), ah AS (SELECT series, sum(yhat) AS ahead FROM aw GROUP BY 1)"


_TOT = "ft AS (SELECT series, fold, sum(r) AS e FROM ch GROUP BY 1, 2)"
_FULL = f"{_BT}, {_PICK}, {_BAND}, {_ahead_sql()}, {_TOT}"


@query("J25_bias_correction", f"""{_FULL}, q AS (SELECT series, count(*) AS k, quantile_cont(e, 0.5) AS mid, count(DISTINCT sign(e)) FILTER (WHERE e <> 0) AS signs FROM ft GROUP BY 1),
m AS (SELECT series, k, signs, greatest(-0.15, least(0.15, mid / abs(ahead) * 0.5)) AS mv FROM q JOIN ah USING (series))
SELECT series, round(CASE WHEN k >= 4 AND signs = 1 AND abs(mv) >= 0.01 THEN 1 + mv ELSE 1 END, 4) AS factor FROM m""")
def bias_correction(spark, sf):
    *_, mine, forecast = _chosen(spark, sf)
    return bt.bias_factor(bt.fold_totals(mine), forecast).select("series", rnd(F.col("factor"), 4).alias("factor"))


@query("J26_horizon_total", f"""{_FULL}, q AS (SELECT series, count(*) AS k, quantile_cont(e, 0.1) AS a, quantile_cont(e, 0.9) AS b FROM ft GROUP BY 1)
SELECT series, round(ahead, 2) AS value, round(least(ahead + a, ahead), 2) AS lower, round(greatest(ahead + b, ahead), 2) AS upper, 'fold totals' AS basis FROM ah JOIN q USING (series) WHERE k >= 3""")
def horizon_total(spark, sf):
    *_, mine, forecast = _chosen(spark, sf)
    out = bt.horizon_total(bt.bands(forecast, mine), bt.fold_totals(mine), horizon=H, cv_h=H)
    return out.select("series", *[rnd(F.col(c)).alias(c) for c in ("value", "lower", "upper")], "basis")


@query("J27_future_dates", f"{P} SELECT series, CAST(step AS INT) AS step, CAST(last + INTERVAL (step) MONTH AS DATE) AS ds FROM (SELECT series, max(ds) AS last FROM panel GROUP BY 1), (SELECT unnest(range(1, 7)) AS step)")
def future_dates(spark, sf):
    return fm.future_dates(_panel(spark, sf), "monthly", H)


_SIG = """sg AS (SELECT *, avg(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base, lag(y) OVER w AS l1, avg(y) OVER (w ROWS BETWEEN {m} PRECEDING AND 1 PRECEDING) AS m1,
  avg(y) OVER (w ROWS BETWEEN {m4} PRECEDING AND 1 PRECEDING) AS m4, lag(y, {m}) OVER w AS sl, greatest(least({m} + 1, n // 3), n // 5, 4) AS st FROM panel WINDOW w AS (PARTITION BY series ORDER BY t)),
r2 AS (SELECT series, greatest(0, least(1, greatest(1 - sum((y - l1) ** 2) / sum((y - base) ** 2), 1 - sum((y - m1) ** 2) / sum((y - base) ** 2), 1 - sum((y - m4) ** 2) / sum((y - base) ** 2),
  CASE WHEN min(st) >= {m} THEN 1 - sum((y - sl) ** 2) / sum((y - base) ** 2) ELSE 0 END))) AS p FROM sg WHERE t >= st GROUP BY 1),
dg AS (SELECT series, count(*) AS periods, stddev_pop(y) / abs(avg(y)) AS cv, regr_r2(y, t) AS tr FROM panel GROUP BY 1)"""


@query("J28_signal", f"""{P}, {_SIG.format(m=12, m4=48)} SELECT series, periods, round(cv, 4) AS cv, round(tr, 4) AS trend_share, round(p, 4) AS predictability, round(1 - round(p, 4), 4) AS noise_share,
  CASE WHEN p >= 0.5 THEN 'strong' WHEN p >= 0.2 THEN 'moderate' WHEN p >= 0.08 THEN 'weak' ELSE 'noise-dominated' END AS verdict FROM dg JOIN r2 USING (series)""")
def signal(spark, sf):
    return fp.diagnose(_panel(spark, sf), "monthly")


def _p_sql(freq: str, m: int, tag: str) -> str:
    text = _SIG.format(m=m, m4=4 * m)
    for name in ("sg", "r2", "dg"):
        text = text.replace(f"{name} AS (", f"{tag}{name} AS (").replace(f"FROM {name} ", f"FROM {tag}{name} ")
    return panel_sql(freq, "mktsegment", name=f"{tag}pn") + ", " + text.replace("FROM panel", f"FROM {tag}pn")


@query("J29_coarser_granularity", f"""{W}, {_p_sql('daily', 7, 'd_')}, {_p_sql('weekly', 52, 'w_')}, {_p_sql('monthly', 12, 'm_')}
SELECT series, round(d.p, 4) AS predictability, CASE WHEN round(d.p, 4) < 0.2 THEN CASE WHEN wd.periods >= 16 AND round(w.p, 4) >= greatest(0.2, round(d.p, 4) * 2) THEN 'weekly'
  WHEN md.periods >= 12 AND round(m.p, 4) >= greatest(0.2, round(d.p, 4) * 2) THEN 'monthly' END END AS recommended
FROM d_r2 d JOIN w_r2 w USING (series) JOIN m_r2 m USING (series) JOIN w_dg wd USING (series) JOIN m_dg md USING (series)""")
def coarser(spark, sf):
    return fp.recommend_granularity({f: _panel(spark, sf, f, "mktsegment") for f in ("daily", "weekly", "monthly")}, "daily")


def _facts(spark, sf):
    panel, board, selected, mine, forecast = _chosen(spark, sf)
    facts = (bt.skill(board, selected).select("series", "skill").join(fp.diagnose(panel, "monthly").select("series", "predictability", "periods"), "series")
             .join(bt.coverage(mine), "series").join(selected.select("series", "folds", "mase", "mape"), "series"))
    return panel, forecast, facts


_FACTS = f"""{_BT}, {_PICK}, {_BAND}, {_SIG.format(m=12, m4=48)}, nv AS (SELECT series, min(prim) AS naive FROM board WHERE model IN ('Naive', 'Seasonal Naive', 'Moving Average') GROUP BY 1),
ids AS (SELECT series, r, row_number() OVER (PARTITION BY series ORDER BY r, fold, step) AS id FROM ch),
loo AS (SELECT a.series, a.id, a.r, quantile_cont(b.r, 0.1) AS lo, quantile_cont(b.r, 0.9) AS hi FROM ids a JOIN ids b ON a.series = b.series AND a.id <> b.id GROUP BY 1, 2, 3),
cv AS (SELECT series, round(avg(CASE WHEN r BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 3) AS coverage FROM loo GROUP BY 1),
facts AS (SELECT series, round(1 - prim / naive, 3) AS skill, round(p, 4) AS p, periods, coverage, folds, mase FROM sel JOIN nv USING (series) JOIN r2 USING (series) JOIN dg USING (series) JOIN cv USING (series)),
lv AS (SELECT *, CASE WHEN skill <= 0 OR p < 0.08 OR folds < 2 THEN 'unreliable' WHEN (skill > 0 AND skill < 0.1) OR (p >= 0.08 AND p < 0.2) OR folds = 2 OR periods < 24 OR abs(coverage - 0.8) > 0.15 THEN 'indicative'
  ELSE 'reliable' END AS level FROM facts)"""


@query("J30_reliability", f"""{_FACTS} SELECT series, level, CASE level WHEN 'unreliable' THEN 0.3 WHEN 'indicative' THEN 0.65 END::DOUBLE AS confidence_cap,
  (skill <= 0)::INT + (p < 0.08)::INT + (folds < 2)::INT + (skill > 0 AND skill < 0.1)::INT + (p >= 0.08 AND p < 0.2)::INT + (folds = 2)::INT + (periods < 24)::INT + (abs(coverage - 0.8) > 0.15)::INT AS reasons FROM lv""")
def reliability(spark, sf):
    *_, facts = _facts(spark, sf)
    return bt.reliability(facts).select("series", "level", "confidence_cap", F.size("reasons").alias("reasons"))


@query("J30_confidence", f"""{_FACTS}, r AS (SELECT series, 1 / (1 + greatest(mase, 0)) * (0.7 + 0.3 * least(1, greatest(0, skill))) * greatest(0.5, 1 - abs(coverage - 0.8)) AS raw, p, folds FROM facts)
SELECT series, round(least(0.95, greatest(0.05, CASE WHEN p < 0.1 THEN least(raw, 0.35) ELSE raw END * CASE WHEN folds < 3 THEN 0.9 ELSE 1.0 END)), 2) AS confidence FROM r""")
def confidence(spark, sf):
    *_, facts = _facts(spark, sf)
    return facts.select("series", bt.confidence().alias("confidence"))


_SUM = f"""{_FULL}, rc AS (SELECT series, sum(y) AS recent FROM panel WHERE t >= n - {H} GROUP BY 1), sm AS (SELECT series, round(recent, 2) AS recent_total, round(ahead, 2) AS forecast_total,
  round((ahead - recent) / abs(recent) * 100, 2) AS change_pct FROM ah JOIN rc USING (series))"""
_IMPACT = "CASE WHEN abs(change_pct) > 15 THEN 'high' WHEN abs(change_pct) > 5 THEN 'medium' ELSE 'low' END"


@query("J31_forecast_summary", f"{_SUM} SELECT *, {_IMPACT} AS impact FROM sm")
def forecast_summary(spark, sf):
    panel, _, _, _, forecast = _chosen(spark, sf)
    return bt.summary(panel, forecast, H)


@query("J36_impact_labels", f"{_SUM} SELECT {_IMPACT} AS impact, count(*) AS series FROM sm GROUP BY 1")
def impact_labels(spark, sf):
    panel, _, _, _, forecast = _chosen(spark, sf)
    return bt.summary(panel, forecast, H).groupBy("impact").agg(F.count(F.lit(1)).alias("series"))


@query("J33_missing_days", f"""{W}, e AS (SELECT brand, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM fact GROUP BY 1), s AS (SELECT brand, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT brand, day FROM s ANTI JOIN (SELECT DISTINCT brand, CAST(ts AS DATE) AS day FROM fact) f USING (brand, day)""")
def missing_days(spark, sf):
    return fp.missing_days(fact(spark, sf, "ts", "brand"), "ts", "brand")


@query("J34_period_labels", f"""{W} SELECT CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) + 6 AS week, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS rows FROM fact GROUP BY 1, 2, 3""")
def period_labels(spark, sf):
    day = F.to_date("ts")
    return fact(spark, sf, "ts").groupBy(day.alias("day"), fp.bucket(day, "weekly").alias("week"), fp.bucket(day, "monthly").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


@query("J35_fold_totals", f"{_BT}, {_PICK}, {_BAND} SELECT series, fold, round(sum(r), 2) AS total_error FROM ch GROUP BY 1, 2")
def fold_totals(spark, sf):
    *_, mine, _ = _chosen(spark, sf)
    return bt.fold_totals(mine).select("series", "fold", rnd(F.col("total_error")).alias("total_error"))


@query("J35_tail_error", f"""{P}, f AS (SELECT series, t, y, regr_intercept(y, t) OVER (PARTITION BY series) + regr_slope(y, t) OVER (PARTITION BY series) * t AS yhat, count(*) OVER (PARTITION BY series) AS n2,
  row_number() OVER (PARTITION BY series ORDER BY t DESC) AS back FROM panel) SELECT series, 'Linear Trend' AS model, round(avg(abs(y - yhat)), 4) AS mae, count(*) AS points FROM f WHERE n2 <= 17 OR back <= 12 GROUP BY 1""")
def tail_error(spark, sf):
    panel = _panel(spark, sf)
    line = fm.fit(panel, ["series"], "monthly").select("series", "slope", "intercept")
    fitted = panel.join(line, "series").withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("t")).withColumn("model", F.lit("Linear Trend"))
    return bt.tail_error(fitted, 12)


def _prior(panel):
    """The forecast as it was made six months before the end, with a plain band."""
    past = panel.where(F.col("t") < F.col("n") - H).withColumn("n", F.col("n") - H)
    made = fm.predict(fm.fit(past, ["series"], "monthly"), ["series"], H, ["Moving Average"])
    dates = fm.future_dates(past, "monthly", H)
    return made.join(dates, ["series", "step"]).select("series", "ds", "yhat", (F.col("yhat") * 0.8).alias("lower"), (F.col("yhat") * 1.2).alias("upper"))


_DRIFT = f"""{P}, pa AS (SELECT series, avg(y) AS yhat FROM panel WHERE t < n - {H} AND t >= n - {H} - 12 GROUP BY 1), ex AS (SELECT series, avg(abs(y - lag12)) AS e FROM
  (SELECT series, y, lag(y, 12) OVER (PARTITION BY series ORDER BY t) AS lag12 FROM panel) GROUP BY 1),
lv AS (SELECT p.series, count(*) AS points, avg(abs(y - yhat)) AS live, avg(y - yhat) AS bias, avg(CASE WHEN y BETWEEN yhat * 0.8 AND yhat * 1.2 THEN 1.0 ELSE 0.0 END) AS inside FROM panel p JOIN pa USING (series) WHERE t >= n - {H} GROUP BY 1),
dr AS (SELECT series, points, round(live, 4) AS live_mae, round(bias, 4) AS bias, round(inside, 3) AS coverage, round(live / e, 3) AS error_ratio FROM lv JOIN ex USING (series)),
ds AS (SELECT *, CASE WHEN points < 3 THEN 'insufficient' WHEN error_ratio > 2 THEN 'degraded' WHEN error_ratio > 1.5 THEN 'watch' ELSE 'healthy' END AS status FROM dr)"""


def _drift(spark, sf):
    panel = materialise(_panel(spark, sf))
    expected = bt.scales(panel, "monthly").select("series", F.col("scale").alias("expected_mae"))
    return bt.drift(_prior(panel), panel, expected)


@query("C13_forecast_vs_actual", f"{_DRIFT} SELECT * FROM ds")
def forecast_vs_actual(spark, sf):
    return _drift(spark, sf)


@query("J32_drift_by_status", f"{_DRIFT} SELECT status, count(*) AS series, round(avg(error_ratio), 3) AS mean_ratio FROM ds GROUP BY 1")
def drift_by_status(spark, sf):
    return _drift(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("series"), rnd(F.avg("error_ratio"), 3).alias("mean_ratio"))


@query("H16_series_fingerprint", f"""{P} SELECT series, left(sha256(concat_ws('|', count(*), CAST(round(sum(y), 4) AS DECIMAL(38, 4)), CAST(round(avg(y), 6) AS DECIMAL(38, 6)),
  CAST(round(stddev_pop(y), 6) AS DECIMAL(38, 6)), CAST(min(ds) AS DATE), CAST(max(ds) AS DATE))), 16) AS fingerprint FROM panel GROUP BY 1""")
def fingerprint(spark, sf):
    return fp.fingerprint(_panel(spark, sf))


@query("H21_transforms", f"""{P} SELECT series, round(sum(ln(1 + greatest(y, 0))), 6) AS log_sum, round(sum(sqrt(greatest(y, 0))), 4) AS root_sum, round(sum(exp(ln(1 + greatest(y, 0)) + 0.5 * 0.1 * 0.1) - 1), 2) AS log_back,
  round(sum(greatest(y, 0) + 25), 2) AS root_back FROM panel GROUP BY 1""")
def transforms(spark, sf):
    y = F.col("y")
    back = [fm.inverse(fm.forward(y, name), name, F.lit(s)) for name, s in (("log1p", 0.1), ("sqrt", 5.0))]
    return _panel(spark, sf).groupBy("series").agg(
        rnd(F.sum(fm.forward(y, "log1p")), 6).alias("log_sum"), rnd(F.sum(fm.forward(y, "sqrt")), 4).alias("root_sum"), rnd(F.sum(back[0])).alias("log_back"), rnd(F.sum(back[1])).alias("root_back"))
