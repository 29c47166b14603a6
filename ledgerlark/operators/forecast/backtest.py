"""Rolling-origin back-test, ranking, choice, bands and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.numbers import rnd
from ledgerlark.operators.forecast.models import MODELS, SCREENING, TRANSFORMS, allowed_transforms, candidates, fit, forward, inverse, predict
from ledgerlark.operators.forecast.panel import intermittent, repair, season

LEVEL, NEED = 0.8, 10


def adaptive_folds(n: Column, h: int) -> Column:
    base = F.when(n >= 180, 6).when(n >= 90, 5).when(n >= 60, 4).otherwise(3)
    return F.greatest(F.lit(2), F.least(base, F.greatest(F.lit(1), F.floor(n / (2 * max(h, 1))))))


def folds_of(panel: DataFrame, h: int, freq: str, folds: int | None = None) -> DataFrame:
    """(series, fold, test_start), oldest origin first; each leaves enough history to train on."""
    n = F.col("n")
    least = F.greatest(F.least(2 * season(n, freq), F.floor(n / 2)), F.lit(8), F.lit(h))
    wanted = F.lit(folds) if folds is not None else adaptive_folds(n, h)
    shapes = panel.groupBy("series").agg(F.max("n").alias("n")).withColumn("least", least).withColumn(
        "k", F.greatest(F.lit(1), F.least(wanted, F.floor((n - F.col("least")) / h))).cast("int"))
    return shapes.select("series", "least", "n", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("fold")).withColumn(
        "test_start", F.col("n") - F.col("fold") * h).where("test_start >= least").select("series", "fold", "test_start")


def split(panel: DataFrame, folds: DataFrame, h: int) -> tuple[DataFrame, DataFrame]:
    """Training rows (n = length of the window) and test rows (with their step) of all folds."""
    joined = panel.join(folds, "series")  # at most six folds per series
    train = joined.where("t < test_start").select("series", "fold", "ds", "t", F.col("test_start").alias("n"), "y")
    test = joined.where((F.col("t") >= F.col("test_start")) & (F.col("t") < F.col("test_start") + h)).select(
        "series", "fold", "ds", (F.col("t") - F.col("test_start") + 1).cast("int").alias("step"), "y")
    return train, test


def residuals(panel: DataFrame, h: int, freq: str, *, folds: int | None = None, models: list[str] | None = None, repaired: bool = True,
              transform: str = "none") -> DataFrame:
    """(series, model, fold, step, y, yhat) out of sample, for every series, fold and model at once."""
    train, test = split(panel, folds_of(panel, h, freq, folds), h)
    keys = ["series", "fold"]
    if repaired:
        train = repair(train, keys, freq).select(*keys, "ds", "t", "n", F.col("fixed").alias("y"))
    if transform != "none":
        train = train.withColumn("y", forward(F.col("y"), transform))
        change = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("t"))
        sigma = train.withColumn("d", change).groupBy(*keys).agg((F.stddev_pop("d") / (2.0 ** 0.5)).alias("sigma"))
        made = predict(fit(train, keys, freq, models), keys, h, models).join(sigma, keys).withColumn(
            "yhat", inverse(F.col("yhat"), transform, F.col("sigma"))).drop("sigma")
    else:
        made = predict(fit(train, keys, freq, models), keys, h, models)
    chosen = candidates(panel.groupBy("series").agg(F.max("n").alias("n")).join(intermittent(panel).select("series", "intermittent"), "series"))
    return made.join(chosen, ["series", "model"], "left_semi").join(test, [*keys, "step"]).select(
        "series", "model", "fold", "step", "y", "yhat")


def scales(panel: DataFrame, freq: str) -> DataFrame:
    """Per series the error of the seasonal naive step, absolute and squared."""
    lagged = F.lag("y", 1).over(Window.partitionBy("series").orderBy("t"))
    m = season(F.col("n"), freq)
    by_m = F.first("y").over(Window.partitionBy("series").orderBy("t").rowsBetween(-_base(freq), -_base(freq)))
    d = F.col("y") - F.when(m == _base(freq), by_m).otherwise(lagged)
    size = panel.withColumn("d", d).groupBy("series").agg(F.avg(F.abs("d")).alias("scale"), F.sqrt(F.avg(F.col("d") ** 2)).alias("sq_scale"))
    return size.select("series", *[F.when(F.col(c) > 1e-9, F.col(c)).alias(c) for c in ("scale", "sq_scale")])


def _base(freq: str) -> int:
    from ledgerlark.operators.forecast.panel import SEASON

    return SEASON[freq]


def _errors() -> list[Column]:
    e = F.col("y") - F.col("yhat")
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (F.avg(F.when(F.abs("y") > 1e-9, F.abs(e / F.col("y")))) * 100).alias("mape"), F.stddev_pop(e).alias("residual_std")]


def fold_errors(resid: DataFrame, scale: DataFrame) -> DataFrame:
    per = resid.groupBy("series", "model", "fold").agg(*_errors(), F.sum("y").alias("a"), F.sum("yhat").alias("p"))
    gap = (F.col("p") - F.col("a")) / F.when(F.abs("a") > 1e-9, F.abs("a"))
    return per.join(scale, "series").withColumns({"mase": F.col("mae") / F.col("scale"), "rmsse": F.col("rmse") / F.col("sq_scale"), "total_gap": gap})


def leaderboard(resid: DataFrame, scale: DataFrame, agg: str = "sum") -> DataFrame:
    """Metrics, ranking score and median fold rank per series and model."""
    per_fold = fold_errors(resid, scale)
    err = F.col("rmsse") if agg == "sum" else F.col("mase")
    place = F.row_number().over(Window.partitionBy("series", "fold").orderBy(F.asc_nulls_last(err), "model"))
    ranks = per_fold.withColumn("place", place).groupBy("series", "model").agg(
        F.percentile("place", F.lit(0.5)).alias("rank_score"), F.avg("total_gap").alias("agg_bias"), F.avg(F.abs("total_gap")).alias("agg_ape"),
        F.count(F.lit(1)).alias("folds"))
    pooled = resid.groupBy("series", "model").agg(*_errors()).join(scale, "series").withColumns(
        {"mase": F.col("mae") / F.col("scale"), "rmsse": F.col("rmse") / F.col("sq_scale")})
    out = pooled.join(ranks, ["series", "model"])
    base = F.coalesce("rmsse", "mase", "rmse") if agg == "sum" else F.coalesce("mase", "rmsse", "mae")
    primary = base * (1 + F.coalesce("agg_ape", F.lit(0.0))) if agg == "sum" else base
    return out.withColumn("primary", primary)


_ORDER = ["primary", "rank_score", "mape", "rmse"]


def ordered(board: DataFrame) -> DataFrame:
    """The leaderboard with its place per series."""
    w = Window.partitionBy("series").orderBy(*[F.asc_nulls_last(c) for c in _ORDER], "model")
    return board.withColumn("place", F.row_number().over(w))


def complexity() -> Column:
    table = F.create_map(*[F.lit(x) for name, m in MODELS.items() for x in (name, m.complexity)], F.lit("Ensemble"), F.lit(9))
    return F.coalesce(F.try_element_at(table, F.col("model")), F.lit(5))


def pick(board: DataFrame, per_fold: DataFrame, agg: str = "sum") -> DataFrame:
    """The simplest model that the same folds cannot tell from the best, within four percent."""
    best = ordered(board).where("place = 1").select("series", F.col("model").alias("best"), F.col("primary").alias("best_primary"))
    err = F.col("rmsse") if agg == "sum" else F.col("mase")
    scores = per_fold.select("series", "model", "fold", err.alias("e"))
    of_best = scores.join(best, "series").where(F.col("model") == F.col("best")).select("series", "fold", F.col("e").alias("be"))
    diff = scores.join(of_best, ["series", "fold"]).where("e is not null and be is not null").withColumn("d", F.col("e") - F.col("be"))
    paired = diff.groupBy("series", "model").agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"),
                                                 F.max(F.abs("d")).alias("widest"))
    joined = board.join(best, "series").join(paired, ["series", "model"], "left")
    tied = (F.when(F.coalesce("pairs", F.lit(0)) < 3, F.col("primary") <= F.col("best_primary") * 1.03).when(F.col("widest") <= 1e-8, True)
            .when(F.col("se") <= 1e-12, F.col("mean") <= 0).otherwise(F.col("mean") <= F.col("se")))
    kept = joined.where((F.col("model") == F.col("best")) | ((F.col("primary") <= F.col("best_primary") * 1.04) & tied))
    simple = Window.partitionBy("series").orderBy(complexity(), *[F.asc_nulls_last(c) for c in _ORDER], "model")
    return kept.withColumn("k", F.row_number().over(simple)).where("k = 1").select("series", F.col("model").alias("selected"), "best", "primary", "mase", "mape", "mae", "folds")


def ensemble(resid: DataFrame, board: DataFrame, size: int = 3) -> DataFrame:
    """Residual rows of the inverse-error blend of the top models of each series."""
    top = ordered(board).where(F.col("place") <= size).select("series", "model", (1 / F.greatest(F.coalesce("primary", F.lit(1.0)), F.lit(1e-6))).alias("inv"))
    total = F.sum("inv").over(Window.partitionBy("series"))
    count = F.count(F.lit(1)).over(Window.partitionBy("series"))
    weights = top.withColumn("w", F.round(F.col("inv") / total, 4)).withColumn("k", count).where("k >= 2").select("series", "model", "w")
    return resid.join(weights, ["series", "model"]).groupBy("series", "fold", "step").agg(
        F.max("y").alias("y"), (F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat")).select("series", F.lit("Ensemble").alias("model"), "fold", "step", "y", "yhat")


def skill(board: DataFrame, selected: DataFrame) -> DataFrame:
    """How much better than the strongest naive model."""
    base = board.where(F.col("model").isin("Naive", "Seasonal Naive", "Moving Average")).groupBy("series").agg(F.min("primary").alias("naive"))
    return selected.join(base, "series").select("series", "selected", F.when(F.col("naive") > 0, rnd(1 - F.col("primary") / F.col("naive"), 3)).alias("skill"))


def best_transform(panel: DataFrame, h: int, freq: str, *, folds: int = 3, agg: str = "sum", margin: float = 0.02) -> DataFrame:
    """The transform under which the fast models do best; the plain scale has two percent grace."""
    parts = [residuals(panel, h, freq, folds=folds, models=SCREENING, transform=t).withColumn("transform", F.lit(t)) for t in TRANSFORMS]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    e = F.col("y") - F.col("yhat")
    score = F.sqrt(F.avg(e * e)) if agg == "sum" else F.avg(F.abs(e))
    per = every.groupBy("series", "transform", "model").agg(score.alias("s")).groupBy("series", "transform").agg(F.min("s").alias("s"))
    allowed = per.join(allowed_transforms(panel), ["series", "transform"], "left_semi")
    graced = F.when(F.col("transform") == "none", F.col("s") * (1 - margin)).otherwise(F.col("s"))
    first = F.array_position(F.array(*map(F.lit, TRANSFORMS)), F.col("transform"))
    return allowed.groupBy("series").agg(F.min_by("transform", F.struct(graced, first)).alias("transform"))


# --- bands --------------------------------------------------------------------


def bands(forecast: DataFrame, resid: DataFrame, *, level: float = LEVEL, non_negative: bool = True) -> DataFrame:
    """Lower and upper bound per step from the back-test errors; width never shrinks.

    *forecast* is (series, step, yhat), *resid* the errors of the chosen model.
    """
    alpha = (1 - level) / 2
    ends = F.array(F.lit(alpha), F.lit(1 - alpha))
    need = int(-(-1 // alpha)) if alpha else NEED
    need = NEED if level == LEVEL else need
    err = resid.select("series", "step", (F.col("y") - F.col("yhat")).alias("r"))
    per = err.groupBy("series", "step").agg(F.count(F.lit(1)).alias("k"), F.percentile("r", ends).alias("q"))
    pool = err.groupBy("series").agg(F.count(F.lit(1)).alias("pool_k"), F.percentile("r", ends).alias("pool_q"), F.avg("step").alias("ref"))
    joined = forecast.join(pool, "series", "left").join(per, ["series", "step"], "left")
    widen = F.sqrt(F.col("step") / F.greatest(F.col("ref"), F.lit(1.0)))
    own, enough = F.coalesce(F.col("k"), F.lit(0)) >= need, F.coalesce(F.col("pool_k"), F.lit(0)) >= need
    raw = joined.withColumn("lo", F.when(own, F.col("q")[0]).when(enough, F.col("pool_q")[0] * widen)).withColumn(
        "hi", F.when(own, F.col("q")[1]).when(enough, F.col("pool_q")[1] * widen))
    so_far = Window.partitionBy("series").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    lower = F.col("yhat") + F.coalesce(F.min("lo").over(so_far), F.lit(0.0))
    upper = F.col("yhat") + F.coalesce(F.max("hi").over(so_far), F.lit(0.0))
    return raw.select("series", "step", "yhat", (F.greatest(lower, F.lit(0.0)) if non_negative else lower).alias("lower"), upper.alias("upper"))


def coverage(resid: DataFrame, level: float = LEVEL) -> DataFrame:
    """Share of errors inside the band of all the others.

    Leaving one out of a sorted list only shifts positions, so no pairs are built.
    """
    alpha = (1 - level) / 2
    lists = resid.groupBy("series").agg(F.array_sort(F.collect_list(F.col("y") - F.col("yhat"))).alias("x"))
    k = F.size("x")

    def bound(p: float, i: Column) -> Column:
        spot = F.lit(p) * (k - 2)
        low = F.floor(spot).cast("int")
        high = F.least(low + 1, k - 2)
        def without(j: Column) -> Column:
            return F.get("x", F.when(j >= i, j + 1).otherwise(j))

        return without(low) + (without(high) - without(low)) * (spot - low)

    inside = F.transform("x", lambda v, i: ((v >= bound(alpha, i)) & (v <= bound(1 - alpha, i))).cast("int"))
    hits = F.aggregate(inside, F.lit(0), lambda a, b: a + b)
    return lists.select("series", F.when(k >= NEED + 1, F.round(hits / k, 3)).alias("coverage"))


def fold_totals(resid: DataFrame) -> DataFrame:
    """Error of the horizon total, per fold."""
    return resid.groupBy("series", "fold").agg(F.sum(F.col("y") - F.col("yhat")).alias("total_error"))


def bias_factor(totals: DataFrame, forecast: DataFrame) -> DataFrame:
    """Half of a bias that all folds agree on, at most 15 percent."""
    per = totals.groupBy("series").agg(F.count(F.lit(1)).alias("k"), F.percentile("total_error", F.lit(0.5)).alias("mid"),
                                       F.count_distinct(F.when(F.col("total_error") != 0, F.signum("total_error"))).alias("signs"))
    ahead = forecast.groupBy("series").agg(F.abs(F.sum("yhat")).alias("size"))
    move = F.greatest(F.lit(-0.15), F.least(F.lit(0.15), F.col("mid") / F.nullif(F.col("size"), F.lit(0.0)) * 0.5))
    usable = (F.col("k") >= 4) & (F.col("signs") == 1) & (F.abs(move) >= 0.01)
    return ahead.join(per, "series", "left").select("series", F.when(usable, 1 + move).otherwise(1.0).alias("factor"))


def horizon_total(banded: DataFrame, totals: DataFrame, *, horizon: int, cv_h: int, agg: str = "sum") -> DataFrame:
    """The total (or mean) over the horizon with bounds from the fold totals."""
    fold = F.sum if agg == "sum" else F.avg
    point = banded.groupBy("series").agg(*[fold(c).alias(c) for c in ("yhat", "lower", "upper")])
    factor = horizon / cv_h if agg == "sum" else 1 / max(cv_h, 1)
    per = totals.groupBy("series").agg(F.count(F.lit(1)).alias("k"), F.percentile(F.col("total_error") * factor, F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    out = point.join(per, "series", "left")
    own = F.coalesce(F.col("k"), F.lit(0)) >= 3
    lo = F.when(own, F.col("yhat") + F.col("q")[0]).otherwise(F.col("lower"))
    hi = F.when(own, F.col("yhat") + F.col("q")[1]).otherwise(F.col("upper"))
    return out.select("series", F.col("yhat").alias("value"), F.least(lo, F.col("yhat")).alias("lower"), F.greatest(hi, F.col("yhat")).alias("upper"),
                      F.when(own, "fold totals").otherwise("period bounds").alias("basis"))


# --- verdicts -----------------------------------------------------------------


def reliability(facts: DataFrame, min_periods: int = 24, nominal: float = LEVEL) -> DataFrame:
    """Grade of a forecast from (series, skill, predictability, folds, coverage, periods)."""
    c = F.col
    bad = [(c("skill") <= 0, "no better than a naive forecast"), (c("predictability") < 0.08, "mostly noise"), (c("folds") < 2, "fewer than two folds")]
    soft = [((c("skill") > 0) & (c("skill") < 0.10), "little better than a naive forecast"),
            ((c("predictability") >= 0.08) & (c("predictability") < 0.20), "much noise"), (c("folds") == 2, "only two folds"),
            (c("periods") < min_periods, "short history"), (F.abs(c("coverage") - nominal) > 0.15, "band off its stated coverage")]
    def hits(tests: list) -> Column:
        return F.array_compact(F.array(*[F.when(t, F.lit(reason)) for t, reason in tests]))

    level = F.when(F.size(hits(bad)) > 0, "unreliable").when(F.size(hits(soft)) > 0, "indicative").otherwise("reliable")
    return facts.select("series", level.alias("level"), F.concat(hits(bad), hits(soft)).alias("reasons"),
                        F.when(F.size(hits(bad)) > 0, 0.30).when(F.size(hits(soft)) > 0, 0.65).alias("confidence_cap"))


def confidence() -> Column:
    """Back-test confidence in [0.05, 0.95] from mase, mape, skill, coverage, predictability, folds."""
    c = F.col
    acc = F.coalesce(1 / (1 + F.greatest(c("mase"), F.lit(0.0))), 1 / (1 + F.greatest(c("mape"), F.lit(0.0)) / 100))
    skilled = F.when(c("skill").isNull(), 0.85).otherwise(0.7 + 0.3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("skill"))))
    calibrated = F.when(c("coverage").isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), 1 - F.abs(c("coverage") - LEVEL)))
    raw = acc * skilled * calibrated
    capped = F.when(c("predictability") < 0.1, F.least(raw, F.lit(0.35))).otherwise(raw) * F.when(c("folds") < 3, 0.9).otherwise(1.0)
    return rnd(F.least(F.lit(0.95), F.greatest(F.lit(0.05), capped)), 2)


def impact(change_pct: Column) -> Column:
    return F.when(F.abs(change_pct) > 15, "high").when(F.abs(change_pct) > 5, "medium").otherwise("low")


def summary(panel: DataFrame, forecast: DataFrame, horizon: int) -> DataFrame:
    """The horizon total against the equally long stretch before it."""
    recent = panel.where(F.col("t") >= F.col("n") - horizon).groupBy("series").agg(F.sum("y").alias("recent"))
    ahead = forecast.groupBy("series").agg(F.sum("yhat").alias("ahead"))
    change = (F.col("ahead") - F.col("recent")) / F.nullif(F.abs("recent"), F.lit(0.0)) * 100
    return ahead.join(recent, "series").select("series", rnd(F.col("recent")).alias("recent_total"), rnd(F.col("ahead")).alias("forecast_total"),
                                               rnd(change, 2).alias("change_pct"), impact(rnd(change, 2)).alias("impact"))


def drift(prior: DataFrame, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """A stored forecast (series, ds, yhat, lower, upper) against what came, per series."""
    e = F.col("y") - F.col("yhat")
    live = prior.join(actual.select("series", "ds", "y"), ["series", "ds"]).groupBy("series").agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.abs(e)).alias("live"), F.avg(e).alias("bias"), F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int")).alias("inside"))
    ratio = rnd(F.col("live") / F.when(F.col("expected_mae") > 0, F.col("expected_mae")), 3)
    status = (F.when(ratio.isNull(), "unscored").when(F.col("points") < 3, "insufficient").when(ratio > 2, "degraded").when(ratio > 1.5, "watch").otherwise("healthy"))
    return live.join(expected, "series", "left").select("series", "points", rnd(F.col("live"), 4).alias("live_mae"), rnd(F.col("bias"), 4).alias("bias"),
                                                        rnd(F.col("inside"), 3).alias("coverage"), ratio.alias("error_ratio"), status.alias("status"))


def tail_error(resid: DataFrame, holdout: int) -> DataFrame:
    """Errors over the last *holdout* fitted periods of each series and model."""
    back = F.row_number().over(Window.partitionBy("series", "model").orderBy(F.desc("t")))
    total = F.count(F.lit(1)).over(Window.partitionBy("series", "model"))
    kept = resid.withColumn("back", back).withColumn("total", total).where((F.col("total") <= holdout + 5) | (F.col("back") <= holdout))
    return kept.groupBy("series", "model").agg(*[rnd(F.avg(x), 4).alias(name) for name, x in (("mae", F.abs(F.col("y") - F.col("yhat"))),)], F.count(F.lit(1)).alias("points"))
