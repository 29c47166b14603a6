"""Closed-form models: one aggregate of training statistics, one expression per model."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.operators.forecast.panel import SEASON, STEP, season

PHI = 0.9
ALPHA = 0.1


@dataclass(frozen=True)
class Model:
    """``predict`` is an expression over the training statistics and ``step``."""

    predict: Callable[[], Column]
    min_n: int
    complexity: int
    cost: int = 0  # 0 cheap, 1 medium, 2 expensive
    intermittent_only: bool = False


MODELS: dict[str, Model] = {}
# Models for demand in pulses, and the fast ones used to choose a transform.
FOR_INTERMITTENT = ["Croston", "Naive", "Moving Average", "Seasonal Profile"]
SCREENING = ["Naive", "Seasonal Naive", "Drift", "Moving Average", "Mean (4 seasons)", "Linear Trend", "Seasonal Profile", "Harmonic Regression"]
# Cycles per frequency.
CYCLES = {"daily": [7.0, 365.25], "weekly": [52.18], "monthly": [12.0]}
HARMONIC = "Harmonic Regression"


def register_model(name: str, predict: Callable[[], Column], min_n: int, complexity: int, **spec) -> None:
    """Add a model of one's own; it is back-tested and ranked like the others."""
    MODELS[name] = Model(predict, min_n, complexity, **spec)


def _c(name: str) -> Column:
    return F.col(name)


def _damped() -> Column:
    return PHI * (1 - F.pow(F.lit(PHI), _c("step"))) / (1 - PHI)


def _mean_step() -> Column:
    return (_c("last") - _c("first")) / (_c("n") - 1)


register_model("Naive", lambda: _c("last"), 2, 0)
register_model("Seasonal Naive", lambda: F.when((_c("m") < 2) | (_c("n") < _c("m")), _c("last")).otherwise(
    F.get("recent", (_c("step") - 1) % _c("m"))), 4, 1)
register_model("Drift", lambda: _c("last") + _mean_step() * _c("step"), 3, 1)
register_model("Moving Average", lambda: _c("mean_1"), 3, 1)
register_model("Mean (2 seasons)", lambda: _c("mean_2"), 6, 1)
register_model("Mean (4 seasons)", lambda: _c("mean_4"), 10, 1)
register_model("Mean (long window)", lambda: _c("mean_long"), 12, 1)
register_model("Linear Trend", lambda: _c("intercept") + _c("slope") * (_c("n") - 1 + _c("step")), 4, 2)
register_model("Damped Drift", lambda: _c("last") + _mean_step() * _damped(), 4, 2)
register_model("Damped Trend", lambda: _c("anchor") + _c("slope") * (_c("anchor_k") / 2) + _c("slope") * _damped(), 6, 2)
register_model("Seasonal Profile", lambda: F.when(_c("profile").isNull(), _c("mean_1")).otherwise(
    _c("mean_4") * F.get("profile", (_c("n") + _c("step") - 1) % _c("m"))), 8, 2)
register_model(HARMONIC, lambda: _wave_sum(), 12, 5)
register_model("Croston", lambda: _c("croston"), 8, 2, intermittent_only=True)


def fit(train: DataFrame, keys: list[str], freq: str, models: list[str] | None = None) -> DataFrame:
    """Training statistics per key from rows (keys, t, n, y) with t = 0 .. n-1, for *models* (None: all)."""
    work = train.withColumn("m", season(F.col("n"), freq)).withColumn("back", F.col("n") - 1 - F.col("t"))
    m, back, n, y = F.col("m"), F.col("back"), F.col("n"), F.col("y")
    long = F.greatest(m, F.floor(n / 3))
    anchor_k = F.greatest(F.lit(3), F.least(n, F.greatest(F.lit(4), F.floor(n / 8), m)))
    waved = HARMONIC in (models or MODELS)
    pulses = F.array_sort(F.collect_list(F.when(y != 0, F.struct(F.col("t").alias("t"), y.alias("y")))))
    stats = work.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("m").alias("m"), F.max(F.when(F.col("t") == 0, y)).alias("first"), F.max(F.when(back == 0, y)).alias("last"),
        F.avg(F.when(back < m, y)).alias("mean_1"), F.avg(F.when(back < 2 * m, y)).alias("mean_2"), F.avg(F.when(back < 4 * m, y)).alias("mean_4"),
        F.avg(F.when(back < long, y)).alias("mean_long"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept"),
        F.max(anchor_k).alias("anchor_k"), F.avg(F.when(back < anchor_k, y)).alias("anchor"), F.avg("y").alias("mean_all"),
        F.transform(F.array_sort(F.collect_list(F.when(back < m, F.struct(F.col("t").alias("t"), y.alias("y"))))), lambda p: p["y"]).alias("recent"),
        pulses.alias("pulses"), *([_targets(freq).alias("xy")] if waved else []))
    stats = stats.withColumn("croston", _croston()).drop("pulses")
    if waved:
        stats = _with_waves(stats, freq)
    return stats.join(_profiles(work, keys, freq), keys, "left")


def _profiles(work: DataFrame, keys: list[str], freq: str) -> DataFrame:
    """Median ratio to a centred mean per phase of the season, scaled to mean one."""
    base = SEASON[freq]
    around = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(base // 2), (base - 1) // 2)
    enough = F.count("y").over(around) >= max(2, base // 2)
    level = F.when(enough, F.avg("y").over(around))
    ratio = F.when(F.abs(level) > 1e-9, F.col("y") / level)
    phases = work.where((F.col("n") >= 2 * base) & (F.col("m") == base)).withColumn("ratio", ratio).groupBy(
        *keys, (F.col("t") % base).alias("phase")).agg(F.coalesce(F.percentile("ratio", F.lit(0.5)), F.lit(1.0)).alias("r"))
    table = phases.groupBy(*keys).agg(F.avg("r").alias("mean"), F.array_sort(F.collect_list(F.struct("phase", "r"))).alias("p"))
    scaled = F.when(F.abs("mean") > 1e-9, F.transform("p", lambda x: x["r"] / F.col("mean"))).otherwise(F.transform("p", lambda x: x["r"]))
    return table.select(*keys, scaled.alias("profile"))


def _croston() -> Column:
    """Smoothed size over smoothed interval of the pulses, bias-corrected."""
    pulses = F.col("pulses")
    start = F.struct(pulses[0]["y"].alias("z"), (pulses[0]["t"] - pulses[0]["t"]).cast("double").alias("p"), pulses[0]["t"].alias("t"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        gap = (x["t"] - acc["t"]).cast("double")
        return F.when(acc["k"] == 0, F.struct(x["y"].alias("z"), F.lit(1.0).alias("p"), x["t"].alias("t"), F.lit(1).alias("k"))).otherwise(
            F.struct((acc["z"] + ALPHA * (x["y"] - acc["z"])).alias("z"), (acc["p"] + ALPHA * (gap - acc["p"])).alias("p"), x["t"].alias("t"), (acc["k"] + 1).alias("k")))

    # the first interval runs from the first pulse to itself: zero, read as one
    folded = F.aggregate(pulses, start, step)
    rate = (1 - ALPHA / 2) * folded["z"] / F.greatest(folded["p"], F.lit(1e-9))
    return F.when(F.size(pulses) < 2, F.col("mean_all")).otherwise(rate)


def predict(stats: DataFrame, keys: list[str], horizon: Column | int, models: list[str] | None = None) -> DataFrame:
    """(keys, model, step, yhat) for every model with enough history."""
    steps = stats.withColumn("step", F.explode(F.sequence(F.lit(1), horizon if isinstance(horizon, Column) else F.lit(horizon))))
    rows = F.array_compact(F.array(*[
        F.when(F.col("n") >= MODELS[name].min_n, F.struct(F.lit(name).alias("model"), MODELS[name].predict().cast("double").alias("yhat")))
        for name in models or MODELS]))
    return steps.select(*keys, "step", F.inline(rows))


def candidates(shapes: DataFrame, max_cost: int = 2) -> DataFrame:
    """(series, model) worth trying: enough history, right shape, within the budget."""
    rows = F.array_compact(F.array(*[
        F.when((F.col("n") >= m.min_n) & F.lit(m.cost <= max_cost)
               & (F.lit(name in FOR_INTERMITTENT) & F.col("intermittent") | ~F.col("intermittent") & F.lit(not m.intermittent_only)),
               F.lit(name)) for name, m in MODELS.items()]))
    return shapes.select("series", F.explode(F.when(F.size(rows) > 0, rows).otherwise(F.array(F.lit("Naive")))).alias("model"))


# --- transforms ---------------------------------------------------------------

TRANSFORMS = ["none", "log1p", "sqrt"]


def forward(y: Column, name: str) -> Column:
    floor = F.greatest(y, F.lit(0.0))
    return {"none": y, "log1p": F.log1p(floor), "sqrt": F.sqrt(floor)}[name]


def inverse(z: Column, name: str, sigma: Column | None = None) -> Column:
    """Back to the original scale; with *sigma* the mean, not the median, comes back."""
    s = sigma if sigma is not None else F.lit(0.0)
    if name == "log1p":
        return F.expm1(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), z + 0.5 * s * s)))
    if name == "sqrt":
        floor = F.greatest(z, F.lit(0.0))
        return floor * floor + s * s
    return z


def allowed_transforms(panel: DataFrame) -> DataFrame:
    """A series with negatives, or nearly constant, is not transformed."""
    ok = (F.count(F.lit(1)) >= 8) & (F.min("y") >= 0) & (F.avg("y") > 0) & (F.stddev_pop("y") / F.nullif(F.avg("y"), F.lit(0.0)) >= 0.05)
    return panel.groupBy("series").agg(F.when(ok, F.array(*map(F.lit, TRANSFORMS))).otherwise(F.array(F.lit("none"))).alias("options")).select(
        "series", F.explode("options").alias("transform"))


# --- harmonic regression -----------------------------------------------


def waves(period: float) -> int:
    """Harmonics of a cycle: more for a long one."""
    return max(1, min(10 if period > 100 else 3, int(period // 2)))


def _angles(freq: str) -> list[float]:
    return [2.0 * math.pi * k / p for p in CYCLES[freq] for k in range(1, waves(p) + 1)]


def _design(t: Column, angles: list[Column]) -> list[Column]:
    return [F.lit(1.0), t, *[f(a * t) for a in angles for f in (F.sin, F.cos)]]


def _targets(freq: str) -> Column:
    """Sums of products of y with the mean, the trend and the waves."""
    return F.array(*[F.sum(c * F.col("y")) for c in _design(F.col("t").cast("double"), list(map(F.lit, _angles(freq))))])


def _with_waves(stats: DataFrame, freq: str) -> DataFrame:
    """Coefficients of a ridge regression on trend and waves (a penalty of n / 1000, none on the mean).

    A series has no gaps, so the products of the unknowns depend on its length only: they are
    made once for a length, whatever the number of series and folds, and all that is gathered from
    the rows are the sums in ``xy``.  A cycle takes part once the series is two cycles long; series of fewer
    than eight periods, or with no more periods than unknowns, get a straight line.
    """
    angles = np.array(_angles(freq))
    cycles = np.array([p for p in CYCLES[freq] for _ in range(2 * waves(p))])

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, targets: pd.Series) -> pd.Series:
        systems: dict = {}

        def system(size: int) -> tuple[np.ndarray, np.ndarray]:
            used, penalty = np.append([True, True], size >= 2 * cycles), 1e-3 * size
            if size < 8 or used.sum() >= size:
                used, penalty = np.arange(len(used)) < 2, 0.0
            t = np.arange(size, dtype=float)
            x = np.column_stack([np.ones(size), t / size, *[f(a * t) for a in angles for f in (np.sin, np.cos)]])[:, used]
            return used, x.T @ x + penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))

        out = []
        for size, xy in zip(n.tolist(), targets):
            if size not in systems:
                systems[size] = system(size)
            used, gram = systems[size]
            xy, beta = np.array(xy, float), np.zeros(len(used))
            xy[1] /= size  # the trend in units of the whole history
            beta[used] = np.linalg.lstsq(gram, xy[used], rcond=None)[0]
            beta[1] /= size
            out.append(beta)
        return pd.Series(out)

    return stats.withColumn("beta", solved("n", "xy")).withColumn("angles", F.array(*map(F.lit, _angles(freq)))).drop("xy")


def _wave_sum() -> Column:
    t = (F.col("n") - 1 + F.col("step")).cast("double")
    pairs = F.flatten(F.transform("angles", lambda a: F.array(F.sin(a * t), F.cos(a * t))))
    terms = F.zip_with("beta", F.concat(F.array(F.lit(1.0), t), pairs), lambda b, c: b * c)
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def harmonic_forecast(panel: DataFrame, freq: str, horizon: int) -> DataFrame:
    """Trend and seasonal waves of every series, however short: (series, step, yhat)."""
    sums = panel.where("y is not null").groupBy("series").agg(F.max("n").alias("n"), _targets(freq).alias("xy"))
    ahead = _with_waves(sums, freq).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select("series", "step", _wave_sum().alias("yhat"))


def future_dates(panel: DataFrame, freq: str, horizon: int) -> DataFrame:
    ends = panel.groupBy("series").agg(F.max("ds").alias("last"))
    span = F.sequence("last", F.col("last") + F.expr(STEP[freq]) * F.lit(horizon), F.expr(STEP[freq]))
    return ends.select("series", F.posexplode(span).alias("step", "ds")).where("step > 0")
