"""Panel, models, back-test and bands on series with known answers."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators.forecast import backtest as bt
from ledgerlark.operators.forecast import models as fm
from ledgerlark.operators.forecast import panel as fp


def panel_of(spark, values, freq="daily", name="s"):
    rows = [(name, date(2024, 1, 1) + timedelta(days=i), i, len(values), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ds date, t int, n int, y double").withColumn("observed", F.lit(True))


def forecasts(spark, values, h, freq="daily"):
    p = panel_of(spark, values)
    out: dict = {}
    for r in fm.predict(fm.fit(p, ["series"], freq), ["series"], h).orderBy("step").collect():
        out.setdefault(r["model"], []).append(r["yhat"])
    return out


def test_partial_weeks_go_and_gaps_are_zero(spark):
    days = [date(2024, 1, 3) + timedelta(days=i) for i in range(40) if i not in (20, 21)]
    df = spark.createDataFrame([(d, 1.0) for d in days], "d date, v double")
    daily = fp.build_panel(df, "d", "v", "daily")
    assert daily.count() == 40 and daily.where("y = 0 and not observed").count() == 2
    weeks = [str(r["ds"]) for r in fp.build_panel(df, "d", "v", "weekly").orderBy("ds").collect()]
    assert weeks == ["2024-01-14", "2024-01-21", "2024-01-28", "2024-02-04", "2024-02-11"]


def test_rates_are_interpolated(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 1, 5), 5.0)], "d date, v double")
    assert [r["y"] for r in fp.build_panel(df, "d", "v", "daily", agg="mean").orderBy("t").collect()] == [1, 2, 3, 4, 5]


def test_closed_forms(spark):
    y = [10.0 + 2 * i for i in range(20)]
    got = forecasts(spark, y, 3)
    assert got["Naive"] == [48.0] * 3 and got["Drift"] == pytest.approx([50, 52, 54]) and got["Linear Trend"] == pytest.approx([50, 52, 54])
    assert got["Seasonal Naive"] == [36.0, 38.0, 40.0] and got["Moving Average"] == pytest.approx([42.0] * 3)
    assert got["Damped Drift"] == pytest.approx(48 + 2 * np.cumsum(0.9 ** np.arange(1, 4)))


def test_season_is_projected(spark):
    week = [1, 2, 3, 4, 5, 6, 7]
    got = forecasts(spark, week * 8, 7)["Seasonal Profile"]
    assert got == pytest.approx(week, rel=0.05)


def test_croston_against_a_loop(spark):
    y = [0, 0, 3, 0, 0, 0, 5, 0, 2, 0, 0, 4]
    z, p, last = 3.0, 1.0, 2
    for t in (6, 8, 11):
        z += 0.1 * (y[t] - z)
        p += 0.1 * ((t - last) - p)
        last = t
    assert forecasts(spark, y, 1)["Croston"] == pytest.approx([0.95 * z / p])


def test_level_and_repair_against_a_loop(spark):
    rng = np.random.default_rng(1)
    y = list(100 + rng.normal(0, 3, 60))
    y[30] = 400.0
    rows = fp.repair(panel_of(spark, y), ["series"], "daily").orderBy("t").collect()
    level = [float(np.median(y[max(0, i - 13):i + 1])) for i in range(60)]
    assert [r["level"] for r in rows] == pytest.approx(level)
    assert [r["t"] for r in rows if r["anomaly"]] == [30] and rows[30]["fixed"] < 130


def test_short_series_use_a_short_level(spark):
    y = [float(i % 5) for i in range(20)]
    rows = fp.repair(panel_of(spark, y), ["series"], "daily").orderBy("t").collect()
    assert [r["level"] for r in rows] == pytest.approx([float(np.median(y[max(0, i - 5):i + 1])) for i in range(20)])


def test_level_shift(spark):
    rng = np.random.default_rng(2)
    y = list(rng.normal(10, 1, 30)) + list(rng.normal(30, 1, 20))
    got = fp.level_shift(panel_of(spark, y)).first()
    assert got["shift_at"] == 30 and got["score"] > 10
    assert fp.level_shift(panel_of(spark, [5.0, 6.0] * 20)).first()["shift_at"] is None


def test_noise_is_called_noise(spark):
    rng = np.random.default_rng(3)
    assert fp.diagnose(panel_of(spark, rng.normal(100, 10, 200)), "daily").first()["verdict"] == "noise-dominated"
    wave = [100 + 30 * np.sin(2 * np.pi * i / 7) for i in range(200)]
    assert fp.diagnose(panel_of(spark, wave), "daily").first()["verdict"] == "strong"


def test_backtest_does_not_look_ahead(spark):
    y = [float(i) for i in range(60)]
    resid = bt.residuals(panel_of(spark, y), 5, "daily", folds=3, repaired=False, models=["Naive", "Drift"])
    naive = {(r["fold"], r["step"]): r["yhat"] for r in resid.where("model = 'Naive'").collect()}
    assert naive == {(k, s): 60 - 5 * k - 1 for k in (1, 2, 3) for s in range(1, 6)}
    assert resid.where("model = 'Drift' and abs(y - yhat) > 1e-9").count() == 0


def test_bands_and_coverage_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("s", "m", k, s, float(v), 0.0) for k in range(1, 7) for s, v in zip(range(1, 6), rng.normal(0, 10, 5), strict=True)]
    resid = spark.createDataFrame(rows, "series string, model string, fold int, step int, y double, yhat double")
    r = np.array([x[4] for x in rows])
    steps = np.array([x[3] for x in rows])
    ahead = spark.createDataFrame([("s", s, 100.0) for s in range(1, 6)], "series string, step int, yhat double")
    got = bt.bands(ahead, resid).orderBy("step").collect()
    widen = np.sqrt(np.arange(1, 6) / steps.mean())
    assert [x["upper"] for x in got] == pytest.approx(100 + np.maximum.accumulate(np.quantile(r, 0.9) * widen))
    assert [x["lower"] for x in got] == pytest.approx(100 + np.minimum.accumulate(np.quantile(r, 0.1) * widen))
    hits = [np.quantile(np.delete(r, i), 0.1) <= r[i] <= np.quantile(np.delete(r, i), 0.9) for i in range(len(r))]
    assert bt.coverage(resid).first()["coverage"] == pytest.approx(round(np.mean(hits), 3))


def test_own_model_is_ranked(spark):
    fm.register_model("Zero", lambda: F.lit(0.0), 2, 0)
    try:
        resid = bt.residuals(panel_of(spark, [5.0] * 50), 5, "daily", folds=3)
        board = bt.leaderboard(resid, bt.scales(panel_of(spark, [5.0, 6.0] * 25), "daily"))
        assert {"Zero", "Naive"} <= {r["model"] for r in board.collect()}
    finally:
        del fm.MODELS["Zero"]


def test_bias_needs_agreement(spark):
    ahead = spark.createDataFrame([("s", 1, 100.0)], "series string, step int, yhat double")
    def factor(errors):
        totals = spark.createDataFrame([("s", i, float(e)) for i, e in enumerate(errors)], "series string, fold int, total_error double")
        return bt.bias_factor(totals, ahead).first()["factor"]

    assert factor([10, 12, 14, 16]) == pytest.approx(1.065) and factor([10, -12, 14, 16]) == 1.0 and factor([10, 10, 10]) == 1.0 and factor([90] * 4) == pytest.approx(1.15)


def test_harmonic_regression_of_each_series_equals_a_ridge_solve(spark):
    rng = np.random.default_rng(4)
    series = {"waves": 50 + 0.3 * np.arange(48) + 9 * np.sin(np.arange(48) * np.pi / 6) + rng.normal(0, 1, 48), "big": 1e6 + 4e4 * rng.normal(size=30), "short": np.array([3.0, 5.0, 6.0, 9.0, 11.0])}
    rows = [(name, t, len(y), float(v)) for name, y in series.items() for t, v in enumerate(y)]
    panel = spark.createDataFrame(rows, "series string, t int, n int, y double").repartition(5)
    got = {(r["series"], r["step"]): r["yhat"] for r in fm.harmonic_forecast(panel, "monthly", 4).collect()}
    for name, y in series.items():
        n = len(y)

        def design(t, n=n):
            return np.stack([np.ones(len(t)), t / n, *[f(2 * np.pi * k * t / 12) for k in (1, 2, 3) for f in (np.sin, np.cos)]], axis=1)

        ahead = np.arange(n, n + 4.0)
        if n < 8:
            want = np.polyval(np.polyfit(np.arange(n), y, 1), ahead)
        else:
            x = design(np.arange(n, dtype=float))
            penalty = np.eye(x.shape[1]) * 1e-3 * n
            penalty[0, 0] = 0
            want = design(ahead) @ np.linalg.solve(x.T @ x + penalty, x.T @ y)
        assert [got[name, s] for s in range(1, 5)] == pytest.approx(list(want), rel=1e-6)


def test_harmonic_regression_competes_and_each_fold_equals_a_refit(spark):
    rng = np.random.default_rng(6)
    y = 200 + np.arange(60) + 40 * np.sin(np.arange(60) * np.pi / 6) + 15 * np.cos(np.arange(60) * np.pi / 3) + rng.normal(0, 3, 60)
    panel = panel_of(spark, y, "monthly")
    resid = bt.residuals(panel, 6, "monthly", folds=3, repaired=False)
    got = {(r["fold"], r["step"]): r["yhat"] for r in resid.where(F.col("model") == fm.HARMONIC).collect()}
    for k in (1, 2, 3):
        n = 60 - 6 * k
        alone = {r["step"]: r["yhat"] for r in fm.harmonic_forecast(panel_of(spark, y[:n], "monthly"), "monthly", 6).collect()}
        assert {s: got[k, s] for s in alone} == pytest.approx(alone, rel=1e-9)
    assert len(got) == 18
    board = {r["model"]: r["place"] for r in bt.ordered(bt.leaderboard(resid, bt.scales(panel, "monthly"))).collect()}
    assert board[fm.HARMONIC] == 1 and len(board) == len(fm.MODELS) - 1
    shapes = spark.createDataFrame([("pulses", 40, True), ("short", 11, False), ("long", 12, False)], "series string, n int, intermittent boolean")
    assert [r["series"] for r in fm.candidates(shapes).where(F.col("model") == fm.HARMONIC).collect()] == ["long"]
