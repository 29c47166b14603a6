"""Daily and weekly series on a complete calendar.

Everything after ``daily_series`` works on one row per day; windows without a
partition are bounded by the length of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.numbers import rnd
from ledgerlark.operators.kpi import number
from ledgerlark.roles import Roles


def _by_day():
    return Window.orderBy("day")


def daily_series(df: DataFrame, roles: Roles) -> DataFrame:
    """(day, y) from the first to the last day, days without rows at zero."""
    sums = (
        df.where(F.col(roles.time).isNotNull())
        .groupBy(F.to_date(roles.time).alias("day")).agg(F.sum(number(roles.revenue)).alias("y"))
    )
    return fill_days(sums)


def fill_days(sums: DataFrame) -> DataFrame:
    spine = sums.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day")
    )
    return spine.join(sums, "day", "left").select("day", F.coalesce("y", F.lit(0.0)).alias("y"))


def weekly_series(daily: DataFrame) -> DataFrame:
    """Weeks ending on Sunday, labelled with that Sunday."""
    sunday = F.date_add(F.date_trunc("week", "day").cast("date"), 6)
    return daily.groupBy(sunday.alias("week")).agg(F.sum("y").alias("y"))


def series_stats(daily: DataFrame) -> DataFrame:
    def stats(frame: DataFrame, label: str, key: str) -> DataFrame:
        return frame.agg(
            F.lit(label).alias("grain"), F.count(F.lit(1)).alias("periods"),
            F.min(key).alias("first"), F.max(key).alias("last"),
            *[rnd(fn("y"), 2).alias(name) for name, fn in
              (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
        )

    return stats(daily, "daily", "day").unionByName(stats(weekly_series(daily), "weekly", "week"))


def rolling_means(daily: DataFrame, spans: tuple[int, ...] = (7, 14, 30), last: int = 30) -> DataFrame:
    """Rolling means, only where the window is full, for the last days."""
    position = F.row_number().over(_by_day())
    out = daily.withColumn("n", position)
    for span in spans:
        mean = F.avg("y").over(_by_day().rowsBetween(1 - span, 0))
        out = out.withColumn(f"mean_{span}", F.when(F.col("n") >= span, rnd(mean, 2)))
    return out.orderBy(F.desc("day")).limit(last).drop("n", "y")


def trend(daily: DataFrame) -> DataFrame:
    slope = rnd(F.regr_slope("y", "x"), 4)
    return daily.select("y", (F.row_number().over(_by_day()) - 1).cast("double").alias("x")).agg(
        slope.alias("trend_slope"),
        F.when(slope > 0, "up").when(slope < 0, "down").otherwise("flat").alias("trend_direction"),
    )


def structural_breaks(daily: DataFrame, span: int = 3, limit_pct: float = 20.0) -> DataFrame:
    """Days where the mean of the *span* days after differs from the days before."""
    before = F.avg("y").over(_by_day().rowsBetween(-span, -1))
    after = F.avg("y").over(_by_day().rowsBetween(1, span))
    full = (F.count("y").over(_by_day().rowsBetween(-span, -1)) == span) & (
        F.count("y").over(_by_day().rowsBetween(1, span)) == span)
    change = (F.col("after") - F.col("before")) / F.nullif(F.abs("before"), F.lit(0.0)) * 100
    return (
        daily.select("day", before.alias("before"), after.alias("after"), full.alias("full"))
        .where("full").withColumn("change", change).where(F.abs("change") > limit_pct)
        .select("day", rnd("before", 2).alias("before_avg"), rnd("after", 2).alias("after_avg"),
                rnd("change", 2).alias("change_pct"))
    )


def z_anomalies(daily: DataFrame, limit: float = 2.5) -> DataFrame:
    """Days beyond *limit* standard deviations, told apart as spikes and drops."""
    stats = daily.agg(F.struct(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.count("y").alias("n")))
    s = stats.scalar()
    z = (F.col("y") - F.col("s.mean")) / F.nullif(F.col("s.sd"), F.lit(0.0))
    return (
        daily.withColumn("s", s).withColumn("z", z).where((F.col("s.n") >= 5) & (F.abs("z") > limit))
        .select("day", rnd("y", 2).alias("y"), rnd("z", 4).alias("z"),
                F.when(F.col("y") > F.col("s.mean") * 1.5, "spike").when(F.col("y") < F.col("s.mean") * 0.5, "drop")
                .otherwise("anomaly").alias("kind"))
    )


def iqr_anomalies(daily: DataFrame, factor: float = 1.5) -> DataFrame:
    q = daily.agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.75)))).scalar()
    lo, hi = _fences("q", factor)
    return (
        daily.withColumn("q", q).where((F.col("y") < lo) | (F.col("y") > hi)).where("q[1] > q[0]")
        .select("day", rnd("y", 2).alias("y"), rnd(lo, 2).alias("lower"), rnd(hi, 2).alias("upper"))
    )


def _fences(quartiles: str, factor: float) -> tuple[Column, Column]:
    q1, q3 = F.col(quartiles)[0], F.col(quartiles)[1]
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
