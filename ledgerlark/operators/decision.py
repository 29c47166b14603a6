"""Decision measures: period comparison, concentration, momentum, margin,
discount, weekday rhythm, repeat economics and sized scenarios."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.numbers import rnd, rounded, share_pct
from ledgerlark.functions.scale import exact_quantiles, materialise, union_all, with_running
from ledgerlark.operators.kpi import LINES, line_count, number, sales_grain
from ledgerlark.operators.series import daily_series
from ledgerlark.roles import Roles

IDENTITY_SHARE = 0.95
MOMENTUM_FLOOR = 0.005


@dataclass(frozen=True)
class Period:
    """A named span of whole days, the last day included."""

    basis: str
    side: str
    start: date
    end: date

    def holds(self, ts: Column) -> Column:
        return (ts >= F.lit(self.start)) & (ts < F.lit(self.end + timedelta(days=1)))


def coverage(df: DataFrame, roles: Roles) -> DataFrame:
    """First and last day, days with and without data, rows without a date."""
    day = F.to_date(roles.time)
    per_day = df.groupBy(day.alias("day")).agg(line_count(df).alias("n"))
    span = F.date_diff(F.max("day"), F.min("day")) + 1
    return per_day.agg(
        F.min("day").alias("first_date"), F.max("day").alias("last_date"), span.alias("days_span"),
        F.count("day").alias("days_with_data"), (span - F.count("day")).alias("days_without_data"),
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("n"))), F.lit(0)).alias("rows_without_date"),
        rnd(span / 30.44, 1).alias("months_span"),
    )


def date_bounds(df: DataFrame, time: str) -> tuple[date, date]:
    row = df.agg(F.to_date(F.min(time)).alias("lo"), F.to_date(F.max(time)).alias("hi")).first()
    return row["lo"], row["hi"]


def last_complete_month(last: date) -> tuple[date, date]:
    month_start = last.replace(day=1)
    next_month = (month_start + timedelta(days=32)).replace(day=1)
    if last + timedelta(days=1) == next_month:
        return month_start, last
    end = month_start - timedelta(days=1)
    return end.replace(day=1), end


def comparison_periods(first: date, last: date, days: int = 30) -> list[Period]:
    """The last *days* and the last complete month, each with the period before,
    when the data covers both."""
    out = []
    start = last - timedelta(days=days - 1)
    prior_end = start - timedelta(days=1)
    prior_start = prior_end - timedelta(days=days - 1)
    if first <= prior_start:
        out += [Period("rolling_30d", "current", start, last), Period("rolling_30d", "prior", prior_start, prior_end)]
    month_start, month_end = last_complete_month(last)
    before_end = month_start - timedelta(days=1)
    if first <= before_end.replace(day=1):
        out += [Period("last_month", "current", month_start, month_end),
                Period("last_month", "prior", before_end.replace(day=1), before_end)]
    return out


def in_periods(df: DataFrame, time: str, periods: list[Period]) -> DataFrame:
    """Every row once per period it falls in; other rows are left at the scan."""
    ts = F.col(time)
    lo, hi = min(p.start for p in periods), max(p.end for p in periods)
    tags = F.array(*[
        F.when(p.holds(ts), F.struct(F.lit(p.basis).alias("basis"), F.lit(p.side).alias("side"))) for p in periods
    ])
    return (
        df.where((ts >= F.lit(lo)) & (ts < F.lit(hi + timedelta(days=1))))
        .withColumn("period", F.explode(F.array_compact(tags)))
        .select("*", "period.basis", "period.side").drop("period")
    )


def period_stats(df: DataFrame, roles: Roles, periods: list[Period]) -> DataFrame:
    """Revenue, orders, customers, units and order value per period."""
    rows = in_periods(df, roles.time, periods)
    grain = rows.groupBy("basis", "side", F.col(roles.order).alias("order"), F.col(roles.customer).alias("customer")).agg(
        F.sum(number(roles.revenue)).alias("revenue"), F.sum(number(roles.quantity)).alias("units"),
        line_count(rows).alias("rows"),
    )
    stats = grain.groupBy("basis", "side").agg(
        F.sum("revenue").alias("revenue"), F.count_distinct("order").alias("orders"),
        F.count_distinct("customer").alias("customers"), F.sum("units").alias("units"), F.sum("rows").alias("rows"),
    )
    spec = df.sparkSession.createDataFrame(
        [(p.basis, p.side, p.start, p.end) for p in periods], "basis string, side string, start date, end date"
    )
    filled = spec.join(stats, ["basis", "side"], "left")
    return filled.select(
        "basis", "side", "start", "end", (F.date_diff("end", "start") + 1).alias("days"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("revenue", "orders", "customers", "units", "rows")],
    ).withColumn("aov", F.col("revenue") / F.nullif(F.col("orders"), F.lit(0)))


def rounded_period_stats(stats: DataFrame) -> DataFrame:
    return stats.select(
        "basis", "side", "start", "end", "days", rounded(F.col("revenue")).alias("revenue"), "orders", "customers",
        rounded(F.col("units")).alias("units"), rounded(F.col("aov")).alias("aov"), "rows",
    )


def bridge(stats: DataFrame) -> DataFrame:
    """Revenue change of each comparison as volume, basket size and interaction."""
    def side(c: str, s: str) -> Column:
        return F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")

    wide = stats.groupBy("basis").agg(
        *[side(c, s) for c in ("revenue", "orders", "customers", "aov") for s in ("current", "prior")]
    )
    d_orders = F.col("orders_current") - F.col("orders_prior")
    d_aov = F.col("aov_current") - F.col("aov_prior")
    change = F.col("revenue_current") - F.col("revenue_prior")
    volume, basket, both = d_orders * F.col("aov_prior"), d_aov * F.col("orders_prior"), d_orders * d_aov
    return wide.where("orders_prior > 0 and aov_current is not null").select(
        "basis", rounded(change).alias("revenue_change"),
        share_pct(change, F.abs("revenue_prior")).alias("revenue_change_pct"),
        rounded(volume).alias("volume_effect"), rounded(basket).alias("basket_effect"),
        rounded(both).alias("interaction_effect"),
        (rounded(change - (volume + basket + both)) + 0.0).alias("residual"),
        F.when(F.abs(volume) >= F.abs(basket), "volume").otherwise("basket size").alias("primary_driver"),
        d_orders.alias("orders_change"), rounded(d_aov).alias("aov_change"),
        (F.col("customers_current") - F.col("customers_prior")).alias("customers_change"),
    )


def concentration(df: DataFrame, entity: str, revenue: str, kind: str) -> DataFrame:
    """Pareto profile: how many entities carry 50 % and 80 % of revenue, top shares."""
    per = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.sum(number(revenue)).alias("rev"))
    ranked = with_running(
        per.where("rev > 0"), [F.desc("rev"), F.asc("entity")], rank="rn", sums={"cum": F.col("rev")}, total_rows="n"
    )
    whole = ranked.agg(F.struct(F.sum("rev").alias("total"), F.count(F.lit(1)).alias("n"))).scalar()
    work = ranked.withColumn("w", whole).withColumn("cum_share", F.col("cum") / F.col("w.total"))
    decile = F.greatest(F.lit(1), F.bround(F.col("n") * 0.10, 0).cast("long"))

    def top(limit: Column) -> Column:
        return F.sum(F.when(F.col("rn") <= limit, F.col("rev")))

    agg = work.agg(
        F.count(F.lit(1)).alias("total_count"), F.sum("rev").alias("total"),
        F.min(F.when(F.col("cum_share") >= 0.8, F.col("rn"))).alias("count_for_80pct"),
        F.min(F.when(F.col("cum_share") >= 0.5, F.col("rn"))).alias("count_for_50pct"),
        F.max(F.when(F.col("rn") == 1, F.col("entity").cast("string"))).alias("top1_name"),
        top(F.lit(1)).alias("t1"), top(F.lit(5)).alias("t5"), top(F.lit(10)).alias("t10"),
        F.max(decile).alias("top_decile_count"), top(decile).alias("td"),
        F.coalesce(F.sum(F.when(F.col("rn") > F.floor(F.col("n") / 2), F.col("rev"))), F.lit(0.0)).alias("bh"),
    )
    total = F.col("total")
    return agg.where("total_count > 0").select(
        F.lit(kind).alias("kind"), "total_count", rounded(total).alias("total_revenue"), "count_for_80pct",
        share_pct(F.col("count_for_80pct"), F.col("total_count")).alias("count_for_80pct_share_of_base"),
        "count_for_50pct", "top1_name", rounded(F.col("t1")).alias("top1_revenue"),
        share_pct(F.col("t1"), total).alias("top1_share"),
        F.when(F.col("total_count") >= 5, share_pct(F.col("t5"), total)).alias("top5_share"),
        F.when(F.col("total_count") >= 10, share_pct(F.col("t10"), total)).alias("top10_share"),
        "top_decile_count", share_pct(F.col("td"), total).alias("top_decile_share"),
        share_pct(F.col("bh"), total).alias("bottom_half_share"),
    )


def momentum(df: DataFrame, roles: Roles, current: Period, prior: Period, limit: int = 5) -> DataFrame:
    """Products that gained or lost most revenue between two periods."""
    ts = F.col(roles.time)
    lo, hi = min(current.start, prior.start), max(current.end, prior.end)
    value = number(roles.revenue)
    per = (
        df.where((ts >= F.lit(lo)) & (ts < F.lit(hi + timedelta(days=1)))).where(F.col(roles.product).isNotNull())
        .groupBy(F.col(roles.product).alias("product")).agg(
            F.coalesce(F.sum(F.when(current.holds(ts), value)), F.lit(0.0)).alias("cur"),
            F.coalesce(F.sum(F.when(prior.holds(ts), value)), F.lit(0.0)).alias("pri"),
        ).withColumn("delta", F.col("cur") - F.col("pri"))
    )
    floor = per.agg(F.greatest(F.sum("cur"), F.sum("pri")) * MOMENTUM_FLOOR).scalar()
    material = per.where(F.abs("delta") >= floor)

    def side(label: str, keep: Column, *order: Column) -> DataFrame:
        best = material.where(keep).orderBy(*order).limit(limit)
        return best.select(
            F.lit(label).alias("side"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "product",
            rounded(F.col("cur")).alias("current_revenue"), rounded(F.col("pri")).alias("prior_revenue"),
            rounded(F.col("delta")).alias("change"), share_pct(F.col("delta"), F.col("pri")).alias("change_pct"),
            (F.col("pri") == 0).alias("is_new"), (F.col("cur") == 0).alias("is_lost"),
        )

    return side("riser", F.col("delta") > 0, F.desc("delta"), F.asc("product")).unionByName(
        side("faller", F.col("delta") < 0, F.asc("delta"), F.asc("product")))


def close(left: Column, right: Column) -> Column:
    """Within one percent of the right side, or one cent."""
    return F.abs(left - right) <= F.greatest(F.abs(right) * 0.01, F.lit(0.01))


#: The checks of a line as sums over lines (or the least or most of them), so that those of two tables add up.
CHECKS = {"__profit_hits": "sum", "__line_cost_hits": "sum", "__unit_cost_hits": "sum", "__gross": "sum", "__net": "sum", "__discounted": "sum", "__percent_hits": "sum",
          "__fraction_hits": "sum", "__discount_most": "max", "__discount_least": "min", "__discount_sum": "sum"}


def cost_checks(roles: Roles) -> list[Column]:
    """Aggregates over lines: on how many cost and profit explain the revenue."""
    rev, out = number(roles.revenue), []
    if roles.profit and roles.cost:
        out.append(F.count_if(close(number(roles.profit), rev - number(roles.cost))).alias("__profit_hits"))
    if roles.cost:
        out.append(F.count_if(number(roles.cost) <= rev + 0.01).alias("__line_cost_hits"))
        if roles.quantity:
            out.append(F.count_if(number(roles.cost) * number(roles.quantity) <= rev + 0.01).alias("__unit_cost_hits"))
    return out


def discount_checks(roles: Roles) -> list[Column]:
    """Aggregates over lines: money before and after the discount, and on how many lines each scale explains the revenue."""
    if not (roles.discount and roles.unit_price and roles.quantity):
        return []
    rev, raw, gross = number(roles.revenue), number(roles.discount), number(roles.unit_price) * number(roles.quantity)
    out = {"__gross": F.sum(gross), "__net": F.sum(rev), "__discounted": F.count_if(raw > 0), "__percent_hits": F.count_if(close(rev, gross * (1 - raw / 100.0))),
           "__fraction_hits": F.count_if(close(rev, gross * (1 - raw))), "__discount_most": F.max(raw), "__discount_least": F.min(raw), "__discount_sum": F.sum(F.when(raw > 0, raw))}
    return [v.alias(k) for k, v in out.items()]


def merged_check(name: str) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[CHECKS[name]](name).alias(name)


def line_checks(df: DataFrame, checks: list[Column]) -> DataFrame:
    """One row: the number of lines and their checks; a rollup keeps these, and they are added up."""
    if LINES in df.columns:
        checks = [merged_check(c) for c in CHECKS if c in df.columns]
    return df.agg(line_count(df).alias("rows"), *checks)


def profit_gate(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: how well each reading of cost and profit holds, and the one accepted."""
    found = line_checks(df, cost_checks(roles))

    def holds(name: str) -> Column:
        return F.col(name) / F.nullif(F.col("rows"), F.lit(0)) if name in found.columns else F.lit(None).cast("double")

    shares = found.select(*[holds(f"__{c}_hits").alias(f"{c}_share") for c in ("profit", "line_cost", "unit_cost")])
    enough = [F.col(c) >= IDENTITY_SHARE for c in ("profit_share", "line_cost_share", "unit_cost_share")]
    basis = (
        F.when(F.lit(bool(roles.profit and not roles.cost)), "profit column")
        .when(enough[0], "profit column").when(enough[1], "line cost").when(enough[2], "unit cost")
        .otherwise("not proven")
    )
    return shares.select(*[rnd(c, 3).alias(c) for c in shares.columns], basis.alias("basis"))


def with_line_profit(df: DataFrame, roles: Roles) -> tuple[DataFrame, str]:
    """Add ``line_profit`` read the way the gate accepted (NULL when it accepted none)."""
    basis = profit_gate(df, roles).first()["basis"]
    rev = number(roles.revenue)
    value = {
        "profit column": lambda: number(roles.profit),
        "line cost": lambda: rev - number(roles.cost),
        "unit cost": lambda: rev - number(roles.cost) * number(roles.quantity),
    }.get(basis, lambda: F.lit(None).cast("double"))()
    return df.withColumn("line_profit", value), basis


#: What a rollup keeps beside revenue for each way to read cost.
UNIT_COST = "__unit_cost"


def product_profit(df: DataFrame, roles: Roles) -> DataFrame:
    """Revenue and profit per product, with the portfolio totals beside them; *df*: lines, or a rollup of them per product."""
    if LINES in df.columns:
        basis = profit_gate(df, roles).first()["basis"]
        rev = F.sum(number(roles.revenue))
        profit = {"profit column": lambda: F.sum(number(roles.profit)), "line cost": lambda: rev - F.sum(number(roles.cost)), "unit cost": lambda: rev - F.sum(number(UNIT_COST))}.get(
            basis, lambda: F.lit(None).cast("double"))()
        per = df.groupBy(F.col(roles.product).alias("product")).agg(rev.alias("rev"), profit.alias("profit"))
    else:
        with_profit, _ = with_line_profit(df, roles)
        per = with_profit.groupBy(F.col(roles.product).alias("product")).agg(
            F.sum(number(roles.revenue)).alias("rev"), F.sum("line_profit").alias("profit"))
    totals = per.agg(F.struct(F.sum("rev").alias("rev"), F.sum("profit").alias("profit"))).scalar()
    overall = F.col("t.profit") / F.nullif(F.col("t.rev"), F.lit(0.0)) * 100
    return per.withColumn("t", totals).withColumn("overall_pct", overall).withColumn(
        "margin_pct", F.when(F.col("rev") > 0, F.col("profit") / F.col("rev") * 100)).where(F.col("profit").isNotNull())


def _is_drag() -> Column:
    return (F.col("rev") >= F.col("t.rev") * 0.01) & (F.col("margin_pct") < F.col("overall_pct") - 2)


def margin_summary(per: DataFrame) -> DataFrame:
    drag = F.when(_is_drag() & F.col("product").isNotNull(), True).otherwise(False)
    total, profit = F.sum("rev"), F.sum("profit")
    uplift = F.sum(F.when(drag, F.col("rev") * F.col("overall_pct") / 100 - F.col("profit")))
    dragging = F.coalesce(F.sum(F.when(drag, F.col("rev"))), F.lit(0.0))
    return per.agg(
        rounded(total).alias("revenue"), rounded(profit).alias("gross_profit"),
        share_pct(profit, total).alias("gross_margin_pct"), F.count_if(drag).alias("margin_drag_products"),
        rounded(dragging).alias("margin_drag_revenue"), share_pct(dragging, total).alias("margin_drag_share"),
        rounded(uplift).alias("margin_drag_uplift"),
    )


def margin_products(per: DataFrame, limit: int = 5) -> DataFrame:
    """Best and worst margins among material products, loss makers and drag products."""
    sold = per.where("rev > 0 and product is not null")
    material = sold.where(F.col("rev") >= F.col("t.rev") * 0.01)

    def pick(label: str, frame: DataFrame, *order: Column) -> DataFrame:
        best = frame.orderBy(*order).limit(limit)
        return best.select(
            F.lit(label).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("rank"), "product",
            rounded(F.col("rev")).alias("revenue"), rounded(F.col("profit")).alias("gross_profit"),
            rounded(F.col("margin_pct"), 1).alias("margin_pct"),
            share_pct(F.col("rev"), F.col("t.rev")).alias("revenue_share"),
        )

    return union_all([
        pick("best", material, F.desc("margin_pct"), F.asc("product")),
        pick("worst", material, F.asc("margin_pct"), F.asc("product")),
        pick("loss_making", sold.where("profit < 0"), F.asc("profit"), F.asc("product")),
        pick("drag", sold.where(_is_drag()), F.desc("rev"), F.asc("product")),
    ])


def discount_given(df: DataFrame, roles: Roles) -> DataFrame:
    """Discount in money, once price x quantity x (1 - discount) is shown to be revenue.

    Both scales are tested in the same pass (or read from a rollup's checks); no row comes back when neither holds.
    """
    rows = F.nullif(F.col("rows"), F.lit(0))

    def scale(divisor: float, tag: str) -> list[Column]:
        return [
            (F.col(f"__{tag}_hits") / rows).alias(f"share_{tag}"), (F.col("__discount_most") / divisor).alias(f"max_{tag}"),
            (F.col("__discount_least") / divisor).alias(f"min_{tag}"), (F.col("__discount_sum") / F.nullif(F.col("__discounted"), F.lit(0)) / divisor).alias(f"avg_{tag}"),
        ]

    wide = line_checks(df, discount_checks(roles)).select(
        "rows", F.col("__gross").alias("gross"), F.col("__net").alias("net"), F.col("__discounted").alias("discounted"), *scale(100.0, "percent"), *scale(1.0, "fraction"))

    def proven(tag: str) -> Column:
        return (F.col(f"max_{tag}") <= 1) & (F.col(f"min_{tag}") >= 0) & (F.col(f"share_{tag}") >= IDENTITY_SHARE)

    picked = F.when(proven("percent"), "percent").when(proven("fraction"), "fraction")
    of = lambda c: F.when(F.col("scale") == "percent", F.col(f"{c}_percent")).otherwise(F.col(f"{c}_fraction"))
    given = F.col("gross") - F.col("net")
    return wide.withColumn("scale", picked).where("scale is not null").select(
        "scale", rounded(of("share"), 3).alias("identity_share"), rounded(F.col("gross")).alias("gross_before_discount"),
        rounded(F.col("net")).alias("revenue_after_discount"), rounded(given).alias("discount_given"),
        share_pct(given, F.col("gross")).alias("discount_share_of_gross"), F.col("discounted").alias("lines_discounted"),
        share_pct(F.col("discounted"), F.col("rows")).alias("lines_discounted_pct"),
        rounded(of("avg") * 100, 1).alias("avg_discount_on_discounted_lines_pct"),
        rounded(of("max") * 100, 1).alias("max_discount_pct"),
    )


def weekday_days(df: DataFrame, roles: Roles) -> DataFrame:
    """Mean revenue per occurrence of each weekday (one row per weekday)."""
    daily = daily_series(df, roles)
    return daily.groupBy(F.date_format("day", "EEEE").alias("day_name")).agg(
        F.avg("y").alias("mean"), F.count(F.lit(1)).alias("occurrences"), F.sum("y").alias("total"))


def weekday_rhythm(days: DataFrame, min_occurrences: int = 4) -> DataFrame:
    order = F.struct("mean", "day_name")
    agg = days.agg(
        F.sum("occurrences").alias("n"), F.min("occurrences").alias("fewest"), F.sum("total").alias("total"),
        F.max_by(F.struct("day_name", "mean"), order).alias("best"),
        F.min_by(F.struct("day_name", "mean", "occurrences"), order).alias("worst"),
    ).where(F.col("fewest") >= min_occurrences).withColumn("overall", F.col("total") / F.col("n"))
    overall = F.col("overall")
    return agg.select(
        rounded(F.col("n") / 7, 1).alias("weeks_covered"), rounded(overall).alias("avg_daily_revenue"),
        F.col("best.day_name").alias("best_day"), rounded(F.col("best.mean")).alias("best_day_avg"),
        share_pct(F.col("best.mean") - overall, overall).alias("best_day_vs_avg_pct"),
        F.col("worst.day_name").alias("worst_day"), rounded(F.col("worst.mean")).alias("worst_day_avg"),
        share_pct(F.col("worst.mean") - overall, overall).alias("worst_day_vs_avg_pct"),
        F.col("worst.occurrences").alias("worst_day_count"),
        rounded((overall - F.col("worst.mean")) * F.col("worst.occurrences")).alias("worst_day_gap_total"),
    )


def repeat_economics(df: DataFrame, roles: Roles) -> DataFrame:
    """Repeat against one-time customers, with the median order value."""
    grain = materialise(sales_grain(df, roles))
    per_order = materialise(grain.where("order is not null").groupBy("order").agg(F.sum("revenue").alias("revenue")))  # read in every pass of the median
    median = exact_quantiles(per_order, ["revenue"], [0.5])["revenue"][0]
    per = grain.where("customer is not null").groupBy("customer").agg(
        F.sum("revenue").alias("rev"), F.count_distinct("order").alias("orders"))
    back = F.col("orders") >= 2
    total, repeat_rev = F.sum("rev"), F.coalesce(F.sum(F.when(back, F.col("rev"))), F.lit(0.0))
    n, repeats = F.count(F.lit(1)), F.count_if(back)
    return per.agg(
        n.alias("customers"), repeats.alias("repeat_customers"), share_pct(repeats, n).alias("repeat_rate_pct"),
        (n - repeats).alias("one_time_customers"), share_pct(n - repeats, n).alias("one_time_rate_pct"),
        rounded(repeat_rev).alias("repeat_revenue"), share_pct(repeat_rev, total).alias("repeat_revenue_share"),
        rounded(F.coalesce(F.sum(F.when(~back, F.col("rev"))), F.lit(0.0))).alias("one_time_revenue"),
        rounded(F.avg("orders")).alias("avg_orders_per_customer"),
        rounded(F.avg(F.when(back, F.col("rev")))).alias("avg_revenue_per_repeat_customer"),
        rounded(F.avg(F.when(~back, F.col("rev")))).alias("avg_revenue_per_one_time_customer"),
        rounded(F.lit(median)).alias("median_order_value"),
    )


def scenarios(
    *, bridges: DataFrame, weekday: DataFrame, repeat: DataFrame, products: DataFrame, margin: DataFrame,
    discount: DataFrame,
) -> DataFrame:
    """What each lever is worth, by arithmetic over the one-row sections."""
    first_basis = F.when(F.col("basis") == "last_month", 0).otherwise(1)
    change = bridges.agg(F.min_by("revenue_change", first_basis).alias("v"))

    def row(frame: DataFrame, key: str, value: Column, keep: Column, action: str) -> DataFrame:
        return frame.where(keep).select(F.lit(key).alias("key"), value.alias("value"), F.lit(action).alias("action"))

    col = F.col
    return union_all([
        row(change, "decline_recovery", rounded(F.abs("v")), col("v") < 0, "demand / traffic recovery"),
        row(weekday, "weak_weekday_uplift", col("worst_day_gap_total"), col("worst_day_gap_total") != 0,
            "staffing, stock and promotion timing"),
        row(repeat, "second_purchase_upside", rounded(col("one_time_customers") * col("median_order_value")),
            (col("one_time_customers") > 0) & (col("median_order_value") != 0), "retention / reactivation campaign"),
        row(products, "top_product_dependency", col("top1_revenue"), col("top1_revenue").isNotNull(),
            "supply / supplier risk review for the top seller"),
        row(margin, "margin_normalisation_upside", col("margin_drag_uplift"), col("margin_drag_uplift") != 0,
            "pricing / sourcing review on the named products"),
        row(discount, "discount_recapture", col("discount_given"), col("discount_given") != 0,
            "discount-policy review"),
    ])
