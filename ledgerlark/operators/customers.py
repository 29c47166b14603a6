"""Customer features, RFM segments, lifecycle, risk and the customer state table."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.numbers import risk_tier, rnd
from ledgerlark.functions.scale import dealt, exact_quantiles, materialise, with_running
from ledgerlark.operators.kpi import number
from ledgerlark.roles import Roles

# Segment by recency score and combined frequency/money score.
SEGMENTS = {
    (5, 5): "Champions", (5, 4): "Champions", (5, 3): "Loyal Customers", (5, 2): "Potential Loyalists", (5, 1): "New Customers",
    (4, 5): "Champions", (4, 4): "Loyal Customers", (4, 3): "Loyal Customers", (4, 2): "Potential Loyalists", (4, 1): "Promising",
    (3, 5): "Can't Lose Them", (3, 4): "Loyal Customers", (3, 3): "Need Attention", (3, 2): "Need Attention", (3, 1): "About to Sleep",
    (2, 5): "Can't Lose Them", (2, 4): "At Risk", (2, 3): "At Risk", (2, 2): "About to Sleep", (2, 1): "Hibernating",
    (1, 5): "Can't Lose Them", (1, 4): "At Risk", (1, 3): "At Risk", (1, 2): "Hibernating", (1, 1): "Lost",
}
# Groups of segments.
RISK_SEGMENTS = ["At Risk", "Can't Lose Them", "Hibernating", "About to Sleep", "Lost"]
GROWTH_SEGMENTS = ["Potential Loyalists", "New Customers", "Promising"]
HIGH_VALUE_SEGMENTS = ["Champions", "Loyal Customers"]

# The features of a customer, in the order a model sees them.
FEATURES = [
    "recency_days", "frequency", "monetary", "tenure_days", "avg_order_value", "avg_interpurchase_days", "orders_last_30",
    "orders_last_60", "orders_last_90", "spend_last_90", "spend_trend", "distinct_products", "distinct_categories",
    "total_quantity", "avg_discount",
]
DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, the floor of the time difference."""
    return F.floor((micros(later) - micros(earlier)) / DAY)


def parse_time(df: DataFrame, time: str) -> DataFrame:
    """Rows with a readable timestamp only, as ``_dt``."""
    if dict(df.dtypes)[time] == "string":
        return df.withColumn("_dt", F.try_to_timestamp(time).cast("timestamp_ntz")).where("_dt is not null")
    return df.withColumn("_dt", F.col(time)).where("_dt is not null")


def feature_panel(df: DataFrame, roles: Roles, cutoffs: list[datetime], horizon_days: int = 0) -> DataFrame:
    """Features of every customer at every cutoff, with the churn label when a
    horizon is given (no purchase in the days after the cutoff).

    Lines are summed per order and moment, these per customer and place among the
    cutoffs and their windows; only those few rows are spread over the cutoffs.
    Products and categories count from the first time they were bought, so they too
    become numbers per customer and place.
    """
    rows = parse_time(df, roles.time).where(F.col(roles.customer).isNotNull())
    has_discount = roles.discount is not None
    discount = F.col(roles.discount).try_cast("double") if has_discount else F.lit(None).cast("double")
    base = rows.groupBy(F.col(roles.customer).alias("customer"), F.col(roles.order).alias("order"), "_dt").agg(
        F.sum(number(roles.revenue)).alias("money"), F.sum(number(roles.quantity)).alias("qty"),
        F.sum(discount).alias("disc"), F.count(discount).alias("disc_n"), F.count(F.lit(1)).alias("lines"),
    )
    points = [F.lit(c).cast("timestamp_ntz") for c in cutoffs]
    reach = F.make_interval(days=F.lit(horizon_days))

    def place(ts: Column) -> Column:
        """A digit per cutoff: 0 beyond its reach, 1 after it, from 2 on before it, in the windows of 90, 60 and 30 days 3 to 5."""
        def digit(c: Column) -> Column:
            inside = [F.when(micros(ts) > micros(c) - days * DAY, digit) for days, digit in ((30, "5"), (60, "4"), (90, "3"))]
            return F.when(ts <= c, F.coalesce(*inside, F.lit("2"))).when(ts <= c + reach, "1").otherwise("0")

        return F.concat(*[digit(c) for c in points])

    # an order with several moments counts in a window by the first of them that lies there
    earlier = F.when(F.col("order").isNotNull(), F.lag("_dt").over(Window.partitionBy("customer", "order").orderBy("_dt")))
    placed = base.select("*", earlier.alias("prev")).select(
        "*", place(F.col("_dt")).alias("place"), F.when(F.col("prev").isNotNull(), place(F.col("prev"))).alias("prev_place"))
    sums = ["money", "qty", "disc", "disc_n", "orders"]
    measured = materialise(placed.groupBy("customer", "place", "prev_place").agg(
        F.min("_dt").alias("first"), F.max("_dt").alias("last"), F.count("order").alias("orders"),
        *[F.sum(c).alias(c) for c in (*sums[:-1], "lines")]))
    lines = measured.agg(F.sum("lines")).first()[0] or 0  # a number for sizing tasks
    distinct = {"distinct_products": roles.product, "distinct_categories": (roles.categories or [None])[0]}
    counted = [_first_bought(rows, roles, column, points, lines).withColumnRenamed("n", name) for name, column in distinct.items() if column is not None]
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), counted, measured.drop("lines"))
    sums += [name for name, column in distinct.items() if column is not None]
    grain = together.groupBy("customer", "place", "prev_place").agg(F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in sums])
    if counted:
        grain = materialise(grain)
    spread = dealt(grain, grain.count(), "customer").select("customer", "first", "last", *sums, F.explode(F.array(*[
        F.struct(c.alias("cutoff"), F.substring("place", i + 1, 1).cast("int").alias("at"), F.coalesce(F.substring("prev_place", i + 1, 1).cast("int"), F.lit(0)).alias("was"))
        for i, c in enumerate(points)]).cast("array<struct<cutoff: timestamp_ntz, at: int, was: int>>")).alias("w")).where("w.at > 0")
    at, was = F.col("w.at"), F.col("w.was")

    def total(name: str, level: int = 2) -> Column:
        return F.sum(F.when(at >= level, F.col(name)))

    def orders_in(level: int) -> Column:
        return F.coalesce(F.sum(F.when((at >= level) & (was < level), F.col("orders"))), F.lit(0))

    per = spread.groupBy(F.col("w.cutoff").alias("cutoff"), "customer").agg(
        F.min(F.when(at >= 2, F.col("first"))).alias("first_order"), F.max(F.when(at >= 2, F.col("last"))).alias("last_order"), orders_in(2).alias("frequency"),
        F.coalesce(total("money"), F.lit(0.0)).alias("monetary"), F.coalesce(total("qty"), F.lit(0.0)).alias("total_quantity"),
        F.coalesce(total("money", 3), F.lit(0.0)).alias("spend_last_90"),
        *[orders_in(level).alias(f"orders_last_{days}") for days, level in ((30, 5), (60, 4), (90, 3))],
        F.coalesce(total("disc") / F.nullif(total("disc_n"), F.lit(0)), F.lit(0.0)).alias("avg_discount"),
        F.bool_or(at == 1).alias("returned"),
        *[(F.lit(0).cast("long") if column is None else F.coalesce(total(name), F.lit(0))).alias(name) for name, column in distinct.items()],
    ).where("last_order is not null")
    tenure = F.greatest(days_between(F.col("cutoff"), F.col("first_order")), F.lit(0))
    out = per.withColumns({
        "recency_days": F.greatest(days_between(F.col("cutoff"), F.col("last_order")), F.lit(0)), "tenure_days": tenure,
        "avg_order_value": F.coalesce(F.col("monetary") / F.nullif(F.col("frequency"), F.lit(0)), F.lit(0.0)),
        "spend_trend": F.coalesce(F.col("spend_last_90") / F.nullif(F.col("monetary"), F.lit(0.0)), F.lit(0.0)),
    }).withColumn("avg_interpurchase_days", F.col("tenure_days") / F.greatest(F.col("frequency"), F.lit(1)))
    label = [(~F.coalesce("returned", F.lit(False))).cast("int").alias("churned")] if horizon_days else []
    present = [f for f in FEATURES if has_discount or f != "avg_discount"]
    return out.select("cutoff", "customer", "first_order", "last_order", *present, *label)


def _first_bought(rows: DataFrame, roles: Roles, column: str, points: list[Column], lines: int) -> DataFrame:
    """(customer, place, n): the values of *column* by the cutoffs that lie at or after their first purchase."""
    bought = rows.where(F.col(column).isNotNull()).select(F.col(roles.customer).alias("customer"), F.col(column).alias("v"), "_dt")
    firsts = dealt(bought, lines, "customer", "v").groupBy("customer", "v").agg(F.min("_dt").alias("since"))
    place = F.concat(*[F.when(F.col("since") <= c, "2").otherwise("0") for c in points])
    return firsts.groupBy("customer", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def features(df: DataFrame, roles: Roles, as_of: datetime) -> DataFrame:
    return feature_panel(df, roles, [as_of]).drop("cutoff")


# --- RFM ----------------------------------------------------------------------


def quintile(table: DataFrame, value: str, key: str, name: str, *, reverse: bool = False) -> DataFrame:
    """Add the quintile 1..5 of a global rank, ties broken by the key."""
    ranked = with_running(table, [F.asc(value), F.asc(key)], rank="__rn", total_rows="__n")
    score = F.when(F.col("__n") > 1, F.greatest(F.lit(1), F.ceil((F.col("__rn") - 1) * 5 / (F.col("__n") - 1)))).otherwise(5)
    score = (6 - score if reverse else score).cast("int")
    return ranked.withColumn(name, score).drop("__rn", "__n")


def rfm_inputs(df: DataFrame, roles: Roles, as_of: date | None = None) -> DataFrame:
    """Recency, frequency and money per customer; as-of defaults to the day after the last row."""
    rows = parse_time(df, roles.time).where(F.col(roles.customer).isNotNull())
    snap = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else rows.agg(
        (F.max("_dt") + F.expr("interval 1 day")).alias("snap")).scalar()
    grain = rows.groupBy(F.col(roles.customer).alias("customer"), F.col(roles.order).alias("order")).agg(
        F.sum(number(roles.revenue)).alias("money"), F.max("_dt").alias("last"))
    per = grain.groupBy("customer").agg(F.max("last").alias("last"), F.count("order").alias("frequency"), F.sum("money").alias("monetary"))
    return per.select("customer", days_between(snap, F.col("last")).alias("recency"), "frequency", "monetary")


def rfm(df: DataFrame, roles: Roles, as_of: date | None = None) -> DataFrame:
    """One row per customer: recency, frequency, money, scores and segment."""
    scored = materialise(rfm_inputs(df, roles, as_of))
    scored = quintile(scored, "recency", "customer", "r", reverse=True)
    scored = quintile(scored, "frequency", "customer", "f")
    scored = quintile(scored, "monetary", "customer", "m")
    return scored.withColumn("fm", combined_score(F.col("f"), F.col("m"))).withColumn("segment", segment_of(F.col("r"), F.col("fm")))


def combined_score(f: Column, m: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.bround((f + m) / 2, 0))).cast("int")


def segment_of(r: Column, fm: Column) -> Column:
    grid = F.create_map(*[F.lit(x) for (a, b), name in SEGMENTS.items() for x in (a * 10 + b, name)])
    return F.coalesce(F.try_element_at(grid, (r * 10 + fm).cast("int")), F.lit("Need Attention"))


def segment_summary(scored: DataFrame) -> DataFrame:
    per = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary").alias("rev"), F.avg("recency").alias("recency"),
        F.avg("frequency").alias("frequency"), F.avg("monetary").alias("monetary"), F.avg(F.col("r") + F.col("f") + F.col("m")).alias("score"))
    everything = Window.partitionBy()  # at most eleven segments
    n, total = F.sum("customers").over(everything), F.sum("rev").over(everything)
    return per.select(
        "segment", "customers", rnd(F.col("customers") / n * 100, 1).alias("customer_pct"), rnd(F.col("rev")).alias("revenue"),
        rnd(F.col("rev") / F.nullif(total, F.lit(0.0)) * 100, 1).alias("revenue_pct"), rnd(F.col("recency"), 1).alias("avg_recency_days"),
        rnd(F.col("frequency")).alias("avg_frequency"), rnd(F.col("monetary")).alias("avg_monetary"), rnd(F.col("score")).alias("avg_rfm_score"))


def marketing_kpis(scored: DataFrame) -> DataFrame:
    """Repeat rate, customers and revenue in risk segments, growth and high-value customers."""
    n = F.count(F.lit(1))
    risk = F.col("segment").isin(RISK_SEGMENTS)
    return scored.agg(
        n.alias("customers"), rnd(F.count_if(F.col("frequency") >= 2) / n * 100, 1).alias("repeat_purchase_rate"),
        rnd(F.count_if(F.col("frequency") < 2) / n * 100, 1).alias("one_time_buyer_rate"),
        F.count_if(risk).alias("churn_risk_customers"), rnd(F.count_if(risk) / n * 100, 1).alias("churn_risk_pct"),
        rnd(F.coalesce(F.sum(F.when(risk, F.col("monetary"))), F.lit(0.0))).alias("revenue_at_risk"),
        F.count_if(F.col("segment").isin(GROWTH_SEGMENTS)).alias("growth_segment_customers"),
        F.count_if(F.col("segment").isin(HIGH_VALUE_SEGMENTS)).alias("high_value_customers"))


# --- lifecycle ----------------------------------------------------------------


def stage_rules(table: DataFrame) -> DataFrame:
    """Thresholds from the customers' own cadence: the median gap of repeat buyers."""
    repeat = table.where("frequency > 1").select("avg_interpurchase_days")
    cadence = None
    if repeat.count() >= 10:
        cadence = exact_quantiles(repeat, ["avg_interpurchase_days"], [0.5])["avg_interpurchase_days"][0]
    measured = cadence is not None and cadence > 0
    days = rnd(F.lit(cadence if measured else 60.0), 1)
    return table.sparkSession.range(1).select(
        days.alias("cadence_days"), F.lit("median_interpurchase_days" if measured else "default_no_repeat_buyers").alias("cadence_basis"),
        rnd(days * 1.5, 1).alias("dormant_after_days"), rnd(days * 3.0, 1).alias("churned_after_days"),
        F.lit(90).alias("new_within_days"))


def lifecycle_stage(rules: dict) -> Column:
    recency, tenure, frequency = F.col("recency_days"), F.col("tenure_days"), F.col("frequency")
    expected = F.when(tenure > 0, frequency * (90.0 / tenure)).otherwise(0.0)
    pace = F.when(expected > 0, F.col("orders_last_90") / expected)
    return (
        F.when(recency > rules["churned_after_days"], "Churned").when(recency > rules["dormant_after_days"], "Dormant")
        .when((tenure <= rules["new_within_days"]) & (frequency <= 1), "New")
        .when(pace >= 1.2, "Growing").when(pace <= 0.6, "Declining").otherwise("Established"))


def value_at_risk(p: Column, clv: Column, money: Column) -> tuple[Column, Column]:
    """Probability times what is lost (predicted value, else past spend), and which it was."""
    base = F.coalesce(clv, money)
    basis = F.when(p.isNull() | base.isNull(), None).when(clv.isNotNull(), "predicted_clv").otherwise("historical_monetary")
    return rnd(p * base), basis


def names(df: DataFrame, roles: Roles, columns: dict[str, str]) -> DataFrame:
    """Per customer the first value present of each column, by time."""
    return df.where(F.col(roles.customer).isNotNull()).groupBy(F.col(roles.customer).alias("customer")).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(roles.time), F.col(c)))).alias(alias) for alias, c in columns.items()])


def customer_state(df: DataFrame, roles: Roles, *, as_of: datetime, scores: DataFrame | None = None,
                   contacts: dict[str, str] | None = None, table: DataFrame | None = None) -> DataFrame:
    """One row per customer at a date: observed, derived and predicted values apart. *table*: the features then, where they are stored already."""
    table = materialise(features(df, roles, as_of)) if table is None else table
    rules = stage_rules(table).first().asDict()
    segments = rfm(df, roles, as_of.date()).select("customer", "r", "f", "m", F.col("segment").alias("rfm_segment"))
    people = names(df, roles, {**({"display_name": roles.name} if roles.name else {}), **(contacts or {})}) if (roles.name or contacts) else None
    out = table.withColumn("lifecycle_stage", lifecycle_stage(rules)).join(segments, "customer", "left")
    if people is not None:
        out = out.join(people, "customer", "left")
    out = out.join(scores.select("customer", "churn_probability"), "customer", "left") if scores is not None else out.withColumn(
        "churn_probability", F.lit(None).cast("double"))
    kinds = [F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for k in (contacts or {}) for i, x in enumerate((k, k))]
    amount, basis = value_at_risk(F.round("churn_probability", 4), F.lit(None).cast("double"), rnd(F.col("monetary")))
    return out.select(
        F.col("customer").cast("string").alias("customer_id"), F.lit(as_of.date()).alias("snapshot_date"),
        (F.col("display_name") if roles.name else F.lit(None).cast("string")).alias("display_name"),
        (F.map_filter(F.create_map(*kinds), lambda k, v: v.isNotNull()) if kinds else F.create_map().cast("map<string,string>")).alias("contact"),
        "recency_days", "frequency", rnd(F.col("monetary")).alias("monetary"), "tenure_days",
        rnd(F.col("avg_order_value")).alias("avg_order_value"), F.to_date("first_order").alias("first_order_date"),
        F.to_date("last_order").alias("last_order_date"), "rfm_segment", F.col("r").alias("r_score"), F.col("f").alias("f_score"),
        F.col("m").alias("m_score"), "lifecycle_stage", F.round("churn_probability", 4).alias("churn_probability"),
        risk_tier(F.col("churn_probability")).alias("risk_tier"), F.lit(None).cast("double").alias("predicted_clv"),
        amount.alias("value_at_risk"), basis.alias("value_basis"))


# --- reading the state --------------------------------------------------------

# Fields that identify a person.
PERSONAL = ["display_name", "contact"]
SORTABLE = ["value_at_risk", "churn_probability", "monetary", "recency_days", "frequency", "customer_id"]


def strip_personal(df: DataFrame) -> DataFrame:
    """Drop personal and internal fields, also inside structs."""
    from pyspark.sql import types as T

    def hidden(name: str) -> bool:
        return name in PERSONAL or name.startswith("_")

    def cleaned(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = [f for f in kind.fields if not hidden(f.name)]
            return F.when(c.isNotNull(), F.struct(*[cleaned(c[f.name], f.dataType).alias(f.name) for f in kept]))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: cleaned(x, kind.elementType))
        return c

    return df.select(*[cleaned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if not hidden(f.name)])


def matching(state: DataFrame, *, segment: str | None = None, stage: str | None = None, tier: str | None = None, search: str | None = None) -> DataFrame:
    out = state
    for column, wanted in (("rfm_segment", segment), ("lifecycle_stage", stage), ("risk_tier", tier)):
        if wanted:
            out = out.where(F.col(column) == wanted)
    if search:
        pattern = "%" + search + "%"
        out = out.where(F.col("customer_id").ilike(pattern) | F.col("display_name").ilike(pattern))
    return out


def page(state: DataFrame, *, sort_by: str = "value_at_risk", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a whitelisted order, nulls last, ties by id."""
    column = sort_by if sort_by in SORTABLE else "value_at_risk"
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return state.orderBy(order, F.asc("customer_id")).offset(offset).limit(limit)


def customer_at(states: DataFrame, customer_id: str, snapshot: date | None = None) -> DataFrame:
    """One customer at a date, or at the latest one."""
    mine = states.where(F.col("customer_id") == customer_id)
    if snapshot is not None:
        mine = mine.where(F.col("snapshot_date") == F.lit(snapshot))
    return mine.orderBy(F.desc("snapshot_date")).limit(1)


def timelines(states: DataFrame, last: int = 90) -> DataFrame:
    """Every customer across snapshots, the newest *last* of them."""
    newest = Window.partitionBy("customer_id").orderBy(F.desc("snapshot_date"))
    return states.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= last).drop("k")


def portfolio_summary(state: DataFrame) -> DataFrame:
    """Totals, NULL when nothing was measured."""
    def money(c: str) -> Column:
        return F.when(F.count(c) > 0, rnd(F.sum(c)))

    return state.agg(
        F.count(F.lit(1)).alias("customers"), money("monetary").alias("total_monetary"), money("value_at_risk").alias("total_value_at_risk"),
        rnd(F.avg("churn_probability"), 4).alias("avg_churn_probability"), F.count("churn_probability").alias("customers_scored"),
        F.count("predicted_clv").alias("customers_with_clv"), F.count("monetary").alias("customers_with_monetary"),
        F.count("value_at_risk").alias("customers_with_value_at_risk"))


def portfolio_breakdown(state: DataFrame) -> DataFrame:
    """Customers by segment, stage, tier and value basis, in one grouping-sets pass."""
    dims = ["rfm_segment", "lifecycle_stage", "risk_tier", "value_basis"]
    sets = state.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("customers"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        name = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(name)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "customers").where("value is not null")


def ranking_overlap(state: DataFrame, top_n: int = 10) -> DataFrame:
    """How far the riskiest and the most valuable at-risk customers are the same."""
    risk = page(state, sort_by="churn_probability", limit=top_n).select("customer_id", "value_at_risk")
    value = page(state, sort_by="value_at_risk", limit=top_n).select("customer_id", "value_at_risk")
    both = risk.select("customer_id").intersect(value.select("customer_id"))
    covered = [F.coalesce(f.agg(F.sum("value_at_risk")).scalar(), F.lit(0.0)) for f in (risk, value)]
    return both.agg(F.count(F.lit(1)).alias("overlap")).select(
        F.lit(top_n).alias("top_n"), "overlap", rnd(covered[0]).alias("value_covered_by_risk"),
        rnd(covered[1]).alias("value_covered_by_value_at_risk"), rnd(covered[1] - covered[0]).alias("difference"))
