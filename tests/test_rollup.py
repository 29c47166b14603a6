"""One rollup for all sections: the figures of the lines themselves, merged and extended part by part."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import decision, kpi, quality, rollup, series
from ledgerlark.plans.tables import sales as sales_rollup
from ledgerlark.roles import Roles

ROLES = Roles(time="ts", revenue="revenue", order="order_id", customer="customer_id", product="product", quantity="quantity", cost="cost", unit_price="unit_price", discount="discount")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i // 3, (i // 3) % 17 if i % 50 else None, datetime(2024, 1, 1) + timedelta(days=(i // 3) % 90), f"p{i % 11}", "xyz"[i % 11 % 3], float(1 + i % 4), 10.0 + i % 7, (i % 5) / 10) for i in range(900)]
    df = spark.createDataFrame(rows, "order_id long, customer_id long, ts timestamp_ntz, product string, brand string, quantity double, unit_price double, discount double")
    return df.withColumn("revenue", F.expr("unit_price * quantity * (1 - discount)")).withColumn("cost", F.expr("0.4 * revenue"))


SECTIONS = {
    "kpi": (lambda d, r: kpi.kpi_block(d, ROLES), lambda r: kpi.kpi_block(r.orders, ROLES, r.products)),
    "periods": (lambda d, r: decision.period_stats(d, ROLES, decision.comparison_periods(*decision.date_bounds(d, "ts"))),
                lambda r: decision.period_stats(r.orders, ROLES, decision.comparison_periods(*decision.date_bounds(r.orders, "ts")))),
    "coverage": (lambda d, r: decision.coverage(d, ROLES), lambda r: decision.coverage(r.orders, ROLES)),
    "products": (lambda d, r: decision.concentration(d, "product", "revenue", "product"), lambda r: decision.concentration(r.products, "product", "revenue", "product")),
    "margin": (lambda d, r: decision.margin_summary(decision.product_profit(d, ROLES)), lambda r: decision.margin_summary(decision.product_profit(r.products, ROLES))),
    "gate": (lambda d, r: decision.profit_gate(d, ROLES), lambda r: decision.profit_gate(r.products, ROLES)),
    "discount": (lambda d, r: decision.discount_given(d, ROLES), lambda r: decision.discount_given(r.products, ROLES)),
    "repeat": (lambda d, r: decision.repeat_economics(d, ROLES), lambda r: decision.repeat_economics(r.orders, ROLES)),
    "daily": (lambda d, r: series.daily_series(d, ROLES), lambda r: series.daily_series(r.orders, ROLES)),
    "dimensions": (lambda d, r: kpi.revenue_by_dimensions(d, ROLES, ["brand"], 9), lambda r: kpi.revenue_by_dimensions(r.products, ROLES, ["brand"], 9)),
}


def rows(df):
    return sorted([tuple(pytest.approx(v, rel=1e-9, abs=1e-6) if isinstance(v, float) else v for v in r) for r in df.collect()], key=lambda t: str(t[0]))


@pytest.mark.parametrize("name", SECTIONS)
def test_sections_read_the_rollup_alone(lines, name):
    of_lines, of_rollup = SECTIONS[name]
    r = rollup.of_lines(lines, ROLES, product_attributes=("brand",))
    assert rows(of_rollup(r)) == rows(of_lines(lines, r))


def test_extended_by_a_day(spark, lines, tmp_path):
    """Parts added one by one, one of them twice, merge into the rollup of all lines; other parts are left alone."""
    whole = rollup.of_lines(lines, ROLES, product_attributes=("brand",))
    cut = lines.withColumn("day", F.to_date("ts"))
    early, late = cut.where("day < date'2024-03-01'"), cut.where("day >= date'2024-03-01'")
    path = str(tmp_path / "rollup")
    for part, some in (("early", early), ("late", late.limit(3)), ("late", late)):
        rollup.of_lines(some, ROLES, product_attributes=("brand",)).save(path, part)
    loaded = rollup.load(spark, path, whole.order_keys, whole.product_keys)
    both = rollup.of_lines(early, ROLES, product_attributes=("brand",)).merged(rollup.of_lines(late, ROLES, product_attributes=("brand",)))
    for name in ("orders", "products"):
        want, *others = ({tuple(str(r[c]) for c in getattr(whole, f"{name[:-1]}_keys")): r.asDict() for r in getattr(x, name).collect()} for x in (whole, loaded, both))
        for got in others:
            assert got.keys() == want.keys() and all(got[k][c] == (pytest.approx(v) if isinstance(v, float) else v) for k in want for c, v in want[k].items())


@pytest.mark.parametrize("name", ["D2_kpi_block", "D5_category_revenue", "D10_period_stats", "D18_scenarios", "M5_evidence_findings"])
def test_lines_are_scanned_twice_at_most(spark, name):
    """Scans of the table of lines in all jobs of a query, those that build its rollup included."""
    from ledgerlark.plans import QUERIES

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    QUERIES[name](spark, SF).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    scans = 0
    done = store.executionsList()
    for i in range(before, done.size()):
        nodes = store.planGraph(done.apply(i).executionId()).allNodes()
        scans += sum("lineitem.parquet" in nodes.apply(k).desc() and "FileScan" in nodes.apply(k).desc() for k in range(nodes.size()))
    assert 1 <= scans <= 2


def test_rollup_of_the_tables(spark):
    r = sales_rollup(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n, money = lines.count(), lines.selectExpr("sum(l_extendedprice * (1 - l_discount))").first()[0]
    for df in (r.orders, r.products):
        got = df.agg(F.sum("__lines").alias("n"), F.sum("revenue").alias("money")).first()
        assert got["n"] == n and got["money"] == pytest.approx(money)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("Aggregate") and plan.count("l_extendedprice") > 0  # summed below the join


def test_duplicates_by_hash(spark):
    """Equal rows by any hash: a good one, one that always collides, and one that tells nothing about two of three columns."""
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, 1, "a"), (2, 3, "b"), (2, 3, "c"), (2, 3, "b"), (2, 3, "b"), (None, None, None), (None, None, None)], "x int, y int, z string")
    for hashes in (quality.row_hashes, lambda c: [F.lit(1), F.lit(2)], lambda c: [F.xxhash64(c[0])]):
        assert tuple(quality.duplicate_counts(df, hashes=hashes).first()) == (9, 4, 7)
    assert tuple(quality.duplicate_counts(df.limit(0)).first()) == (0, 0, 0) and tuple(quality.duplicate_counts(df, ["x", "y"]).first()) == (9, 5, 8)


def test_a_clean_table_shuffles_hashes_only(spark):
    df = spark.range(1000).selectExpr("id", "concat('long text ', id) AS a", "id * 2 AS b")
    counted = quality.duplicate_counts(df)
    assert tuple(counted.first()) == (1000, 0, 0)
