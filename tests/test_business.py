"""Business measures on small frames whose answers can be worked out by hand."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import churn, customers, decision, keys, kpi, monitor, quality, relations, roledetect, rootcause, series
from ledgerlark.operators.relations import Relationship
from ledgerlark.roles import Roles

ROLES = Roles(time="order_date", revenue="total_price", order="order_id", customer="customer_id", product="product", quantity="quantity",
              categories=["category"], cost="cost", profit="profit", unit_price="unit_price", discount="discount")


def sales(spark):
    """April: ten orders of 100; May: six of 50 and one on the last day."""
    rows = [(f"a{i}", f"c{i}", datetime(2024, 4, 1 + i), "Latte", 1, 100.0) for i in range(10)]
    rows += [(f"m{i}", f"c{i}", datetime(2024, 5, 1 + i), "Tea", 1, 50.0) for i in range(6)] + [("m9", "c9", datetime(2024, 5, 31, 23, 30), "Tea", 1, 50.0)]
    df = spark.createDataFrame(rows, "order_id string, customer_id string, order_date timestamp_ntz, product string, quantity int, total_price double")
    return df.withColumns({"category": F.lit("x"), "cost": F.col("total_price") * 0.6, "profit": F.col("total_price") * 0.4, "discount": F.lit(0.2),
                           "unit_price": F.col("total_price") / 0.8})


def test_last_complete_month():
    assert decision.last_complete_month(date(2001, 8, 1)) == (date(2001, 7, 1), date(2001, 7, 31))
    assert decision.last_complete_month(date(2024, 5, 31)) == (date(2024, 5, 1), date(2024, 5, 31))
    assert decision.last_complete_month(date(2024, 3, 15)) == (date(2024, 2, 1), date(2024, 2, 29))


def test_bridge_closes_and_last_day_counts(spark):
    df = sales(spark)
    periods = [p for p in decision.comparison_periods(*decision.date_bounds(df, "order_date")) if p.basis == "last_month"]
    stats = decision.period_stats(df, ROLES, periods)
    rows = {r["side"]: r for r in stats.collect()}
    assert rows["current"]["revenue"] == 350 and rows["current"]["orders"] == 7 and rows["prior"]["revenue"] == 1000
    b = decision.bridge(stats).first()
    assert b["revenue_change"] == -650 == b["volume_effect"] + b["basket_effect"] + b["interaction_effect"]
    assert b["residual"] == 0 and b["primary_driver"] == "basket size" and b["volume_effect"] == -300


def test_profit_must_be_proven(spark):
    df = sales(spark)
    assert decision.profit_gate(df, ROLES).first()["basis"] == "profit column"
    wrong = df.withColumn("profit", F.lit(1.0)).withColumn("cost", F.col("total_price") * 3)
    assert decision.profit_gate(wrong, ROLES).first()["basis"] == "not proven"
    assert decision.product_profit(wrong, ROLES).count() == 0


def test_discount_must_be_proven(spark):
    got = decision.discount_given(sales(spark), ROLES).first()
    assert got["scale"] == "fraction" and got["discount_given"] == pytest.approx(337.5)
    percent = decision.discount_given(sales(spark).withColumn("discount", F.lit(20.0)), ROLES).first()
    assert percent["scale"] == "percent"
    assert decision.discount_given(sales(spark).withColumn("unit_price", F.lit(1.0)), ROLES).count() == 0


def test_kpis_reconcile(spark):
    got = kpi.kpi_block(sales(spark), ROLES).first()
    assert got["revenue"] == 1350 and got["orders"] == 17 and got["aov"] == pytest.approx(79.41) and got["aov_median"] == 100
    assert got["total_customers"] == got["returning_customers"] + got["one_time_customers"] == 10
    assert kpi.is_unit_price("Unit Price") and not kpi.is_unit_price("total_price")


def test_gap_series(spark):
    rows = [(date(2024, 1, d), 10.0) for d in (1, 2, 3, 5, 6, 9, 10)]
    df = spark.createDataFrame(rows, "order_date date, total_price double")
    daily = series.daily_series(df, ROLES)
    assert daily.count() == 10 and daily.where("y = 0").count() == 3
    assert {str(r["week"]) for r in series.weekly_series(daily).collect()} == {"2024-01-07", "2024-01-14"}


def test_quality_grades(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, -4.0)], "k int, v double")
    got = {(r["check_name"], r["column_name"]): r for r in quality.quality_report(df, money=["v"], quantity="v").collect()}
    assert got["missing_values", None]["n"] == 1 and got["missing_values", None]["severity"] == "high"
    assert got["duplicate_rows", None]["n"] == 1 and got["negative_values", "v"]["severity"] == "high"


# --- keys and relations ---------------------------------------------------------


def test_primary_keys(spark):
    orders = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12)], "order_id int, line int")
    assert keys.primary_key("orders", orders).first()["columns"] == ["order_id", "line"]
    named = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(9)], "customer_id int, grp int, label string")
    got = keys.primary_key("c", named).first()
    assert got["status"] == "confirmed" and got["columns"] == ["customer_id"]
    dirty = spark.createDataFrame([("1",), ("x",), ("3",)], "ref_id string")
    assert keys.primary_key("d", dirty).first()["status"] == "candidate"  # two forms in one key
    assert keys.primary_key("e", spark.createDataFrame([(1,), (1,), (1,)], "v int")).first()["status"] == "none"


def test_key_forms_match(spark):
    fk = spark.createDataFrame([("1001",), ("1002.0",), (None,), ("1003",)], "customer_id string")
    pk = spark.createDataFrame([(1001.0,), (1002.0,)], "id double")
    got = relations.orphan_rate(fk, "customer_id", pk, "id").first()
    assert got["orphans"] == 1 and got["orphan_rate"] == pytest.approx(0.3333)
    assert [r["raw"] for r in relations.orphan_sample(fk, "customer_id", pk, "id").collect()] == ["1003"]


def test_integrity_gate(spark):
    customers_ = spark.createDataFrame([(1, "a"), (2, "b")], "customer_id int, label string")
    good = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "order_id int, customer_id int")
    bad = spark.createDataFrame([(10, 1), (11, 9)], "order_id int, customer_id int")
    rel = [Relationship("orders", "customer_id", "customers", "customer_id")]
    assert keys.integrity_report({"customers": customers_, "orders": good}, rel).first()["passed"]
    assert not keys.integrity_report({"customers": customers_, "orders": bad}, rel).first()["passed"]


def test_discovery_orients_the_relationship(spark):
    tables = {"orders": spark.createDataFrame([(i, i % 4) for i in range(12)], "order_no int, customer_id int"),
              "customers": spark.createDataFrame([(i, f"c{i}") for i in range(4)], "customer_id int, label string")}
    got = relations.find_relationships(tables).first()
    assert (got["table_a"], got["column_a"], got["table_b"], got["column_b"], got["confidence"]) == ("orders", "customer_id", "customers", "customer_id", 1.0)


def test_combination_plans(spark):
    orders = spark.createDataFrame([(i, i % 3) for i in range(9)], "order_id int, product_id int")
    products = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (2, "again")], "product_id int, name string")
    once = products.where("name <> 'again'")
    assert relations.plan_combination({"o": orders}).strategy == "single"
    assert relations.plan_combination({"o": orders, "p": orders.toDF("Order_ID", "PRODUCT_ID")}).strategy == "append"
    plan = relations.plan_combination({"o": orders, "p": once})
    assert (plan.strategy, plan.primary, plan.joins) == ("join", "o", (("p", "product_id"),))
    assert relations.combine({"o": orders, "p": once}, plan).count() == 9
    assert relations.plan_combination({"o": orders, "p": products}).strategy == "separate"
    assert relations.star_join(orders, products, "product_id", ["name"]).count() == 9


def test_identifiers(spark):
    assert relations.sanitized_names(["Order #", "Order!", "اسم العميل", "1st", " "]) == {
        "Order #": "order", "Order!": "order_2", "اسم العميل": "اسم_العميل", "1st": "_1st", " ": "column"}
    tables = {"My Orders": spark.createDataFrame([(1,)], "`Order ID` int"), "People": spark.createDataFrame([(1,)], "`Order ID` int")}
    renamed, rel, pk = relations.sanitize_all(tables, [Relationship("My Orders", "Order ID", "People", "Order ID")], {"People": ["Order ID"]})
    assert renamed["my_orders"].columns == ["order_id"] and rel[0].table_b == "people" and pk == {"people": ["order_id"]}


def test_roles(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "o1", "c1", "p", "k", 10.0, 1)],
                               "order_date timestamp, order_id string, customer_id string, product string, category string, total_amount double, quantity int")
    got = roledetect.detect_roles(df)
    assert (got.time, got.order, got.customer, got.product, got.revenue, got.quantity, got.categories) == (
        "order_date", "order_id", "customer_id", "product", "total_amount", "quantity", ["category"])
    assert roledetect.detect_roles(df, ROLES) is ROLES
    assert roledetect.forecastable_metrics(df, "order_date") == ["total_amount", "quantity"]


# --- customers and churn --------------------------------------------------------


def churn_tx(spark, days=200):
    rng, rows, start = random.Random(4), [], datetime(2024, 1, 1)
    for c in range(90):
        active = c < 45
        last = days if active else days // 2
        day = rng.randrange(0, 20)
        while day < last:
            rows.append((f"c{c:02d}", f"o{len(rows)}", start + timedelta(days=day), rng.choice("ab"), "k", 1, 20.0 + rng.random()))
            day += rng.randrange(5, 18)
    return spark.createDataFrame(rows, "customer_id string, order_id string, order_date timestamp_ntz, product string, category string, quantity int, total_price double")


CHURN_ROLES = Roles(time="order_date", revenue="total_price", order="order_id", customer="customer_id", product="product", quantity="quantity", categories=["category"])


def test_churn_signal(spark):
    df = churn_tx(spark)
    older, newest, validation = churn.split_panel(df, CHURN_ROLES)
    model, _ = churn.train(older, iterations=10)
    got = churn.metrics(churn.with_probability(model, newest), validation).first()
    assert validation == "out_of_time" and got["auc"] > 0.75 and got["tp"] + got["fp"] + got["fn"] + got["tn"] == newest.count()


def test_short_history_splits_at_random(spark):
    df = churn_tx(spark, 60)
    older, newest, validation = churn.split_panel(df, CHURN_ROLES, wanted=40) or (None, None, "none")
    assert validation in ("random_split", "none", "out_of_time")
    assert churn.training_cutoffs(datetime(2024, 1, 1), datetime(2024, 1, 20), 14) == []


def test_auc_formula(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, churned int").withColumn("g", F.lit(1))
    assert churn.auc(df, ["g"]).first()["auc"] == pytest.approx(4.5 / 6)
    both = df.unionByName(df.withColumn("g", F.lit(2)).withColumn("churned", 1 - F.col("churned"))).withColumn("score", F.col("p") / 1e6)
    assert {r["g"]: round(r["auc"], 9) for r in churn.auc(both, ["g"], "score").collect()} == {1: 0.75, 2: 0.25}


def test_quintiles_of_few(spark):
    for n, want in ((1, [5]), (2, [1, 5]), (7, [1, 1, 2, 3, 4, 5, 5])):
        df = spark.createDataFrame([(i, float(i)) for i in range(n)], "id int, v double")
        got = [r["q"] for r in customers.quintile(df, "v", "id", "q").orderBy("id").collect()]
        assert got == want


def test_state_has_one_row_per_customer(spark):
    df = churn_tx(spark)
    state = customers.customer_state(df, CHURN_ROLES, as_of=datetime(2024, 7, 18)).collect()
    assert len(state) == 90 == len({r["customer_id"] for r in state})
    assert all(r["churn_probability"] is None and r["value_at_risk"] is None for r in state)
    assert {r["lifecycle_stage"] for r in state} >= {"Churned"}
    summary = customers.portfolio_summary(spark.createDataFrame(state, customers.customer_state(df, CHURN_ROLES, as_of=datetime(2024, 7, 18)).schema)).first()
    assert summary["total_value_at_risk"] is None and summary["customers"] == 90


def test_personal_fields_go_at_any_depth(spark):
    df = spark.sql("select 'x' as display_name, 1 as id, named_struct('contact', 'y', 'keep', 2) as inner, array(named_struct('_internal', 1, 'ok', 3)) as list")
    out = customers.strip_personal(df)
    assert out.columns == ["id", "inner", "list"]
    assert out.schema["inner"].dataType.names == ["keep"] and out.schema["list"].dataType.elementType.names == ["ok"]


# --- root cause -------------------------------------------------------------------


def planted(spark, hit: bool):
    """Every combination sells four times a day; with *hit* one of them loses nine tenths in April."""
    rng, rows = random.Random(7), []
    for d in range(61):
        for product in ("Office Bulk", "Chair", "Desk", "Lamp"):
            for region in ("North", "South", "East"):
                for channel in ("Email", "Web", "Store"):
                    for _ in range(4):
                        if hit and d >= 31 and (product, region, channel) == ("Office Bulk", "North", "Email") and rng.random() < 0.9:
                            continue
                        rows.append((f"o{len(rows)}", datetime(2025, 3, 1) + timedelta(days=d), product, region, channel, 50.0 + rng.random() * 20))
    return spark.createDataFrame(rows, "order_id string, order_date timestamp_ntz, product string, region string, channel string, total_price double")


RC_ROLES = Roles(time="order_date", revenue="total_price", order="order_id")


def test_planted_cause_is_found_and_control_confirms_nothing(spark):
    windows = rootcause.Period("custom", "current", date(2025, 4, 1), date(2025, 4, 30)), rootcause.Period("custom", "prior", date(2025, 3, 2), date(2025, 3, 31))
    dims = ["channel", "product", "region"]
    found = rootcause.analyse(planted(spark, True), RC_ROLES, dims=dims, current=windows[0], prior=windows[1])
    robust = [r["slice"] for r in found["causes"].where("robust").orderBy("rank").collect()]
    assert "channel=Email & product=Office Bulk & region=North" in robust
    assert all(part in ("channel=Email", "product=Office Bulk", "region=North") for r in robust for part in r.split(" & "))
    control = rootcause.analyse(planted(spark, False), RC_ROLES, dims=dims, current=windows[0], prior=windows[1])
    assert control["causes"].where("robust").count() == 0


def test_windows():
    assert [p.basis for p in rootcause.windows(date(2024, 1, 1), date(2024, 4, 10))] == ["last_month"] * 2
    assert [p.basis for p in rootcause.windows(date(2024, 1, 1), date(2024, 2, 10))] == ["halves"] * 2
    with pytest.raises(ValueError):
        rootcause.windows(date(2024, 1, 1), date(2024, 1, 2))


# --- monitoring -------------------------------------------------------------------


def test_own_rule_and_order(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "last timestamp")
    late = lambda c: monitor.freshness_findings(c["last"], c["as_of"])
    found = monitor.evaluate({"last": df, "as_of": date(2024, 1, 9)}, [late, late])
    assert [r["severity"] for r in monitor.ordered(found).collect()] == ["critical", "critical"]
    assert monitor.evaluate({"last": df, "as_of": date(2024, 1, 2)}, [late]).count() == 0
    held = monitor.deliver(found, found.select("fingerprint"), limit=1)
    assert {r["held_reason"] for r in held.collect()} == {"inside the cooldown"}
