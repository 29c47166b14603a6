"""Customer features at several cutoffs against a plain loop, and what large tables are dealt into."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import scale
from ledgerlark.operators import customers
from ledgerlark.plans import customers as plans
from ledgerlark.plans.tables import fact
from ledgerlark.roles import Roles

ROLES = Roles(time="ts", revenue="revenue", order="order_id", customer="customer_id", product="product", quantity="quantity", categories=["brand"], discount="discount")
END = datetime(2024, 12, 1)


def lines():
    """Orders with lines at several moments, also on the edges of the windows; some without order, customer, product or amount."""
    pick, out = random.Random(3), []
    for i in range(400):
        at = END - timedelta(days=pick.choice([0, 7, 30, 60, 90, pick.randrange(200)]))
        out.append((pick.choice([None, *range(40)]), pick.choice([None, *range(9)]), at, pick.choice([None, "a", "b", "c"]), pick.choice(["x", "y"]),
                    pick.choice([None, 1.0, 2.5]), float(pick.randrange(4)), pick.choice([None, 0.1, 0.3])))
    return out


def expected(rows, cutoff, horizon):
    out = {}
    for who in {r[1] for r in rows if r[1] is not None}:
        mine = [r for r in rows if r[1] == who and r[2] <= cutoff]
        if not mine:
            continue
        orders = lambda days: len({r[0] for r in mine if r[0] is not None and (days is None or r[2] > cutoff - timedelta(days=days))})  # noqa: B023, E731
        disc = [r[7] for r in mine if r[7] is not None]
        out[cutoff, who] = {
            "first_order": min(r[2] for r in mine), "last_order": max(r[2] for r in mine), "frequency": orders(None), "orders_last_30": orders(30),
            "orders_last_60": orders(60), "orders_last_90": orders(90), "monetary": sum(r[5] or 0 for r in mine), "total_quantity": sum(r[6] for r in mine),
            "spend_last_90": sum(r[5] or 0 for r in mine if r[2] > cutoff - timedelta(days=90)), "avg_discount": sum(disc) / len(disc) if disc else 0.0,
            "distinct_products": len({r[3] for r in mine} - {None}), "distinct_categories": len({r[4] for r in mine}),
            "churned": int(not any(r[1] == who and cutoff < r[2] <= cutoff + timedelta(days=horizon) for r in rows))}
    return out


@pytest.mark.parametrize("task_rows", [10, 250_000])
def test_panel_against_a_loop(spark, monkeypatch, task_rows):
    monkeypatch.setattr(scale, "TASK_ROWS", task_rows)
    rows, cutoffs = lines(), [END - timedelta(days=d) for d in (30, 60, 97, 190)]
    df = spark.createDataFrame(rows, "order_id long, customer_id long, ts timestamp_ntz, product string, brand string, revenue double, quantity double, discount double")
    want = {k: v for c in cutoffs for k, v in expected(rows, c, 30).items()}
    got = {(r["cutoff"], r["customer"]): r for r in customers.feature_panel(df, ROLES, cutoffs, 30).collect()}
    assert got.keys() == want.keys()
    for k, features in want.items():
        for name, value in features.items():
            assert got[k][name] == (pytest.approx(value) if isinstance(value, float) else value), (k, name)


def test_no_cutoff_no_rows(spark):
    df = spark.createDataFrame(lines(), "order_id long, customer_id long, ts timestamp_ntz, product string, brand string, revenue double, quantity double, discount double")
    assert customers.feature_panel(df, ROLES, [], 30).count() == 0


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1000)
    assert scale.dealt(df, 30 * scale.TASK_ROWS, "id").rdd.getNumPartitions() == 30
    assert scale.dealt(df, 1000, "id") is df


def test_state_makes_its_features_once(spark, monkeypatch):
    made, real = [], customers.feature_panel
    monkeypatch.setattr(customers, "feature_panel", lambda *a, **k: made.append(1) or real(*a, **k))
    assert plans.state(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1


def test_state_of_customers_listed_twice(spark, tmp_path):
    """Lines of a customer with two rows count twice in the state, as in the view they come from."""
    for name in ("lineitem", "orders", "part", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    people = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    people.unionByName(people).write.parquet(str(tmp_path / "customer.parquet"))
    once, twice = (plans.state(spark, d).agg(F.sum("monetary")).first()[0] for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert twice == pytest.approx(2 * once)


def test_customers_join_orders_not_lines(spark, capsys):
    fact(spark, "/root/testdata/sf0.001", "mktsegment", "revenue").explain("extended")
    joins = [line for line in capsys.readouterr().out.split("== Optimized")[0].splitlines() if "Join LeftOuter" in line]
    assert "l_orderkey" in joins[-2] and "c_custkey" in joins[-1]


def test_pairs_of_the_importance_in_bounded_tasks(spark, monkeypatch):
    """Rows that the importance scores are dealt by their number; what comes out does not depend on the tasks."""
    from ledgerlark.operators import churn

    n, columns = 200, customers.FEATURES
    rows = spark.range(n).select(F.col("id").alias("customer"), F.lit(END).cast("timestamp_ntz").alias("cutoff"), (F.col("id") % 3 == 0).cast("int").alias("churned"),
                                 *[(F.col("id") * (k + 1) % (3 if k == 0 else 7 + k)).cast("double").alias(c) for k, c in enumerate(columns)])
    model, _ = churn.train(rows, iterations=1, depth=2)
    tasks, out, real = [], [], churn.auc
    monkeypatch.setattr(churn, "auc", lambda scored, *a: tasks.append(scored.rdd.getNumPartitions()) or real(scored, *a))
    for task_rows in (250_000, 1000):
        monkeypatch.setattr(scale, "TASK_ROWS", task_rows)
        out.append({r["feature"]: r["importance"] for r in churn.permutation_importance(model, rows, columns).collect()})
    assert tasks[0] < n * 5 * len(columns) // 1000 <= tasks[1]
    assert out[0] == out[1] and set(out[0]) == set(columns) and max(out[0], key=out[0].get) == columns[0]
