"""The benchmark tables as the inputs the operators expect."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scale import dealt
from ledgerlark.operators.rollup import Rollup, order_sums, product_sums
from ledgerlark.roles import Roles

ROLES = Roles(
    time="ts", revenue="revenue", order="order_id", customer="customer_id", product="product",
    quantity="quantity", categories=["brand", "ptype", "mktsegment", "nation", "priority"],
    unit_price="unit_price", discount="discount", name="customer_name",
)

#: the same with the cost that the margin is measured by
COSTED = replace(ROLES, cost="cost")

#: fact column -> (table that carries it, expression)
FACT_COLUMNS = {
    "order_id": ("orders", "o_orderkey"),
    "customer_id": ("orders", "o_custkey"),
    "ts": ("orders", "o_orderdate"),
    "priority": ("orders", "o_orderpriority"),
    "status": ("orders", "o_orderstatus"),
    "product": ("part", "p_name"),
    "brand": ("part", "p_brand"),
    "ptype": ("part", "p_type"),
    "retail": ("part", "p_retailprice"),
    "mktsegment": ("customer", "c_mktsegment"),
    "customer_name": ("customer", "c_name"),
    "nation": ("nation", "n_name"),
    "revenue": ("lineitem", "l_extendedprice * (1 - l_discount)"),
    "quantity": ("lineitem", "l_quantity"),
    "price": ("lineitem", "l_extendedprice"),
    "discount": ("lineitem", "l_discount"),
    "unit_price": ("lineitem", "l_extendedprice / l_quantity"),
    "cost": ("lineitem", "0.6 * l_extendedprice"),
    "orderkey": ("lineitem", "l_orderkey"),
    "linenumber": ("lineitem", "l_linenumber"),
    "partkey": ("lineitem", "l_partkey"),
    "suppkey": ("lineitem", "l_suppkey"),
    "returnflag": ("lineitem", "l_returnflag"),
    "linestatus": ("lineitem", "l_linestatus"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, *columns: str, bounded: bool = False) -> DataFrame:
    """The order lines left-joined to just the tables the wanted columns live in.

    *bounded*: lines and orders meet in tasks of a bounded number of lines, for what goes on to group by order there.
    """
    wanted = {c: FACT_COLUMNS[c] for c in columns}
    tables = {t for t, _ in wanted.values()}
    out = table(spark, sf_dir, "lineitem")
    if tables & {"orders", "customer", "nation"}:
        orders = table(spark, sf_dir, "orders")
        if tables & {"customer", "nation"}:  # joined to the few orders, not to their lines
            orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        if "nation" in tables:
            orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        if bounded:
            rows = out.count()
            out, orders = dealt(out, rows, "l_orderkey"), dealt(orders, rows, "o_orderkey")
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "part" in tables:
        out = out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select(*[F.expr(e).alias(c) for c, (_, e) in wanted.items()])


def sales(spark: SparkSession, sf_dir: str, *attributes: str) -> Rollup:
    """The rollup of the order lines: one scan for orders, one for products, both summed before they are joined.

    *attributes*: columns of orders, customers and products to have beside the sums; only their tables are joined.
    """
    asked = {c: FACT_COLUMNS[c][1] for c in ("revenue", "quantity", "cost", "unit_price", "discount")}
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *[F.expr(e).alias(c) for c, e in asked.items()])
    of_products = [c for c in attributes if FACT_COLUMNS[c][0] == "part"]
    of_orders = [c for c in attributes if c not in of_products]
    tables = {FACT_COLUMNS[c][0] for c in of_orders}
    orders = order_sums(lines, COSTED, ["l_orderkey"]).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if tables & {"customer", "nation"}:
        orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if "nation" in tables:
        orders = orders.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    products = product_sums(lines, COSTED, ["l_partkey"]).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")

    def named(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        own = [c for c in frame.columns if c in (COSTED.revenue, COSTED.quantity, COSTED.cost) or c.startswith("__")]
        return frame.select(*[F.expr(FACT_COLUMNS[c][1]).alias(c) for c in keys], *own)

    order_keys, product_keys = ("order_id", "customer_id", "ts", *of_orders), ("product", *of_products)
    return Rollup(named(orders, order_keys), named(products, product_keys), order_keys, product_keys)


FACT_SQL = """fact AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ts, o_orderpriority AS priority,
         o_orderstatus AS status, p_name AS product, p_brand AS brand, p_type AS ptype, p_retailprice AS retail,
         c_mktsegment AS mktsegment, c_name AS customer_name, n_name AS nation,
         l_extendedprice * (1 - l_discount) AS revenue, l_quantity AS quantity, l_extendedprice AS price,
         l_discount AS discount, l_extendedprice / l_quantity AS unit_price, 0.6 * l_extendedprice AS cost,
         l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
         l_returnflag AS returnflag, l_linestatus AS linestatus
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey
)"""
