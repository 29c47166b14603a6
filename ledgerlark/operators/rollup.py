"""A stored, mergeable rollup of the order lines that all sections of an analysis read.

Two scans of the lines make it: sums per order and sums per product, each before anything is joined to them.
An order's table stands in for the fact view wherever orders, customers or the calendar are measured, a product's table
wherever products are, and the checks of a row (does the discount explain the revenue? is the
cost a line's or a unit's?) are counts that add up, kept beside the products' sums.

Everything in it is a sum, a count, a minimum or a maximum, so two rollups of different lines merge
into the rollup of all of them: a stored one is extended by a day by adding that day's part,
and adding the same part again replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scale import materialise
from ledgerlark.operators.decision import CHECKS, UNIT_COST, cost_checks, discount_checks, merged_check
from ledgerlark.operators.kpi import LINES, line_count, number
from ledgerlark.roles import Roles

PART = "__part"


def order_sums(lines: DataFrame, roles: Roles, keys: list[str]) -> DataFrame:
    """Revenue, units and lines by *keys*, under the names that the roles give them."""
    sums = [F.sum(number(c)).alias(c) for c in (roles.revenue, roles.quantity) if c]
    return lines.groupBy(*keys).agg(*sums, line_count(lines).alias(LINES))


def product_sums(lines: DataFrame, roles: Roles, keys: list[str]) -> DataFrame:
    """Revenue, units, cost and profit by *keys*, with the counts behind the checks of cost and discount."""
    sums = {c: F.sum(number(c)) for c in (roles.revenue, roles.quantity, roles.cost, roles.profit) if c}
    if roles.cost and roles.quantity:
        sums[UNIT_COST] = F.sum(number(roles.cost) * number(roles.quantity))
    return lines.groupBy(*keys).agg(*[v.alias(c) for c, v in sums.items()], line_count(lines).alias(LINES), *cost_checks(roles), *discount_checks(roles))


@dataclass(frozen=True)
class Rollup:
    """Sums per order and per product, and the columns that tell orders and products (and their attributes) apart."""

    orders: DataFrame
    products: DataFrame
    order_keys: tuple[str, ...]
    product_keys: tuple[str, ...]

    def stored(self) -> Rollup:
        """Both tables written once, to be read by every section."""
        return replace(self, orders=materialise(self.orders), products=materialise(self.products))

    def merged(self, other: Rollup) -> Rollup:
        """The rollup of the lines of both."""
        return replace(self, orders=_added(self.orders.unionByName(other.orders), self.order_keys), products=_added(self.products.unionByName(other.products), self.product_keys))

    def save(self, path: str, part: str) -> None:
        """Add this rollup to the stored one as the lines of *part* (a day, a batch); a repeated part is replaced, no other is read or written."""
        for name, df in (("orders", self.orders), ("products", self.products)):
            df.withColumn(PART, F.lit(part)).write.partitionBy(PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")


def of_lines(lines: DataFrame, roles: Roles, order_attributes: tuple[str, ...] = (), product_attributes: tuple[str, ...] = ()) -> Rollup:
    """The rollup of a joined table of lines; an attribute has one value for each order (or product)."""
    orders, products = (roles.order, roles.customer, roles.time, *order_attributes), (roles.product, *product_attributes)
    return Rollup(order_sums(lines, roles, list(orders)), product_sums(lines, roles, list(products)), orders, products)


def load(spark: SparkSession, path: str, order_keys: tuple[str, ...], product_keys: tuple[str, ...]) -> Rollup:
    """The stored parts as one rollup."""
    orders, products = (spark.read.parquet(f"{path}/{name}").drop(PART) for name in ("orders", "products"))
    return Rollup(_added(orders, order_keys), _added(products, product_keys), order_keys, product_keys)


def _added(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of equal keys made one: sums are added, the least and the most are kept."""
    return df.groupBy(*keys).agg(*[merged_check(c) if c in CHECKS else F.sum(c).alias(c) for c in df.columns if c not in keys])
