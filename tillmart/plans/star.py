"""The star schema and the two facts most reports start from."""

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    """Five tables: customers 1:N orders N:1 locations; orders 1:N order_items N:1 products."""

    customers: DataFrame
    products: DataFrame
    locations: DataFrame
    orders: DataFrame
    order_items: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.__dataclass_fields__}

    def with_tables(self, **tables: DataFrame) -> "Star":
        return replace(self, **tables)


@dataclass(frozen=True)
class Slice:
    """Optional filters; ``None`` means all."""

    year: int | None = None
    market: str | None = None
    segment: str | None = None

    def orders(self, orders: DataFrame) -> DataFrame:
        """Orders of the year. A date range reaches the scan, a function of the date would not."""
        if self.year is None:
            return orders
        start, end = dt.date(self.year, 1, 1), dt.date(self.year + 1, 1, 1)
        return orders.where((F.col("order_date") >= F.lit(start)) & (F.col("order_date") < F.lit(end)))

    def customers(self, customers: DataFrame) -> DataFrame:
        return customers if self.segment is None else customers.where(F.col("segment") == self.segment)

    def locations(self, locations: DataFrame) -> DataFrame:
        return locations if self.market is None else locations.where(F.col("market") == self.market)


EVERYTHING = Slice()

# Up to this many orders of a slice their ids are broadcast to the items.
BROADCAST_ORDERS = 1_000_000


def order_totals(star: Star) -> DataFrame:
    """Items summed per order.

    Summing before any join keeps an order with very many items to one row per input
    partition, and the join to orders that follows reuses the partitioning by order_id.
    """
    return star.order_items.groupBy("order_id").agg(
        F.sum("sales").alias("sales"),
        F.sum("profit").alias("profit"),
        F.sum("quantity").alias("quantity"),
    )


def sold_orders(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """One row per order that has items, with its totals; of a slice, its orders.

    The orders of a slice are counted first. While they are few, only their items are summed. Beyond
    that all items are: a join by shuffle would send the items of a very large order to one task unsummed.
    """
    orders = scope.orders(star.orders)
    if scope == EVERYTHING:
        return order_totals(star).join(orders, "order_id")
    if scope.segment is not None:
        orders = orders.join(scope.customers(star.customers).select("customer_id"), "customer_id", "left_semi")
    if scope.market is not None:
        orders = orders.join(scope.locations(star.locations).select("location_id"), "location_id", "left_semi")
    ids = orders.select("order_id")
    if ids.count() <= BROADCAST_ORDERS:
        star = star.with_tables(order_items=star.order_items.join(F.broadcast(ids), "order_id", "left_semi"))
    return order_totals(star).join(orders, "order_id")


def in_scope(rows: DataFrame, star: Star, scope: Slice = EVERYTHING, *keep: str) -> DataFrame:
    """Rows whose customer and location exist and pass the filters, with the ``keep`` columns of those tables.

    The small filtered side is left to Spark to broadcast by its measured size; above the
    threshold it is a sort-merge join whose oversized partitions AQE splits.
    """
    customers = scope.customers(star.customers)
    locations = scope.locations(star.locations)
    rows = rows.join(locations.select("location_id", *_of(locations, keep)), "location_id")
    return rows.join(customers.select("customer_id", *_of(customers, keep)), "customer_id")


def _of(table: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [name for name in names if name in table.columns]


def total(*names: str) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]
