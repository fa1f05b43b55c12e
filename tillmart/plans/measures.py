"""Report measures evaluated over the tables as related in the BI model.

Unlike the overview, a measure keeps facts without a matching dimension row; sliced by
that dimension they fall in the null (blank) member. Orders count even without items.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.functions.dates import month_label
from tillmart.functions.numbers import ratio
from tillmart.plans.star import EVERYTHING, Slice, Star, order_totals, total


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def order_facts(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """One row per order or per orphaned order id, with item sums and ``is_order``."""
    orders = scope.orders(star.orders).select("order_id", "order_date", "customer_id", "location_id").withColumn("is_order", F.lit(1))
    facts = order_totals(star).join(orders, "order_id", "right" if scope.year is not None else "full")
    if scope.market is not None:
        facts = facts.join(scope.locations(star.locations).select("location_id"), "location_id", "left_semi")
    if scope.segment is not None:
        facts = facts.join(scope.customers(star.customers).select("customer_id"), "customer_id", "left_semi")
    return facts


def _measures(sums: DataFrame) -> DataFrame:
    return sums.select(
        "*",
        _or_zero(ratio(F.col("total_profit"), F.col("total_sales"))).alias("profit_margin"),
        _or_zero(ratio(F.col("total_sales"), F.col("order_count"))).alias("average_order_value"),
    )


# What a measure can be sliced by, and the table that holds it.
_SLICERS = {"market": "locations", "customer_name": "customers", "segment": "customers", "year_month": None}


def measures(star: Star, by: str | None = None, scope: Slice = EVERYTHING) -> DataFrame:
    """Total sales, total profit, order count, margin (a fraction) and average order value.

    ``by`` is market, customer_name, segment or year_month. Facts are summed per key
    before the dimension join, which then sees each key once.
    """
    facts = order_facts(star, scope)
    sums = [F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit"), F.count("is_order").alias("order_count")]
    if by is None:
        return _measures(facts.agg(*sums))
    table = _SLICERS[by]
    if table is None:
        return _measures(facts.groupBy(month_label(F.col("order_date")).alias(by)).agg(*sums)).orderBy(by)
    key = "location_id" if table == "locations" else "customer_id"
    per_key = facts.groupBy(key).agg(*total("sales", "profit"), F.count("is_order").alias("orders"))
    named = per_key.join(getattr(star, table).select(key, by), key, "left")
    grouped = named.groupBy(by).agg(
        F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit"), F.sum("orders").alias("order_count")
    )
    return _measures(grouped).orderBy(F.desc("total_sales"), by)


def scoped_orders(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Ids of the orders that pass the filters."""
    orders = scope.orders(star.orders)
    if scope.market is not None:
        orders = orders.join(scope.locations(star.locations).select("location_id"), "location_id", "left_semi")
    if scope.segment is not None:
        orders = orders.join(scope.customers(star.customers).select("customer_id"), "customer_id", "left_semi")
    return orders.select("order_id")


def measures_by_category(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Measures per product category. An item filter also restricts the orders counted.

    Distinct (category, order) pairs are counted, so a large category spreads over all
    tasks, and a large order is one row per category and input partition. With a filter, items
    are reduced to those of the orders that pass before anything is summed.
    """
    orders = scoped_orders(star, scope)
    items = star.order_items if scope == EVERYTHING else star.order_items.join(orders, "order_id", "left_semi")
    named = items.join(star.products.select("product_id", "category"), "product_id", "left")
    pairs = named.groupBy("category", "order_id").agg(*total("sales", "profit"))
    known = orders.select("order_id", F.lit(1).alias("is_order"))
    sums = pairs.join(known, "order_id", "left").groupBy("category").agg(
        F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit"), F.count("is_order").alias("order_count")
    )
    return _measures(sums).orderBy(F.desc("total_sales"), "category")


def orders_by_category(star: Star) -> DataFrame:
    """Orders with at least one item of the category."""
    return measures_by_category(star).select("category", "order_count")


def previous_month(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Sales per calendar month beside those one calendar month earlier; null after a gap month."""
    months = (
        order_facts(star, scope)
        .where("order_date is not null")
        .groupBy(F.trunc("order_date", "month").alias("month_start"))
        .agg(F.sum("sales").alias("total_sales"))
    )
    shifted = months.select(
        F.add_months("month_start", 1).alias("month_start"), F.col("total_sales").alias("prev_month_sales")
    )
    return (
        months.join(shifted, "month_start", "left")
        .select(month_label(F.col("month_start")).alias("month"), "total_sales", "prev_month_sales")
        .orderBy("month")
    )


def month_growth(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Growth on the calendar month before as a fraction; 0 when that month has no sales."""
    change = F.col("total_sales") - F.coalesce("prev_month_sales", F.lit(0))
    rate = F.when(F.col("prev_month_sales").isNull(), 0.0).otherwise(_or_zero(ratio(change, F.col("prev_month_sales"))))
    return previous_month(star, scope).withColumn("growth", rate)
