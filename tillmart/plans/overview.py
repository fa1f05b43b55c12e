"""The sales overview: filter lists, headline figures and chart data.

Every report keeps only sales whose order, customer and location all exist. Where the
result allows it, orders are summed per customer and location before the dimension
joins, so that a customer or a place with a large share of the orders is one row per
input partition when it is shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.functions.dates import month_label
from tillmart.functions.numbers import ratio
from tillmart.functions.text import short_label
from tillmart.plans.star import EVERYTHING, Slice, Star, in_scope, sold_orders, total


def filter_values(star: Star) -> DataFrame:
    """The choices of each filter, "All" first, then ascending."""

    def choices(name: str, values: DataFrame) -> DataFrame:
        text = values.select(F.col(values.columns[0]).cast("string").alias("value")).distinct()
        return text.where("value is not null").select(F.lit(name).alias("filter"), "value")

    found = (
        choices("year", star.orders.select(F.year("order_date")))
        .unionByName(choices("market", star.locations.select("market")))
        .unionByName(choices("segment", star.customers.select("segment")))
    )
    head = star.customers.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, ("year", "market", "segment")))).alias("filter"), F.lit("All").alias("value")
    )
    return (
        head.withColumn("is_all", F.lit(True))
        .unionByName(found.withColumn("is_all", F.lit(False)))
        .orderBy("filter", F.desc("is_all"), "value")
    )


def customer_place_totals(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Sums per customer and location of the orders in scope; order ids are unique, so orders are counted."""
    sums = sold_orders(star, scope).groupBy("customer_id", "location_id").agg(
        *total("sales", "profit", "quantity"), F.count(F.lit(1)).alias("orders")
    )
    return in_scope(sums, star, scope, "customer_name", "segment", "market")


def kpis(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Revenue, profit, orders, customers and margin; zeros when nothing is in scope."""
    row = customer_place_totals(star, scope).agg(
        F.coalesce(F.sum("sales"), F.lit(0)).alias("revenue"),
        F.coalesce(F.sum("profit"), F.lit(0)).alias("profit"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
    )
    margin = ratio(F.col("profit"), F.col("revenue")) * 100
    return row.withColumn("margin_pct", F.when(F.col("revenue") > 0, margin).otherwise(F.lit(0.0)))


def monthly_trend(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    rows = sold_orders(star, scope).withColumn("month", month_label(F.col("order_date")))
    sums = rows.groupBy("month", "customer_id", "location_id").agg(*total("sales", "profit"))
    return in_scope(sums, star, scope).groupBy("month").agg(*total("sales", "profit")).orderBy("month")


def product_totals(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Sums per product over the items in scope, with the product's columns.

    Items meet their orders unsummed, as pairs of order and product hardly repeat. Should
    one order hold a large share of the items, AQE splits its join partition: nothing
    after the join relies on its partitioning. Products are joined after summing.
    """
    orders = in_scope(scope.orders(star.orders).select("order_id", "customer_id", "location_id"), star, scope)
    items = star.order_items.join(orders.select("order_id"), "order_id")
    return items.groupBy("product_id").agg(*total("sales", "quantity")).join(star.products, "product_id")


def sales_by_category(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    return product_totals(star, scope).groupBy("category").agg(*total("sales")).orderBy(F.desc("sales"), "category")


def category_share(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Each category's percentage of all sales. The window runs on the few category rows."""
    sums = product_totals(star, scope).groupBy("category").agg(*total("sales"))
    whole = F.sum("sales").over(Window.partitionBy())
    return sums.withColumn("pct", ratio(F.col("sales"), whole) * 100)


def revenue_by_market(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    sums = customer_place_totals(star, scope).groupBy("market").agg(*total("sales", "profit"))
    return sums.orderBy(F.desc("sales"), "market")


def top_customers_by_name(star: Star, scope: Slice = EVERYTHING, limit: int = 8) -> DataFrame:
    """Best customers by name; customers of one name count together."""
    sums = customer_place_totals(star, scope).groupBy("customer_name").agg(F.sum("sales").alias("spent"))
    return sums.orderBy(F.desc("spent"), "customer_name").limit(limit)


def top_products_by_name(star: Star, scope: Slice = EVERYTHING, limit: int = 6) -> DataFrame:
    """Most sold products by name; products of one name count together."""
    sums = product_totals(star, scope).groupBy("product_name").agg(F.sum("quantity").alias("qty"))
    return sums.orderBy(F.desc("qty"), "product_name").limit(limit)


def short_labels(star: Star) -> DataFrame:
    """Axis labels of customers (20 characters) and products (18 characters)."""
    customers = star.customers.select(
        F.lit("customer").alias("kind"), F.col("customer_name").alias("name"), short_label(F.col("customer_name"), 20).alias("label")
    )
    products = star.products.select(
        F.lit("product").alias("kind"), F.col("product_name").alias("name"), short_label(F.col("product_name"), 18).alias("label")
    )
    return customers.unionByName(products).distinct()
