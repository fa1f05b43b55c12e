"""Ranked customers, products and categories over all sales.

Items are summed per order or per product before they meet a dimension, so the joins
see one row per key and a popular product cannot overload a task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.functions.numbers import percent, round2
from tillmart.plans.star import Star, sold_orders, total


def customer_totals(star: Star) -> DataFrame:
    sums = sold_orders(star).groupBy("customer_id").agg(*total("sales", "profit"), F.count(F.lit(1)).alias("total_orders"))
    return sums.join(star.customers, "customer_id")


def item_totals(star: Star) -> DataFrame:
    sums = star.order_items.groupBy("product_id").agg(*total("sales", "profit", "quantity"))
    return sums.join(star.products, "product_id")


def top_customers(star: Star, limit: int = 10) -> DataFrame:
    """Best customers by id: orders, sales, profit and margin."""
    rows = customer_totals(star).select(
        "customer_id",
        "customer_name",
        "segment",
        "total_orders",
        round2(F.col("sales")).alias("total_sales"),
        round2(F.col("profit")).alias("total_profit"),
        percent(F.col("profit"), F.col("sales")).alias("profit_margin_pct"),
    )
    return rows.orderBy(F.desc("total_sales"), "customer_id").limit(limit)


def top_products(star: Star, limit: int = 10) -> DataFrame:
    """Most sold products by id."""
    rows = item_totals(star).select(
        "product_id",
        "product_name",
        "category",
        "sub_category",
        F.col("quantity").alias("total_quantity_sold"),
        round2(F.col("sales")).alias("total_sales"),
        round2(F.col("profit")).alias("total_profit"),
    )
    return rows.orderBy(F.desc("total_quantity_sold"), "product_id").limit(limit)


def category_rank(star: Star) -> DataFrame:
    """Sub-categories ranked within their category; the window runs on the grouped rows."""
    sums = item_totals(star).groupBy("category", "sub_category").agg(*total("sales", "profit"))
    best_first = Window.partitionBy("category").orderBy(F.desc("sales"))
    return sums.select(
        "category",
        "sub_category",
        round2(F.col("sales")).alias("total_sales"),
        round2(F.col("profit")).alias("total_profit"),
        F.dense_rank().over(best_first).alias("rank_within_category"),
    ).orderBy("category", F.desc("total_sales"), "sub_category")


def top_customers_with_orders(star: Star, limit: int = 3) -> DataFrame:
    """Best customer names with their order counts."""
    sums = customer_totals(star).groupBy("customer_name").agg(
        F.sum("total_orders").alias("orders_placed"), F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit")
    )
    return sums.orderBy(F.desc("total_sales"), "customer_name").limit(limit)
