"""Month series. The windows have no partition keys: they run on one row per month."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.functions.dates import month_label
from tillmart.functions.numbers import percent, round2
from tillmart.plans.star import Star, sold_orders, total


def monthly_totals(star: Star) -> DataFrame:
    rows = sold_orders(star).withColumn("month", month_label(F.col("order_date")))
    return rows.groupBy("month").agg(*total("sales", "profit", "quantity"))


def monthly_running_total(star: Star) -> DataFrame:
    """Rounded sales and profit per month with the running total of the rounded sales."""
    months = monthly_totals(star).select(
        F.col("month").alias("sales_month"),
        round2(F.col("sales")).alias("monthly_sales"),
        round2(F.col("profit")).alias("monthly_profit"),
        F.col("quantity").alias("items_sold"),
    )
    so_far = F.sum("monthly_sales").over(Window.orderBy("sales_month"))
    return months.withColumn("running_total_sales", so_far).orderBy("sales_month")


def growth(star: Star) -> DataFrame:
    """Growth on the previous month that has sales, from rounded figures."""
    months = monthly_totals(star).select(
        F.col("month").alias("revenue_month"), round2(F.col("sales")).alias("current_month_sales")
    )
    before = F.lag("current_month_sales").over(Window.orderBy("revenue_month"))
    rows = months.withColumn("previous_month_sales", before)
    change = F.col("current_month_sales") - F.col("previous_month_sales")
    return rows.select(
        "*",
        change.alias("absolute_growth"),
        percent(change, F.col("previous_month_sales")).alias("growth_percentage"),
    ).orderBy("revenue_month")


def growth_unrounded(star: Star) -> DataFrame:
    """Growth on the previous month that has sales, from exact figures."""
    months = monthly_totals(star).select("month", F.col("sales").alias("total_sales"))
    rows = months.withColumn("prev_month_sales", F.lag("total_sales").over(Window.orderBy("month")))
    change = F.col("total_sales") - F.col("prev_month_sales")
    return rows.withColumn("mom_growth_pct", percent(change, F.col("prev_month_sales"))).orderBy("month")
