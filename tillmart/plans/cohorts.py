"""Quarterly retention of customers by the quarter of their first order.

One shuffle of the orders: each customer's quarters are gathered as a set, which holds
at most one entry per quarter however many orders the customer has. The first quarter
is the cohort, and every entry is one active customer, so no self join and no distinct
count is needed. A cohort's size is its activity in its own first quarter.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.functions.dates import quarter_index, quarter_label
from tillmart.functions.numbers import percent, ratio
from tillmart.plans.star import EVERYTHING, Slice, Star

ELAPSED_QUARTERS = 12


def active_quarters(star: Star, scope: Slice | None = None) -> DataFrame:
    """customer_id, quarters: the quarters with an order in scope, ascending.

    Without a scope the orders stand alone; with one, customer and location must exist
    and the filters also decide which order counts as the first.
    """
    orders = star.orders
    if scope is not None:
        locations = scope.locations(star.locations).select("location_id")
        orders = scope.orders(orders).join(locations, "location_id", "left_semi")
    seen = orders.groupBy("customer_id").agg(F.collect_set(quarter_index(F.col("order_date"))).alias("quarters"))
    if scope is not None:
        seen = seen.join(scope.customers(star.customers).select("customer_id"), "customer_id", "left_semi")
    return seen.withColumn("quarters", F.array_sort("quarters"))


def customer_cohorts(star: Star, scope: Slice | None = None) -> DataFrame:
    seen = active_quarters(star, scope)
    return seen.select("customer_id", quarter_label(F.get("quarters", F.lit(0))).alias("cohort_quarter"))


def cohort_sizes(star: Star, scope: Slice | None = None) -> DataFrame:
    return customer_cohorts(star, scope).groupBy("cohort_quarter").agg(F.count(F.lit(1)).alias("cohort_size"))


def retention(star: Star, scope: Slice | None = None) -> DataFrame:
    """Active customers per cohort and elapsed quarter, as a share of the cohort."""
    steps = active_quarters(star, scope).select(
        F.get("quarters", F.lit(0)).alias("first_quarter"), F.explode("quarters").alias("quarter")
    )
    elapsed = F.col("quarter") - F.col("first_quarter")
    active = (
        steps.withColumn("elapsed_quarters", elapsed)
        .where(F.col("elapsed_quarters") < ELAPSED_QUARTERS)
        .groupBy("first_quarter", "elapsed_quarters")
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    size = F.max(F.when(F.col("elapsed_quarters") == 0, F.col("active_customers"))).over(Window.partitionBy("first_quarter"))
    return (
        active.withColumn("cohort_size", size)
        .select(
            quarter_label(F.col("first_quarter")).alias("cohort_quarter"),
            "cohort_size",
            "elapsed_quarters",
            "active_customers",
            percent(F.col("active_customers"), F.col("cohort_size")).alias("retention_pct"),
        )
        .orderBy("cohort_quarter", "elapsed_quarters")
    )


def retention_matrix(star: Star, scope: Slice | None = EVERYTHING) -> DataFrame:
    """One row per cohort, one column per elapsed quarter; quarters without activity stay null."""
    wide = (
        retention(star, scope)
        .groupBy("cohort_quarter")
        .pivot("elapsed_quarters", list(range(ELAPSED_QUARTERS)))
        .agg(F.first("retention_pct"))
    )
    columns = [F.col(str(n)).alias(f"q{n}") for n in range(ELAPSED_QUARTERS)]
    return wide.select("cohort_quarter", *columns).orderBy("cohort_quarter")


def retention_summary(star: Star, scope: Slice | None = EVERYTHING) -> DataFrame:
    """Mean retention one and four quarters on, over the cohorts that have a figure, and the cohort count."""

    def mean_at(quarter: int):
        pct = F.when(F.col("elapsed_quarters") == quarter, F.col("retention_pct"))
        return F.coalesce(ratio(F.sum(pct), F.count(pct)), F.lit(0.0)).alias(f"avg_q{quarter}_retention")

    return retention(star, scope).agg(mean_at(1), mean_at(4), F.count_distinct("cohort_quarter").alias("total_cohorts"))
