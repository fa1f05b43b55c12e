"""The star schema, and messy uploads, derived from the order-entry test tables."""

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart.plans.star import Star


# Declared so that opening a table starts no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Exact amounts from doubles that hold two decimals. Whole hundredths are multiplied and then
# scaled: several times faster than casting doubles to decimals, which goes through text.
_PRICE = "CAST(rint(l_extendedprice * 100) AS BIGINT)"
_RATE = "CAST(rint(l_discount * 100) AS BIGINT)"
_TAX = "CAST(rint(l_tax * 100) AS BIGINT)"
_COST = "CAST(l_quantity AS INT) * CAST(rint(p_retailprice * 100) AS BIGINT) * 100"


def _amount(ten_thousandths: str) -> str:
    return f"CAST(CAST({ten_thousandths} AS DECIMAL(18,0)) * 0.0001BD AS DECIMAL(18,4))"


# The columns of a sale line, from a line item and the price of its part.
SALE_COLUMNS = {
    **{name: name for name in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity",
                               "l_extendedprice", "l_tax")},
    "l_shipdate": "CAST(l_shipdate AS DATE)",
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "sales": _amount(f"{_PRICE} * (100 - {_RATE})"),
    "quantity": "CAST(l_quantity AS INT)",
    "discount": _amount(f"{_RATE} * 100"),
    "profit": _amount(f"{_PRICE} * (100 - {_RATE}) - {_COST}"),
    "shipping_cost": _amount(f"{_PRICE} * {_TAX}"),
}


def prices(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """At most one price row per part: a left join with it is dropped from the plan when profit is not used."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias(key)).agg(F.max("p_retailprice").alias("p_retailprice"))


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with exact sales, shipping cost and profit."""
    return table(spark, sf_dir, "lineitem").join(prices(spark, sf_dir, "l_partkey"), "l_partkey", "left").selectExpr(
        *[f"{expression} AS {name}" for name, expression in SALE_COLUMNS.items()]
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "CAST(n_nationkey AS BIGINT) AS location_id", "n_name AS country", "r_name AS market", "r_name AS region",
        "'Unknown' AS state", "'Unknown' AS city", "'N/A' AS postal_code",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id", "c_name AS customer_name", "c_mktsegment AS segment"
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "p_name AS product_name", "p_type AS category", "p_brand AS sub_category"
    )


def homes(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """At most one nation per customer."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias(key)).agg(F.max("c_nationkey").alias("c_nationkey"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's nation as location.

    Both joins are left joins on a grouped, hence unique, key: Catalyst drops a join
    from any query that does not use its columns.
    """
    heads = table(spark, sf_dir, "orders")
    shipped = sale_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship_date"), F.sum("shipping_cost").alias("shipping_cost")
    )
    return heads.join(homes(spark, sf_dir, "o_custkey"), "o_custkey", "left").join(shipped, "o_orderkey", "left").selectExpr(
        "o_orderkey AS order_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        "coalesce(first_ship_date, CAST(o_orderdate AS DATE)) AS ship_date",
        "'Standard Class' AS ship_mode",
        "o_custkey AS customer_id",
        "CAST(c_nationkey AS BIGINT) AS location_id",
        "coalesce(shipping_cost, 0BD) AS shipping_cost",
        "o_orderpriority AS order_priority",
    )


@functools.lru_cache(maxsize=8)
def star(spark: SparkSession, sf_dir: str) -> Star:
    """The five tables. Only the logical plans are kept for the next caller, no data."""
    items = sale_lines(spark, sf_dir).select("order_id", "product_id", "sales", "quantity", "discount", "profit")
    return Star(
        customers=customers(spark, sf_dir),
        products=products(spark, sf_dir),
        locations=locations(spark, sf_dir),
        orders=orders(spark, sf_dir),
        order_items=items,
    )
