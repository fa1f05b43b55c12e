"""From flat rows to the star tables.

"First" means first in row order, carried by the ``row_id`` column. Aggregates have a
map-side combine, so a customer with a third of all rows leaves each input partition
as one row; nothing is gathered per key.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.operators.numbering import number_rows
from tillmart.plans.star import Star
from tillmart.schemas import LOCATION_KEY

ORDER_COLUMNS = ("order_date", "ship_date", "ship_mode", "customer_id")


def _all(candidates: DataFrame) -> DataFrame:
    return candidates


def first_rows(flat: DataFrame, key: str, *columns: str, among: Callable[[DataFrame], DataFrame] = _all) -> DataFrame:
    """The first row of each key, of those keys that ``among`` leaves.

    Where ``row_id`` is a number, which is the same whenever the rows are read, only the number of
    each key's first row is aggregated (by hash, as it has a fixed width), and the values are fetched
    for the numbers that are left. A composite ``row_id`` may not be stable; its rows are read once.
    """
    if not isinstance(flat.schema["row_id"].dataType, T.LongType):
        first = F.min_by(F.struct(*columns), "row_id").alias("first")
        return among(flat.groupBy(key).agg(first)).select(key, "first.*")
    numbers = among(flat.groupBy(key).agg(F.min("row_id").alias("row_id")))
    wanted = numbers.select(F.col(key).alias("_key"), F.col("row_id").alias("_row"))
    rows = flat.select(key, "row_id", *columns)
    return rows.join(wanted, (rows["row_id"] == wanted["_row"]) & rows[key].eqNullSafe(wanted["_key"])).select(key, *columns)


def customers(flat: DataFrame, among: Callable[[DataFrame], DataFrame] = _all) -> DataFrame:
    return first_rows(flat, "customer_id", "customer_name", "segment", among=among)


def products(flat: DataFrame, among: Callable[[DataFrame], DataFrame] = _all) -> DataFrame:
    return first_rows(flat, "product_id", "product_name", "category", "sub_category", among=among)


def location_tuples(flat: DataFrame) -> DataFrame:
    """Distinct places with the row they first appear in; nulls compare equal."""
    return flat.groupBy(*LOCATION_KEY).agg(F.min("row_id").alias("first_row"))


def locations(flat: DataFrame, start: int = 1) -> DataFrame:
    """Distinct places numbered by first appearance."""
    numbered = number_rows(location_tuples(flat), "first_row", name="location_id", start=start)
    return numbered.select("location_id", *LOCATION_KEY)


def same_place(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality of the place columns; still a hashable join key."""
    matches = [left[name].eqNullSafe(right[name]) for name in LOCATION_KEY]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return condition


def attach_location(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Add location_id by place; rows of an unknown place keep null."""
    known = places.select("location_id", *LOCATION_KEY)
    return rows.join(known, same_place(rows, known), "left").select(*[rows[name] for name in rows.columns], known["location_id"])


def first_value(name: str) -> Column:
    """First non-null value in row order."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("row_id"))).alias(name)


def order_heads(flat: DataFrame, *more: Column) -> DataFrame:
    """One row per non-null order id: first non-null value of each column, summed shipping cost, and ``more``."""
    columns = [first_value(name) for name in (*ORDER_COLUMNS, "order_priority")]
    shipping = F.sum("shipping_cost").alias("shipping_cost")
    return flat.where("order_id is not null").groupBy("order_id").agg(*columns, shipping, *more)


def orders(flat: DataFrame, places: DataFrame) -> DataFrame:
    """Orders of a bulk file. The place is that of the order's first row.

    A place is looked up once per order, not once per row, after the rows are grouped.
    """
    place = F.min_by(F.struct(*LOCATION_KEY), "row_id").alias("place")
    heads = order_heads(flat, place).select("*", "place.*").drop("place")
    return attach_location(heads, places).select(
        "order_id", *ORDER_COLUMNS, "location_id", "shipping_cost", "order_priority"
    )


def order_items(flat: DataFrame, start: int = 1) -> DataFrame:
    """All rows, those without an order id too. ``row_id`` counts from 1 without gaps."""
    return flat.select(
        (F.col("row_id") + (start - 1)).alias("order_item_id"),
        "order_id",
        "product_id",
        "sales",
        F.col("quantity").cast("bigint").alias("quantity"),
        "discount",
        "profit",
    )


def normalise(flat: DataFrame) -> Star:
    """The star of a cleaned flat file. Each table reads only its columns of the staged rows."""
    places = locations(flat)
    return Star(
        customers=customers(flat),
        products=products(flat),
        locations=places,
        orders=orders(flat, places),
        order_items=order_items(flat),
    )
