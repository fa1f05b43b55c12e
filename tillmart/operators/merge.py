"""Insert-only merge of cleaned rows into the stored star.

``plan_merge`` only describes the new rows; the store appends them. Rows carry
``row_id``, dense over the merged rows; the earliest row of a key wins, and a stored
row wins over any new one.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.operators import normalise
from tillmart.operators.numbering import number_rows
from tillmart.operators.staging import stage
from tillmart.plans.star import Star
from tillmart.schemas import LOCATION_KEY

FALLBACK_LOCATION = 1

# A batch has at most as many keys as rows; up to this many rows its keys are broadcast. So are new keys up to this many.
BROADCAST_ROWS = 1_000_000

# Up to this many new places are numbered by one task.
WINDOW_ROWS = 100_000


def _keys_of(candidates: DataFrame, batch_rows: int | None, *key: str) -> DataFrame:
    """The batch's keys, broadcast when the batch is known to be small."""
    keys = candidates.select(*key)
    return F.broadcast(keys) if batch_rows is not None and batch_rows <= BROADCAST_ROWS else keys


def not_stored(candidates: DataFrame, stored: DataFrame, key: str, batch_rows: int | None = None) -> DataFrame:
    """Candidates whose key is not stored yet.

    The stored keys are first reduced to those in the batch. For a small batch that only
    scans the stored key column; an anti join alone would shuffle every stored key. For a
    large or unknown one Spark picks the join.
    """
    hits = stored.select(key).join(_keys_of(candidates, batch_rows, key), key, "left_semi")
    return candidates.join(hits, key, "left_anti")


def _new_firsts(firsts: DataFrame, stored: DataFrame, key: str, batch_rows: int | None) -> DataFrame:
    """The first rows of keys not stored yet.

    Where the batch may be large, their numbers are staged and counted: while they are few they are sent
    to the batch, and its rows are not shuffled to fetch the values.
    """
    new = not_stored(firsts, stored, key, batch_rows)
    if "row_id" not in new.columns or (batch_rows is not None and batch_rows <= BROADCAST_ROWS):
        return new
    new = stage(new, "first-rows")
    return F.broadcast(new) if new.count() <= BROADCAST_ROWS else new


def highest(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def new_customers(batch: DataFrame, stored: DataFrame, batch_rows: int | None = None) -> DataFrame:
    return normalise.customers(batch, lambda keys: _new_firsts(keys, stored, "customer_id", batch_rows))


def new_products(batch: DataFrame, stored: DataFrame, batch_rows: int | None = None) -> DataFrame:
    return normalise.products(batch, lambda keys: _new_firsts(keys, stored, "product_id", batch_rows))


def place_ids(batch: DataFrame, stored: DataFrame, batch_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new locations, id of every place in the batch). Plain equality: a place with a null is always new.

    The batch's places are staged, as both results use them. New places are numbered by a
    plain window while there are few, and without one beyond that.
    """
    tuples = normalise.location_tuples(batch)
    keys = list(LOCATION_KEY)
    known = stored.join(_keys_of(tuples, batch_rows, *keys), keys).groupBy(*keys).agg(F.min("location_id").alias("location_id"))
    places = stage(tuples.join(known, keys, "left"), "places")
    fresh = places.where("location_id is null").drop("location_id")
    start = highest(stored, "location_id") + 1
    if fresh.count() <= WINDOW_ROWS:
        number = F.row_number().over(Window.orderBy("first_row")) + F.lit(start - 1)
        numbered = fresh.withColumn("location_id", number.cast("bigint"))
    else:
        numbered = number_rows(fresh, "first_row", name="location_id", start=start)
    new = numbered.select("location_id", *keys)
    return new, places.where("location_id is not null").select("location_id", *keys).unionByName(new)


def new_locations(batch: DataFrame, stored: DataFrame) -> DataFrame:
    return place_ids(batch, stored)[0]


def new_orders(batch: DataFrame, ids: DataFrame, stored: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Orders not stored yet. A place mixed from different rows may be unknown and falls back to id 1."""
    heads = normalise.order_heads(batch, *[normalise.first_value(name) for name in LOCATION_KEY])
    located = normalise.attach_location(not_stored(heads, stored, "order_id", batch_rows), ids)
    return located.select(
        "order_id",
        *normalise.ORDER_COLUMNS,
        F.coalesce("location_id", F.lit(FALLBACK_LOCATION)).cast("bigint").alias("location_id"),
        "shipping_cost",
        "order_priority",
    )


def new_order_items(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Every row, numbered after the highest stored id, quantity cut to a whole number."""
    return normalise.order_items(batch, start=highest(stored, "order_item_id") + 1)


def plan_merge(batch: DataFrame, stored: Star, batch_rows: int | None = None) -> Star:
    """The rows to append to each table. ``batch_rows``, where known, allows broadcasting the keys of a small batch."""
    locations, ids = place_ids(batch, stored.locations, batch_rows)
    return Star(
        customers=new_customers(batch, stored.customers, batch_rows),
        products=new_products(batch, stored.products, batch_rows),
        locations=locations,
        orders=new_orders(batch, ids, stored.orders, batch_rows),
        order_items=new_order_items(batch, stored.order_items),
    )
