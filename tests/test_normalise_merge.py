import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillmart.operators import merge, normalise
from tillmart.plans.star import Star
from tillmart.schemas import LOCATION_KEY, STAR_SCHEMAS

COLUMNS = (
    "row_id long, order_id string, order_date date, ship_date date, ship_mode string, customer_id string, customer_name string, "
    "segment string, product_id string, product_name string, category string, sub_category string, city string, state string, "
    "country string, postal_code string, market string, region string, sales decimal(18,4), quantity decimal(18,4), "
    "discount decimal(18,4), profit decimal(18,4), shipping_cost decimal(18,4), order_priority string"
)
NAMES = [part.split()[0] for part in COLUMNS.split(", ")]


AMOUNTS = ("sales", "quantity", "discount", "profit", "shipping_cost")


def typed(spark, *rows):
    """Flat rows with defaults, numbered as given. They are shuffled: the order is in row_id, not in where a row lies."""
    base = dict.fromkeys(NAMES) | dict.fromkeys(AMOUNTS, 1) | {
        "order_id": "O1", "order_date": dt.date(2014, 1, 1), "ship_date": dt.date(2014, 1, 2), "ship_mode": "S", "customer_id": "C1",
        "product_id": "P1", "city": "c", "state": "s", "country": "k", "postal_code": "p", "market": "m", "region": "r",
    }
    built = []
    for number, row in enumerate(rows, start=1):
        values = base | {"row_id": number} | row
        built.append(tuple(Decimal(str(values[name])) if name in AMOUNTS else values[name] for name in NAMES))
    return spark.createDataFrame(built, COLUMNS).repartition(4, F.rand(1))


def empty_star(spark):
    return Star(**{name: spark.createDataFrame([], schema) for name, schema in STAR_SCHEMAS.items()})


def rows_of(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_first_row_of_a_key_wins(spark):
    rows = typed(spark, {"customer_name": "late", "row_id": 5}, {"customer_name": None, "row_id": 3}, {"customer_id": None, "customer_name": "x"})
    assert rows_of(normalise.customers(rows).select("customer_id", "customer_name")) == [("C1", None), (None, "x")]


@pytest.mark.parametrize("composite", [False, True])
def test_first_rows_against_a_loop(spark, composite):
    """Ties of rows in all columns, null keys and values, a hot key; ids as numbers and as sort keys; with and without stored keys."""
    chance = random.Random(3)
    rows = [{"customer_id": chance.choice([None, "hot", "hot", *"abcdef"]), "customer_name": chance.choice([None, "x", "y"]), "segment": f"s{n % 5}"} for n in range(200)]
    want = {}
    for row in rows:
        want.setdefault(row["customer_id"], (row["customer_id"], row["customer_name"], row["segment"]))
    batch = typed(spark, *rows)
    if composite:
        batch = batch.withColumn("row_id", F.struct("row_id"))
    assert rows_of(normalise.customers(batch)) == sorted(want.values(), key=repr)
    stored = spark.createDataFrame([("hot", "kept", None), ("a", None, None), ("z", None, None)], STAR_SCHEMAS["customers"])
    left = sorted((row for key, row in want.items() if key not in ("hot", "a")), key=repr)
    for batch_rows in (None, 200):
        assert rows_of(merge.new_customers(batch, stored, batch_rows)) == left
    assert merge.new_customers(batch.where("false"), stored).count() == 0


def test_numbered_first_rows_are_not_sorted(spark):
    """Customers and products, new ones too: by hash, and the values are read for the first rows only."""
    batch, stored = typed(spark, {}), empty_star(spark)
    frames = (
        normalise.customers(batch), normalise.products(batch),
        merge.new_customers(batch, stored.customers, 1), merge.new_products(batch, stored.products, 1),
    )
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "min_by" not in plan and "HashAggregate" in plan


def test_orders_take_the_first_value_that_is_not_null(spark):
    rows = typed(
        spark,
        {"ship_mode": None, "city": "a", "shipping_cost": 2},
        {"ship_mode": "Fast", "city": "b", "order_date": dt.date(2015, 1, 1), "shipping_cost": 3.5},
        {"order_id": None},
    )
    places = normalise.locations(rows)
    (order,) = normalise.orders(rows, places).collect()
    assert (order.ship_mode, order.order_date, order.location_id, float(order.shipping_cost)) == ("Fast", dt.date(2014, 1, 1), 1, 5.5)
    assert normalise.order_items(rows).count() == 3


def test_places_are_numbered_by_first_appearance_and_nulls_are_equal(spark):
    rows = typed(spark, {"city": "b"}, {"city": None}, {"city": "a"}, {"city": None}, {"city": "b"})
    places = normalise.locations(rows)
    assert rows_of(places.select("location_id", "city")) == [(1, "b"), (2, None), (3, "a")]
    attached = normalise.attach_location(rows, places)
    assert rows_of(attached.select("row_id", "location_id")) == [(1, 1), (2, 2), (3, 3), (4, 2), (5, 1)]


@pytest.mark.parametrize("batch_rows", [None, 2])
def test_merging_dimensions_twice_adds_nothing(spark, batch_rows):
    batch = typed(spark, {}, {"customer_id": "C2", "product_id": "P2", "city": "d", "order_id": "O2"})
    first = merge.plan_merge(batch, empty_star(spark))
    stored = Star(**{name: spark.createDataFrame(rows.collect(), rows.schema) for name, rows in first.tables().items()})
    second = merge.plan_merge(batch, stored, batch_rows)
    assert [second.tables()[name].count() for name in STAR_SCHEMAS] == [0, 0, 0, 0, 2]
    assert sorted(row.order_item_id for row in second.order_items.collect()) == [3, 4]
    assert rows_of(first.orders.select("order_id", "location_id")) == [("O1", 1), ("O2", 2)]


@pytest.mark.parametrize("limit", [merge.WINDOW_ROWS, 0])
def test_stored_rows_win_and_new_places_follow_the_highest_id(spark, monkeypatch, limit):
    monkeypatch.setattr(merge, "WINDOW_ROWS", limit)
    stored = empty_star(spark).with_tables(
        customers=spark.createDataFrame([("C1", "kept", None)], STAR_SCHEMAS["customers"]),
        locations=spark.createDataFrame([(7, "k", "m", "r", "s", "c", "p"), (5, "k", "m", "r", "s", "c", "p")], STAR_SCHEMAS["locations"]),
    )
    batch = typed(spark, {"order_id": "A"}, {"order_id": "B", "city": "new"}, {"order_id": "C", "city": None})
    plan = merge.plan_merge(batch, stored)
    assert plan.customers.count() == 0
    assert rows_of(plan.locations.select("location_id", "city")) == [(8, "new"), (9, None)]
    assert rows_of(plan.orders.select("order_id", "location_id")) == [("A", 5), ("B", 8), ("C", 9)]


def test_a_place_mixed_from_two_rows_falls_back_to_one(spark):
    batch = typed(spark, {"city": None, "state": "s1"}, {"city": "c2", "state": None})
    plan = merge.plan_merge(batch, empty_star(spark))
    assert plan.locations.count() == 2
    assert [row.location_id for row in plan.orders.collect()] == [merge.FALLBACK_LOCATION]


def test_quantity_is_cut_not_rounded(spark):
    batch = typed(spark, {"quantity": 2.9}, {"quantity": -2.9})
    assert sorted(row.quantity for row in merge.plan_merge(batch, empty_star(spark)).order_items.collect()) == [-2, 2]


def test_a_customer_with_most_rows_is_combined_before_the_shuffle(spark):
    rows = typed(spark, {}).crossJoin(spark.range(0, 4000, 1, 4)).withColumn("row_id", F.col("id"))
    rows = rows.withColumn("customer_id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot"))
    plan = normalise.customers(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(" in plan and "SortAggregate" not in plan
    assert normalise.customers(rows).count() == 401
    assert set(LOCATION_KEY) <= set(rows.columns)
