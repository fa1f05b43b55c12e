import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillmart.operators.cleaning import UnknownLayout, clean_batch, clean_bulk, fill_ids, map_columns
from tillmart.schemas import CANONICAL_COLUMNS, COLUMN_ALIASES

AS_OF = dt.datetime(2020, 5, 6, 7, 8)


def test_every_alias_in_any_case_and_with_spaces():
    for canonical, aliases in COLUMN_ALIASES.items():
        for alias in aliases:
            assert map_columns([f"  {alias.upper()} "]).sources == {canonical: 0}


def test_first_alias_wins_and_the_other_is_reported():
    mapping = map_columns(["order_date", "note", "Order Date", "margin"])
    assert mapping.source_names() == {"order_date": "Order Date", "profit": "margin"}
    assert mapping.unmapped == ["order_date", "note"]


def test_of_equal_names_the_last_counts(spark):
    rows = spark.createDataFrame([("1", "2", 1)], "a string, b string, row_no long").toDF("Sales", "sales ", "row_no")
    assert clean_batch(rows, AS_OF).rows.first().sales == Decimal(2)


def test_absent_columns(spark):
    upload = spark.createDataFrame([("x", 1), ("", 2), (None, 3)], "buyer string, row_no long")
    batch = clean_batch(upload, AS_OF)
    assert batch.rows.columns == [*CANONICAL_COLUMNS, "row_no"]
    assert len(batch.warnings) == 5
    first, second, third = batch.rows.orderBy("row_no").collect()
    assert (first.order_id, first.customer_id, first.product_id) == ("ORD-202005060708-1", "CUST-1", "PROD-1")
    assert (first.order_date, first.ship_date) == (dt.date(2020, 5, 6), dt.date(2020, 5, 6))
    assert (first.sales, first.quantity, first.postal_code, first.ship_mode) == (0, 1, "N/A", "Standard Class")
    assert [row.customer_name for row in (first, second, third)] == ["x", "Unknown Customer", "Unknown Customer"]


def test_bad_quantity_is_zero_and_null_order_id_stays(spark):
    upload = spark.createDataFrame([(None, "n/k", 1)], "order_id string, qty string, row_no long")
    row = clean_batch(upload, AS_OF).rows.first()
    assert row.quantity == 0 and row.order_id is None


def test_all_null_column(spark):
    upload = spark.createDataFrame([(None, None, 1)], "date string, sales string, row_no long")
    row = clean_batch(upload, AS_OF).rows.first()
    assert (row.order_date, row.ship_date, row.sales) == (dt.date(2024, 1, 1), dt.date(2024, 1, 1), 0)


def test_warning_lists_five_unknown_columns(spark):
    upload = spark.createDataFrame([tuple("abcdefg") + (1,)], "u1 string, u2 string, u3 string, u4 string, u5 string, u6 string, sales string, row_no long")
    assert clean_batch(upload, AS_OF).warnings[-1].endswith("u1, u2, u3, u4, u5")


def test_scoped_ids_do_not_meet(spark):
    rows = spark.createDataFrame([("b1", None, 1), ("b2", None, 1)], "batch_key string, customer_id string, row_no long")
    ids = [row.customer_id for row in fill_ids(rows, scope=F.col("batch_key")).collect()]
    assert sorted(ids) == ["CUST-b1-1", "CUST-b2-1"]


def test_unknown_layout(spark):
    with pytest.raises(UnknownLayout):
        clean_batch(spark.createDataFrame([("a", 1)], "foo string, row_no long"), AS_OF)
    with pytest.raises(UnknownLayout):
        clean_bulk(spark.createDataFrame([("a",)], "sales string"))


def test_empty_batch(spark):
    batch = clean_batch(spark.createDataFrame([], "sales string, row_no long"), AS_OF)
    assert batch.rows.count() == 0


def test_a_repeated_header_counts_once():
    mapping = map_columns(["Order ID", "sales", "sales", "Quantity", "quantity"])
    assert mapping.sources == {"order_id": 0, "sales": 1, "quantity": 4}
    assert mapping.unmapped == ["sales"]
