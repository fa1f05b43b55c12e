"""What travels: how often the lines are shuffled, and which of their columns."""

import re

import pytest

from tests.conftest import SF_DIR
from tillmart import registry
from tillmart.operators import numbering
from tillmart.sources import sample_uploads


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_shuffled_once_per_order_and_part(spark, no_broadcast):
    """Customers and places are joined on the orders, prices on the products: no exchange of the lines by any of their keys."""
    keys = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", plan_of(sample_uploads.flat_lines(spark, SF_DIR)))
    assert keys.count("l_orderkey") == 2 and keys.count("l_partkey") == 2 and len(keys) == 12
    assert not {"order_id", "product_id"} & set(keys)


def test_first_names_carry_no_amounts(spark):
    for name in ("dim_customers", "dim_products", "merge_customers", "merge_products"):
        assert not re.search("l_extendedprice|l_tax|l_suppkey|l_shipdate", plan_of(registry.QUERIES[name](spark, SF_DIR))), name


def test_numbered_rows_keep_what_is_asked_for(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(numbering, "stage", lambda rows, name: stored.append(rows.columns) or rows.localCheckpoint())
    rows = spark.createDataFrame([(3, "c", 1), (1, "a", 2), (2, "b", 3)], "n int, text string, more int")
    assert sorted(numbering.number_rows(rows, "n", keep=["text"]).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert stored[0] == ["text", "_seq"]
    assert sorted(numbering.number_rows(rows, "n").collect()) == [(1, "a", 2, 1), (2, "b", 3, 2), (3, "c", 1, 3)]


def test_queries_store_only_their_columns(spark, monkeypatch):
    stored = []
    inner = numbering.stage
    monkeypatch.setattr(numbering, "stage", lambda rows, name: stored.append(set(rows.columns)) or inner(rows, name))
    for name in ("first_customers", "generated_ids", "fact_order_items", "merge_order_items"):
        registry.QUERIES[name](spark, SF_DIR)
    numbered = [columns for columns in stored if "_seq" in columns]
    assert len(numbered) == 5 and all("market" not in columns and "l_tax" not in columns for columns in numbered)


def test_upload_is_written_compressed(spark, tmp_path):
    """The parts of the untidy upload are as wide as text gets: they are stored as gzip, one task each, and read back whole."""
    from tillmart.sources.flat_file import read_flat_csv, write_csv

    rows = spark.createDataFrame([("1", " a ", None), ("2", 'b,"c"', "x")], "one string, two string, three string")
    write_csv(rows, f"{tmp_path}/up", "gzip")
    assert list(tmp_path.glob("up/part-*.csv.gz")) and not list(tmp_path.glob("up/part-*.csv"))
    assert sorted(map(tuple, read_flat_csv(spark, f"{tmp_path}/up").select("one", "two").collect())) == [("1", " a "), ("2", 'b,"c"')]


def test_numbered_lines_travel_as_in_the_tables(spark, monkeypatch):
    """Ids become text and amounts decimals when the numbered lines are read: neither is stored with them."""
    stored = []
    inner = numbering.stage
    monkeypatch.setattr(numbering, "stage", lambda rows, name: stored.append(set(rows.columns)) or inner(rows, name))
    for name in ("first_customers", "first_products", "generated_ids", "generated_order_ids", "fact_order_items", "merge_order_items"):
        registry.QUERIES[name](spark, SF_DIR)
    numbered = [columns for columns in stored if "_seq" in columns]
    assert len(numbered) == 7
    assert not any({"order_id", "product_id", "sales", "profit", "discount", "quantity"} & columns for columns in numbered)


def test_derived_columns_keep_their_values(spark):
    """Numbered lines hold what the flat ones do, in their order."""
    flat = sample_uploads.flat_lines(spark, SF_DIR)
    names = [name for name in flat.columns if name != "line_pos"]
    numbered = sample_uploads.numbered_lines(sample_uploads.joined_lines(spark, SF_DIR), keep=names)
    rows = numbered.orderBy("row_id").collect()
    assert numbered.schema[names.index("sales")] == flat.schema["sales"] and [row.row_id for row in rows] == list(range(1, len(rows) + 1))
    expected = flat.orderBy(*sample_uploads.LINE_ORDER).select(*names).collect()
    assert [tuple(row)[:-1] for row in rows] == [tuple(row) for row in expected]
