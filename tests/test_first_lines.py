"""First lines of the flat file, reduced before names are joined."""

import datetime as dt
import re

import pytest

from tests.conftest import SF_DIR
from tests.test_travel import no_broadcast, plan_of  # noqa: F401
from tillmart import registry
from tillmart.operators import merge, normalise
from tillmart.sources import sample_tables, sample_uploads

TABLES = {
    "region": [(0, "ASIA")],
    "nation": [(0, "INDIA", 0), (1, "NOWHERE", 7)],  # the second has no region, so no place
    "customer": [
        (1, "Ann", 0, 0.0, "HOME"), (2, "Bob", 0, 0.0, None), (3, "Cid", 1, 0.0, "HOME"), (4, None, None, 0.0, "HOME"),
        (5, "Eve", 0, 0.0, "HOME"), (5, "Eve", 0, 0.0, "HOME"), (None, "None", 0, 0.0, "HOME"), (10, "Ten", 0, 0.0, "HOME"),
    ],
    "part": [(1, "nut"), (2, "bolt"), (2, "bolt"), (3, None), (4, "never sold"), (5, "lost order only"), (None, "null"), (10, "ten")],
    "orders": [(1, 1), (2, 2), (2, 2), (3, 3), (4, 4), (5, 5), (6, 9), (7, None), (None, 1), (8, 1), (9, 10), (11, 2), (11, 5)],
    "lineitem": [
        (8, 1), (1, 1), (1, 1), (1, 2), (2, 3), (2, None), (None, 1), (3, 1), (3, 5), (4, 5), (5, 99), (6, 5), (7, 5), (77, 5), (9, 10), (11, 10),
    ],
}


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Keys that repeat, are null or lack a partner."""
    folder = str(tmp_path_factory.mktemp("odd"))
    day = dt.datetime(2020, 1, 1)
    rows = TABLES | {
        "part": [(key, name, "brand", "type", 1, 10.0) for key, name in TABLES["part"]],
        "orders": [(key, customer, "O", 1.0, day, "LOW") for key, customer in TABLES["orders"]],
        "lineitem": [(order, part, 1, n, 1.0, 9.0, 0.0, 0.0, "N", "O", day) for n, (order, part) in enumerate(TABLES["lineitem"])],
    }
    for name, entries in rows.items():
        spark.createDataFrame(entries, sample_tables.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def flat_rows(spark, folder):
    return sample_uploads.in_line_order(sample_uploads.flat_lines(spark, folder))


def held(rows):
    return sorted(map(tuple, rows.collect()), key=str)


def shuffled_lines(plan: str) -> list[str]:
    """What lies below each exchange over a scan of the lines."""
    rows = plan.splitlines()
    depth = [len(re.match(r"[\s:|+\-]*", row).group()) for row in rows]
    found = []
    for n, row in enumerate(rows):
        if "Exchange hashpartitioning" in row:
            below = [m for m in range(n + 1, len(rows)) if all(d > depth[n] for d in depth[n + 1:m + 1])]
            if any("lineitem" in rows[m] for m in below):
                found.append("\n".join(rows[m] for m in below))
    return found


def test_with_partner_is_a_semi_join(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "k bigint, v string")
    partners = spark.createDataFrame([(1,), (1,), (None,), (3,), (4,)], "k bigint")
    expected = held(rows.join(partners, "k", "left_semi"))
    assert held(sample_uploads.with_partner(rows, "k", partners)) == expected
    assert held(sample_uploads.with_partner(rows, "k", partners.limit(0))) == []
    monkeypatch.setattr(sample_uploads, "BROADCAST_MISSING", 0)
    assert held(sample_uploads.with_partner(rows, "k", partners)) == expected


def test_dim_products_shuffles_no_line_unreduced(spark, no_broadcast):  # noqa: F811
    """only rows that are already summed up per key leave a task that reads lines."""
    for name in ("dim_products", "merge_products"):
        shuffled = shuffled_lines(plan_of(registry.QUERIES[name](spark, SF_DIR)))
        assert shuffled and all("Aggregate" in below for below in shuffled), shuffled


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_products_of_the_whole_flat_file(spark, odd_folder, monkeypatch, limit):
    monkeypatch.setattr(sample_uploads, "BROADCAST_MISSING", limit)
    rows = flat_rows(spark, odd_folder)
    found = registry.QUERIES["dim_products"](spark, odd_folder)
    assert held(found) == held(normalise.products(rows)) and [row.product_id for row in found.orderBy("product_id").collect()] == ["1", "10", "2", "3"]
    stored = registry._stored(sample_tables.products(spark, odd_folder), "product_id")
    assert held(registry.QUERIES["merge_products"](spark, odd_folder)) == held(merge.new_products(rows, stored))


def test_first_line_of_a_product(spark, odd_folder):
    rows = sample_uploads.first_product_lines(spark, odd_folder).select("product_id", "row_id.l_orderkey").distinct()
    assert held(rows) == [("1", 1), ("10", 9), ("2", 1), ("3", 2)]


def test_dim_customers_shuffles_no_line_unreduced(spark, no_broadcast):  # noqa: F811
    """as for products; names are joined on one row per customer, not per order."""
    for name in ("dim_customers", "merge_customers"):
        shuffled = shuffled_lines(plan_of(registry.QUERIES[name](spark, SF_DIR)))
        assert shuffled and all("Aggregate" in below for below in shuffled), shuffled


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_customers_of_the_whole_flat_file(spark, odd_folder, monkeypatch, limit):
    monkeypatch.setattr(sample_uploads, "BROADCAST_MISSING", limit)
    rows = flat_rows(spark, odd_folder)
    found = registry.QUERIES["dim_customers"](spark, odd_folder)
    assert held(found) == held(normalise.customers(rows)) and [row.customer_id for row in found.orderBy("customer_id").collect()] == ["1", "10", "2", "5"]
    stored = registry._stored(sample_tables.customers(spark, odd_folder), "customer_id")
    assert held(registry.QUERIES["merge_customers"](spark, odd_folder)) == held(merge.new_customers(rows, stored))


def test_first_line_of_a_customer(spark, odd_folder):
    rows = sample_uploads.first_customer_lines(spark, odd_folder).select("customer_id", "row_id.l_orderkey").distinct()
    assert held(rows) == [("1", 1), ("10", 9), ("2", 2), ("5", 11)]
