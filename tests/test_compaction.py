"""Merging commits into one generation."""

import os

import pytest

from tests.test_store import AS_OF, BAD, GOOD, REORDERED, content, store, write  # noqa: F401
from tillmart.operators import batch_log
from tillmart.operators.intake import bulk_load, ingest_file
from tillmart.sources import store as store_module
from tillmart.sources.store import COMMIT

MORE = "Order ID,customer id,product id,sales,quantity\nO8,C1,P9,5,1\nO9,C7,P1,6,2\n"


def folders(store, table):  # noqa: F811
    path = f"{store.path}/{table}"
    return sorted(name for name in os.listdir(path) if name.startswith(COMMIT)) if os.path.isdir(path) else []


def state(store):  # noqa: F811
    log = batch_log.history(store.log(), 50).drop(COMMIT).collect()
    return content(store), [tuple(row) for row in log]


@pytest.fixture
def filled(store, tmp_path):  # noqa: F811
    for name, text in (("good.csv", GOOD), ("reordered.csv", REORDERED), ("bad.csv", BAD)):
        ingest_file(store, write(tmp_path, name, text), AS_OF, batch_key=name)
    return store


def test_compaction(filled, tmp_path):
    before = state(filled)
    key = filled.compact()
    assert state(filled) == before and folders(filled, "orders") == folders(filled, "ingestion_log") == [f"{COMMIT}={key}"]
    assert filled.compact() is None and ingest_file(filled, str(tmp_path / "good.csv"), AS_OF, batch_key="good.csv") is None
    later = ingest_file(filled, write(tmp_path, "more.csv", MORE), AS_OF, on_review="merge", batch_key="more.csv")
    assert later.action == "merge" and filled.log().count() == 4 and filled.log().agg({"batch_id": "max"}).first()[0] == 4
    before = state(filled)
    second = filled.compact()
    assert second != key and state(filled) == before
    for table in ("orders", "order_items", "customers", "ingestion_log", "generations"):
        assert folders(filled, table) == [f"{COMMIT}={second}"]


def test_a_failure_at_any_step_leaves_the_store_readable(filled, monkeypatch):
    before = state(filled)
    write_rows, remove = type(filled)._append, store_module.remove_path
    for step in range(7):
        calls = iter(range(100))

        def failing(*args, **kwargs):
            if next(calls) == step:
                raise OSError("no space")
            return write_rows(*args, **kwargs)

        monkeypatch.setattr(type(filled), "_append", failing)
        with pytest.raises(OSError):
            filled.compact()
        assert state(filled) == before
    monkeypatch.setattr(type(filled), "_append", write_rows)
    def stuck(spark, path):
        if "/ingestion_log/" in path and "compacted" not in path:
            raise OSError("gone")  # after the generation's own row
        remove(spark, path)

    monkeypatch.setattr(store_module, "remove_path", stuck)
    with pytest.raises(OSError):
        filled.compact()
    assert state(filled) == before and len(folders(filled, "ingestion_log")) > 1
    monkeypatch.setattr(store_module, "remove_path", remove)
    assert state(filled) == before
    filled.compact()
    assert state(filled) == before and len(folders(filled, "orders")) == len(folders(filled, "ingestion_log")) == 1


def test_a_bulk_load_replaces_a_generation(filled, tmp_path):
    filled.compact()
    bulk = "Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,Product ID,Product Name,Category,Sub-Category,Country,Market,Region,State,City,Postal Code,Sales,Quantity,Discount,Profit,Shipping Cost,Order Priority\n"
    bulk += "B1,2014-01-01,2014-01-02,Air,C1,Ann,Consumer,P1,Pen,Office,Pens,IT,EU,South,Lazio,Rome,1,10,1,0,2,1,High\n"
    bulk_load(filled, write(tmp_path, "bulk.csv", bulk), AS_OF)
    assert [row.order_id for row in filled.table("orders").collect()] == ["B1"]
    before = state(filled)
    filled.compact()
    assert state(filled) == before and [row.order_id for row in filled.table("orders").collect()] == ["B1"]
