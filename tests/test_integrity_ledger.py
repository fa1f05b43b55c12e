"""The ledger of checks and the key filters against the full check and against sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillmart.operators import integrity_ledger
from tillmart.operators.integrity import integrity_checks
from tillmart.operators.integrity_ledger import IntegrityLedger
from tillmart.plans.star import Star
from tillmart.schemas import INGESTION_LOG, STAR_SCHEMAS
from tillmart.sources.key_index import build_filters, commits_for, key_hash
from tillmart.sources.store import BULK, StarStore


@pytest.fixture
def store(spark, tmp_path):
    return StarStore(spark, str(tmp_path / "store"))


def commit(store, number, customers=(), products=(), orders=(), items=(), batch_key=None):
    """Orders are (id, customer), items (order, product, sales, quantity)."""
    day = dt.date(2015, 1, 1) + dt.timedelta(number)
    values = {
        "customers": [(key, "n", "s") for key in customers],
        "products": [(key, "n", "c", "s") for key in products],
        "locations": [],
        "orders": [(key, day, day, "Air", customer, 1, None, "High") for key, customer in orders],
        "order_items": [(n, order, product, None if sales is None else sales, quantity, None, None) for n, (order, product, sales, quantity) in enumerate(items)],
    }
    spark = store.spark
    amounts = {f.name: "string" for f in STAR_SCHEMAS["order_items"] if f.dataType.typeName() == "decimal"} | {"shipping_cost": "string"}
    frames = {}
    for name, schema in STAR_SCHEMAS.items():
        ddl = ", ".join(f"{f.name} {amounts.get(f.name, f.dataType.simpleString())}" for f in schema)
        frames[name] = spark.createDataFrame(values[name], ddl)
    log = [(number, batch_key or f"b{number}", None, "f", 1, "Accepted", 1.0, "[]", 1, 0)]
    store.commit(Star(**frames), spark.createDataFrame(log, INGESTION_LOG), f"c{number}")


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def agree(store, ledger):
    got = rows(ledger.checks())
    assert got == rows(integrity_checks(store.star()))
    return {row[0]: row[2] for row in got}


def test_late_parents_nulls_and_empty_tables(store):
    ledger = IntegrityLedger(store)
    assert agree(store, ledger)["Orphan Orders"] == 0
    commit(store, 1, orders=[("O1", "C1"), ("O2", None)], items=[("O1", "P1", "0", 1), ("O9", None, None, -1)])
    found = agree(store, ledger)  # no customer at all: a null reference counts too
    assert (found["Orphan Orders"], found["Orphan Line Items"], found["Orphan Product Refs"]) == (2, 1, 2)
    commit(store, 2, customers=["C2"], items=[("O1", "P2", "3", 1), ("O9", "P1", "3", 0), ("O9", "P1", "3", 0)])
    assert agree(store, ledger)["Orphan Line Items"] == 3
    commit(store, 3, customers=["C1"], products=["P1"], orders=[("O9", "C2"), ("O7", "C8")])
    found = agree(store, ledger)
    assert (found["Orphan Orders"], found["Orphan Line Items"], found["Orphan Product Refs"]) == (1, 0, 1)
    commit(store, 4, customers=[None])
    assert agree(store, ledger)["Orphan Orders"] == 0
    commit(store, 5)
    state = ledger.update()
    assert agree(store, ledger)["Orphan Product Refs"] == 1 and ledger.update() == state


@pytest.mark.parametrize("bits,probed", [(0.001, 50_000), (16, 0)])
def test_any_sequence_equals_the_full_check(store, monkeypatch, bits, probed):
    """Also with filters that name nearly every commit, and without them."""
    monkeypatch.setattr(integrity_ledger, "PROBED_KEYS", probed)
    chance, ledger = random.Random(bits + probed), IntegrityLedger(store, bits)

    def some(letter, count):
        return [f"{letter}{chance.randint(0, 40)}" if chance.random() < 0.9 else None for _ in range(count)]

    for number in range(1, 5):
        held = {letter: [key for key in some(letter, 8) if key] for letter in "CPO"}
        commit(
            store, number, held["C"], held["P"], list(zip(held["O"], some("C", 8))),
            [(*pair, chance.choice((None, "0", "2")), chance.randint(-1, 3)) for pair in zip(some("O", 12), some("P", 12))],
        )
        if number != 2:  # two commits in one update
            agree(store, ledger)


def test_compaction_and_bulk_loads_start_anew(store):
    ledger = IntegrityLedger(store)
    commit(store, 1, customers=["C1"], orders=[("O1", "C1"), ("O2", "C2")])
    agree(store, ledger)
    commit(store, 2, customers=["C3"], orders=[("O3", "C1"), ("O4", "C3")])
    assert agree(store, ledger)["Orphan Orders"] == 1
    store.compact()
    assert agree(store, ledger)["Orphan Orders"] == 1
    commit(store, 3, customers=["C2"], orders=[("O5", "C3")])
    assert agree(store, ledger)["Orphan Orders"] == 0
    commit(store, 4, customers=["C9"], orders=[("O6", "C1")], batch_key=f"{BULK}x")
    assert agree(store, ledger)["Orphan Orders"] == 1


def test_a_failed_update_is_repeated(store, monkeypatch):
    ledger = IntegrityLedger(store)
    commit(store, 1, customers=["C1"], orders=[("O1", "C1"), ("O2", "C2")], items=[("O1", "P1", "1", 1)])
    agree(store, ledger)
    commit(store, 2, customers=["C2"], products=["P1"], orders=[("O3", "C1"), ("O4", "C4")])
    write = IntegrityLedger._write
    for failing in ("open", "figures", "filters", "commits", "current"):

        def broken(self, frame, table, number):
            if table == failing:
                raise OSError("no space")
            write(self, frame, table, number)

        monkeypatch.setattr(IntegrityLedger, "_write", broken)
        with pytest.raises(OSError):
            ledger.update()
    monkeypatch.setattr(IntegrityLedger, "_write", write)
    assert agree(store, ledger)["Orphan Orders"] == 1


def test_an_update_reads_new_commits_and_named_ones_only(store, spark, monkeypatch):
    ledger, read = IntegrityLedger(store), []
    for number in range(1, 4):
        commit(store, number, [f"C{number}"], [f"P{number}"], [(f"O{number}", f"C{number}")], [(f"O{number}", f"P{number}", "1", 1)])
    ledger.update()
    commit(store, 4, orders=[("O4", "C2")], items=[("O4", "P3", "1", 1), ("O77", "P3", "1", 1)])
    written = StarStore.written

    def watched(self, name, keys):
        read.append((name, sorted(row.commit_key for row in keys.collect())))
        return written(self, name, keys)

    monkeypatch.setattr(StarStore, "written", watched)
    ledger.update()
    assert [keys for _, keys in read[:5]] == [["c4"]] * 5
    assert read[5:] == [("customers", ["c2"]), ("orders", []), ("products", ["c3"])]
    monkeypatch.setattr(StarStore, "written", written)
    assert agree(store, ledger)["Orphan Line Items"] == 1


def test_filters_name_every_commit_that_holds_a_key(spark):
    keys = spark.range(60_000).selectExpr("concat('part-', id % 3) AS commit_key", "1 AS `check`", "concat('k', id) AS key")
    keys = keys.unionByName(spark.createDataFrame([("tiny", 1, "k5"), ("tiny", 2, "k6"), ("tiny", 2, "")], keys.schema))
    filters = build_filters(keys).cache()
    sizes = {row.commit_key: row.blocks for row in filters.where("check = 1").collect()}
    assert sizes == {"part-0": 16, "part-1": 16, "part-2": 16, "tiny": 1}
    asked = spark.range(59_990, 61_990).selectExpr("1 AS `check`", "concat('k', id) AS key")
    asked = asked.unionByName(spark.createDataFrame([(1, "k5"), (2, "k6"), (2, ""), (2, "k7")], asked.schema))
    named = commits_for(filters, asked).join(asked.withColumn("hash", key_hash(F.col("key"))), ["check", "hash"])
    pairs = {(row.check, row.key, row.commit_key) for row in named.collect()}
    held = {(row.check, row.key, row.commit_key) for row in keys.join(asked, ["check", "key"]).collect()}
    assert held <= pairs and len(held) == 14 and len(pairs - held) < 100
    assert filters.where("length(bits) <> 4096").isEmpty()


def test_an_update_reads_no_files_of_earlier_commits(store, monkeypatch):
    """The staged keys of the new commits prune the folders that are scanned; distinct held keys are made once."""
    ledger = IntegrityLedger(store)
    commit(store, 1, ["a"], ["p"], [("o", "a")], [("o", "p", 1, 1)])
    ledger.update()
    commit(store, 2, ["b"], ["q"], [("u", "a")], [("u", "q", 1, 1)])
    staged, read = [], []
    inner, written = integrity_ledger.stage, store.written
    monkeypatch.setattr(integrity_ledger, "stage", lambda rows, name: staged.append(name) or inner(rows, name))
    monkeypatch.setattr(store, "written", lambda name, keys: read.append(written(name, keys)) or read[-1])
    ledger.update()
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in read]
    pruned = {name: "dynamicpruning" in plan for name, plan in zip(STAR_SCHEMAS, plans)}
    assert all(pruned[name] for name in ("customers", "products", "orders", "order_items"))  # no locations are stored
    assert staged.count("held-keys") == 1
