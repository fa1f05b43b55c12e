import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillmart.operators import intake
from tillmart.operators.intake import Submission, bulk_load, ingest_file, ingest_files, submissions
from tillmart.operators.staging import shared_folder
from tillmart.schemas import STAR_SCHEMAS
from tillmart.sources import store as store_module
from tillmart.sources.store import StarStore
from tillmart.streaming.events import window_totals
from tillmart.streaming.gate import watch_folder

AS_OF = dt.datetime(2020, 1, 2, 3, 4, 5)
GOOD = "Order No,Date,Buyer,cust id,item id,revenue,qty,CITY,extra\nO1,2015-01-02,Zoë,C1,P1,10,1,Rome,x\nO2,2015-01-03,Ann,C2,P1,$20,2,Rome,y\n"
REORDERED = "CITY,qty,revenue,item id,cust id,Buyer,Date,Order No\nOslo,3,(30),P2,C1,Zed,2015/02/03,O3\n"
HALF_BAD = "Order ID,sales,quantity\nO5,1,1\nO6,1,0\n"
BAD = "Order ID,sales,quantity\nO7,0,0\n"


@pytest.fixture
def store(spark, tmp_path):
    return StarStore(spark, str(tmp_path / "store"))


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_bytes(text.encode("latin-1"))
    return str(path)


def content(store):
    """Every stored row without the surrogate ids."""
    star = store.star()
    items = star.order_items.join(star.orders, "order_id").join(star.locations, "location_id").drop("order_item_id", "location_id")
    frames = [star.customers, star.products, items]
    return [sorted((tuple(row) for row in frame.collect()), key=repr) for frame in frames]


def test_empty_store(store):
    assert store.log().count() == 0
    assert [rows.count() for rows in store.star().tables().values()] == [0] * 5


def test_decisions_and_quarantine(store, tmp_path):
    accepted = ingest_file(store, write(tmp_path, "good.csv", GOOD), AS_OF)
    held = ingest_file(store, write(tmp_path, "half.csv", HALF_BAD), AS_OF)
    forced = ingest_file(store, write(tmp_path, "half2.csv", HALF_BAD), AS_OF, on_review="merge")
    refused = ingest_file(store, write(tmp_path, "bad.csv", BAD), AS_OF)
    assert [(row.status, row.action) for row in (accepted, held, forced, refused)] == [
        ("Accepted", "merge"), ("Needs Review", "hold"), ("Needs Review", "merge"), ("Rejected", "reject"),
    ]
    log = store.log().orderBy("batch_id").collect()
    assert [(row.batch_id, row.filename, row.accepted_rows, row.rejected_rows) for row in log] == [
        (1, "good.csv", 2, 0), (2, "half.csv", 0, 2), (3, "half2.csv", 2, 0), (4, "bad.csv", 0, 1),
    ]
    assert sorted(row.order_item_id for row in store.table("order_items").collect()) == [1, 2, 3, 4]
    refused_rows = store.spark.read.option("header", True).csv(f"{store.path}/quarantine/*")
    assert [row.order_id for row in refused_rows.collect()] == ["O7"]


def test_same_file_twice_counts_twice_but_a_replay_does_not(store, tmp_path):
    path = write(tmp_path, "good.csv", GOOD)
    ingest_file(store, path, AS_OF, batch_key="k1")
    assert ingest_file(store, path, AS_OF, batch_key="k1") is None
    assert store.table("order_items").count() == 2
    ingest_file(store, path, AS_OF, batch_key="k2")
    assert store.table("order_items").count() == 4
    assert store.table("orders").count() == 2 and store.table("customers").count() == 2


@pytest.mark.parametrize("limit", [store_module.BROADCAST_COMMITS, 0])
def test_an_append_without_log_row_is_not_seen_and_is_replaced(store, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(store_module, "BROADCAST_COMMITS", limit)
    path = write(tmp_path, "good.csv", GOOD)
    whole = StarStore._append

    def dies_at_the_log(self, rows, table, schema, commit_key):
        if table == store_module.LOG:
            raise RuntimeError("driver lost")
        whole(self, rows, table, schema, commit_key)

    monkeypatch.setattr(StarStore, "_append", dies_at_the_log)
    with pytest.raises(RuntimeError):
        ingest_file(store, path, AS_OF, batch_key="k1")
    assert any(name.startswith("commit_key=") for name in os.listdir(f"{store.path}/orders"))
    assert [rows.count() for rows in store.star().tables().values()] == [0] * 5
    monkeypatch.setattr(StarStore, "_append", whole)
    # Another file brings the same customers in between: the retry has none of its own left.
    ingest_file(store, path, AS_OF, batch_key="k0")
    ingest_file(store, path, AS_OF, batch_key="k1")
    assert store.table("customers").count() == 2
    assert store.table("order_items").count() == 4


def test_staged_tables_are_removed(store, tmp_path):
    folder = shared_folder(store.spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ingest_file(store, write(tmp_path, "good.csv", GOOD), AS_OF)
    assert set(os.listdir(folder)) - before == set()


def test_bulk_load_exports_and_registers(store, tmp_path):
    text = (
        "Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,Product ID,Product Name,Category,Sub-Category,City,"
        "State,Country,Postal Code,Market,Region,Sales,Quantity,Discount,Profit,Shipping Cost,Order Priority\n"
        'O1,3/15/2014,junk,First,C1,José,Consumer,P1,Pen,Office,Pens,Paris,,France,,EU,West,"$1,200.50",2,0.1,(12.00),3.5,High\n'
        "O1,3/15/2014,3/20/2014,,C1,José B,Consumer,P2,Desk,Furn,Desks,Paris,,France,,EU,West,300,1,0,30,1.5,High\n"
    )
    bulk_load(store, write(tmp_path, "raw.csv", text), AS_OF, str(tmp_path / "export"))
    (order,) = store.table("orders").collect()
    assert (order.order_date, order.ship_date, order.ship_mode, float(order.shipping_cost)) == (dt.date(2014, 3, 15), dt.date(2014, 3, 19), "First", 5.0)
    assert store.table("customers").first().customer_name == "José"
    assert sorted(os.listdir(tmp_path / "export")) == sorted(f"cleaned_{name}" for name in STAR_SCHEMAS)
    store.register("st_")
    assert store.spark.table("st_order_items").count() == 2


def run(store, inbox, checkpoint):
    query = watch_folder(store, str(inbox), str(checkpoint), clock=lambda: AS_OF)
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_one_merge_and_a_replay_adds_nothing(spark, store, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "a b.csv", GOOD)
    write(inbox, "c.csv", REORDERED)
    write(inbox, "skip.txt", GOOD)
    run(store, inbox, tmp_path / "ck")
    once = StarStore(spark, str(tmp_path / "once"))
    files = submissions(spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(str(inbox)))
    assert [file.filename for file in files] == ["a b.csv", "c.csv"]
    assert [row.action for row in ingest_files(once, files, AS_OF)] == ["merge", "merge"]
    wrong = [Submission("k", files[0].path, "x", "elsewhere")]
    with pytest.raises(Exception, match="no submission for"):
        ingest_files(once, wrong, AS_OF)
    assert content(store) == content(once)
    assert sorted(row.order_item_id for row in store.table("order_items").collect()) == [1, 2, 3]
    before = content(store)
    run(store, inbox, tmp_path / "ck")
    run(store, inbox, tmp_path / "other")  # a lost checkpoint offers every file again
    assert content(store) == before
    write(inbox, "d.csv", REORDERED.replace("O3", "O4"))
    run(store, inbox, tmp_path / "ck")
    assert store.log().count() == 3 and store.table("orders").count() == 4


def partitions(store):
    """Commit keys of all folders, by table."""
    return {
        table: {name.partition("=")[2] for name in os.listdir(f"{store.path}/{table}") if name.startswith("commit_key=")}
        for table in os.listdir(store.path)
    }


def test_a_replayed_epoch_in_another_grouping_leaves_nothing_behind(store, tmp_path, monkeypatch):
    inbox, checkpoint = tmp_path / "in", tmp_path / "ck"
    for name, text in (("a.csv", GOOD), ("b.csv", BAD), ("c.csv", REORDERED)):
        write(inbox, name, text)
    whole, taken = StarStore._append, []

    def dies_at_the_log(self, rows, table, schema, commit_key):
        if table == store_module.LOG:
            taken.append(commit_key)
            if len(taken) == limit:
                raise RuntimeError("driver lost")
        whole(self, rows, table, schema, commit_key)

    monkeypatch.setattr(StarStore, "_append", dies_at_the_log)
    for size, limit in ((3, 1), (2, 2), (1, 9)):  # one commit fails, then the second of two, then each file is taken alone
        taken.clear()
        monkeypatch.setattr(intake, "FILES_PER_COMMIT", size)
        if size > 1:
            with pytest.raises(Exception):
                run(store, inbox, checkpoint)
        else:
            run(store, inbox, checkpoint)
    logged = {row.commit_key for row in store.log().collect()}
    assert len(logged) == 2 and all(key.startswith("stream-") for key in logged)
    found = partitions(store)
    assert set().union(*found.values()) <= logged and found["quarantine"]
    assert sorted(row.filename for row in store.log().collect()) == ["a.csv", "b.csv", "c.csv"]
    assert sorted(row.order_item_id for row in store.table("order_items").collect()) == [1, 2, 3]
    store.compact()
    (key,) = found["quarantine"]
    store.discard_unlogged("stream-")
    assert partitions(store)["quarantine"] == {key}  # its batch is logged under the generation's key now


def test_headers_cost_no_job_per_file(store, tmp_path, monkeypatch):
    read = []
    whole = intake.read_header
    monkeypatch.setattr(intake, "read_header", lambda spark, path, multi_line: read.append(path) or whole(spark, path, multi_line))
    for n in range(4):
        write(tmp_path / "in", f"f{n}.csv", GOOD.replace("O1", f"A{n}").replace("O2", f"B{n}"))
    write(tmp_path / "in", "g.csv", GOOD.replace("extra", '"ex\ntra"'))
    files = submissions(store.spark.read.format("binaryFile").load(str(tmp_path / "in")))
    assert {row.action for row in ingest_files(store, files, AS_OF, multi_line=True)} == {"merge"}
    assert store.table("order_items").count() == 10
    assert len(read) == 3  # one for each of two layouts, one to tell the quoted header


def test_stream_logs_unreadable_and_empty_files(store, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "u.csv", "foo,bar\n1,2\n")
    write(inbox, "e.csv", "sales,quantity\n")
    write(inbox, "g.csv", GOOD)
    run(store, inbox, tmp_path / "ck")
    status = {row.filename: (row.status, row.row_count) for row in store.log().collect()}
    assert status == {"u.csv": ("Rejected", 0), "e.csv": ("Rejected", 0), "g.csv": ("Accepted", 2)}


def test_files_beyond_one_pass_are_taken_in_turn(store, tmp_path, monkeypatch):
    monkeypatch.setattr(intake, "FILES_PER_COMMIT", 1)
    for name, text in (("a.csv", GOOD), ("b.csv", REORDERED)):
        write(tmp_path / "in", name, text)
    files = submissions(store.spark.read.format("binaryFile").load(str(tmp_path / "in")))
    assert [row.action for row in ingest_files(store, files, AS_OF)] == ["merge", "merge"]
    assert sorted(row.order_item_id for row in store.table("order_items").collect()) == [1, 2, 3]
    assert store.log().select("commit_key").distinct().count() == 2


def test_batch_keys_make_one_stable_commit_key():
    assert intake.commit_key_of(["a", "b"]) == intake.commit_key_of(["b", "a"]) != intake.commit_key_of(["a"])


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(
        "/root/testdata/sf0.001/events.parquet"
    )
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = window_totals(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()

    def as_rows(frame):
        return sorted(tuple(row) for row in frame.withColumn("window_start", F.col("window_start").cast("string")).collect())

    assert as_rows(spark.table("win")) == as_rows(window_totals(events))
    assert window_totals(events).agg(F.sum("events")).first()[0] == events.count()


def test_bulk_load_replaces_everything(store, tmp_path, monkeypatch):
    header = "Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,Product ID,Product Name,Category,Sub-Category,City,State,Country,Postal Code,Market,Region,Sales,Quantity,Discount,Profit,Shipping Cost,Order Priority\n"

    def line(order, customer, sales):
        return f"{order},2015-01-02,2015-01-03,Std,{customer},Ann,Home,P1,Pen,Office,Pens,Rome,RM,Italy,1,EU,South,{sales},1,0,1,1,High\n"

    first, second = (write(tmp_path, name, header + text) for name, text in (("a.csv", line("B1", "C1", 100)), ("b.csv", line("B2", "C2", 50) + line("B3", "C2", 7))))
    bulk_load(store, first, AS_OF)
    ingest_file(store, write(tmp_path, "good.csv", GOOD), AS_OF)
    before = content(store)

    def fail(*_):
        raise RuntimeError("disk full")

    with monkeypatch.context() as broken:
        broken.setattr(StarStore, "_append", fail)
        with pytest.raises(RuntimeError):
            bulk_load(store, second, AS_OF)
    assert content(store) == before
    bulk_load(store, second, AS_OF)
    fresh = StarStore(store.spark, str(tmp_path / "fresh"))
    bulk_load(fresh, second, AS_OF)
    assert content(store) == content(fresh)
    items = store.table("order_items").collect()
    assert sorted(row.order_item_id for row in items) == [1, 2] and sum(row.sales for row in items) == 57
    assert [row.batch_id for row in store.log().orderBy("batch_id").collect()] == [1, 2, 3]
    assert len(os.listdir(tmp_path / "store" / "customers")) <= 3
    ingest_file(store, write(tmp_path, "more.csv", GOOD), AS_OF)
    assert store.table("order_items").count() == 4


def test_a_logged_commit_cannot_be_discarded(store, tmp_path):
    ingest_file(store, write(tmp_path, "good.csv", GOOD), AS_OF)
    with pytest.raises(ValueError):
        store.discard(store.log().first().commit_key)
    assert store.table("order_items").count() == 2


def test_lines_that_are_too_wide_refuse_the_file(store, tmp_path):
    wide = write(tmp_path, "wide.csv", "Order ID,sales,quantity\nO1,2,3\nO2,1,234,5\n")
    decision = ingest_file(store, wide, AS_OF)
    assert (decision.status, decision.action) == ("Rejected", "reject")
    paths = [wide, write(tmp_path, "fine.csv", "Order ID,sales,quantity\nO3,2,3\n")]
    found = [Submission(f"k{n}", path, path, f"file:{path}") for n, path in enumerate(paths)]
    assert [row.status for row in ingest_files(store, found, AS_OF)] == ["Rejected", "Accepted"]
    assert [row.order_id for row in store.table("order_items").collect()] == ["O3"]
    with pytest.raises(intake.UnknownLayout):
        bulk_load(store, wide, AS_OF)


def test_line_breaks_in_quotes(store, tmp_path):
    path = write(tmp_path, "quoted.csv", 'Order ID,Customer Name,sales,quantity\nO1,"Ann\nLee",10,1\n')
    assert ingest_file(store, path, AS_OF, multi_line=True).status == "Accepted"
    assert [row.customer_name for row in store.table("customers").collect()] == ["Ann\nLee"]


def test_an_unreadable_file_is_logged(store, tmp_path):
    assert ingest_file(store, write(tmp_path, "odd.csv", "foo,bar\n1,2\n"), AS_OF).status == "Rejected"
    assert ingest_file(store, write(tmp_path, "none.csv", ""), AS_OF).status == "Rejected"
    assert store.log().count() == 2


def test_submission_time_is_utc(spark):
    from tillmart.operators.batch_log import log_entries
    from tillmart.schemas import ISSUE

    row = spark.createDataFrame([("k", 1, [], 100.0, "Accepted", 1, 0)], f"batch_key string, row_count bigint, issues array<{ISSUE.simpleString()}>, health_score double, status string, accepted_rows bigint, rejected_rows bigint")
    import time

    zone = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        assert log_entries(row, AS_OF).select(F.col("submitted_at").cast("string")).first()[0] == "2020-01-02 03:04:05"
    finally:
        os.environ.pop("TZ") if zone is None else os.environ.update(TZ=zone)
        time.tzset()


def test_an_amount_that_the_store_cannot_hold_refuses_the_batch(store, tmp_path):
    large = write(tmp_path, "large.csv", "Order ID,sales,quantity\nO1,123456789012345678,1\nO2,5,1\n")
    decision = ingest_file(store, large, AS_OF, on_review="merge")
    assert (decision.status, decision.action, decision.issues[-1]["name"]) == ("Rejected", "reject", "Amount Range")
    refused = store.spark.read.option("header", True).csv(f"{store.path}/quarantine/*").collect()
    assert sorted(row.sales for row in refused) == ["123456789012345678.0000000000000000", "5.0000"]
    assert store.table("order_items").count() == 0 and store.log().count() == 1


def test_rules_see_amounts_before_they_are_rounded(store, tmp_path):
    path = write(tmp_path, "fine.csv", "Order ID,sales,quantity,discount\nO1,0.00001,1,1.00001\nO2,5,2.99999,1\n")
    decision = ingest_file(store, path, AS_OF, on_review="merge")
    counts = {issue["name"]: issue["count"] for issue in decision.issues}
    assert (counts["Extreme Discounts"], counts["Null or Zero Sales"], len(counts)) == (1, 0, 7)
    assert sorted(row.quantity for row in store.table("order_items").collect()) == [1, 2]


def test_decisions_carry_mapping_and_warnings(store, tmp_path):
    decision = ingest_file(store, write(tmp_path, "good.csv", GOOD), AS_OF)
    assert decision.columns["order_id"] == "Order No" and decision.columns["quantity"] == "qty"
    assert decision.warnings == ["ship_date is missing: the order date is used", "profit is missing: 0 is used", "columns not recognised: extra"]
    assert ingest_file(store, write(tmp_path, "odd.csv", "foo\n1\n"), AS_OF).warnings == []


def test_every_file_of_an_inbox_has_a_log_row(store, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "good.csv", GOOD)
    write(inbox, "none.csv", "")
    for checkpoint in ("ck", "other"):
        run(store, inbox, tmp_path / checkpoint)
        log = store.log().collect()
        assert sorted((row.filename, row.status) for row in log) == [("good.csv", "Accepted"), ("none.csv", "Rejected")]


def test_parts_with_other_headers_refuse_the_folder(store, tmp_path):
    folder = tmp_path / "parts"
    write(folder, "a.csv", "Order ID,sales,quantity\nO1,10,3\n")
    write(folder, "b.csv", "quantity,sales,Order ID\n3,20,O2\n")
    decision = ingest_file(store, str(folder), AS_OF)
    assert (decision.status, decision.issues[0]["desc"]) == ("Rejected", intake.OTHER_HEADER)
    with pytest.raises(intake.UnknownLayout):
        bulk_load(store, str(folder), AS_OF)
    write(folder, "b.csv", "Order ID,sales,quantity\nO2,20,3\n")
    assert ingest_file(store, str(folder), AS_OF, batch_key="again").status == "Accepted"
    assert sorted((row.order_id, row.sales) for row in store.table("order_items").collect()) == [("O1", 10), ("O2", 20)]
