"""Line breaks inside quotes: refused line by line, and read in parallel as Spark's one-task reader reads them."""

import datetime as dt
import random
from collections import Counter

import pytest

from tests.test_store import AS_OF, store, write  # noqa: F401
from tillmart.operators import intake
from tillmart.operators.intake import Submission, bulk_load, ingest_file, ingest_files
from tillmart.operators.numbering import number_file_rows
from tillmart.sources.flat_file import OpenQuotes, read_flat_csv
from tillmart.sources.quoted import read_records

VALUES = ["", "plain", "two words", 'a "b" c', "x,y", "line\nbreak", "\n", "\n\n\n", '"', '""', ",", 'end"\n', "é", " lead", "many\nlines\nin,one\n\"value\"", "5\" pipe"]


def csv_of(rng, count, columns=3):
    def field(value):
        if any(mark in value for mark in ',\n"') and not value.startswith("5"):
            return '"' + value.replace('"', '""') + '"'
        return value  # a quote within a bare field is a character like any other

    lines = [",".join(f"h{n}" for n in range(columns))]
    for n in range(count):
        lines.append(",".join([f"r{n}"] + [field(rng.choice(VALUES)) for _ in range(columns - 1)]))
        lines += [""] * (rng.random() < 0.1)
    return "\n".join(lines) + "\n"


@pytest.fixture
def small_blocks(spark):
    """Splits files into blocks of the given size."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}

    def use(size):
        for name in names:
            spark.conf.set(name, size)

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def one_task(spark, path, columns=3):
    schema = ", ".join(f"c{n} string" for n in range(columns + 1))
    return spark.read.schema(schema).options(header="true", enforceSchema="true", encoding="ISO-8859-1", escape='"', multiLine="true").csv(path)


@pytest.mark.parametrize("size", [23, 200, 100_000])
def test_same_rows_as_one_task(spark, tmp_path, small_blocks, size):
    folder = tmp_path / "parts"
    for n in range(2):
        write(folder, f"p{n}.csv", csv_of(random.Random(size + n), 120))
    want = Counter(tuple(None if value in ("",) else value for value in row) for row in one_task(spark, str(folder)).collect())
    small_blocks(size)
    records = read_records(spark, str(folder), "ISO-8859-1")
    assert records.unclosed == [] and (size > 1000 or records.rows.select("_block").distinct().count() > 10)
    got = read_flat_csv(spark, str(folder), multi_line=True)
    assert Counter(tuple(row)[:4] for row in got.collect()) == want
    numbered = number_file_rows(got, per_file=True).select("_file", "row_no", "h0").collect()
    by_file = {}
    for row in numbered:
        by_file.setdefault(row._file, {})[row.row_no] = row.h0
    assert all([found[n] for n in sorted(found)] == [f"r{n}" for n in range(120)] and min(found) == 1 for found in by_file.values())


def test_a_field_over_many_blocks(spark, tmp_path, small_blocks):
    long = "no quotes here\n" * 300
    path = write(tmp_path, "long.csv", f'a,b\n1,"{long}"\n2,"x"\n')
    small_blocks(50)
    got = read_flat_csv(spark, path, multi_line=True).collect()
    assert [(row.a, row.b) for row in sorted(got, key=lambda row: row.a)] == [("1", long), ("2", "x")]


def test_a_file_that_ends_inside_quotes_is_refused(spark, store, tmp_path, small_blocks):  # noqa: F811
    text = "Order ID,Customer Name,sales,quantity\n" + "".join(f"O{n},Ann,10,1\n" for n in range(40)) + 'O99,"Lee,10,1\n' + "".join(f"P{n},Ann,10,1\n" for n in range(40))
    path, fine = write(tmp_path, "open.csv", text), write(tmp_path, "fine.csv", 'Order ID,Customer Name,sales,quantity\nO1,"Ann\nLee",10,1\n')
    small_blocks(100)
    with pytest.raises(OpenQuotes):
        read_flat_csv(spark, path, multi_line=True)
    assert ingest_file(store, path, AS_OF, multi_line=True).status == "Rejected"
    found = [Submission(f"k{n}", place, place, f"file:{place}") for n, place in enumerate((path, fine))]
    assert [row.status for row in ingest_files(store, found, AS_OF, multi_line=True)] == ["Rejected", "Accepted"]
    assert [row.customer_name for row in store.table("customers").collect()] == ["Ann\nLee"]


def test_open_quotes_are_refused_by_default(spark, store, tmp_path):  # noqa: F811
    good = "".join(f"G{n},Ann,10,1\n" for n in range(20))
    path = write(tmp_path, "open.csv", "Order ID,Customer Name,sales,quantity\n" + good + 'O1,"Ann\nLee",10,1\n')
    fine = write(tmp_path, "fine.csv", 'Order ID,Customer Name,sales,quantity\nO2,"Lee, Ann",10,1\nO3,"5"" pipe",1,1\nO4,5" pipe,1,1\n')
    decision = ingest_file(store, path, AS_OF)
    assert (decision.status, decision.accepted_rows) == ("Rejected", 0) and intake.OPEN_QUOTE in str(decision.issues)
    with pytest.raises(intake.UnknownLayout):
        bulk_load(store, path, AS_OF)
    found = [Submission(f"k{n}", place, place, f"file:{place}") for n, place in enumerate((path, fine))]
    assert [row.status for row in ingest_files(store, found, AS_OF + dt.timedelta(1))] == ["Rejected", "Accepted"]
    assert sorted(row.order_id for row in store.table("orders").collect()) == ["O2", "O3", "O4"]
