import random

import pytest
from pyspark.sql import functions as F

from tillmart.operators import numbering
from tillmart.operators.numbering import number_file_rows, number_rows
from tillmart.operators.staging import stage
from tillmart.sources.flat_file import read_flat_csv, read_header, write_csv


def test_numbers_follow_the_order_without_gaps(spark):
    values = list(range(2000))
    random.Random(3).shuffle(values)
    rows = spark.createDataFrame([(value,) for value in values], "v long").repartition(7)
    got = sorted((row.v, row.n) for row in number_rows(rows, "v", name="n", start=11).collect())
    assert got == [(value, value + 11) for value in range(2000)]


def test_equal_rows_with_a_position_spread_over_ranges(spark, monkeypatch):
    """Two thirds of the rows are copies; they must not end up in one range."""
    staged = []
    monkeypatch.setattr(numbering, "stage", lambda rows, name: staged.append(stage(rows, name)) or staged[-1])
    rows = spark.range(0, 30000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("v"), F.col("id").alias("place"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_rows(rows, "v", "place", name="n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (30000, 1, 30000)
    largest = staged[0].groupBy(F.shiftright("_seq", 33)).count().agg(F.max("count")).first()[0]
    assert largest < 12000


@pytest.mark.parametrize("limit", [numbering.BROADCAST_PIECES, 0])
def test_file_rows_follow_the_file_over_many_splits(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(numbering, "BROADCAST_PIECES", limit)
    path = tmp_path / "up.csv"
    path.write_text("Order ID,note\n" + "".join(f"{n},{'x' * (n % 50)}\n" for n in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32kb")
    spark.conf.set("spark.sql.files.openCostInBytes", "1kb")
    try:
        raw = read_flat_csv(spark, str(path))
        assert raw.rdd.getNumPartitions() > 8
        numbered = number_file_rows(raw)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert numbered.where(F.col("Order ID").cast("long") != F.col("row_no")).count() == 0
    assert numbered.count() == 20000


def test_each_file_starts_at_one(spark, tmp_path):
    for name, size in (("b", 5), ("a", 3)):
        (tmp_path / f"{name}.csv").write_text("sales\n" + "".join(f"{name}{n}\n" for n in range(1, size + 1)))
    raw = number_file_rows(read_flat_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]), per_file=True)
    assert sorted((row.sales, row.row_no) for row in raw.collect()) == [(f"{f}{n}", n) for f, size in (("a", 3), ("b", 5)) for n in range(1, size + 1)]
    together = number_file_rows(read_flat_csv(spark, str(tmp_path)))
    assert [row.sales for row in together.orderBy("row_no").collect()] == ["a1", "a2", "a3", "b1", "b2", "b3", "b4", "b5"]


def test_csv_details(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes('Name ,ZIP,Note\n"Zo\xeb, ""Z""",007,NA\n , NA,\n'.encode("latin-1"))
    assert read_header(spark, str(path)) == ["Name ", "ZIP", "Note"]
    rows = read_flat_csv(spark, str(path)).drop("_beyond", "_file", "_block", "_seq")
    assert rows.columns == ["Name", "ZIP", "Note"]
    assert [tuple(row) for row in rows.collect()] == [('Zoë, "Z"', "007", None), (" ", " NA", None)]


def test_written_csv_keeps_spaces(spark, tmp_path):
    write_csv(spark.createDataFrame([("  a ", 'q"')], "x string, y string"), str(tmp_path / "out"))
    rows = read_flat_csv(spark, str(tmp_path / "out"))
    assert tuple(rows.first())[:2] == ("  a ", 'q"')
