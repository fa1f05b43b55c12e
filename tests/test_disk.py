"""What lies on disk at once: how often lines are shuffled before they are numbered, and how soon shuffles and staged tables go."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tests.test_travel import no_broadcast, plan_of  # noqa: F401
from tillmart import registry
from tillmart.operators import merge, numbering
from tillmart.operators.numbering import number_keyed_rows, number_rows
from tillmart.operators.staging import releasing_shuffles, shared_folder, stage
from tillmart.sources.flat_file import write_csv
from tillmart.sources.store import StarStore

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(n).getName() for n in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_writes_leave_no_shuffled_rows(spark, tmp_path):
    """the shuffles of a staged table, an export and a commit go with the write."""
    rows = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 700).alias("n")).count().repartitionByRange("n")
    before = shuffle_files(spark)
    staged = stage(rows, "released")
    write_csv(rows, f"{tmp_path}/csv")
    assert shuffle_files(spark) <= before
    assert staged.count() == 700 and rows.agg(F.sum("count")).first()[0] == 5000
    store = StarStore(spark, f"{tmp_path}/store")
    star = store.star().with_tables(products=rows.select(F.col("n").alias("product_id"), *[F.lit("x").alias(name) for name in ("product_name", "category", "sub_category")]))
    before = shuffle_files(spark)
    store.commit(star, registry.batch_log.log_entries(registry._accepted(spark, 0), registry.AS_OF, 0), "part-0")
    assert shuffle_files(spark) <= before
    assert store.star().products.count() == 700


def test_release_keeps_the_sessions_setting(spark):
    assert spark.conf.get(RELEASE) == "false"
    with pytest.raises(ZeroDivisionError), releasing_shuffles(spark):
        assert spark.conf.get(RELEASE) == "true"
        1 / 0
    assert spark.conf.get(RELEASE) == "false"


@pytest.mark.parametrize(("large", "pieces"), [(1_000_000, 1_000_000), (3, 1_000_000), (0, 1_000_000), (3, 0)])
def test_numbers_by_key_follow_the_order(spark, monkeypatch, large, pieces):
    """as number_rows, for keys of any size; one key holds a third of the rows, some rows are equal."""
    monkeypatch.setattr(numbering, "ROWS_OF_A_KEY", large)
    monkeypatch.setattr(numbering, "BROADCAST_PIECES", pieces)
    rows = [(k, n, f"t{n % 3}") for k in range(60) for n in range(k % 5)] + [(33, n % 9, "hot") for n in range(60)] + [(7, None, None), (8, 0, None)] * 2
    random.Random(5).shuffle(rows)
    frame = spark.createDataFrame(rows, "k long, n long, text string").repartition(7)
    wanted = sorted(map(tuple, number_rows(frame, "k", "n", "text", name="number", start=11).collect()), key=lambda row: row[-1])
    found = sorted(map(tuple, number_keyed_rows(frame, "k", "n", "text", name="number", start=11).collect()), key=lambda row: row[-1])
    assert found == wanted and [row[-1] for row in found] == list(range(11, 11 + len(rows)))
    kept = number_keyed_rows(frame, "k", "n", "text", keep=["text"])
    assert kept.columns == ["text", "row_id"] and sorted(kept.collect(), key=lambda row: row[-1]) == [(row[2], n) for n, row in enumerate(wanted, 1)]
    assert number_keyed_rows(frame.limit(0), "k", "n").count() == 0


def test_lines_are_numbered_where_they_were_joined(spark, no_broadcast, monkeypatch):  # noqa: F811
    """F1 F3: whole lines travel to their part and their order, and to no range."""
    plans = []
    inner = numbering.stage
    monkeypatch.setattr(numbering, "stage", lambda rows, name: plans.append((set(rows.columns), plan_of(rows))) or inner(rows, name))
    registry.QUERIES["clean_batch"](spark, SF_DIR)
    whole = [plan for columns, plan in plans if "_seq" in columns]
    assert len(whole) == 1 and "rangepartitioning" not in whole[0]
    keys = [key for key in re.findall(r"Exchange hashpartitioning\(([a-z_]+)", whole[0])]
    assert keys.count("l_partkey") == 2 and keys.count("l_orderkey") == 3
    carried = re.search(r"Exchange hashpartitioning\(l_orderkey[^\n]*\n(?:[^\n]*\n)*?[^\n]*Project \[([^\]]*)\]", whole[0]).group(1)
    assert "l_partkey" in carried and "segment" not in carried


def test_bulk_upload_is_compressed(spark, tmp_path, monkeypatch):
    """the text of the whole upload lies on disk as gzip."""
    monkeypatch.setattr(registry, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    tables = {row.table: row.rows for row in registry.QUERIES["bulk_load"](spark, SF_DIR).collect()}
    assert list(tmp_path.glob("bulk/upload/part-*.csv.gz")) and not list(tmp_path.glob("bulk/upload/part-*.csv"))
    assert tables["order_items"] == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()


def test_few_first_rows_do_not_move_the_lines(spark, no_broadcast, monkeypatch):  # noqa: F811
    """few new customers are sent to the lines; beyond the bound both are shuffled. The rows are the same."""
    lines = [(n, f"c{n % 5}" if n % 7 else None, f"name {n}") for n in range(1, 200)]
    frame = stage(spark.createDataFrame(lines, "row_id long, customer_id string, customer_name string").withColumn("segment", F.lit("s")).repartition(5), "lines")
    stored = spark.createDataFrame([("c1",), ("c9",)], "customer_id string")
    found = merge.new_customers(frame, stored)
    assert "Exchange hashpartitioning" not in plan_of(found)
    monkeypatch.setattr(merge, "BROADCAST_ROWS", 0)
    shuffled = merge.new_customers(frame, stored)
    assert "Exchange hashpartitioning" in plan_of(shuffled)
    assert sorted(map(str, found.collect())) == sorted(map(str, shuffled.collect())) and found.count() == 5


def test_a_merged_batch_leaves_no_staged_table(spark, monkeypatch):
    """when the second batch is committed, what was staged for the first is gone."""
    folder = shared_folder(spark)
    lying = []
    earlier = set(os.listdir(folder))
    inner = StarStore.commit
    monkeypatch.setattr(StarStore, "commit", lambda self, *rest: lying.append({n for n in os.listdir(folder) if n.startswith("tillmart-numbered")} - earlier) or inner(self, *rest))
    registry.QUERIES["whole_merge"](spark, SF_DIR)
    assert [len(names) for names in lying] == [1, 1] and lying[0] != lying[1]
