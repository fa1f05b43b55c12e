import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from tillmart.operators import batch_log, integrity, quality
from tillmart.operators.quality import Rule, score_batches
from tillmart.plans.star import Star

DAY = dt.date(2020, 1, 1)
SCHEMA = "batch_key string, quantity double, sales double, discount double, order_date date, ship_date date, customer_name string, product_name string"
GOOD = ("a", 1.0, 1.0, 0.1, dt.date(2019, 1, 1), dt.date(2019, 1, 2), "n", "p")


def rows(spark, *changes):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((dict(zip(names, GOOD)) | change)[name] for name in names) for change in changes], SCHEMA)


def counts(scores):
    return {row.name: (row["count"], row.severity, row.passed) for row in quality.issues(scores).collect()}


def test_each_rule(spark):
    batch = rows(
        spark, {}, {"quantity": 0.0}, {"sales": None}, {"sales": 0.0}, {"discount": 1.5}, {"order_date": dt.date(2021, 1, 1), "ship_date": dt.date(2021, 1, 1)},
        {"ship_date": dt.date(2018, 1, 1)}, {"customer_name": "Unknown Customer"}, {"product_name": "Unknown Product"}, {"quantity": None},
    )
    found = counts(score_batches(batch, DAY))
    assert {name: count for name, (count, _, _) in found.items()} == {
        "Negative Quantities": 1, "Null or Zero Sales": 2, "Extreme Discounts": 1, "Future Order Dates": 1, "Ship Before Order": 1,
        "Missing Customer Names": 1, "Missing Product Names": 1,
    }
    assert score_batches(batch, DAY).first().health_score == 40.0


def test_empty_batch_scores_zero(spark):
    row = score_batches(rows(spark, {}).where("false"), DAY).first()
    assert (row.row_count, row.health_score, row.status) == (0, 0.0, "Rejected")


def test_info_does_not_lower_the_score_and_two_faults_count_twice(spark):
    assert score_batches(rows(spark, {"customer_name": "Unknown Customer"}), DAY).first().health_score == 100.0
    assert score_batches(rows(spark, {"quantity": -1.0, "sales": 0.0}, {}, {}, {}), DAY).first().health_score == 50.0
    assert score_batches(rows(spark, {"quantity": -1.0, "sales": 0.0}), DAY).first().health_score == 0.0


def test_many_batches_in_one_pass(spark):
    batch = rows(spark, {"batch_key": "x"}, {"batch_key": "y", "quantity": -1.0}, {"batch_key": "y"})
    assert {row.batch_key: row.health_score for row in score_batches(batch, DAY, ["batch_key"]).collect()} == {"x": 100.0, "y": 50.0}


def test_a_rule_that_cannot_run_is_an_error_and_stops_acceptance(spark):
    extra = Rule("No Such", "critical", "never", lambda day: F.col("absent") > 0)
    scores = score_batches(rows(spark, {}), DAY, rules=(*quality.RULES, extra))
    assert counts(scores)["No Such"] == (0, "error", False)
    row = quality.disposition(scores).first()
    assert (row.health_score, row.status, row.action, row.accepted_rows, row.rejected_rows) == (100.0, "Needs Review", "hold", 0, 1)
    classes = {r.name: r.issue_class for r in quality.classified_issues(scores).collect()}
    assert classes["No Such"] == "fail" and classes["Negative Quantities"] == "pass"


@pytest.mark.parametrize("bad, on_review, action", [(0, "hold", "merge"), (3, "hold", "hold"), (3, "merge", "merge"), (9, "merge", "reject")])
def test_disposition(spark, bad, on_review, action):
    batch = rows(spark, *[{"quantity": -1.0 if n < bad else 1.0} for n in range(10)])
    row = quality.disposition(score_batches(batch, DAY), on_review).first()
    assert row.action == action
    assert (row.accepted_rows, row.rejected_rows) == ((10, 0) if action == "merge" else (0, 10))


def test_log_round_trip(spark):
    batch = rows(spark, {"batch_key": "x", "quantity": -1.0}, {"batch_key": "x"}, {"batch_key": "y"})
    log = batch_log.log_entries(quality.disposition(score_batches(batch, DAY, ["batch_key"])), dt.datetime(2020, 1, 1, 2, 3, 4), last_batch_id=41)
    newest, older = batch_log.history(log).collect()
    assert (newest.batch_id, newest.batch_key, older.batch_id, older.status) == (43, "y", 42, "Needs Review")
    assert json.loads(older.issues_json)[0] == {
        "name": "Negative Quantities", "severity": "warning", "count": 1, "desc": "Rows with zero or negative quantity", "passed": False,
    }
    assert [tuple(row) for row in batch_log.failed_issues(log).collect()] == [(42, "Negative Quantities", 1, "Rows with zero or negative quantity")]
    assert batch_log.pending_count(log).first().pending == 1


@pytest.mark.parametrize("text, expected", [(None, 0), ("{bad", 0), ("[]", 0), ('[{"name":"a","count":1,"desc":"d"}]', 0), ('[{"name":"a","count":1,"desc":"d","passed":false}]', 1)])
def test_unreadable_issue_text_gives_no_issues(spark, text, expected):
    log = spark.createDataFrame([(1, "Needs Review", text)], "batch_id long, status string, issues_json string")
    assert batch_log.failed_issues(log).count() == expected


def not_in(left, right):
    """SQL's NOT IN over Python lists."""
    if not right:
        return len(left)
    if None in right:
        return 0
    return sum(1 for key in left if key is not None and key not in right)


@pytest.mark.parametrize("left, right", list(itertools.product(([], [1, 2, None], [1, 1, 3], [None]), ([], [1], [1, None], [2, 3, 3]))))
def test_orphans_follow_not_in(spark, left, right):
    items = spark.createDataFrame([(key, 1, 1.0, 1) for key in left], "order_id long, product_id long, sales double, quantity long")
    orders = spark.createDataFrame([(key, 1, DAY) for key in right], "order_id long, customer_id long, order_date date")
    one = spark.createDataFrame([(1,)], "customer_id long")
    star = Star(customers=one, products=one.select(F.col("customer_id").alias("product_id")), locations=one, orders=orders, order_items=items)
    found = {row.name: row["count"] for row in integrity.integrity_checks(star).collect()}
    assert found["Orphan Line Items"] == not_in(left, right)
    assert found["Orphan Orders"] == 0


def test_a_check_that_fails_leaves_the_others(spark, star):
    checks = {row.name: row["count"] for row in integrity.integrity_checks(star.with_tables(orders=star.orders.drop("customer_id", "order_date"))).collect()}
    assert checks["Orphan Orders"] == -1 and checks["Date Range"] == -1
    assert checks["Orphan Line Items"] == 0 and checks["Table Sizes"] == 0


def test_missing_and_empty_tables(spark):
    spark.createDataFrame([], "a int").createOrReplaceTempView("pre_orders")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("pre_customers")
    found = {row.table: (row.present, row.rows, row.ok) for row in integrity.table_presence(spark, "pre_").collect()}
    assert found["orders"] == (True, 0, False) and found["customers"] == (True, 1, True) and found["products"] == (False, 0, False)
