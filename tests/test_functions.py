import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillmart.functions.dates import parse_date, quarter_index, quarter_label
from tillmart.functions.numbers import fits, parse_amount, parse_exact, parse_number
from tillmart.functions.text import null_if_token, or_default, short_label, strip
from tillmart.operators.quality import health, verdict


def evaluate(spark, values, *columns, schema="i int, s string"):
    rows = spark.createDataFrame(list(enumerate(values)), schema).repartition(3)
    found = {row.i: row[1:] for row in rows.select("i", *columns).collect()}
    return [found[n] if len(columns) > 1 else found[n][0] for n in range(len(values))]


NUMBERS = {
    "$1,234.50": 1234.5, "(12.00)": -12.0, "$(5)": -5.0, "-$5": -5.0, "1e3": 1000.0, "abc": 0.0, "12%": 0.0, "( 5 )": 0.0,
    "(-5)": 0.0, None: 0.0, "": 0.0, "1_000": 1000.0, "1__0": 0.0, "5d": 0.0, "nan": 0.0, "inf": 0.0, "1e400": 0.0, " 7 ": 7.0,
    "\t8\n": 8.0, "$ 5": 5.0, "()": 0.0, "(5": 0.0, ".5": 0.5, "5.": 5.0, "+5": 5.0, "0x10": 0.0, "1,2,3": 123.0,
}


def test_numbers(spark):
    got = evaluate(spark, list(NUMBERS), parse_number(F.col("s")), parse_amount(F.col("s")))
    assert [value for value, _ in got] == list(NUMBERS.values())
    assert [float(amount) for _, amount in got] == list(NUMBERS.values())


def test_an_amount_beyond_the_store_is_an_error(spark):
    assert evaluate(spark, ["12345678901234.5678", "1e999", "1e-300"], parse_amount(F.col("s")).cast("string")) == [
        "12345678901234.5678", "0.0000", "0.0000",
    ]
    for text in ("1e15", "-123456789012345678", "1e300"):
        with pytest.raises(Exception, match="does not fit"):
            evaluate(spark, [text], parse_amount(F.col("s")))
        assert evaluate(spark, [text], fits(parse_exact(F.col("s")))) == [False]


MARCH_15 = dt.date(2014, 3, 15)
DATES = {
    "2014-03-15": MARCH_15, "3/15/2014": MARCH_15, "15/3/2014": MARCH_15, "2014/3/15": MARCH_15, "20140315": MARCH_15,
    "15 Mar 2014": MARCH_15, "March 15, 2014": MARCH_15, "MAR 15 2014": MARCH_15, "15-Mar-14": MARCH_15, "2014.3.15": MARCH_15,
    "15.03.2014": MARCH_15, " 2014-03-15 ": MARCH_15, "2014-03-15T10:00:00": MARCH_15, "3/15/2014 10:30 PM": MARCH_15,
    "01-02-2014": dt.date(2014, 1, 2), "1/2/14": dt.date(2014, 1, 2), "1/2/76": dt.date(1976, 1, 2), "1/2/70": dt.date(2070, 1, 2),
    "Mar 2014": dt.date(2014, 3, 1), "2014": dt.date(2014, 1, 1), "2014-03": dt.date(2014, 3, 1), "Sept 5, 2014": dt.date(2014, 9, 5),
    "31/02/2014": None, "2/30/2014": None, "2014-13-01": None, "2014/15/3": None, "1/2/2014 25:00": None, "2014-03-15 junk": None,
    "Marsh 1, 2014": None, "1677-01-01": None, "2300-01-01": None, "junk": None, "": None, None: None,
}


def test_dates(spark):
    assert dict(zip(DATES, evaluate(spark, list(DATES), parse_date(F.col("s"))))) == DATES


@settings(max_examples=5, deadline=None)
@given(st.lists(st.dates(dt.date(1678, 1, 1), dt.date(2261, 12, 31)), min_size=1, max_size=50))
def test_dates_survive_a_round_trip(spark, dates):
    layouts = ("%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%B %d, %Y", "%d %b %Y", "%Y.%m.%d")
    for layout in layouts:
        texts = [f"{day.year:04d}".join(day.strftime(layout.replace("%Y", "@")).split("@")) for day in dates]
        assert evaluate(spark, texts, parse_date(F.col("s"))) == dates


def test_text(spark):
    assert evaluate(spark, ["  a b \x1f", None], strip(F.col("s"))) == ["a b", None]
    assert evaluate(spark, ["NA", " NA", "", "n/a", "nil", None], null_if_token(F.col("s"))) == [None, " NA", None, None, "nil", None]
    assert evaluate(spark, ["", None, "  ", "x"], or_default(F.col("s"), "d")) == ["d", "d", "  ", "x"]
    assert evaluate(spark, ["a" * 20, "a" * 21], short_label(F.col("s"), 20)) == ["a" * 20, "a" * 20 + "..."]


def test_quarters(spark):
    labels = evaluate(spark, ["2014-01-31", "2014-12-01", "2015-04-01"], quarter_label(quarter_index(F.col("s").cast("date"))))
    assert labels == ["2014-Q1", "2014-Q4", "2015-Q2"]


def test_health_rounds_like_python(spark):
    chance = random.Random(7)
    totals = [chance.randint(1, 3000) for _ in range(3000)]
    pairs = [(chance.randint(0, 2 * total), total) for total in totals] + [(n, 400) for n in range(401)] + [(5, 0)]
    rows = spark.createDataFrame(pairs, "flagged long, total long").select("*", health(F.col("flagged"), F.col("total")).alias("score"))
    for row in rows.collect():
        plain = max(0, 1 - row.flagged / row.total) * 100 if row.total else 0
        assert row.score == round(plain, 1)
        assert 0 <= row.score <= 100


@pytest.mark.parametrize("score, name", [(100.0, "Accepted"), (80.0, "Accepted"), (79.9, "Needs Review"), (50.0, "Needs Review"), (49.9, "Rejected"), (0.0, "Rejected")])
def test_verdict(spark, score, name):
    assert spark.range(1).select(verdict(F.lit(score))).first()[0] == name


def test_plain_amounts_take_the_short_way(spark):
    """Plain numerals, with $, commas, blanks or brackets, are cast at once; the others as before, to the same values."""
    want = {
        "12": "12.0000", "-1,234.5": "-1234.5000", "$7.25": "7.2500", "-$3": "-3.0000", "(4.5)": "-4.5000", "($1,000)": "-1000.0000", "  8.1 ": "8.1000",
        "(-5)": "0.0000", "--5": "0.0000", "5\n": "5.0000", "1.23456": "1.2346", "1e3": "1000.0000", "n/k": "0.0000", "( 5)": "0.0000", "(5": "0.0000", "000000000000000012": "12.0000",
    }
    rows = spark.createDataFrame([(text,) for text in want] + [(None,)], "text string")
    got = {r.text: (str(r.amount), str(r.exact)) for r in rows.select("text", parse_amount(F.col("text")).alias("amount"), parse_exact(F.col("text")).cast("decimal(18,4)").alias("exact")).collect()}
    assert got == {text: (value, value) for text, value in want.items()} | {None: ("0.0000", "0.0000")}
    assert "rlike" in str(parse_amount(F.col("text"))).lower()
