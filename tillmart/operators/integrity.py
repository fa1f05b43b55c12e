"""Consistency checks on the stored tables.

The orphan checks follow NOT IN: no row counts when the referenced column holds a null,
a null reference never counts, and an empty referenced table makes every row an orphan.
They are computed without a join. References and referenced keys are stacked and
grouped by key, so both sides combine map-side, a key with a third of all rows is one
row per input partition, and no table has to fit in memory.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.plans.star import Star
from tillmart.schemas import STAR_SCHEMAS

RESULT_COLUMNS = ("name", "desc", "count", "severity")


def _references(rows: DataFrame, columns: dict[int, str], key_type: T.DataType) -> DataFrame:
    """(check, key, 1, 0) for each checked column; one scan serves several checks."""
    entries = [F.struct(F.lit(check).alias("check"), F.col(column).cast(key_type).alias("key")) for check, column in columns.items()]
    return rows.select(F.inline(F.array(*entries))).select("check", "key", F.lit(1).alias("used"), F.lit(0).alias("held"))


def _holders(rows: DataFrame, columns: dict[int, str], key_type: T.DataType) -> DataFrame:
    return _references(rows, columns, key_type).select("check", "key", F.lit(0).alias("used"), F.lit(1).alias("held"))


# Name, description, referring table, key column, referenced table.
ORPHAN_CHECKS = {
    1: ("Orphan Orders", "Orders referencing missing customers", "orders", "customer_id", "customers"),
    2: ("Orphan Line Items", "Items referencing missing orders", "order_items", "order_id", "orders"),
    3: ("Orphan Product Refs", "Items referencing missing products", "order_items", "product_id", "products"),
}


def _runnable(star: Star) -> list[int]:
    """Checks whose key column exists on both sides."""
    tables = star.tables()
    return [
        check for check, (_, _, child, key, parent) in ORPHAN_CHECKS.items()
        if key in tables[child].columns and key in tables[parent].columns
    ]


def orphan_counts(star: Star, checks: list[int] | None = None) -> DataFrame:
    """(check, count) of the reference checks, in one grouping."""
    tables, referring, stacked = star.tables(), {}, []
    checked = [(check, *ORPHAN_CHECKS[check][2:]) for check in checks or ORPHAN_CHECKS]
    types = {tables[name].schema[key].dataType for _, child, key, parent in checked for name in (child, parent)}
    key_type = types.pop() if len(types) == 1 else T.StringType()
    for check, child, key, parent in checked:
        referring.setdefault(child, {})[check] = key
        stacked.append(_holders(tables[parent], {check: key}, key_type))
    stacked += [_references(tables[child], columns, key_type) for child, columns in referring.items()]
    stacked = reduce(DataFrame.unionByName, stacked)
    per_key = stacked.groupBy("check", "key").agg(F.sum("used").alias("used"), F.max("held").alias("held"))
    known_null = F.max(F.when(F.col("key").isNull(), F.col("held")).otherwise(0))
    missing = F.sum(F.when(F.col("key").isNotNull() & (F.col("held") == 0), F.col("used")).otherwise(0))
    return (
        per_key.groupBy("check")
        .agg(known_null.alias("known_null"), missing.alias("missing"), F.sum("used").alias("rows"), F.max("held").alias("any_held"))
        .select(
            "check",
            F.when(F.col("any_held") == 0, F.col("rows")).when(F.col("known_null") == 1, 0).otherwise(F.col("missing")).alias("count"),
        )
    )


def _orphans(star: Star) -> DataFrame:
    checks = _runnable(star)
    entries = []
    for check, (name, desc, *_) in ORPHAN_CHECKS.items():
        count = F.coalesce(F.max(F.when(F.col("check") == check, F.col("count"))), F.lit(0)).cast("bigint")
        values = (desc, count, "critical") if check in checks else ("Check failed", F.lit(-1).cast("bigint"), "error")
        entries.append(F.struct(
            F.lit(name).alias("name"), F.lit(values[0]).alias("desc"), values[1].alias("count"), F.lit(values[2]).alias("severity")
        ))
    counts = orphan_counts(star, checks) if checks else star.orders.sparkSession.createDataFrame([], "check int, count bigint")
    return counts.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))


def range_text(first: Column, last: Column, rows: Column) -> Column:
    return F.concat(
        F.lit("Orders from "), F.coalesce(first.cast("string"), F.lit("None")),
        F.lit(" to "), F.coalesce(last.cast("string"), F.lit("None")),
        F.lit(" ("), F.format_number(rows, 0), F.lit(" total)"),
    )


def _date_range(star: Star) -> DataFrame:
    text = range_text(F.min("order_date"), F.max("order_date"), F.count(F.lit(1)))
    return _row(star.orders.agg(text.alias("desc")), "Date Range", F.col("desc"), F.lit(0), "info")


def _row(rows: DataFrame, name: str, desc: Column, count: Column, severity: str) -> DataFrame:
    return rows.select(
        F.lit(name).alias("name"), desc.alias("desc"), count.cast("bigint").alias("count"), F.lit(severity).alias("severity")
    )


def _item_values(star: Star) -> DataFrame:
    """Zero sales and bad quantities in one pass over the items."""
    counts = star.order_items.agg(
        F.count_if(F.col("sales").isNull() | (F.col("sales") == 0)).alias("sales"),
        F.count_if(F.col("quantity") <= 0).alias("quantity"),
    )
    entries = [
        F.struct(F.lit(name).alias("name"), F.lit(desc).alias("desc"), F.col(column).alias("count"), F.lit("warning").alias("severity"))
        for name, desc, column in (
            ("Zero/Null Sales", "Line items with no revenue value", "sales"),
            ("Bad Quantities", "Line items with zero or negative qty", "quantity"),
        )
    ]
    return counts.select(F.inline(F.array(*entries)))


def table_counts(star: Star) -> DataFrame:
    """(table, rows, present) per table."""
    counts = None
    for name, rows in star.tables().items():
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def table_sizes(star: Star) -> DataFrame:
    counts = table_counts(star)
    texts = [
        F.concat(F.lit(f"{name}: "), F.format_number(F.max(F.when(F.col("table") == name, F.col("rows"))), 0))
        for name in star.tables()
    ]
    return _row(counts.agg(F.concat_ws(" · ", *texts).alias("desc")), "Table Sizes", F.col("desc"), F.lit(0), "info")


# Each builder yields one row per name.
CHECKS: tuple[tuple[tuple[str, ...], Callable[[Star], DataFrame]], ...] = (
    (tuple(check[0] for check in ORPHAN_CHECKS.values()), _orphans),
    (("Date Range",), _date_range),
    (("Zero/Null Sales", "Bad Quantities"), _item_values),
    (("Table Sizes",), table_sizes),
)


def integrity_checks(star: Star) -> DataFrame:
    """name, desc, count and severity of every check.

    A check that the analyser refuses, for instance for a missing column, yields count
    -1 with severity error, and the others go on.
    """
    spark = star.orders.sparkSession
    result = None
    for names, build in CHECKS:
        try:
            rows = build(star)
        except PySparkException:
            failed = [(name, "Check failed", -1, "error") for name in names]
            rows = spark.createDataFrame(failed, "name string, desc string, count bigint, severity string")
        result = rows if result is None else result.unionByName(rows)
    return result


def classified(checks: DataFrame) -> DataFrame:
    """Checks with display class and label."""
    count, severity = F.col("count"), F.col("severity")
    display = (
        F.when(count == 0, "pass").when(count == -1, "fail").when(severity == "critical", "fail")
        .when(severity == "warning", "warn").otherwise("pass")
    )
    label = F.when(count > 0, F.concat(count.cast("string"), F.lit(" issue(s)"))).when(count == 0, "OK").otherwise("Error")
    return checks.select("*", display.alias("check_class"), label.alias("label"))


def table_presence(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(table, present, rows, ok) of the five tables in the catalog."""
    result = None
    for name in STAR_SCHEMAS:
        if spark.catalog.tableExists(prefix + name):
            counted = spark.table(prefix + name).agg(F.count(F.lit(1)).alias("rows"))
            row = counted.select(F.lit(name).alias("table"), F.lit(True).alias("present"), "rows")
        else:
            row = spark.range(1).select(F.lit(name).alias("table"), F.lit(False).alias("present"), F.lit(0).cast("bigint").alias("rows"))
        result = row if result is None else result.unionByName(row)
    return result.withColumn("ok", F.col("present") & (F.col("rows") > 0))
