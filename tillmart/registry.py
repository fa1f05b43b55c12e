"""Every operator as a query on the test tables: name -> (session, folder) -> rows."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.functions.numbers import parse_amount, parse_number
from tillmart.functions.text import null_if_token
from tillmart.operators import batch_log, cleaning, intake, integrity, merge, normalise, quality
from tillmart.operators.integrity_ledger import IntegrityLedger
from tillmart.operators.staging import scratch_path, staging_scope
from tillmart.plans import cohorts, funnel, measures, overview, questions, rankings, trends
from tillmart.plans.star import Slice, Star
from tillmart.schemas import CANONICAL_COLUMNS, ISSUE
from tillmart.sources import sample_tables, sample_uploads
from tillmart.sources.flat_file import read_flat_csv, write_csv
from tillmart.sources.sample_uploads import AS_OF
from tillmart.sources.store import StarStore
from tillmart.streaming.events import window_totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SLICE = Slice(year=1997, market="ASIA", segment="HOUSEHOLD")
VIEW_PREFIX = "till_"


def as_report(rows: DataFrame) -> DataFrame:
    """Plain result types: exact decimals become doubles, dates text, whole numbers bigint."""
    columns = []
    for entry in rows.schema:
        column = F.col(entry.name)
        if isinstance(entry.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(entry.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(entry.dataType, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(entry.name))
    return rows.select(*columns)


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_report(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


def star_query(name: str, build: Callable[[Star], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return as_report(build(sample_tables.star(spark, sf_dir)))

    QUERIES[name] = run


def batch_query(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query on the scores of the faulty batches, one per order month."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sample_uploads.faulty_batches(spark, sf_dir)
        return as_report(build(quality.score_batches(rows, AS_OF.date(), ["batch_key"])))

    QUERIES[name] = run


# --- reports -------------------------------------------------------------------------

star_query("filter_values", overview.filter_values)
star_query("kpis", overview.kpis)
star_query("kpis_filtered", lambda star: overview.kpis(star, SLICE))
star_query("monthly_trend", overview.monthly_trend)
star_query("monthly_trend_filtered", lambda star: overview.monthly_trend(star, SLICE))
star_query("sales_by_category", overview.sales_by_category)
star_query("sales_by_category_filtered", lambda star: overview.sales_by_category(star, SLICE))
star_query("category_share", overview.category_share)
star_query("revenue_by_market", overview.revenue_by_market)
star_query("top8_customers", overview.top_customers_by_name)
star_query("top6_products", overview.top_products_by_name)
star_query("top10_customers", rankings.top_customers)
star_query("top10_products", rankings.top_products)
star_query("category_rank", rankings.category_rank)
star_query("top3_customers", rankings.top_customers_with_orders)
star_query("monthly_running_total", trends.monthly_running_total)
star_query("mom_growth", trends.growth)
star_query("mom_growth_unrounded", trends.growth_unrounded)
star_query("cohort_retention", cohorts.retention)
star_query("cohort_retention_filtered", lambda star: cohorts.retention(star, Slice(market="ASIA", segment="HOUSEHOLD")))
star_query("cohort_retention_year", lambda star: cohorts.retention(star, Slice(year=1997)))
star_query("customer_cohorts", cohorts.customer_cohorts)
star_query("cohort_sizes", cohorts.cohort_sizes)
star_query("retention_matrix", cohorts.retention_matrix)
star_query("retention_summary", cohorts.retention_summary)
star_query("estimated_funnel", funnel.estimated_funnel)
star_query("funnel_summary", funnel.funnel_summary)
star_query("funnel_steps", funnel.funnel_steps)
star_query("q_top5_customers", questions.best_customers)
star_query("q_march_sales", questions.sales_of_month)
star_query("q_top5_products", questions.best_products)
star_query("q_daily_sales", questions.latest_days)
star_query("bi_measures", measures.measures)
star_query("bi_measures_sliced", lambda star: measures.measures(star, scope=SLICE))
star_query("bi_measures_by_market", lambda star: measures.measures(star, "market"))
star_query("bi_measures_by_month", lambda star: measures.measures(star, "year_month"))
star_query("bi_measures_by_customer", lambda star: measures.measures(star, "customer_name"))
star_query("bi_measures_by_category", measures.measures_by_category)
star_query("bi_measures_by_category_sliced", lambda star: measures.measures_by_category(star, SLICE))
star_query("bi_orders_by_category", measures.orders_by_category)


def _without_one_month(star: Star) -> Star:
    return star.with_tables(orders=star.orders.where("date_format(order_date, 'yyyy-MM') <> '1998-05'"))


star_query("bi_prev_month", lambda star: measures.previous_month(_without_one_month(star)))
star_query("bi_mom_growth", lambda star: measures.month_growth(_without_one_month(star)))
star_query("mom_growth_gap", lambda star: trends.growth(_without_one_month(star)))


@query
def short_labels(spark, sf_dir):
    star = sample_tables.star(spark, sf_dir)
    customers = star.customers.withColumn("customer_name", F.concat_ws(" ", "customer_name", "segment"))
    products = star.products.withColumn("product_name", F.concat_ws(" ", "product_name", "sub_category"))
    return overview.short_labels(star.with_tables(customers=customers, products=products))


@query
def question_routing(spark, sf_dir):
    turns = sample_tables.table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    asked = (
        F.when(kind == 0, F.concat(F.lit("Who are the TOP 5 customers? "), "text"))
        .when(kind == 1, F.concat("text", F.lit(" Sales in March, please")))
        .when(kind == 2, F.concat(F.lit("Our Best Selling Product: "), "text"))
        .when(kind == 3, F.concat("text", F.lit(" top product and best customers")))
        .otherwise(F.col("text"))
    )
    return questions.route_questions(turns.select(asked.alias("question")))


@query
def adhoc_sql(spark, sf_dir):
    questions.register_views(sample_tables.star(spark, sf_dir), VIEW_PREFIX)
    text = f"""
        SELECT c.segment, l.market, count(*) AS lines, sum(i.quantity) AS units
        FROM {VIEW_PREFIX}order_items i
        JOIN {VIEW_PREFIX}orders o ON i.order_id = o.order_id
        JOIN {VIEW_PREFIX}customers c ON o.customer_id = c.customer_id
        JOIN {VIEW_PREFIX}locations l ON o.location_id = l.location_id
        WHERE o.order_date >= :start
        GROUP BY c.segment, l.market
    """
    rows, error = questions.run_select(spark, text, start=dt.date(1998, 1, 1))
    if error:
        raise ValueError(error)
    return rows


@query
def table_presence(spark, sf_dir):
    questions.register_views(sample_tables.star(spark, sf_dir), VIEW_PREFIX)
    return integrity.table_presence(spark, VIEW_PREFIX)


# --- reading and cleaning ------------------------------------------------------------


@query
def read_flat_csv_rows(spark, sf_dir):
    path = scratch_path(spark, "upload")
    write_csv(sample_uploads.untidy_upload(sample_uploads.flat_lines(spark, sf_dir)), path, "gzip")
    rows = read_flat_csv(spark, path)
    names = {"Order No": "order_no", "Buyer": "buyer", "Item ID": "item_id", "ZIP": "zip", "Product Category": "category", "Sales Rep": "rep"}
    return rows.select(*[F.col(f"`{header}`").alias(name) for header, name in names.items()])


@query
def read_quoted_csv(spark, sf_dir):
    """Values with line breaks, commas and quotes, written as CSV parts and read back."""
    path = scratch_path(spark, "quoted")
    number, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    said = F.concat(F.lit('said "'), number.cast("string"), F.lit('",\nthen '), priority, F.lit("\n"))
    note = F.when(number % 3 == 0, said).when(number % 5 != 0, priority)
    write_csv(sample_tables.table(spark, sf_dir, "orders").select(number.alias("Order No"), note.alias("Note"), F.col("o_orderstatus").alias("State")), path)
    rows = read_flat_csv(spark, path, multi_line=True)
    return rows.select(F.col("Order No").alias("order_no"), F.col("Note").alias("note"), F.col("State").alias("state"))


@query
def normalize_null_tokens(spark, sf_dir):
    lines = sample_tables.sale_lines(spark, sf_dir)
    token = (
        F.when(F.col("l_linenumber") == 1, "NA").when(F.col("l_linenumber") == 2, " NA").when(F.col("l_linenumber") == 3, "n/a")
        .when(F.col("l_linenumber") == 4, "nil").when(F.col("l_linenumber") == 5, "").otherwise(F.col("l_returnflag"))
    )
    return lines.select(null_if_token(token).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("rows"))


@query
def column_mapping(spark, sf_dir):
    """Source header of each canonical column and the rows it fills; unmapped headers are listed as they come."""
    upload = sample_uploads.untidy_upload(sample_uploads.flat_lines(spark, sf_dir))
    rows, mapping = cleaning.select_canonical(upload)
    sources = mapping.source_names()
    counts = rows.agg(*[F.count(name).alias(name) for name in sources])
    entries = [
        F.struct(F.lit(name).alias("canonical"), F.lit(source).alias("source"), F.col(name).alias("filled"))
        for name, source in sources.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


@query
def clean_numbers(spark, sf_dir):
    lines = sample_uploads.flat_lines(spark, sf_dir)
    key = F.col("l_orderkey")
    profit = F.when(F.col("l_linenumber") == 7, "12%").otherwise(sample_uploads.money_text(F.col("profit"), key))
    return lines.select(
        "order_id",
        parse_number(sample_uploads.money_text(F.col("sales"), key)).alias("sales"),
        parse_amount(profit).alias("profit"),
        parse_number(F.concat(F.lit("1_0"), F.col("l_linenumber"), F.lit("e2"))).alias("scientific"),
    )


@query
def clean_dates(spark, sf_dir):
    orders = sample_tables.orders(spark, sf_dir)
    text = orders.select("order_id", sample_uploads.date_text(F.col("order_date"), F.col("order_id")).alias("order_date"))
    return cleaning.clean_date_columns(text, AS_OF)[0]


@query
def bulk_date_defaults(spark, sf_dir):
    rows = sample_uploads.flat_lines(spark, sf_dir)
    text = rows.select(
        "order_id",
        sample_uploads.date_text(F.col("order_date"), F.col("l_orderkey")).alias("order_date"),
        sample_uploads.date_text(F.col("ship_date"), F.col("l_partkey")).alias("ship_date"),
    )
    return cleaning.bulk_dates(text)


@query
def missing_date_columns(spark, sf_dir):
    rows = sample_uploads.flat_lines(spark, sf_dir)
    neither = cleaning.clean_date_columns(rows.select("order_id"), AS_OF)[0]
    only_order = cleaning.clean_date_columns(rows.select("order_id", F.col("order_date").cast("string")), AS_OF)[0]
    return (
        neither.withColumn("kind", F.lit("neither")).unionByName(only_order.withColumn("kind", F.lit("order_date only")))
        .groupBy("kind", "order_date", "ship_date").agg(F.count(F.lit(1)).alias("rows"))
    )


@query
def missing_numeric_columns(spark, sf_dir):
    rows = sample_uploads.flat_lines(spark, sf_dir).select("order_id", F.col("sales").cast("string").alias("sales"))
    return cleaning.clean_amount_columns(rows)[0]


@query
def text_defaults(spark, sf_dir):
    rows = sample_uploads.flat_lines(spark, sf_dir)
    columns = sample_uploads.untidy_columns()
    partial = rows.select(*[columns[name].alias(name) for name in ("customer_name", "segment", "category", "country", "market")])
    filled = cleaning.fill_text(partial)
    return filled.groupBy(*filled.columns).agg(F.count(F.lit(1)).alias("rows"))


def _numbered_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = [*CANONICAL_COLUMNS, *sample_uploads.UPLOAD_KEYS]
    lines = sample_uploads.numbered_lines(sample_uploads.joined_lines(spark, sf_dir), "row_no", keep)
    return sample_uploads.untidy_upload(lines, "row_no")


def _numbered_columns(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Some canonical columns of the upload, each written as in the whole one; no other column is numbered with them."""
    columns = sample_uploads.untidy_columns()
    keep = [*names, *sample_uploads.UPLOAD_KEYS]
    lines = sample_uploads.numbered_lines(sample_uploads.joined_lines(spark, sf_dir), "row_no", keep)
    return lines.select(*[columns[name].alias(header) for header, name in sample_uploads.UPLOAD_HEADER if name in names], "row_no")


@query
def generated_ids(spark, sf_dir):
    rows = cleaning.select_canonical(_numbered_columns(spark, sf_dir, "order_id", "customer_id", "product_id"))[0]
    return cleaning.fill_ids(rows).select("order_id", "customer_id", "product_id")


@query
def generated_order_ids(spark, sf_dir):
    rows = cleaning.select_canonical(_numbered_columns(spark, sf_dir, "sales"))[0]
    return cleaning.fill_order_ids(rows, AS_OF)[0].select("order_id")


@query
def clean_batch(spark, sf_dir):
    return cleaning.clean_batch(_numbered_upload(spark, sf_dir), AS_OF).rows.select(*CANONICAL_COLUMNS)


# --- normalising ---------------------------------------------------------------------


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_uploads.in_line_order(sample_uploads.flat_lines(spark, sf_dir))


@query
def dim_customers(spark, sf_dir):
    return normalise.customers(sample_uploads.first_customer_lines(spark, sf_dir))


@query
def dim_products(spark, sf_dir):
    return normalise.products(sample_uploads.first_product_lines(spark, sf_dir))


@query
def dim_locations(spark, sf_dir):
    return normalise.locations(_ordered(spark, sf_dir))


@query
def attach_location(spark, sf_dir):
    """Places with a null half of the time: nulls match nulls."""
    rows = _ordered(spark, sf_dir).withColumn("state", F.when(F.col("country") > "NATION_2", F.col("state")))
    placed = normalise.attach_location(rows, normalise.locations(rows))
    return placed.groupBy("location_id", "country", "state").agg(F.count(F.lit(1)).alias("rows"))


@query
def dim_orders(spark, sf_dir):
    rows = _ordered(spark, sf_dir).withColumn("ship_mode", F.when(F.col("l_linenumber") > 2, F.col("ship_mode")))
    rows = rows.withColumn("order_id", F.when(F.col("l_orderkey") % 20 != 0, F.col("order_id")))
    return normalise.orders(rows, normalise.locations(rows))


@query
def fact_order_items(spark, sf_dir):
    keep = ("order_id", "product_id", "sales", "quantity", "discount", "profit", "l_orderkey")
    rows = sample_uploads.numbered_lines(sample_uploads.joined_lines(spark, sf_dir), keep=keep)
    return normalise.order_items(rows.withColumn("order_id", F.when(F.col("l_orderkey") % 20 != 0, F.col("order_id"))))


@query
def bulk_load(spark, sf_dir):
    """The whole first load, from CSV files to stored tables: rows and sums per table."""
    folder = scratch_path(spark, "bulk")
    write_csv(sample_uploads.flat_lines(spark, sf_dir).select(*CANONICAL_COLUMNS), f"{folder}/upload", "gzip")
    store = StarStore(spark, f"{folder}/store")
    intake.bulk_load(store, f"{folder}/upload", AS_OF)
    return _contents(store)


def _contents(store: StarStore) -> DataFrame:
    star = store.star()
    sums = star.order_items.agg(F.sum("sales").alias("sales"), F.max("order_item_id").alias("rows"))
    shipping = star.orders.agg(F.sum("shipping_cost").alias("sales"), F.count(F.lit(1)).alias("rows"))
    counts = integrity.table_counts(star).select("table", "rows", F.lit(None).cast("double").alias("amount"))
    return counts.unionByName(
        sums.select(F.lit("items, highest id and sales").alias("table"), "rows", F.col("sales").cast("double").alias("amount"))
    ).unionByName(
        shipping.select(F.lit("orders, shipping").alias("table"), "rows", F.col("sales").cast("double").alias("amount"))
    )


# --- merging -------------------------------------------------------------------------


def _stored(rows: DataFrame, key: str) -> DataFrame:
    """A stored table that lacks every tenth key; keys are text, as in an upload."""
    kept = rows.where(F.col(key) % 10 != 0)
    return kept if key == "location_id" else kept.withColumn(key, F.col(key).cast("string"))


@query
def merge_customers(spark, sf_dir):
    return merge.new_customers(sample_uploads.first_customer_lines(spark, sf_dir), _stored(sample_tables.customers(spark, sf_dir), "customer_id"))


@query
def merge_products(spark, sf_dir):
    return merge.new_products(sample_uploads.first_product_lines(spark, sf_dir), _stored(sample_tables.products(spark, sf_dir), "product_id"))


def _named_by_line(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Numbered lines of an upload in which the same customer or product is named otherwise on each line."""
    rows = sample_uploads.numbered_lines(sample_uploads.joined_lines(spark, sf_dir), keep=(name, *columns, "l_suppkey", "l_linenumber"))
    seller = F.concat(F.lit(" / "), F.col("l_suppkey").cast("string"), F.lit(" / "), F.col("l_linenumber").cast("string"))
    return rows.withColumn(name, F.concat(name, seller))


_CUSTOMER = ("customer_name", "customer_id", "segment")
_PRODUCT = ("product_name", "product_id", "category", "sub_category")


@query
def first_customers(spark, sf_dir):
    return normalise.customers(_named_by_line(spark, sf_dir, *_CUSTOMER))


@query
def first_products(spark, sf_dir):
    return normalise.products(_named_by_line(spark, sf_dir, *_PRODUCT))


@query
def merge_first_customers(spark, sf_dir):
    stored = _stored(sample_tables.customers(spark, sf_dir), "customer_id")
    return merge.new_customers(_named_by_line(spark, sf_dir, *_CUSTOMER), stored)


@query
def merge_first_products(spark, sf_dir):
    stored = _stored(sample_tables.products(spark, sf_dir), "product_id")
    return merge.new_products(_named_by_line(spark, sf_dir, *_PRODUCT), stored)


@query
def merge_locations(spark, sf_dir):
    return merge.new_locations(_ordered(spark, sf_dir), _stored(sample_tables.locations(spark, sf_dir), "location_id"))


@query
def merge_orders(spark, sf_dir):
    """Some orders get a place mixed from two of their rows, which falls back to id 1."""
    rows = _ordered(spark, sf_dir)
    late = F.col("l_linenumber") >= 4
    mixed = F.col("l_orderkey") % 30 == 0
    rows = rows.withColumn("city", F.when(~mixed, F.lit("City")).when(late, F.lit("Hidden City")))
    rows = rows.withColumn("state", F.when(~late, F.lit("State")))
    _, ids = merge.place_ids(rows, _stored(sample_tables.locations(spark, sf_dir), "location_id"))
    new = merge.new_orders(rows, ids, _stored(sample_tables.orders(spark, sf_dir), "order_id"))
    return new.select("order_id", "order_date", "ship_date", "customer_id", "shipping_cost", (F.col("location_id") == 1).alias("fell_back"))


@query
def merge_order_items(spark, sf_dir):
    rows, keep = sample_uploads.joined_lines(spark, sf_dir), ("order_id", "product_id", "sales", "quantity", "discount", "profit")
    stored = normalise.order_items(sample_uploads.numbered_lines(rows.where("l_orderkey % 10 <> 0"), keep=keep))
    batch = sample_uploads.numbered_lines(rows.where("l_orderkey % 10 = 0"), keep=keep)
    return merge.new_order_items(batch.withColumn("quantity", F.col("quantity") + 0.75), stored)


@query
def whole_merge(spark, sf_dir):
    """A store of nine tenths of the orders, then a batch of all lines merged and committed: what the store holds then."""
    lines = sample_uploads.joined_lines(spark, sf_dir)
    store = StarStore(spark, scratch_path(spark, "store"))
    empty = store.star()
    for number, part in enumerate((lines.where("l_orderkey % 10 <> 0"), lines)):
        with staging_scope(spark):
            batch = sample_uploads.numbered_lines(part, keep=CANONICAL_COLUMNS)
            new = merge.plan_merge(batch, store.star() if number else empty)
            store.commit(new, batch_log.log_entries(_accepted(spark, number), AS_OF, number), f"part-{number}")
    return _contents(store)


@query
def exported_tables(spark, sf_dir):
    """The stored tables written as CSV and read again: rows and first and last key of each."""
    store = StarStore(spark, scratch_path(spark, "store"))
    _commit(store, sample_tables.star(spark, sf_dir), 0)
    folder = scratch_path(spark, "export")
    store.export_csv(folder)
    result = None
    for name, key in (("customers", "customer_id"), ("products", "product_id"), ("locations", "location_id"), ("orders", "order_id"), ("order_items", "order_id")):
        number = F.col(key).cast("bigint")
        rows = read_flat_csv(spark, [f"{folder}/cleaned_{name}"]).agg(
            F.count(F.lit(1)).alias("rows"), F.min(number).alias("first_key"), F.max(number).alias("last_key")
        ).select(F.lit(name).alias("table"), "rows", "first_key", "last_key")
        result = rows if result is None else result.unionByName(rows)
    return result


# --- gate, log, integrity --------------------------------------------------------------


@query
def quality_checks(spark, sf_dir):
    rows = sample_uploads.faulty_batches(spark, sf_dir)
    return quality.issues(quality.score_batches(rows, AS_OF.date()))


batch_query("quality_issues", lambda scores: quality.issues(scores, "batch_key"))
batch_query("health_score", lambda scores: scores.select("batch_key", "row_count", "health_score"))
batch_query("batch_verdict", lambda scores: scores.groupBy("status").agg(F.count(F.lit(1)).alias("batches"), F.sum("row_count").alias("rows")))
batch_query(
    "issue_classes",
    lambda scores: quality.classified_issues(scores, "batch_key").select("batch_key", "name", "issue_class", "checks_passed"),
)
batch_query(
    "batch_disposition",
    lambda scores: quality.disposition(scores, "hold").select("batch_key", "status", "action", "accepted_rows", "rejected_rows"),
)
batch_query(
    "batch_disposition_forced",
    lambda scores: quality.disposition(scores, "merge").select("batch_key", "status", "action", "accepted_rows", "rejected_rows"),
)


def _log(scores: DataFrame) -> DataFrame:
    return batch_log.log_entries(quality.disposition(scores), AS_OF)


batch_query("log_batch", _log)
batch_query("batch_history", lambda scores: batch_log.history(_log(scores)).select("batch_id", "filename", "status", "health_score"))
batch_query(
    "batch_history_table",
    lambda scores: batch_log.history_table(_log(scores), 20).select("ID", "File", "Rows", "Status", "Accepted", "Rejected"),
)
batch_query("pending_alerts", lambda scores: batch_log.pending(_log(scores)).select("batch_id", "filename", "row_count", "health_score"))
batch_query("pending_count", lambda scores: batch_log.pending_count(_log(scores)))


def _some_unreadable(log: DataFrame) -> DataFrame:
    broken = F.col("batch_id") % 5 == 0
    return log.withColumn("issues_json", F.when(broken, F.lit("{not json")).otherwise(F.col("issues_json")))


batch_query("failed_issues", lambda scores: batch_log.failed_issues(_some_unreadable(_log(scores))))


def _damaged(star: Star) -> Star:
    """Every tenth referenced key is gone, and some items have no sales or a negative quantity."""
    items = star.order_items.withColumns({
        "sales": F.when(F.col("product_id") % 50 == 1, 0).when(F.col("product_id") % 50 == 2, F.lit(None)).otherwise(F.col("sales")),
        "quantity": F.when(F.col("order_id") % 7 == 0, -F.col("quantity")).otherwise(F.col("quantity")),
    })
    return Star(
        customers=star.customers.where("customer_id % 10 <> 0"),
        products=star.products.where("product_id % 10 <> 0"),
        locations=star.locations,
        orders=star.orders.where("order_id % 10 <> 0"),
        order_items=items,
    )


def _null_keys(star: Star) -> Star:
    """A null among the customers, null references in the items, and no products at all."""
    return star.with_tables(
        customers=star.customers.withColumn("customer_id", F.when(F.col("customer_id") % 10 != 0, F.col("customer_id"))),
        products=star.products.where("product_id < 0"),
        orders=star.orders.where("order_id % 10 <> 0"),
        order_items=star.order_items.withColumn("order_id", F.when(F.col("order_id") % 15 != 0, F.col("order_id"))),
    )


star_query("integrity_checks", lambda star: integrity.integrity_checks(_damaged(star)))
star_query("integrity_null_keys", lambda star: integrity.integrity_checks(_null_keys(star)))
star_query("integrity_failed_check", lambda star: integrity.classified(integrity.integrity_checks(star.with_tables(products=star.products.drop("product_id")))))
star_query("integrity_classes", lambda star: integrity.classified(integrity.integrity_checks(_damaged(star))).select("name", "check_class", "label"))
star_query("table_sizes", lambda star: integrity.table_sizes(star))


def _accepted(spark: SparkSession, number: int) -> DataFrame:
    entry = f"batch_key string, row_count bigint, issues array<{ISSUE.simpleString()}>, health_score double, status string, accepted_rows bigint, rejected_rows bigint"
    return spark.createDataFrame([(f"b{number}", 1, [], 100.0, "Accepted", 1, 0)], entry)


def _commit(store: StarStore, rows: Star, number: int) -> None:
    rows = rows.with_tables(order_items=rows.order_items.withColumn("order_item_id", F.monotonically_increasing_id()))
    store.commit(rows, batch_log.log_entries(_accepted(store.spark, number), AS_OF, number), f"part-{number}")


def _third(star: Star, customers: int, products: int, orders: int, items: int) -> Star:
    """One third of each table, by its key; locations come with the first third of the orders."""
    return Star(
        customers=star.customers.where(F.col("customer_id") % 3 == customers), products=star.products.where(F.col("product_id") % 3 == products),
        locations=star.locations.where(F.lit(orders == 0)), orders=star.orders.where(F.col("order_id") % 3 == orders),
        order_items=star.order_items.where(F.col("order_id") % 3 == items),
    )


@query
def compacted_table_sizes(spark, sf_dir):
    """Three commits merged into one generation."""
    store = StarStore(spark, scratch_path(spark, "store"))
    for part in range(3):
        _commit(store, _third(sample_tables.star(spark, sf_dir), part, part, part, part), part)
    store.compact()
    return integrity.table_sizes(store.star())


@query
def integrity_after_commits(spark, sf_dir):
    """Checks kept up to date over three commits, two of them in one update; some keys come before, some after the rows that refer to them."""
    store = StarStore(spark, scratch_path(spark, "store"))
    ledger = IntegrityLedger(store)
    for part in range(3):
        _commit(store, _third(_damaged(sample_tables.star(spark, sf_dir)), part, 2 - part, part, (part + 1) % 3), part)
        if part == 0:
            ledger.update()
    return ledger.checks()


# --- events --------------------------------------------------------------------------


@query
def events_hourly(spark, sf_dir):
    return window_totals(sample_tables.table(spark, sf_dir, "events"))


@query
def observed_funnel(spark, sf_dir):
    return funnel.observed_funnel(sample_tables.table(spark, sf_dir, "events"))


# The name of the reading operator, kept free above for the function itself.
QUERIES["read_flat_csv"] = QUERIES.pop("read_flat_csv_rows")
