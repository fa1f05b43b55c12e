"""Questions answered from keyword templates, and caller-written SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException, ParseException, PySparkException

from tillmart.functions.dates import month_label
from tillmart.operators.staging import stage
from tillmart.plans.rankings import customer_totals, item_totals
from tillmart.plans.star import Star, sold_orders, total


def best_customers(star: Star, limit: int = 5) -> DataFrame:
    sums = customer_totals(star).groupBy("customer_name").agg(
        F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit")
    )
    return sums.orderBy(F.desc("total_sales"), "customer_name").limit(limit)


def sales_of_month(star: Star, month: int = 3) -> DataFrame:
    """Sales of one calendar month, per year."""
    rows = sold_orders(star.with_tables(orders=star.orders.where(F.month("order_date") == month)))
    sums = rows.groupBy(month_label(F.col("order_date")).alias("sales_month")).agg(
        F.sum("sales").alias("total_sales"), F.sum("profit").alias("total_profit")
    )
    return sums.orderBy("sales_month")


def best_products(star: Star, limit: int = 5) -> DataFrame:
    sums = item_totals(star).groupBy("product_name").agg(
        F.sum("quantity").alias("quantity_sold"), F.sum("sales").alias("total_sales")
    )
    return sums.orderBy(F.desc("quantity_sold"), "product_name").limit(limit)


def latest_days(star: Star, limit: int = 10) -> DataFrame:
    """The last days that have sales."""
    sums = sold_orders(star).groupBy("order_date").agg(
        F.sum("sales").alias("daily_sales"), F.sum("profit").alias("daily_profit")
    )
    return sums.orderBy(F.desc("order_date")).limit(limit)


# Phrases, in order of precedence, and the template each one selects.
QUESTION_PHRASES = (
    (("top 5 customers", "best customers"), "best_customers"),
    (("sales in march", "march sales"), "sales_of_month"),
    (("best selling product", "top product"), "best_products"),
)
DEFAULT_TEMPLATE = "latest_days"
TEMPLATES = {
    "best_customers": best_customers,
    "sales_of_month": sales_of_month,
    "best_products": best_products,
    "latest_days": latest_days,
}


def template_of(question: Column) -> Column:
    """Name of the template whose phrase the question contains."""
    text = F.lower(question)
    label = F.lit(None).cast("string")
    for phrases, name in reversed(QUESTION_PHRASES):
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(text, F.lit(phrase))
        label = F.when(hit, name).otherwise(label)
    return F.coalesce(label, F.lit(DEFAULT_TEMPLATE))


def route_questions(questions: DataFrame, column: str = "question") -> DataFrame:
    """Questions per template."""
    return questions.groupBy(template_of(F.col(column)).alias("template")).agg(F.count(F.lit(1)).alias("questions"))


def answer(star: Star, question: str) -> DataFrame:
    """Run the template a single question selects."""
    spark = star.orders.sparkSession
    name = spark.range(1).select(template_of(F.lit(question))).first()[0]
    return TEMPLATES[name](star)


def register_views(star: Star, prefix: str = "") -> None:
    """Expose the five tables to SQL."""
    for name, table in star.tables().items():
        table.createOrReplaceTempView(prefix + name)


# Expressions that run code from outside the query, or tell where files lie.
REFUSED_EXPRESSIONS = {
    "CallMethodViaReflection", "TryReflect", "ScalaUDF", "ScalaUDAF", "ScalaAggregator", "PythonUDF", "PythonUDAF", "PythonUDTF",
    "UnresolvedPolymorphicPythonUDTF", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
}
# Leaves that hold no stored rows.
PLAIN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


def _listed(rows) -> list:
    """A sequence of the JVM as a list."""
    return [rows.apply(number) for number in range(rows.size())]


def _refused_expression(expression) -> str | None:
    kind = expression.getClass().getName()
    if not kind.startswith(EXPRESSIONS) or expression.getClass().getSimpleName() in REFUSED_EXPRESSIONS:
        return f"the query may not use {expression.prettyName()}"
    return next(filter(None, map(_refused_expression, _listed(expression.children()))), None)


def _refused(plan) -> str | None:
    """Why the analysed plan may not run. Its rows come from temporary views, what these read is not looked at."""
    kind, children = plan.getClass().getSimpleName(), _listed(plan.children())
    if kind == "View" and plan.isTempView():
        return None
    if not children and kind not in PLAIN_LEAVES:
        return f"the query may read temporary views only, not {plan.simpleStringWithNodeId()}"
    reasons = [*map(_refused_expression, _listed(plan.expressions())), *map(_refused, _listed(plan.subqueries())), *map(_refused, children)]
    return next(filter(None, reasons), None)


def run_select(spark: SparkSession, sql: str, **params) -> tuple[DataFrame | None, str | None]:
    """(rows, None), or (None, message) when the text is no query, names something unknown or asks for more than it may.

    The text is placed in a FROM clause, where only a query can stand, so a statement
    that would change data or the catalog is refused by the parser before it can run. The
    analysed plan may read temporary views and use built-in functions that stay inside the query.
    """
    text = sql.strip().rstrip(";")
    try:
        rows = spark.sql(f"SELECT * FROM (\n{text}\n)", args=params or None)
    except (AnalysisException, ParseException) as error:
        return None, str(error)
    reason = _refused(rows._jdf.queryExecution().analyzed())
    return (None, reason) if reason else (rows, None)


def fetch_select(spark: SparkSession, sql: str, **params) -> tuple[DataFrame | None, str | None]:
    """As ``run_select``, but run: the rows are a stored table, and an error while running is a message too.

    The table lies in the shared folder, so that an answer of any size is whole and passes through no single process.
    """
    rows, message = run_select(spark, sql, **params)
    if rows is None:
        return None, message
    names = rows.columns  # these may repeat, or hold what Parquet refuses
    numbered = rows.toDF(*[f"c{number}" for number in range(len(names))])
    voids = {column.name: F.col(column.name).cast("string") for column in numbered.schema if column.dataType.typeName() == "void"}
    try:
        return stage(numbered.withColumns(voids) if voids else numbered, "answer").toDF(*names), None
    except PySparkException as error:
        return None, str(error)
