"""Table schemas, the canonical flat layout and its header aliases."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 4)

# An amount as written, before it is rounded for the store.
EXACT = T.DecimalType(38, 16)

# The canonical columns of an upload and the header spellings accepted for each,
# first match wins.
COLUMN_ALIASES = {
    "order_id": ("order id", "order_id", "orderid", "order no", "order number"),
    "order_date": ("order date", "order_date", "orderdate", "date"),
    "ship_date": ("ship date", "ship_date", "shipdate", "shipping date"),
    "ship_mode": ("ship mode", "ship_mode", "shipmode", "shipping mode"),
    "customer_id": ("customer id", "customer_id", "customerid", "cust id"),
    "customer_name": ("customer name", "customer_name", "customername", "client", "buyer"),
    "segment": ("segment", "customer segment"),
    "product_id": ("product id", "product_id", "productid", "item id"),
    "product_name": ("product name", "product_name", "productname", "item", "item name"),
    "category": ("category", "product category"),
    "sub_category": ("sub-category", "sub_category", "subcategory", "sub category"),
    "city": ("city",),
    "state": ("state", "province"),
    "country": ("country", "nation"),
    "postal_code": ("postal code", "postal_code", "postalcode", "zip", "zip code", "zipcode"),
    "market": ("market", "region market"),
    "region": ("region",),
    "sales": ("sales", "revenue", "amount", "total sales"),
    "quantity": ("quantity", "qty", "units", "count"),
    "discount": ("discount", "disc", "discount rate"),
    "profit": ("profit", "net profit", "margin"),
    "shipping_cost": ("shipping cost", "shipping_cost", "freight"),
    "order_priority": ("order priority", "order_priority", "priority"),
}
CANONICAL_COLUMNS = tuple(COLUMN_ALIASES)

# What a blank or absent text column becomes.
TEXT_DEFAULTS = {
    "customer_name": "Unknown Customer",
    "segment": "Consumer",
    "product_name": "Unknown Product",
    "category": "General",
    "sub_category": "Other",
    "city": "Unknown",
    "state": "Unknown",
    "country": "Unknown",
    "market": "Unknown",
    "region": "Unknown",
    "postal_code": "N/A",
    "ship_mode": "Standard Class",
    "order_priority": "Medium",
}

# Id columns and the prefix of the ids generated for blank ones.
GENERATED_IDS = {"customer_id": "CUST-", "product_id": "PROD-"}

# Numeric columns and what an absent column becomes.
NUMERIC_DEFAULTS = {"sales": 0, "profit": 0, "discount": 0, "shipping_cost": 0, "quantity": 1}

# The spellings of a missing value that the common CSV readers turn into null.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

LOCATION_KEY = ("country", "market", "region", "state", "city", "postal_code")

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("segment", T.StringType()),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sub_category", T.StringType()),
])
LOCATIONS = T.StructType(
    [T.StructField("location_id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in LOCATION_KEY]
)
ORDERS = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("ship_date", T.DateType()),
    T.StructField("ship_mode", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("location_id", T.LongType()),
    T.StructField("shipping_cost", AMOUNT),
    T.StructField("order_priority", T.StringType()),
])
ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("sales", AMOUNT),
    T.StructField("quantity", T.LongType()),
    T.StructField("discount", AMOUNT),
    T.StructField("profit", AMOUNT),
])
STAR_SCHEMAS = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "locations": LOCATIONS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

ISSUE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("desc", T.StringType()),
    T.StructField("passed", T.BooleanType()),
])
INGESTION_LOG = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("batch_key", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()),
    T.StructField("filename", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("health_score", T.DoubleType()),
    T.StructField("issues_json", T.StringType()),
    T.StructField("accepted_rows", T.LongType()),
    T.StructField("rejected_rows", T.LongType()),
])
