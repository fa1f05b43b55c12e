"""DuckDB statements that state the expected result of each registered query."""

# The star schema over the test tables, as plain SQL.
STAR = """
d_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment FROM customer),
d_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category FROM part),
d_locations AS (
  SELECT n_nationkey AS location_id, n_name AS country, r_name AS market, r_name AS region,
         'Unknown' AS state, 'Unknown' AS city, 'N/A' AS postal_code
  FROM nation JOIN region ON n_regionkey = r_regionkey),
priced AS (
  SELECT l.*, p_retailprice,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS sales,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS shipping_cost,
         CAST(l_quantity AS BIGINT) AS quantity
  FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey),
f_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, sales, quantity, CAST(l_discount AS DECIMAL(4,2)) AS discount,
         CAST(sales - quantity * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS profit, shipping_cost,
         l_linenumber, l_partkey, l_suppkey, l_orderkey, l_returnflag, l_linestatus, l_extendedprice, l_quantity, l_tax,
         CAST(l_shipdate AS DATE) AS l_shipdate
  FROM priced),
f_orders AS (
  SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id, c_nationkey AS location_id,
         o_orderpriority AS order_priority
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
j4 AS (
  SELECT i.*, o.order_date, o.customer_id, o.location_id, c.customer_name, c.segment, l.market
  FROM f_items i JOIN f_orders o USING (order_id) JOIN d_customers c USING (customer_id) JOIN d_locations l USING (location_id)),
flat AS (
  SELECT i.order_id, o.order_date, i.l_shipdate AS ship_date, 'Standard Class' AS ship_mode, o.customer_id, c.customer_name,
         c.segment, i.product_id, p.product_name, p.category, p.sub_category, l.city, l.state, l.country, l.postal_code,
         l.market, l.region, i.sales, i.quantity, i.discount, i.profit, i.shipping_cost, o.order_priority, o.location_id,
         i.l_linenumber, i.l_suppkey,
         row_number() OVER (ORDER BY i.l_orderkey, i.l_linenumber, i.l_partkey, i.l_suppkey, i.l_extendedprice, i.l_quantity,
                            i.discount, i.l_tax, i.l_shipdate, i.l_returnflag, i.l_linestatus) AS row_no
  FROM f_items i JOIN f_orders o USING (order_id) JOIN d_customers c USING (customer_id)
       JOIN d_products p USING (product_id) JOIN d_locations l USING (location_id))
"""

_IN_SLICE = "order_date >= DATE '1997-01-01' AND order_date < DATE '1998-01-01' AND market = 'ASIA' AND segment = 'HOUSEHOLD'"


def _star(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([STAR.strip(), *more]) + "\n" + select


def _round2(value: str) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def _exact2(value: str) -> str:
    return f"ROUND(CAST({value} AS DECIMAL(38,6)), 2)"


def _pct(part: str, whole: str) -> str:
    return _round2(f"CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0) * 100")


def _d(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def _kpis(where: str) -> str:
    return _star(f"""
SELECT {_d('COALESCE(SUM(sales), 0)')} AS revenue, {_d('COALESCE(SUM(profit), 0)')} AS profit,
       COUNT(DISTINCT order_id) AS orders, COUNT(DISTINCT customer_id) AS customers,
       CASE WHEN COALESCE(SUM(sales), 0) > 0 THEN {_d('SUM(profit)')} / {_d('SUM(sales)')} * 100 ELSE 0.0::DOUBLE END AS margin_pct
FROM j4 WHERE {where}""")


def _trend(where: str) -> str:
    return _star(f"""
SELECT strftime(order_date, '%Y-%m') AS month, {_d('SUM(sales)')} AS sales, {_d('SUM(profit)')} AS profit
FROM j4 WHERE {where} GROUP BY 1""")


def _by_category(where: str) -> str:
    return _star(f"SELECT category, {_d('SUM(sales)')} AS sales FROM j4 JOIN d_products USING (product_id) WHERE {where} GROUP BY 1")


_MONTHS = """months AS (
  SELECT strftime(order_date, '%Y-%m') AS month, SUM(sales) AS sales, SUM(profit) AS profit, SUM(quantity) AS quantity
  FROM f_items JOIN f_orders USING (order_id) {where} GROUP BY 1)"""


def _growth(where: str) -> str:
    return _star(
        f"""
SELECT month AS revenue_month, {_d('cur')} AS current_month_sales, {_d('prev')} AS previous_month_sales,
       {_d('cur - prev')} AS absolute_growth, {_pct('(cur - prev)', 'prev')} AS growth_percentage
FROM (SELECT month, cur, LAG(cur) OVER (ORDER BY month) AS prev FROM (SELECT month, {_exact2('sales')} AS cur FROM months))""",
        _MONTHS.format(where=where),
    )


def _cohorts(scope: str) -> str:
    return f"""
quarters AS (
  SELECT DISTINCT customer_id, year(order_date) * 4 + quarter(order_date) - 1 AS q FROM {scope}),
starts AS (SELECT customer_id, MIN(q) AS q0 FROM quarters GROUP BY 1),
sizes AS (SELECT q0, COUNT(*) AS cohort_size FROM starts GROUP BY 1),
retained AS (
  SELECT (q0 // 4) || '-Q' || (q0 % 4 + 1) AS cohort_quarter, cohort_size, q - q0 AS elapsed_quarters,
         COUNT(DISTINCT customer_id) AS active_customers
  FROM quarters JOIN starts USING (customer_id) JOIN sizes USING (q0)
  WHERE q - q0 BETWEEN 0 AND 11 GROUP BY q0, cohort_size, q - q0),
rates AS (SELECT *, {_pct('active_customers', 'cohort_size')} AS retention_pct FROM retained)"""


_RETENTION = """SELECT cohort_quarter, cohort_size, CAST(elapsed_quarters AS BIGINT) AS elapsed_quarters, active_customers, retention_pct
FROM rates"""

_FULL_SCOPE = "(SELECT o.* FROM f_orders o JOIN d_customers USING (customer_id) JOIN d_locations USING (location_id))"


def _scope(where: str) -> str:
    return f"(SELECT o.* FROM f_orders o JOIN d_customers USING (customer_id) JOIN d_locations USING (location_id) WHERE {where})"


_FUNNEL_STAGES = (
    ("1. Session Started", "18.5", "22.0"), ("2. Product Viewed", "7.4", "8.5"), ("3. Added to Cart", "3.2", "3.8"),
    ("4. Checkout Initiated", "1.7", "2.0"), ("5. Completed Purchase", "1.0", "1.0"),
)
_FUNNEL = "base AS (SELECT COUNT(DISTINCT order_id) AS n, SUM(sales) AS v FROM j4),\nfunnel AS (\n" + "\nUNION ALL ".join(
    f"SELECT '{stage}' AS stage, CAST(TRUNC(n * {visits}) AS BIGINT) AS visitor_count, "
    f"{_round2(f'v * {value}')} AS estimated_val, {_pct(visits, '18.5')} AS conversion_rate FROM base"
    for stage, visits, value in _FUNNEL_STAGES
) + ")"

_MEASURES = f"""{_d('SUM(sales)')} AS total_sales, {_d('SUM(profit)')} AS total_profit, COUNT(DISTINCT head) AS order_count,
  COALESCE({_d('SUM(profit)')} / NULLIF({_d('SUM(sales)')}, 0), 0) AS profit_margin,
  COALESCE({_d('SUM(sales)')} / NULLIF({_d('COUNT(DISTINCT head)')}, 0), 0) AS average_order_value"""
_FACTS = """facts AS (
  SELECT i.sales, i.profit, i.product_id, o.order_id AS head, o.order_date, customer_name, segment, market
  FROM f_items i FULL JOIN f_orders o ON i.order_id = o.order_id
       LEFT JOIN d_customers c ON o.customer_id = c.customer_id LEFT JOIN d_locations l ON o.location_id = l.location_id)"""


def _measures(select: str, tail: str) -> str:
    return _star(f"SELECT {select}{_MEASURES} FROM facts {tail}", _FACTS)


_CALENDAR = _MONTHS.format(where="WHERE strftime(order_date, '%Y-%m') <> '1998-05'") + """,
calendar AS (
  SELECT m.month, m.sales AS total_sales, p.sales AS prev_month_sales
  FROM months m LEFT JOIN months p ON strftime(CAST(p.month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') = m.month)"""

_TOP_NAMES = f"""
SELECT customer_name, {_d('SUM(sales)')} AS total_sales, {_d('SUM(profit)')} AS total_profit
FROM f_items JOIN f_orders USING (order_id) JOIN d_customers USING (customer_id)
GROUP BY 1 ORDER BY SUM(sales) DESC, customer_name LIMIT 5"""

# Expected text defaults of the untidy upload.
_NAME = "CASE WHEN l_linenumber = 3 THEN {null} WHEN l_linenumber = 2 THEN '  ' ELSE customer_name END"
_ORDER_DATE = "CASE WHEN order_id % 9 = 8 THEN DATE '{default}' ELSE order_date END"
_SHIP_DATE = "CASE WHEN product_id % 9 = 8 THEN {default} ELSE ship_date END"
_CUSTOMER = "CASE WHEN l_linenumber IN (4, 5) THEN 'CUST-' || row_no ELSE CAST(customer_id AS VARCHAR) END"
_PRODUCT = "CASE WHEN product_id % 11 = 0 THEN 'PROD-' || row_no ELSE CAST(product_id AS VARCHAR) END"

# The gate: batches, faults and rules.
_FAULTY = """faulty AS (
  SELECT strftime(order_date, '%Y-%m') AS batch_key, order_date,
         CASE WHEN l_linenumber = 7 THEN -quantity ELSE quantity END AS quantity,
         CASE WHEN product_id % 50 = 0 THEN 0 ELSE sales END AS sales,
         CASE WHEN l_suppkey % 40 = 0 THEN discount + 2 ELSE discount END AS discount,
         CASE WHEN month(order_date) <= 4 OR (month(order_date) <= 8 AND l_suppkey % 2 = 0)
              THEN order_date + 3 ELSE ship_date END AS ship_date,
         CASE WHEN customer_id % 97 = 0 THEN 'Unknown Customer' ELSE customer_name END AS customer_name,
         CASE WHEN product_id % 89 = 0 THEN 'Unknown Product' ELSE product_name END AS product_name
  FROM flat)"""
_RULES = (
    ("Negative Quantities", "warning", "Rows with zero or negative quantity", "quantity <= 0"),
    ("Null or Zero Sales", "warning", "Rows with no sales value", "sales IS NULL OR sales = 0"),
    ("Extreme Discounts", "warning", "Discount exceeding 100%", "discount > 1"),
    ("Future Order Dates", "warning", "Orders dated in the future", "order_date > DATE '2000-06-30'"),
    ("Ship Before Order", "warning", "Ship date is earlier than order date", "ship_date < order_date"),
    ("Missing Customer Names", "info", "Rows with placeholder customer names", "customer_name = 'Unknown Customer'"),
    ("Missing Product Names", "info", "Rows with placeholder product names", "product_name = 'Unknown Product'"),
)


def _gate(select: str) -> str:
    counts = ", ".join(f"COUNT(*) FILTER (WHERE {rule[3]}) AS c{n}" for n, rule in enumerate(_RULES))
    flagged = " + ".join(f"c{n}" for n, rule in enumerate(_RULES) if rule[1] == "warning")
    long = "\nUNION ALL ".join(
        f"SELECT batch_key, {n} AS place, '{name}' AS name, '{severity}' AS severity, c{n} AS count, '{desc}' AS \"desc\", c{n} = 0 AS passed FROM counted"
        for n, (name, severity, desc, _) in enumerate(_RULES)
    )
    return _star(
        select,
        _FAULTY,
        f"counted AS (SELECT batch_key, COUNT(*) AS row_count, {counts} FROM faulty GROUP BY 1)",
        # Printed to one decimal, a double is rounded by its exact binary value, ties to even, as in Python.
        f"scored AS (SELECT *, CAST(format('{{:.1f}}', GREATEST(0, 1 - ({flagged})::DOUBLE / row_count) * 100) AS DOUBLE) AS health_score FROM counted)",
        "judged AS (SELECT *, CASE WHEN health_score >= 80 THEN 'Accepted' WHEN health_score >= 50 THEN 'Needs Review' ELSE 'Rejected' END AS status, row_number() OVER (ORDER BY batch_key) AS batch_id FROM scored)",
        f"issue AS ({long})",
    )


_ISSUES_JSON = "'[' || " + " || ',' || ".join(
    f"""'{{"name":"{name}","severity":"{severity}","count":' || c{n} || ',"desc":"{desc}","passed":' || CASE WHEN c{n} = 0 THEN 'true' ELSE 'false' END || '}}'"""
    for n, (name, severity, desc, _) in enumerate(_RULES)
) + " || ']'"


def _disposed(review: str) -> str:
    taken = "status = 'Accepted'" if review == "hold" else "status <> 'Rejected'"
    return f"""SELECT batch_key, status,
  CASE status WHEN 'Accepted' THEN 'merge' WHEN 'Rejected' THEN 'reject' ELSE '{review}' END AS action,
  CASE WHEN {taken} THEN row_count ELSE 0 END AS accepted_rows, CASE WHEN {taken} THEN 0 ELSE row_count END AS rejected_rows
FROM judged"""


_SELLER = "' / ' || l_suppkey || ' / ' || l_linenumber"

_FIRST_CUSTOMERS = f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, arg_min(customer_name || {_SELLER}, row_no) AS customer_name,
       arg_min(segment, row_no) AS segment FROM flat WHERE {{of}} GROUP BY flat.customer_id"""

_FIRST_PRODUCTS = f"""
SELECT CAST(product_id AS VARCHAR) AS product_id, arg_min(product_name || {_SELLER}, row_no) AS product_name,
       arg_min(category, row_no) AS category, arg_min(sub_category, row_no) AS sub_category FROM flat WHERE {{of}} GROUP BY flat.product_id"""

_NOT_STORED_ORDERS = """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(order_date AS VARCHAR) AS order_date,
  CAST(arg_min(ship_date, row_no) AS VARCHAR) AS ship_date, CAST(customer_id AS VARCHAR) AS customer_id,
  CAST(SUM(shipping_cost) AS DOUBLE) AS shipping_cost,
  order_id % 30 = 0 AND MIN(l_linenumber) < 4 AND MAX(l_linenumber) >= 4 AS fell_back
FROM flat WHERE order_id % 10 = 0 GROUP BY order_id, order_date, customer_id"""


def _integrity(orphans: tuple[str, str, str], orders: str, items: str, tables: dict[str, str], failed_products: bool = False) -> str:
    """Integrity rows from the expected orphan counts and the tables they are taken on."""
    names = (("Orphan Orders", "Orders referencing missing customers"), ("Orphan Line Items", "Items referencing missing orders"),
             ("Orphan Product Refs", "Items referencing missing products"))
    rows = [f"SELECT '{n}' AS name, '{d}' AS \"desc\", CAST(({sql}) AS BIGINT) AS count, 'critical' AS severity" for (n, d), sql in zip(names, orphans)]
    if failed_products:
        rows[2] = "SELECT 'Orphan Product Refs', 'Check failed', CAST(-1 AS BIGINT), 'error'"
    rows.append(f"SELECT 'Date Range', 'Orders from ' || MIN(order_date) || ' to ' || MAX(order_date) || ' (' || format('{{:,}}', COUNT(*)) || ' total)', CAST(0 AS BIGINT), 'info' FROM ({orders})")
    rows.append(f"SELECT 'Zero/Null Sales', 'Line items with no revenue value', COUNT(*) FILTER (WHERE sales IS NULL OR sales = 0), 'warning' FROM ({items})")
    rows.append(f"SELECT 'Bad Quantities', 'Line items with zero or negative qty', COUNT(*) FILTER (WHERE quantity <= 0), 'warning' FROM ({items})")
    sizes = " || ' · ' || ".join(f"'{name}: ' || format('{{:,}}', (SELECT COUNT(*) FROM {source}))" for name, source in tables.items())
    rows.append(f"SELECT 'Table Sizes', {sizes}, CAST(0 AS BIGINT), 'info'")
    return "\nUNION ALL ".join(rows)


_ALL_TABLES = {"customers": "d_customers", "products": "d_products", "locations": "d_locations", "orders": "f_orders", "order_items": "f_items"}
_DAMAGED_ITEMS = """SELECT CASE product_id % 50 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE sales END AS sales,
  CASE WHEN order_id % 7 = 0 THEN -quantity ELSE quantity END AS quantity, order_id, product_id FROM f_items"""
_DAMAGED = _integrity(
    (
        "SELECT COUNT(*) FROM f_orders WHERE order_id % 10 <> 0 AND customer_id NOT IN (SELECT customer_id FROM d_customers WHERE customer_id % 10 <> 0)",
        "SELECT COUNT(*) FROM f_items WHERE order_id NOT IN (SELECT order_id FROM f_orders WHERE order_id % 10 <> 0)",
        "SELECT COUNT(*) FROM f_items WHERE product_id NOT IN (SELECT product_id FROM d_products WHERE product_id % 10 <> 0)",
    ),
    "SELECT * FROM f_orders WHERE order_id % 10 <> 0",
    _DAMAGED_ITEMS,
    {**_ALL_TABLES, "customers": "d_customers WHERE customer_id % 10 <> 0", "products": "d_products WHERE product_id % 10 <> 0",
     "orders": "f_orders WHERE order_id % 10 <> 0"},
)
_NULL_KEYS = _integrity(
    (
        "SELECT COUNT(*) FROM f_orders WHERE order_id % 10 <> 0 AND customer_id NOT IN (SELECT CASE WHEN customer_id % 10 <> 0 THEN customer_id END FROM d_customers)",
        "SELECT COUNT(*) FROM (SELECT CASE WHEN order_id % 15 <> 0 THEN order_id END AS k FROM f_items) WHERE k NOT IN (SELECT order_id FROM f_orders WHERE order_id % 10 <> 0)",
        "SELECT COUNT(*) FROM f_items WHERE product_id NOT IN (SELECT product_id FROM d_products WHERE product_id < 0)",
    ),
    "SELECT * FROM f_orders WHERE order_id % 10 <> 0",
    "SELECT * FROM f_items",
    {**_ALL_TABLES, "products": "d_products WHERE product_id < 0", "orders": "f_orders WHERE order_id % 10 <> 0"},
)
_INTACT = _integrity(
    ("SELECT 0", "SELECT 0", "SELECT 0"), "SELECT * FROM f_orders", "SELECT * FROM f_items", _ALL_TABLES, failed_products=True
)


def _classes(checks: str, select: str) -> str:
    return f"""SELECT {select} FROM (SELECT *,
  CASE WHEN count = 0 THEN 'pass' WHEN count = -1 THEN 'fail' WHEN severity = 'critical' THEN 'fail' WHEN severity = 'warning' THEN 'warn' ELSE 'pass' END AS check_class,
  CASE WHEN count > 0 THEN count || ' issue(s)' WHEN count = 0 THEN 'OK' ELSE 'Error' END AS label
FROM ({checks}))"""


_STAGES = ("view", "click", "signup", "purchase")


def _observed() -> str:
    parts = ["r1 AS (SELECT user_id, MIN(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1)"]
    for n, stage in enumerate(_STAGES[1:], start=2):
        parts.append(
            f"r{n} AS (SELECT e.user_id, MIN(e.ts) AS t FROM events e JOIN r{n - 1} r ON e.user_id = r.user_id AND e.ts > r.t "
            f"WHERE e.event_type = '{stage}' GROUP BY 1)"
        )
    rows = " UNION ALL ".join(
        f"SELECT CAST({n} AS BIGINT) AS step, '{stage}' AS stage, (SELECT COUNT(*) FROM r{n}) AS users" for n, stage in enumerate(_STAGES, start=1)
    )
    return "WITH " + ",\n".join(parts) + "\n" + rows


ORACLE: dict[str, str] = {
    "filter_values": _star("""
SELECT 'year' AS filter, CAST(year(order_date) AS VARCHAR) AS value, FALSE AS is_all FROM f_orders GROUP BY ALL
UNION ALL SELECT 'market', market, FALSE FROM d_locations GROUP BY ALL
UNION ALL SELECT 'segment', segment, FALSE FROM d_customers GROUP BY ALL
UNION ALL SELECT unnest(['year', 'market', 'segment']), 'All', TRUE"""),
    "kpis": _kpis("TRUE"),
    "kpis_filtered": _kpis(_IN_SLICE),
    "monthly_trend": _trend("TRUE"),
    "monthly_trend_filtered": _trend(_IN_SLICE),
    "sales_by_category": _by_category("TRUE"),
    "sales_by_category_filtered": _by_category(_IN_SLICE),
    "category_share": _star(f"""
SELECT category, {_d('SUM(sales)')} AS sales, {_d('SUM(sales)')} / {_d('SUM(SUM(sales)) OVER ()')} * 100 AS pct
FROM j4 JOIN d_products USING (product_id) GROUP BY 1"""),
    "revenue_by_market": _star(f"SELECT market, {_d('SUM(sales)')} AS sales, {_d('SUM(profit)')} AS profit FROM j4 GROUP BY 1"),
    "top8_customers": _star(f"""
SELECT customer_name, {_d('SUM(sales)')} AS spent FROM j4 GROUP BY 1 ORDER BY SUM(sales) DESC, customer_name LIMIT 8"""),
    "top6_products": _star("""
SELECT product_name, CAST(SUM(quantity) AS BIGINT) AS qty FROM j4 JOIN d_products USING (product_id)
GROUP BY 1 ORDER BY 2 DESC, product_name LIMIT 6"""),
    "short_labels": _star("""
SELECT DISTINCT 'customer' AS kind, n AS name, CASE WHEN length(n) > 20 THEN substr(n, 1, 20) || '...' ELSE n END AS label
FROM (SELECT customer_name || ' ' || segment AS n FROM d_customers)
UNION ALL SELECT DISTINCT 'product', n, CASE WHEN length(n) > 18 THEN substr(n, 1, 18) || '...' ELSE n END
FROM (SELECT product_name || ' ' || sub_category AS n FROM d_products)"""),
    "top10_customers": _star(f"""
SELECT customer_id, customer_name, segment, COUNT(DISTINCT order_id) AS total_orders, {_round2('SUM(sales)')} AS total_sales,
       {_round2('SUM(profit)')} AS total_profit, {_pct('SUM(profit)', 'SUM(sales)')} AS profit_margin_pct
FROM f_items JOIN f_orders USING (order_id) JOIN d_customers USING (customer_id)
GROUP BY 1, 2, 3 ORDER BY {_exact2('SUM(sales)')} DESC, customer_id LIMIT 10"""),
    "top10_products": _star(f"""
SELECT product_id, product_name, category, sub_category, CAST(SUM(quantity) AS BIGINT) AS total_quantity_sold,
       {_round2('SUM(sales)')} AS total_sales, {_round2('SUM(profit)')} AS total_profit
FROM f_items JOIN d_products USING (product_id) GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, product_id LIMIT 10"""),
    "category_rank": _star(f"""
SELECT category, sub_category, {_round2('SUM(sales)')} AS total_sales, {_round2('SUM(profit)')} AS total_profit,
       DENSE_RANK() OVER (PARTITION BY category ORDER BY SUM(sales) DESC) AS rank_within_category
FROM f_items JOIN d_products USING (product_id) GROUP BY 1, 2"""),
    "top3_customers": _star(f"""
SELECT customer_name, COUNT(DISTINCT order_id) AS orders_placed, {_d('SUM(sales)')} AS total_sales, {_d('SUM(profit)')} AS total_profit
FROM f_items JOIN f_orders USING (order_id) JOIN d_customers USING (customer_id)
GROUP BY 1 ORDER BY SUM(sales) DESC, customer_name LIMIT 3"""),
    "monthly_running_total": _star(f"""
SELECT month AS sales_month, {_d('s')} AS monthly_sales, {_d('p')} AS monthly_profit, CAST(quantity AS BIGINT) AS items_sold,
       {_d('SUM(s) OVER (ORDER BY month)')} AS running_total_sales
FROM (SELECT month, {_exact2('sales')} AS s, {_exact2('profit')} AS p, quantity FROM months)""", _MONTHS.format(where="")),
    "mom_growth": _growth(""),
    "mom_growth_gap": _growth("WHERE strftime(order_date, '%Y-%m') <> '1998-05'"),
    "mom_growth_unrounded": _star(f"""
SELECT month, {_d('sales')} AS total_sales, {_d('prev')} AS prev_month_sales, {_pct('(sales - prev)', 'prev')} AS mom_growth_pct
FROM (SELECT month, sales, LAG(sales) OVER (ORDER BY month) AS prev FROM months)""", _MONTHS.format(where="")),
    "cohort_retention": _star(_RETENTION, _cohorts("f_orders")),
    "cohort_retention_filtered": _star(_RETENTION, _cohorts(_scope("market = 'ASIA' AND segment = 'HOUSEHOLD'"))),
    "cohort_retention_year": _star(_RETENTION, _cohorts(_scope("year(order_date) = 1997"))),
    "customer_cohorts": _star("SELECT customer_id, (q0 // 4) || '-Q' || (q0 % 4 + 1) AS cohort_quarter FROM starts", _cohorts("f_orders")),
    "cohort_sizes": _star("SELECT (q0 // 4) || '-Q' || (q0 % 4 + 1) AS cohort_quarter, cohort_size FROM sizes", _cohorts("f_orders")),
    "retention_matrix": _star(
        "SELECT cohort_quarter, "
        + ", ".join(f"MAX(retention_pct) FILTER (WHERE elapsed_quarters = {n}) AS q{n}" for n in range(12))
        + " FROM rates GROUP BY 1",
        _cohorts(_FULL_SCOPE),
    ),
    "retention_summary": _star(
        "SELECT "
        + ", ".join(
            f"COALESCE(CAST(SUM(CAST(retention_pct AS DECIMAL(18,2))) FILTER (WHERE elapsed_quarters = {n}) AS DOUBLE) "
            f"/ COUNT(*) FILTER (WHERE elapsed_quarters = {n}), 0) AS avg_q{n}_retention" for n in (1, 4)
        )
        + ", COUNT(DISTINCT cohort_quarter) AS total_cohorts FROM rates",
        _cohorts(_FULL_SCOPE),
    ),
    "estimated_funnel": _star("SELECT * FROM funnel", _FUNNEL),
    "funnel_summary": _star(f"""
SELECT CAST(TRUNC(n * 18.5) AS BIGINT) AS sessions, n AS orders, {_round2('v')} AS sales,
       n::DOUBLE / TRUNC(n * 18.5)::DOUBLE * 100 AS conversion_pct FROM base WHERE n > 0""", _FUNNEL),
    "funnel_steps": _star(f"""
SELECT stage, visitor_count, {_pct('visitor_count', 'FIRST_VALUE(visitor_count) OVER (ORDER BY stage)')} AS pct_initial,
       {_pct('visitor_count', 'LAG(visitor_count) OVER (ORDER BY stage)')} AS step_rate FROM funnel""", _FUNNEL),
    "q_top5_customers": _star(_TOP_NAMES),
    "q_march_sales": _star(f"""
SELECT strftime(order_date, '%Y-%m') AS sales_month, {_d('SUM(sales)')} AS total_sales, {_d('SUM(profit)')} AS total_profit
FROM f_items JOIN f_orders USING (order_id) WHERE month(order_date) = 3 GROUP BY 1"""),
    "q_top5_products": _star(f"""
SELECT product_name, CAST(SUM(quantity) AS BIGINT) AS quantity_sold, {_d('SUM(sales)')} AS total_sales
FROM f_items JOIN d_products USING (product_id) GROUP BY 1 ORDER BY 2 DESC, product_name LIMIT 5"""),
    "q_daily_sales": _star(f"""
SELECT CAST(order_date AS VARCHAR) AS order_date, {_d('SUM(sales)')} AS daily_sales, {_d('SUM(profit)')} AS daily_profit
FROM f_items JOIN f_orders USING (order_id) GROUP BY f_orders.order_date ORDER BY f_orders.order_date DESC LIMIT 10"""),
    "bi_measures": _measures("", ""),
    "bi_measures_sliced": _measures("", f"WHERE {_IN_SLICE}"),
    "bi_measures_by_market": _measures("market, ", "GROUP BY 1"),
    "bi_measures_by_month": _measures("strftime(order_date, '%Y-%m') AS year_month, ", "GROUP BY 1"),
    "bi_measures_by_customer": _measures("customer_name, ", "GROUP BY 1"),
    "bi_measures_by_category": _star(
        f"SELECT category, {_MEASURES} FROM facts LEFT JOIN d_products USING (product_id) WHERE sales IS NOT NULL GROUP BY 1", _FACTS
    ),
    "bi_measures_by_category_sliced": _star(
        f"SELECT category, {_MEASURES} FROM facts LEFT JOIN d_products USING (product_id) WHERE sales IS NOT NULL AND {_IN_SLICE} GROUP BY 1", _FACTS
    ),
    "bi_orders_by_category": _star("""
SELECT category, COUNT(DISTINCT o.order_id) AS order_count
FROM f_items i JOIN d_products USING (product_id) JOIN f_orders o ON i.order_id = o.order_id GROUP BY 1"""),
    "bi_prev_month": _star(f"SELECT month, {_d('total_sales')} AS total_sales, {_d('prev_month_sales')} AS prev_month_sales FROM calendar", _CALENDAR),
    "bi_mom_growth": _star(f"""
SELECT month, {_d('total_sales')} AS total_sales, {_d('prev_month_sales')} AS prev_month_sales,
       COALESCE({_d('total_sales - prev_month_sales')} / NULLIF({_d('prev_month_sales')}, 0), 0) AS growth FROM calendar""", _CALENDAR),
    "question_routing": """
WITH asked AS (SELECT lower(CASE (conv_id + turn) % 6 WHEN 0 THEN 'Who are the TOP 5 customers? ' || text
  WHEN 1 THEN text || ' Sales in March, please' WHEN 2 THEN 'Our Best Selling Product: ' || text
  WHEN 3 THEN text || ' top product and best customers' ELSE text END) AS q FROM conversations)
SELECT CASE WHEN contains(q, 'top 5 customers') OR contains(q, 'best customers') THEN 'best_customers'
  WHEN contains(q, 'sales in march') OR contains(q, 'march sales') THEN 'sales_of_month'
  WHEN contains(q, 'best selling product') OR contains(q, 'top product') THEN 'best_products'
  ELSE 'latest_days' END AS template, COUNT(*) AS questions FROM asked GROUP BY 1""",
    "adhoc_sql": _star("""
SELECT segment, market, COUNT(*) AS lines, CAST(SUM(quantity) AS BIGINT) AS units FROM j4
WHERE order_date >= DATE '1998-01-01' GROUP BY 1, 2"""),
    "table_presence": _star("\nUNION ALL ".join(
        f"SELECT '{name}' AS \"table\", TRUE AS present, COUNT(*) AS rows, COUNT(*) > 0 AS ok FROM {source}" for name, source in _ALL_TABLES.items()
    )),
    "read_flat_csv": _star(f"""
SELECT CAST(order_id AS VARCHAR) AS order_no, {_NAME.format(null='NULL')} AS buyer,
       CASE WHEN product_id % 11 = 0 THEN NULL ELSE CAST(product_id AS VARCHAR) END AS item_id,
       CASE WHEN product_id % 2 = 0 THEN NULL ELSE ' NA' END AS zip,
       CASE WHEN product_id % 13 = 0 THEN NULL ELSE category END AS category, 'Rep ' || l_suppkey AS rep FROM flat"""),
    "read_quoted_csv": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_no, o_orderstatus AS state,
       CASE WHEN o_orderkey % 3 = 0 THEN 'said "' || o_orderkey || '",' || chr(10) || 'then ' || o_orderpriority || chr(10)
            WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS note FROM orders""",
    "normalize_null_tokens": """
SELECT CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN ' NA' WHEN 3 THEN NULL WHEN 4 THEN 'nil' WHEN 5 THEN NULL ELSE l_returnflag END AS value,
       COUNT(*) AS rows FROM lineitem GROUP BY 1""",
    "column_mapping": _star("""
SELECT unnest(['order_id', 'order_date', 'ship_date', 'ship_mode', 'customer_id', 'customer_name', 'segment', 'product_id', 'product_name',
               'category', 'sub_category', 'city', 'state', 'country', 'postal_code', 'market', 'region', 'sales', 'quantity', 'discount',
               'profit', 'shipping_cost', 'order_priority']) AS canonical,
       unnest([' Order No ', 'DATE', 'Shipping Date', 'shipping mode', 'Cust ID', 'Buyer', 'Customer Segment', 'Item ID', 'Item Name',
               'Product Category', 'Sub-Category', 'CITY', 'Province', 'Nation', 'ZIP', 'Region Market', 'Region', 'Revenue', 'Qty', 'Disc',
               'Net Profit', 'Freight', 'Priority']) AS source,
       unnest([n, n, n, n, n - no_id, n - no_name, n, n, n, n, n, n, n, n, n, n, n, n, n, n, n, n, n]) AS filled
FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE l_linenumber = 4) AS no_id, COUNT(*) FILTER (WHERE l_linenumber = 3) AS no_name FROM flat)"""),
    "clean_numbers": _star(f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, {_d('sales')} AS sales, {_d('CASE WHEN l_linenumber = 7 THEN 0 ELSE profit END')} AS profit,
       {_d('(100 + l_linenumber) * 100')} AS scientific FROM flat"""),
    "clean_dates": _star(f"""
SELECT order_id, CAST({_ORDER_DATE.format(default='2024-01-01')} AS VARCHAR) AS order_date,
       CAST({_ORDER_DATE.format(default='2024-01-01')} AS VARCHAR) AS ship_date FROM f_orders"""),
    "bulk_date_defaults": _star(f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(od AS VARCHAR) AS order_date,
       CAST({_SHIP_DATE.format(default='od + 4')} AS VARCHAR) AS ship_date
FROM (SELECT *, {_ORDER_DATE.format(default='2014-01-01')} AS od FROM flat)"""),
    "missing_date_columns": _star("""
SELECT 'neither' AS kind, '2000-06-30' AS order_date, '2000-06-30' AS ship_date, COUNT(*) AS rows FROM flat
UNION ALL SELECT 'order_date only', CAST(order_date AS VARCHAR), CAST(order_date AS VARCHAR), COUNT(*) FROM flat GROUP BY flat.order_date"""),
    "missing_numeric_columns": _star(f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, {_d('sales')} AS sales, 0::DOUBLE AS profit, 0::DOUBLE AS discount,
       0::DOUBLE AS shipping_cost, 1::DOUBLE AS quantity FROM flat"""),
    "text_defaults": _star(f"""
SELECT {_NAME.format(null="'Unknown Customer'")} AS customer_name, CASE WHEN product_id % 7 = 0 THEN 'Consumer' ELSE segment END AS segment,
       CASE WHEN product_id % 13 = 0 THEN 'NULL' ELSE category END AS category, country, market,
       'Unknown Product' AS product_name, 'Other' AS sub_category, 'Unknown' AS city, 'Unknown' AS state, 'Unknown' AS region,
       'N/A' AS postal_code, 'Standard Class' AS ship_mode, 'Medium' AS order_priority, COUNT(*) AS rows
FROM flat GROUP BY ALL"""),
    "generated_ids": _star(f"SELECT CAST(order_id AS VARCHAR) AS order_id, {_CUSTOMER} AS customer_id, {_PRODUCT} AS product_id FROM flat"),
    "generated_order_ids": _star("SELECT 'ORD-200006301234-' || row_no AS order_id FROM flat"),
    "clean_batch": _star(f"""
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST({_ORDER_DATE.format(default='2024-01-01')} AS VARCHAR) AS order_date,
       CAST({_SHIP_DATE.format(default="DATE '2024-01-01'")} AS VARCHAR) AS ship_date, ship_mode, {_CUSTOMER} AS customer_id,
       {_NAME.format(null="'Unknown Customer'")} AS customer_name, CASE WHEN product_id % 7 = 0 THEN 'Consumer' ELSE segment END AS segment,
       {_PRODUCT} AS product_id, product_name, CASE WHEN product_id % 13 = 0 THEN 'NULL' ELSE category END AS category, sub_category,
       city, state, country, CASE WHEN product_id % 2 = 0 THEN 'NA' ELSE ' NA' END AS postal_code, market, region, {_d('sales')} AS sales,
       {_d('CASE WHEN l_linenumber = 6 THEN 0 ELSE quantity END')} AS quantity, {_d('discount')} AS discount, {_d('profit')} AS profit,
       {_d('shipping_cost')} AS shipping_cost, order_priority FROM flat"""),
    "dim_customers": _star("SELECT DISTINCT CAST(customer_id AS VARCHAR) AS customer_id, customer_name, segment FROM flat"),
    "dim_products": _star("SELECT DISTINCT CAST(product_id AS VARCHAR) AS product_id, product_name, category, sub_category FROM flat"),
    "dim_locations": _star("""
SELECT row_number() OVER (ORDER BY MIN(row_no)) AS location_id, country, market, region, state, city, postal_code
FROM flat GROUP BY country, market, region, state, city, postal_code"""),
    "attach_location": _star("""
SELECT row_number() OVER (ORDER BY MIN(row_no)) AS location_id, country, CASE WHEN country > 'NATION_2' THEN state END AS state, COUNT(*) AS rows
FROM flat GROUP BY country, state"""),
    "dim_orders": _star("""
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(order_date AS VARCHAR) AS order_date, CAST(arg_min(ship_date, row_no) AS VARCHAR) AS ship_date,
       CASE WHEN MAX(l_linenumber) > 2 THEN 'Standard Class' END AS ship_mode, CAST(customer_id AS VARCHAR) AS customer_id,
       place.location_id, CAST(SUM(shipping_cost) AS DOUBLE) AS shipping_cost, order_priority
FROM flat JOIN (SELECT country, row_number() OVER (ORDER BY MIN(row_no)) AS location_id FROM flat GROUP BY country) place USING (country)
WHERE order_id % 20 <> 0 GROUP BY flat.order_id, flat.order_date, flat.customer_id, place.location_id, order_priority"""),
    "fact_order_items": _star(f"""
SELECT row_no AS order_item_id, CASE WHEN order_id % 20 <> 0 THEN CAST(order_id AS VARCHAR) END AS order_id,
       CAST(product_id AS VARCHAR) AS product_id, {_d('sales')} AS sales, quantity, {_d('discount')} AS discount, {_d('profit')} AS profit FROM flat"""),
    "bulk_load": _star(f"""
SELECT 'customers' AS "table", COUNT(DISTINCT customer_id) AS rows, NULL::DOUBLE AS amount FROM flat
UNION ALL SELECT 'products', COUNT(DISTINCT product_id), NULL FROM flat
UNION ALL SELECT 'locations', COUNT(DISTINCT country), NULL FROM flat
UNION ALL SELECT 'orders', COUNT(DISTINCT order_id), NULL FROM flat
UNION ALL SELECT 'order_items', COUNT(*), NULL FROM flat
UNION ALL SELECT 'items, highest id and sales', COUNT(*), {_d('SUM(sales)')} FROM flat
UNION ALL SELECT 'orders, shipping', COUNT(DISTINCT order_id), {_d('SUM(shipping_cost)')} FROM flat"""),
    "whole_merge": _star(f"""
SELECT 'customers' AS "table", COUNT(DISTINCT customer_id) AS rows, NULL::DOUBLE AS amount FROM flat
UNION ALL SELECT 'products', COUNT(DISTINCT product_id), NULL FROM flat
UNION ALL SELECT 'locations', COUNT(DISTINCT country), NULL FROM flat
UNION ALL SELECT 'orders', COUNT(DISTINCT order_id), NULL FROM flat
UNION ALL SELECT 'order_items', COUNT(*) + COUNT(*) FILTER (WHERE order_id % 10 <> 0), NULL FROM flat
UNION ALL SELECT 'items, highest id and sales', COUNT(*) + COUNT(*) FILTER (WHERE order_id % 10 <> 0),
  {_d('SUM(sales) + SUM(sales) FILTER (WHERE order_id % 10 <> 0)')} FROM flat
UNION ALL SELECT 'orders, shipping', COUNT(DISTINCT order_id), {_d('SUM(shipping_cost)')} FROM flat"""),
    "exported_tables": _star("""
SELECT 'customers' AS "table", COUNT(*) AS rows, MIN(customer_id) AS first_key, MAX(customer_id) AS last_key FROM d_customers
UNION ALL SELECT 'products', COUNT(*), MIN(product_id), MAX(product_id) FROM d_products
UNION ALL SELECT 'locations', COUNT(*), MIN(location_id), MAX(location_id) FROM d_locations
UNION ALL SELECT 'orders', COUNT(*), MIN(order_id), MAX(order_id) FROM f_orders
UNION ALL SELECT 'order_items', COUNT(*), MIN(order_id), MAX(order_id) FROM f_items"""),
    "merge_customers": _star("SELECT DISTINCT CAST(customer_id AS VARCHAR) AS customer_id, customer_name, segment FROM flat WHERE customer_id % 10 = 0"),
    "merge_products": _star("""
SELECT DISTINCT CAST(product_id AS VARCHAR) AS product_id, product_name, category, sub_category FROM flat WHERE product_id % 10 = 0"""),
    "first_customers": _star(_FIRST_CUSTOMERS.format(of="TRUE")),
    "first_products": _star(_FIRST_PRODUCTS.format(of="TRUE")),
    "merge_first_customers": _star(_FIRST_CUSTOMERS.format(of="customer_id % 10 = 0")),
    "merge_first_products": _star(_FIRST_PRODUCTS.format(of="product_id % 10 = 0")),
    "merge_locations": _star("""
SELECT (SELECT MAX(location_id) FROM d_locations WHERE location_id % 10 <> 0) + row_number() OVER (ORDER BY MIN(row_no)) AS location_id,
       country, market, region, state, city, postal_code
FROM flat WHERE location_id % 10 = 0 GROUP BY country, market, region, state, city, postal_code"""),
    "merge_orders": _star(_NOT_STORED_ORDERS),
    "merge_order_items": _star(f"""
SELECT (SELECT COUNT(*) FROM flat WHERE order_id % 10 <> 0) + row_number() OVER (ORDER BY row_no) AS order_item_id,
       CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id, {_d('sales')} AS sales, quantity,
       {_d('discount')} AS discount, {_d('profit')} AS profit FROM flat WHERE order_id % 10 = 0"""),
    "quality_checks": _gate("""SELECT name, severity, CAST(SUM(count) AS BIGINT) AS count, "desc", SUM(count) = 0 AS passed FROM issue GROUP BY name, severity, "desc\""""),
    "quality_issues": _gate('SELECT batch_key, name, severity, count, "desc", passed FROM issue'),
    "health_score": _gate("SELECT batch_key, row_count, health_score FROM scored"),
    "batch_verdict": _gate("SELECT status, COUNT(*) AS batches, CAST(SUM(row_count) AS BIGINT) AS rows FROM judged GROUP BY 1"),
    "issue_classes": _gate("""SELECT batch_key, name, CASE WHEN passed OR severity = 'info' THEN 'pass' ELSE 'warn' END AS issue_class,
  CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY batch_key) AS BIGINT) AS checks_passed FROM issue"""),
    "batch_disposition": _gate(_disposed("hold")),
    "batch_disposition_forced": _gate(_disposed("merge")),
    "log_batch": _gate(f"""SELECT '2000-06-30 12:34:00' AS submitted_at, batch_id, batch_key, batch_key AS filename, row_count, status, health_score, {_ISSUES_JSON} AS issues_json,
  CASE WHEN status = 'Accepted' THEN row_count ELSE 0 END AS accepted_rows,
  CASE WHEN status = 'Accepted' THEN 0 ELSE row_count END AS rejected_rows FROM judged"""),
    "batch_history": _gate("SELECT batch_id, batch_key AS filename, status, health_score FROM judged ORDER BY batch_id DESC LIMIT 50"),
    "batch_history_table": _gate("""SELECT batch_id AS "ID", batch_key AS "File", row_count AS "Rows", status AS "Status",
  CASE WHEN status = 'Accepted' THEN row_count ELSE 0 END AS "Accepted", CASE WHEN status = 'Accepted' THEN 0 ELSE row_count END AS "Rejected"
FROM judged ORDER BY batch_id DESC LIMIT 20"""),
    "pending_alerts": _gate("SELECT batch_id, batch_key AS filename, row_count, health_score FROM judged WHERE status = 'Needs Review'"),
    "pending_count": _gate("SELECT COUNT(*) FILTER (WHERE status = 'Needs Review') AS pending FROM judged"),
    "failed_issues": _gate("""SELECT batch_id, name, count, "desc" FROM issue JOIN judged USING (batch_key)
WHERE status = 'Needs Review' AND NOT passed AND batch_id % 5 <> 0"""),
    "integrity_checks": _star(_DAMAGED),
    "integrity_null_keys": _star(_NULL_KEYS),
    "integrity_failed_check": _star(_classes(_INTACT, "*")),
    "integrity_classes": _star(_classes(_DAMAGED, "name, check_class, label")),
    "table_sizes": _star(f"SELECT * FROM ({_INTACT}) WHERE name = 'Table Sizes'"),
    "events_hourly": f"""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, COUNT(*) AS events,
       {_d('SUM(CAST(value AS DECIMAL(18,4)))')} AS value FROM events GROUP BY 1, 2""",
    "observed_funnel": _observed(),
}

ORACLE["compacted_table_sizes"] = ORACLE["table_sizes"]
ORACLE["integrity_after_commits"] = ORACLE["integrity_checks"]
