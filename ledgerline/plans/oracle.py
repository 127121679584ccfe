"""DuckDB SQL with the same results as the registered queries, written independently of them."""

from __future__ import annotations

from ledgerline.functions.quantiles import t_table
from ledgerline.operators import cleaning, insights
from ledgerline.plans import registry as r
from ledgerline.sources.tpch import CUTOVER, LOADED_AT, TYPE_MARGINS

# --- building blocks ----------------------------------------------------------------------

LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, Sales, Quantity"
PLACE = f"l_orderkey, {LINE}"

FLAT = """flat AS (
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_shipdate AS DATE) AS l_shipdate,
  CAST(l.l_orderkey AS VARCHAR) AS Order_ID, CAST(o.o_orderdate AS DATE) AS Order_Date,
  CAST(c.c_custkey AS VARCHAR) AS Customer_ID, c.c_name AS Customer_Name,
  p.p_name AS Product, p.p_type AS Category, CAST(l.l_quantity AS INT) AS Quantity,
  CAST(p.p_retailprice AS DECIMAL(12,2)) AS Price, CAST(l.l_extendedprice AS DECIMAL(12,2)) AS Sales,
  CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
       - CAST(l.l_quantity AS INT) * CAST(p.p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS Profit,
  concat(n.n_name, ' ', c.c_mktsegment) AS City, n.n_name AS State, r.r_name AS Region
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

# half-up to four places in whole numbers: exact
MARGIN = """CASE WHEN Sales > 0 THEN sign(Profit) *
  ((abs(CAST(Profit * 100 AS HUGEINT)) * 20000 + CAST(Sales * 100 AS HUGEINT))
   // (2 * CAST(Sales * 100 AS HUGEINT))) / 10000.0 ELSE 0.0 END"""
DATES = """CAST(year(Order_Date) AS INT) AS Year, CAST(month(Order_Date) AS INT) AS Month,
  'Q' || quarter(Order_Date) AS Quarter, strftime(Order_Date, '%b') AS Month_Name"""
SALES = f"""{FLAT},
sales AS (SELECT *, {DATES}, CAST({MARGIN} AS DOUBLE) AS Profit_Margin FROM flat)"""

DIRTY = f"""{FLAT},
dirty AS (
SELECT * REPLACE (
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 67 = 0 THEN NULL ELSE Profit END AS Profit,
  CASE WHEN l_partkey % 113 = 1 THEN NULL ELSE Customer_Name END AS Customer_Name,
  CASE WHEN l_suppkey % 97 = 4 THEN '' ELSE City END AS City,
  CASE WHEN l_partkey % 211 = 2 THEN -1 ELSE Quantity END AS Quantity,
  CASE WHEN l_partkey % 223 = 3 THEN 0 ELSE Price END AS Price,
  CASE WHEN l_partkey % 223 = 3 THEN 0 ELSE Sales END AS Sales)
FROM flat)"""

_DEFAULTS = ", ".join(f"('{c}', CAST({m} AS DOUBLE))" for c, m in TYPE_MARGINS.items())
MARGINS = f"""margins AS (
SELECT d.Category, CASE WHEN count(x.Category) > 5
    THEN avg(CAST(x.Profit AS DOUBLE) / CAST(x.Sales AS DOUBLE)) ELSE any_value(d.m) END AS margin
FROM (VALUES {_DEFAULTS}) d(Category, m)
LEFT JOIN (SELECT * FROM dirty WHERE Profit IS NOT NULL AND Sales > 0) x ON x.Category = d.Category
GROUP BY d.Category)"""
NAMES = f"""names AS (
SELECT Customer_ID, Customer_Name AS known_name FROM dirty WHERE Customer_Name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY Customer_ID ORDER BY {PLACE}) = 1)"""
CITIES = """cities AS (
SELECT State, City AS usual_city FROM (
  SELECT State, City, count(*) AS n FROM dirty WHERE City <> '' GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY State ORDER BY n DESC, City) = 1)"""
IMPUTED = f"""{DIRTY}, {MARGINS}, {NAMES}, {CITIES},
imputed AS (
SELECT d.* REPLACE (
  CASE WHEN d.Profit IS NULL THEN
    CAST(round(CAST(d.Sales AS DOUBLE) * coalesce(m.margin, 0.25), 2) AS DECIMAL(12,2))
    ELSE d.Profit END AS Profit,
  coalesce(d.Customer_Name, n.known_name, '{cleaning.UNKNOWN_NAME}') AS Customer_Name,
  CASE WHEN d.City = '' THEN coalesce(c.usual_city, '{cleaning.UNKNOWN_CITY}') ELSE d.City END AS City),
  d.Profit IS NULL AS no_profit, d.Customer_Name IS NULL AS no_name, d.City = '' AS no_city,
  coalesce(m.margin, 0.25) AS margin
FROM dirty d LEFT JOIN margins m USING (Category) LEFT JOIN names n USING (Customer_ID)
LEFT JOIN cities c USING (State))"""
CLEAN = f"""{IMPUTED},
kept AS (
SELECT * FROM (SELECT * FROM imputed
  QUALIFY row_number() OVER (PARTITION BY Order_ID ORDER BY {LINE}) = 1)
WHERE Quantity > 0 AND Price > 0 AND Sales > 0),
derived AS (SELECT *, {DATES}, CAST({MARGIN} AS DOUBLE) AS Profit_Margin FROM kept),
fences AS (
SELECT quantile_cont(CAST(Sales AS DOUBLE), 0.25) AS s1, quantile_cont(CAST(Sales AS DOUBLE), 0.75) AS s3,
  quantile_cont(CAST(Profit AS DOUBLE), 0.25) AS p1, quantile_cont(CAST(Profit AS DOUBLE), 0.75) AS p3
FROM derived),
clean AS (
SELECT d.*, CAST(Sales AS DOUBLE) < s1 - 1.5 * (s3 - s1) OR CAST(Sales AS DOUBLE) > s3 + 1.5 * (s3 - s1)
  OR CAST(Profit AS DOUBLE) < p1 - 1.5 * (p3 - p1) OR CAST(Profit AS DOUBLE) > p3 + 1.5 * (p3 - p1)
  AS Is_Outlier FROM derived d, fences)"""

RECORD = """Order_ID, Order_Date, Customer_ID, Customer_Name, Product, Category, Quantity,
  CAST(Price AS DOUBLE) AS Price, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit,
  City, State, Region"""
CLEAN_RECORD = f"{RECORD}, Year, Month, Quarter, Month_Name, Profit_Margin"

S = "CAST(sum(Sales) AS DOUBLE)"
P = "CAST(sum(Profit) AS DOUBLE)"
Q = "CAST(sum(Quantity) AS BIGINT)"
O = "count(DISTINCT Order_ID)"  # noqa: E741


def div(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def grouped_text(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT))"


def pct_text(x: str, digits: int) -> str:
    return f"printf('%.{digits}f%%', {x} * 100)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE: dict[str, str] = {}

# --- sales figures ------------------------------------------------------------------------

ORACLE["flat_sales"] = with_(FLAT, f"SELECT {RECORD} FROM flat")

MONTHLY = f"""SELECT Year, Month, Month_Name, {S} AS Sales, {P} AS Profit, {O} AS Orders, {Q} AS Quantity,
  {div(P, S)} AS Profit_Margin, {div(S, O)} AS AOV FROM sales GROUP BY Year, Month, Month_Name"""
ORACLE["monthly_trends"] = with_(SALES, f"{MONTHLY} ORDER BY Year, Month")

ORACLE["kpis"] = with_(
    SALES,
    f"""SELECT t.*, c.repeaters / c.customers AS CustomerRetentionRate,
  TotalOrders / (TotalOrders * 38.5 + 2400.0) AS ConversionRate
FROM (SELECT {S} AS Revenue, {P} AS Profit, {div(P, S)} AS ProfitMargin, {O} AS TotalOrders,
  {div(S, O)} AS AOV FROM sales) t,
 (SELECT CAST(count(*) AS DOUBLE) AS customers, CAST(count(*) FILTER (n > 1) AS DOUBLE) AS repeaters FROM
   (SELECT Customer_ID, {O} AS n FROM sales GROUP BY 1)) c""",
).replace(
    "TotalOrders / (TotalOrders * 38.5 + 2400.0)",
    "CAST(TotalOrders AS DOUBLE) / (TotalOrders * CAST(38.5 AS DOUBLE) + CAST(2400 AS DOUBLE))",
)
ORACLE["extra_kpis"] = with_(
    SALES,
    f"""SELECT {Q} AS TotalUnits, {div(S, Q)} AS AvgUnitPrice,
  CAST(max(Sales) AS DOUBLE) AS HighestOrderValue FROM sales""",
)
ORACLE["quarter_analysis"] = with_(
    SALES,
    f"""SELECT Quarter, {S} AS Sales, {P} AS Profit, {O} AS Orders, {Q} AS Quantity,
  {div(P, S)} AS Profit_Margin FROM sales GROUP BY Quarter""",
)
YEARLY = f"""yearly AS (
SELECT Year, sum(Sales) AS s, sum(Profit) AS p, {O} AS Orders FROM sales GROUP BY Year),
growing AS (
SELECT Year, CAST(s AS DOUBLE) AS Sales, CAST(p AS DOUBLE) AS Profit, Orders,
  coalesce(CAST(s - lag(s) OVER w AS DOUBLE) / CAST(lag(s) OVER w AS DOUBLE) * 100, 0.0) AS Sales_Growth_Pct,
  coalesce(CAST(p - lag(p) OVER w AS DOUBLE) / CAST(lag(p) OVER w AS DOUBLE) * 100, 0.0) AS Profit_Growth_Pct
FROM yearly WINDOW w AS (ORDER BY Year))"""
ORACLE["yearly_growth"] = with_(f"{SALES}, {YEARLY}", "SELECT * FROM growing")


def _growth(c: str) -> str:
    before = f"CAST(lag({c}) OVER w AS DOUBLE)"
    return (
        f"CASE WHEN coalesce({before}, 0) = 0 THEN 0.0 "
        f"ELSE (CAST({c} AS DOUBLE) - {before}) / {before} * 100 END AS {c}_Growth_Pct"
    )


ORACLE["monthly_growth"] = with_(
    f"{SALES}, m AS ({MONTHLY})",
    f"""SELECT Year, Month, Sales, Profit, Orders, {_growth('Sales')}, {_growth('Profit')},
  {_growth('Orders')} FROM m WINDOW w AS (ORDER BY Year, Month)""",
)
ORACLE["seasonality"] = with_(SALES, f"SELECT Month_Name, {S} AS Sales FROM sales GROUP BY 1")

CUSTOMERS = f"""cust AS (
SELECT Customer_ID, Customer_Name, {S} AS Total_Spent, {P} AS Total_Profit, {O} AS Total_Orders,
  {Q} AS Total_Units, max(Order_Date) AS Last_Purchase, {div(S, O)} AS AOV, {div(P, S)} AS Profit_Margin
FROM sales GROUP BY 1, 2)"""
ORACLE["customer_metrics"] = with_(f"{SALES}, {CUSTOMERS}", "SELECT * FROM cust")
ORACLE["customer_summary_stats"] = with_(
    SALES,
    f"""SELECT count(*) AS TotalCustomers, count(*) FILTER (n > 1) AS RepeatCustomersCount,
  CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*) AS RepeatRate,
  CAST(sum(s) AS DOUBLE) / count(*) AS AverageCLV, CAST(sum(n) AS DOUBLE) / count(*) AS AverageFrequency
FROM (SELECT sum(Sales) AS s, {O} AS n FROM sales GROUP BY Customer_ID, Customer_Name)""",
)
ORACLE["top_customers_sales"] = with_(
    f"{SALES}, {CUSTOMERS}",
    "SELECT * FROM cust ORDER BY Total_Spent DESC, Customer_ID, Customer_Name LIMIT 10",
)
ORACLE["top_customers_profit"] = with_(
    f"{SALES}, {CUSTOMERS}",
    "SELECT * FROM cust ORDER BY Total_Profit DESC, Customer_ID, Customer_Name LIMIT 10",
)
ORACLE["rfm"] = with_(
    SALES,
    f"""SELECT Customer_ID, Customer_Name,
  CAST(date_diff('day', max(Order_Date), (SELECT max(Order_Date) FROM sales)) AS DOUBLE) AS Recency,
  {O} AS Frequency, {S} AS Monetary FROM sales GROUP BY 1, 2""",
)

PRODUCTS = f"""prod AS (
SELECT Product, Category, {S} AS Sales, {P} AS Profit, {Q} AS Quantity,
  CAST(sum(Price) AS DOUBLE) / count(Price) AS Avg_Price, {O} AS Orders, {div(P, S)} AS Profit_Margin
FROM sales GROUP BY 1, 2)"""
ORACLE["product_metrics"] = with_(f"{SALES}, {PRODUCTS}", "SELECT * FROM prod")
for _by in ("Sales", "Quantity", "Profit"):
    ORACLE[f"top_products_{_by.lower()}"] = with_(
        f"{SALES}, {PRODUCTS}",
        f"SELECT * FROM prod ORDER BY {_by} DESC, Product, Category LIMIT 10",
    )
ORACLE["low_performing_products"] = with_(
    f"{SALES}, {PRODUCTS}", f"SELECT * FROM prod WHERE Sales < {r.LOW_SALES_LIMIT}"
)


def _scaled(c: str) -> str:
    low, high = f"min({c}) OVER ()", f"max({c}) OVER ()"
    return (
        f"(CASE WHEN {high} = {low} THEN 0.0 ELSE CAST({c} - {low} AS DOUBLE) / "
        f"CAST({high} - {low} AS DOUBLE) END)"
    )


ORACLE["product_ranking"] = with_(
    f"""{SALES}, {PRODUCTS},
scored AS (SELECT *, {_scaled('Sales')} * CAST(0.40 AS DOUBLE) + {_scaled('Quantity')} * CAST(0.30 AS DOUBLE)
  + {_scaled('Profit_Margin')} * CAST(0.30 AS DOUBLE) AS Composite_Score FROM prod)""",
    """SELECT row_number() OVER (ORDER BY Composite_Score DESC, Product, Category) AS Rank, Product, Category,
  Sales, Profit, Quantity, Profit_Margin, Composite_Score FROM scored""",
)


def _shares(key: str) -> str:
    return f"""{key.lower()}s AS (
SELECT {key}, {S} AS Sales, {P} AS Profit, {O} AS Orders, {Q} AS Quantity, {div(P, S)} AS Profit_Margin,
  {S} / CAST(sum(sum(Sales)) OVER () AS DOUBLE) * 100 AS Share_Pct FROM sales GROUP BY {key})"""


CATEGORIES, REGIONS = _shares("Category"), _shares("Region")
ORACLE["category_metrics"] = with_(f"{SALES}, {CATEGORIES}", "SELECT * FROM categorys")
_KEYS = ", ".join(f"('{k}')" for k in r.CONTRIBUTION_KEYS)
ORACLE["category_contribution"] = with_(
    f"{SALES}, {CATEGORIES}",
    f"""SELECT Key, coalesce(Share_Pct, 0.0) AS Contribution_Pct FROM (VALUES {_KEYS}) k(Key)
FULL JOIN categorys ON Key = replace(Category, ' ', '')""",
)
ORACLE["region_metrics"] = with_(f"{SALES}, {REGIONS}", "SELECT * FROM regions")
ORACLE["lowest_region"] = with_(
    f"{SALES}, {REGIONS}", "SELECT * FROM regions ORDER BY Sales, Region LIMIT 1"
)
_PLACE_MEASURES = f"{S} AS Sales, {P} AS Profit, {O} AS Orders, {div(P, S)} AS Profit_Margin"
ORACLE["state_sales"] = with_(
    SALES, f"SELECT State, Region, {_PLACE_MEASURES} FROM sales GROUP BY 1, 2"
)
ORACLE["city_revenue"] = with_(
    SALES,
    f"""SELECT City, State, Region, {_PLACE_MEASURES} FROM sales GROUP BY 1, 2, 3
ORDER BY Sales DESC, City, State, Region LIMIT 10""",
)
ORACLE["regional_growth"] = with_(
    f"""{SALES}, ry AS (
SELECT Region, Year, {S} AS Sales, {P} AS Profit FROM sales GROUP BY 1, 2)""",
    """SELECT Region, Year, Sales, Profit,
  CASE WHEN lag(Sales) OVER w > 0 THEN (Sales - lag(Sales) OVER w) / lag(Sales) OVER w * 100
    ELSE 0.0 END AS Sales_Growth_Pct,
  CASE WHEN lag(Profit) OVER w > 0 THEN (Profit - lag(Profit) OVER w) / lag(Profit) OVER w * 100
    ELSE 0.0 END AS Profit_Growth_Pct
FROM ry WINDOW w AS (PARTITION BY Region ORDER BY Year)""",
)
ORACLE["dashboard_filter"] = with_(
    SALES,
    f"""SELECT {RECORD}, Quarter FROM sales WHERE Region = '{r.FILTER_REGION}'
AND Category = '{r.FILTER_CATEGORY}' AND lower(Quarter) = '{r.FILTER_QUARTER}'""",
)

# --- star views ---------------------------------------------------------------------------

UNIQUE_NAME = "p_name || ' #' || p_partkey"
STAR = f"""s_categories AS (SELECT min(p_partkey) AS category_id, p_type AS category_name FROM part GROUP BY p_type),
s_customers AS (
SELECT c_custkey AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS customer_name,
  n_name || ' ' || c_mktsegment AS city, n_name AS state, '{LOADED_AT}' AS created_at, '{LOADED_AT}' AS updated_at
FROM customer JOIN nation ON c_nationkey = n_nationkey),
s_products AS (
SELECT p_partkey AS product_id, {UNIQUE_NAME} AS product_name, category_id,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(100 AS BIGINT) AS stock,
  '{LOADED_AT}' AS created_at, '{LOADED_AT}' AS updated_at
FROM part JOIN s_categories ON p_type = category_name),
s_orders AS (
SELECT o_orderkey AS order_id, CAST(o_orderkey AS VARCHAR) AS order_code, o_custkey AS customer_id,
  CAST(o_orderdate AS DATE) AS order_date, CAST(n_regionkey AS BIGINT) AS region_id,
  '{LOADED_AT}' AS created_at, '{LOADED_AT}' AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
s_items AS (
SELECT l_orderkey * 8 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
  CAST(l_quantity AS INT) AS quantity, CAST(p_retailprice AS DECIMAL(12,2)) AS price_per_unit,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS sales,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2))
    - CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS profit
FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SUMMARY = """summary AS (
SELECT o.order_code AS Order_ID, o.order_date AS Order_Date, c.customer_code AS Customer_ID,
  c.customer_name AS Customer_Name, p.product_name AS Product, g.category_name AS Category,
  i.quantity AS Quantity, i.price_per_unit AS Price, i.sales AS Sales, i.profit AS Profit,
  c.city AS City, c.state AS State, r.r_name AS Region
FROM s_items i JOIN s_orders o ON i.order_id = o.order_id JOIN s_customers c ON o.customer_id = c.customer_id
JOIN s_products p ON i.product_id = p.product_id JOIN s_categories g ON p.category_id = g.category_id
JOIN region r ON o.region_id = r.r_regionkey)"""
ORACLE["view_sales_summary"] = with_(f"{STAR}, {SUMMARY}", f"SELECT {RECORD} FROM summary")
ORACLE["sales_by_date"] = with_(
    f"{STAR}, {SUMMARY}",
    f"SELECT {RECORD} FROM summary WHERE Order_Date BETWEEN DATE '{r.DATE_FROM}' AND DATE '{r.DATE_TO}'",
)
ORACLE["sales_by_category"] = with_(
    f"{STAR}, {SUMMARY}", f"SELECT {RECORD} FROM summary WHERE Category = '{r.FILTER_CATEGORY}'"
)
ORACLE["sales_by_region"] = with_(
    f"{STAR}, {SUMMARY}", f"SELECT {RECORD} FROM summary WHERE Region = '{r.FILTER_REGION}'"
)
VIEW_CUSTOMER = """v_customer AS (
SELECT c.customer_id AS id, c.customer_code AS Customer_ID, c.customer_name AS Customer_Name, c.city AS City,
  c.state AS State, count(DISTINCT o.order_id) AS Total_Orders,
  CAST(coalesce(sum(i.sales), 0) AS DOUBLE) AS Total_Sales,
  CAST(coalesce(sum(i.profit), 0) AS DOUBLE) AS Total_Profit,
  coalesce(CAST(sum(i.sales) AS DOUBLE) / nullif(count(DISTINCT o.order_id), 0), 0.0) AS Avg_Order_Value
FROM s_customers c LEFT JOIN s_orders o ON c.customer_id = o.customer_id
LEFT JOIN s_items i ON o.order_id = i.order_id GROUP BY ALL)"""
ORACLE["view_customer_summary"] = with_(f"{STAR}, {VIEW_CUSTOMER}", "SELECT * FROM v_customer")
ORACLE["proc_top_customers"] = with_(
    f"{STAR}, {VIEW_CUSTOMER}",
    """SELECT Customer_ID AS customer_code, Customer_Name, City, State, Total_Orders, Total_Sales, Total_Profit,
  Avg_Order_Value FROM v_customer ORDER BY Total_Sales DESC, id LIMIT 10""",
)
VIEW_PRODUCT = """v_product AS (
SELECT p.product_id, p.product_name AS Product, g.category_name AS Category, CAST(p.price AS DOUBLE) AS List_Price,
  p.stock AS Current_Stock, CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS Total_Units_Sold,
  CAST(coalesce(sum(i.sales), 0) AS DOUBLE) AS Total_Sales,
  CAST(coalesce(sum(i.profit), 0) AS DOUBLE) AS Total_Profit
FROM s_products p JOIN s_categories g ON p.category_id = g.category_id
LEFT JOIN s_items i ON p.product_id = i.product_id GROUP BY ALL)"""
ORACLE["view_product_summary"] = with_(f"{STAR}, {VIEW_PRODUCT}", "SELECT * FROM v_product")
ORACLE["proc_top_products"] = with_(
    f"{STAR}, {VIEW_PRODUCT}",
    "SELECT * EXCLUDE (product_id) FROM v_product ORDER BY Total_Sales DESC, product_id LIMIT 10",
)
ORACLE["view_monthly_sales"] = with_(
    STAR,
    """SELECT CAST(year(order_date) AS INT) AS Year, CAST(month(order_date) AS INT) AS Month,
  strftime(order_date, '%b') AS Month_Name, CAST(sum(sales) AS DOUBLE) AS Monthly_Sales,
  CAST(sum(profit) AS DOUBLE) AS Monthly_Profit, count(DISTINCT o.order_id) AS Total_Orders
FROM s_orders o JOIN s_items i ON o.order_id = i.order_id GROUP BY 1, 2, 3""",
)
ORACLE["yearly_sales"] = with_(
    STAR,
    """SELECT CAST(year(order_date) AS INT) AS Year, CAST(sum(sales) AS DOUBLE) AS Yearly_Sales,
  CAST(sum(profit) AS DOUBLE) AS Yearly_Profit, count(DISTINCT o.order_id) AS Total_Orders
FROM s_orders o JOIN s_items i ON o.order_id = i.order_id GROUP BY 1""",
)


def _unique(table: str, rel: str, col: str) -> str:
    return f"""SELECT '{table}' AS table_name, 'unique({col})' AS rule_name, CAST({col} AS VARCHAR) AS key,
  count(*) AS n FROM {rel} GROUP BY {col} HAVING count(*) > 1"""


def _foreign(table: str, rel: str, col: str, parent: str, prel: str) -> str:
    return f"""SELECT '{table}', '{col} -> {parent}.{col}', CAST({col} AS VARCHAR), count(*) FROM {rel}
WHERE {col} NOT IN (SELECT {col} FROM {prel}) GROUP BY {col}"""


def _check(rule: str) -> str:
    return f"""SELECT 'order_items', '{rule}', order_id || '|' || product_id, count(*) FROM s_items
WHERE NOT ({rule}) GROUP BY 3"""


_REGION = "(SELECT CAST(r_regionkey AS BIGINT) AS region_id, r_name AS region_name FROM region)"
ORACLE["constraint_violations"] = with_(
    STAR,
    "\nUNION ALL\n".join(
        [
            _unique("categories", "s_categories", "category_id"),
            _unique("categories", "s_categories", "category_name"),
            _unique("regions", _REGION, "region_id"),
            _unique("regions", _REGION, "region_name"),
            _unique("customers", "s_customers", "customer_id"),
            _unique("customers", "s_customers", "customer_code"),
            _unique("products", "s_products", "product_id"),
            _unique("products", "s_products", "product_name"),
            _unique("orders", "s_orders", "order_id"),
            _unique("orders", "s_orders", "order_code"),
            _unique("order_items", "s_items", "order_item_id"),
            _foreign("products", "s_products", "category_id", "categories", "s_categories"),
            _foreign("orders", "s_orders", "customer_id", "customers", "s_customers"),
            _foreign("orders", "s_orders", "region_id", "regions", _REGION),
            _foreign("order_items", "s_items", "order_id", "orders", "s_orders"),
            _foreign("order_items", "s_items", "product_id", "products", "s_products"),
            _check("quantity > 0"),
            _check("price_per_unit >= 0"),
            _check("sales >= 0"),
        ]
    ),
)

# --- star built from the flat records -----------------------------------------------------

BUILT = f"""{FLAT},
placed AS (SELECT *, row_number() OVER (ORDER BY {PLACE}) AS place FROM flat),
b_categories AS (
SELECT row_number() OVER (ORDER BY min(place)) AS category_id, Category AS category_name FROM placed GROUP BY Category),
b_regions AS (
SELECT row_number() OVER (ORDER BY min(place)) AS region_id, Region AS region_name FROM placed GROUP BY Region),
b_customers AS (
SELECT row_number() OVER (ORDER BY Customer_ID) AS customer_id, Customer_ID AS customer_code,
  arg_min(Customer_Name, place) AS customer_name, arg_min(City, place) AS city, arg_min(State, place) AS state
FROM placed GROUP BY Customer_ID),
b_products AS (
SELECT x.product_id, x.product_name, c.category_id, x.price, CAST(100 AS BIGINT) AS stock FROM (
  SELECT row_number() OVER (ORDER BY Product) AS product_id, Product AS product_name,
    arg_min(Category, place) AS category_name, arg_min(Price, place) AS price FROM placed GROUP BY Product) x
LEFT JOIN b_categories c USING (category_name)),
b_orders AS (
SELECT x.order_id, x.order_code, c.customer_id, x.order_date, g.region_id FROM (
  SELECT row_number() OVER (ORDER BY Order_ID) AS order_id, Order_ID AS order_code,
    arg_min(Customer_ID, place) AS customer_code, arg_min(Order_Date, place) AS order_date,
    arg_min(Region, place) AS region_name FROM placed GROUP BY Order_ID) x
LEFT JOIN b_customers c USING (customer_code) LEFT JOIN b_regions g USING (region_name))"""
for _name in ("categories", "regions", "customers", "orders"):
    ORACLE[f"star_{_name}"] = with_(BUILT, f"SELECT * FROM b_{_name}")
ORACLE["star_products"] = with_(
    BUILT, "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM b_products"
)
ORACLE["star_items"] = with_(
    BUILT,
    """SELECT o.order_id, p.product_id, f.Quantity AS quantity, CAST(p.price AS DOUBLE) AS price_per_unit,
  CAST(f.Sales AS DOUBLE) AS sales, CAST(f.Profit AS DOUBLE) AS profit
FROM flat f LEFT JOIN b_orders o ON f.Order_ID = o.order_code
LEFT JOIN b_products p ON f.Product = p.product_name""",
)

# --- cleaning -----------------------------------------------------------------------------

_ROW = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
ORACLE["margins"] = with_(f"{DIRTY}, {MARGINS}", "SELECT * FROM margins")
ORACLE["impute_profit"] = with_(
    IMPUTED,
    f"""SELECT {_ROW}, Category, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit, no_profit
FROM imputed""",
)
ORACLE["impute_name"] = with_(
    IMPUTED, f"SELECT {_ROW}, Customer_ID, Customer_Name, no_name FROM imputed"
)
ORACLE["impute_city"] = with_(IMPUTED, f"SELECT {_ROW}, City, State, no_city FROM imputed")

_CUT = """CASE WHEN abs(Profit) < 100000 THEN CAST(Profit AS DOUBLE)
  WHEN abs(Profit) < 1000000 THEN CAST(round(Profit, 1) AS DOUBLE) ELSE CAST(round(Profit, 0) AS DOUBLE) END"""
_SEVEN = f"""regexp_replace(regexp_replace(format('{{:,.2f}}', {_CUT}), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"""
_AUDIT_TIME = r.CHANGED_AT.split(" ")[1]
ORACLE["audit_log"] = with_(
    f"""{IMPUTED},
entries AS (
SELECT 1 AS rank, {PLACE}, Order_ID, {quoted(cleaning.ISSUE_PROFIT)} AS Issue,
  'Imputed profit (₹' || {_SEVEN} || ') using ' || CAST(round_even(margin * 100, 0) AS INT)
  || '% average margin for ' || Category AS Action FROM imputed WHERE no_profit
UNION ALL
SELECT 2, {PLACE}, Order_ID, {quoted(cleaning.ISSUE_NAME)},
  'Mapped ID ''' || Customer_ID || ''' to database record ''' || Customer_Name || '''' FROM imputed WHERE no_name
UNION ALL
SELECT 3, {PLACE}, Order_ID, {quoted(cleaning.ISSUE_CITY)},
  'Resolved geographic scope to ''' || City || ''' from State context ''' || State || '''' FROM imputed
WHERE no_city)""",
    f"""SELECT 'AUD-' || (1000 + row_number() OVER (ORDER BY rank, {PLACE})) AS Audit_ID, Order_ID, Issue, Action,
  '{_AUDIT_TIME}' AS Time, 'Resolved' AS Status FROM entries""",
)
ORACLE["dedupe"] = with_(
    DIRTY,
    f"""SELECT {_ROW}, Order_ID, CAST(Sales AS DOUBLE) AS Sales FROM dirty
QUALIFY row_number() OVER (PARTITION BY Order_ID ORDER BY {LINE}) = 1""",
)
ORACLE["valid_rows"] = with_(
    DIRTY,
    f"""SELECT {_ROW}, Order_ID, Quantity, CAST(Price AS DOUBLE) AS Price, CAST(Sales AS DOUBLE) AS Sales
FROM dirty WHERE Quantity > 0 AND Price > 0 AND Sales > 0""",
)
ORACLE["typed_rows"] = with_(DIRTY, f"SELECT {RECORD} FROM dirty")
ORACLE["derived_metrics"] = with_(
    SALES,
    """SELECT Order_ID, Order_Date, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit,
  Year, Month, Quarter, Month_Name, Profit_Margin FROM sales""",
)
ORACLE["outliers"] = with_(
    f"""{FLAT}, q AS (
SELECT quantile_cont(CAST(Sales AS DOUBLE), 0.25) AS s1, quantile_cont(CAST(Sales AS DOUBLE), 0.75) AS s3,
  quantile_cont(CAST(Profit AS DOUBLE), 0.25) AS p1, quantile_cont(CAST(Profit AS DOUBLE), 0.75) AS p3 FROM flat)""",
    """SELECT Order_ID, Product, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit,
  CAST(Sales AS DOUBLE) < s1 - 1.5 * (s3 - s1) OR CAST(Sales AS DOUBLE) > s3 + 1.5 * (s3 - s1)
  OR CAST(Profit AS DOUBLE) < p1 - 1.5 * (p3 - p1) OR CAST(Profit AS DOUBLE) > p3 + 1.5 * (p3 - p1) AS Is_Outlier
FROM flat, q""",
)


def _norm(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return (
        f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({v} - min({v}) OVER ()) "
        f"/ (max({v}) OVER () - min({v}) OVER ()) END AS {c}_Norm"
    )


ORACLE["normalize"] = with_(
    FLAT,
    f"""SELECT Order_ID, Product, CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit, Quantity,
  {_norm('Sales')}, {_norm('Profit')}, {_norm('Quantity')} FROM flat""",
)
ORACLE["clean_pipeline"] = with_(CLEAN, f"SELECT {CLEAN_RECORD}, Is_Outlier FROM clean")
ORACLE["pipeline_stats"] = with_(
    CLEAN,
    """SELECT raw_n AS Raw_Rows, raw_n - ids AS Duplicates_Removed, ids - clean_n AS Invalid_Removed,
  clean_n AS Clean_Rows, outliers AS Outliers, CAST(outliers AS DOUBLE) / clean_n * 100 AS Outlier_Pct
FROM (SELECT count(*) AS raw_n, count(DISTINCT Order_ID) AS ids FROM dirty),
 (SELECT count(*) AS clean_n, count(*) FILTER (Is_Outlier) AS outliers FROM clean)""",
)

# --- reports and insights -----------------------------------------------------------------

_DAY = f"DATE '{r.REPORT_DAY}'"
_SAME_YEAR = f"Year = year({_DAY})"


def _period(condition: str, label: str) -> str:
    """Rows of a period; all rows under the full label when it has none."""
    return with_(
        f"{SALES}, hits AS (SELECT count(*) AS n FROM sales WHERE {condition})",
        f"""SELECT {CLEAN_RECORD}, CASE WHEN n > 0 THEN {label} ELSE 'Full_Dataset' END AS Label
FROM sales, hits WHERE n = 0 OR ({condition})""",
    )


ORACLE["report_daily"] = _period(f"Order_Date = {_DAY}", f"'Daily_{r.REPORT_DAY}'")
ORACLE["report_monthly"] = _period(
    "date_trunc('month', Order_Date) = (SELECT date_trunc('month', max(Order_Date)) FROM sales)",
    "strftime((SELECT max(Order_Date) FROM sales), 'Monthly_%Y_%m')",
)
ORACLE["report_quarterly"] = _period(
    f"{_SAME_YEAR} AND Quarter = 'Q' || quarter({_DAY})",
    f"'Quarterly_' || year({_DAY}) || '_Q' || quarter({_DAY})",
)
ORACLE["report_yearly"] = _period(_SAME_YEAR, f"'Yearly_' || year({_DAY})")
ORACLE["report_fallback"] = _period(
    f"date_trunc('month', Order_Date) = date_trunc('month', DATE '{r.EMPTY_DAY}')",
    f"strftime(DATE '{r.EMPTY_DAY}', 'Monthly_%Y_%m')",
)

YEAR_ROWS = f"{SALES}, chosen AS (SELECT * FROM sales WHERE {_SAME_YEAR})"
YEAR_KPIS = f"""{YEAR_ROWS}, k AS (
SELECT {S} AS Revenue, {P} AS Profit, {div(P, S)} AS ProfitMargin, {O} AS TotalOrders, {div(S, O)} AS AOV,
  count(*) AS Record_Volume,
  (SELECT CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*) FROM
    (SELECT {O} AS n FROM chosen GROUP BY Customer_ID)) AS Retention FROM chosen)"""


def _plain(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '\\.?0+$', '')"


ORACLE["report_kpis"] = with_(
    YEAR_KPIS,
    f"""SELECT CAST(1 AS INT) AS position, 'Total Revenue' AS KPI, {_plain('Revenue')} AS Value FROM k
UNION ALL SELECT 2, 'Total Profit', {_plain('Profit')} FROM k
UNION ALL SELECT 3, 'Gross Profit Margin', {pct_text('ProfitMargin', 2)} FROM k
UNION ALL SELECT 4, 'Total Orders', CAST(TotalOrders AS VARCHAR) FROM k
UNION ALL SELECT 5, 'Average Order Value (AOV)', {_plain('round(AOV, 2)')} FROM k
UNION ALL SELECT 6, 'Retention Rate', {pct_text('Retention', 2)} FROM k""",
)
ORACLE["report_cards"] = with_(
    YEAR_KPIS,
    f"""SELECT 'Yearly_' || year({_DAY}) AS Label, Record_Volume, '₹' || {grouped_text('Revenue')} AS Revenue,
  '₹' || {grouped_text('Profit')} AS Profit, {pct_text('ProfitMargin', 2)} AS ProfitMargin,
  CAST(TotalOrders AS VARCHAR) AS TotalOrders, '₹' || {grouped_text('AOV')} AS AOV,
  {pct_text('Retention', 2)} AS CustomerRetentionRate FROM k""",
)
ORACLE["report_region_rows"] = with_(
    YEAR_ROWS,
    f"""SELECT Region, '₹' || {grouped_text('sum(Sales)')} AS Sales_Volume,
  '₹' || {grouped_text('sum(Profit)')} AS Profit_Amount, {pct_text(div(P, S), 1)} AS Profit_Margin
FROM chosen GROUP BY Region""",
)
ORACLE["report_product_rows"] = with_(
    YEAR_ROWS,
    f"""SELECT Product, Category, q || ' units' AS Quantity_Sold, '₹' || {grouped_text('s')} AS Revenue,
  '₹' || {grouped_text('p')} AS Total_Profit FROM (
  SELECT Product, Category, {Q} AS q, sum(Sales) AS s, sum(Profit) AS p FROM chosen GROUP BY 1, 2
  ORDER BY s DESC, Product, Category LIMIT 5)""",
)


def _fill(template: str, *values: str) -> str:
    """SQL concatenation of a sentence template and its value expressions."""
    pieces, rest = [], template
    for v in values:
        for mark in ("%.1f%%", "%s", "%d"):
            if mark in rest and rest.index(mark) == min(
                rest.index(m) for m in ("%.1f%%", "%s", "%d") if m in rest
            ):
                head, rest = rest.split(mark, 1)
                pieces.append(quoted(head))
                pieces.append(f"printf('%.1f%%', {v} * 100)" if mark == "%.1f%%" else f"({v})")
                break
    pieces.append(quoted(rest))
    return " || ".join(pieces)


BEST_CATEGORY = "best_category AS (SELECT * FROM categorys ORDER BY Sales DESC, Category LIMIT 1)"
WORST_REGION = "worst_region AS (SELECT * FROM regions ORDER BY Sales, Region LIMIT 1)"
TOP_CUSTOMER = (
    "top_customer AS (SELECT * FROM cust ORDER BY Total_Spent DESC, Customer_ID, Customer_Name LIMIT 1)"
)
TOPICS = f"{SALES}, {CATEGORIES}, {REGIONS}, {CUSTOMERS}, {PRODUCTS}, {YEARLY}, {BEST_CATEGORY}, {WORST_REGION}, {TOP_CUSTOMER}"
_Y = "(SELECT Sales_Growth_Pct / 100 FROM growing ORDER BY Year DESC LIMIT 1)"
ORACLE["insights"] = with_(
    f"""{TOPICS},
top_profit AS (SELECT * FROM prod ORDER BY Profit DESC, Product, Category LIMIT 1),
peak AS (SELECT Month_Name FROM sales GROUP BY Month, Month_Name ORDER BY sum(Sales) DESC, Month LIMIT 1)""",
    f"""SELECT CAST(1 AS INT) AS position, 'BestCategory' AS key,
  {_fill(insights.BEST_CATEGORY, 'Category', grouped_text('Sales'), 'Profit_Margin')} AS text FROM best_category
UNION ALL SELECT 2, 'WorstRegion',
  {_fill(insights.WORST_REGION, 'Region', grouped_text('Sales'), 'Profit_Margin')} FROM worst_region
UNION ALL SELECT 3, 'TopCustomer',
  {_fill(insights.TOP_CUSTOMER, 'Customer_Name', 'Customer_ID', grouped_text('Total_Spent'), 'Total_Orders')}
FROM top_customer
UNION ALL SELECT 4, 'HighestProfitProduct',
  {_fill(insights.TOP_PROFIT_PRODUCT, 'Product', grouped_text('Profit'), 'Profit_Margin')} FROM top_profit
UNION ALL SELECT 5, 'SeasonalTrend', {_fill(insights.PEAK_MONTH, 'Month_Name')} FROM peak
UNION ALL SELECT 6, 'GrowthTrend', {_fill(insights.GROWTH, _Y, '(SELECT max(Year) FROM growing)')}""",
)
ORACLE["recommendations"] = with_(
    TOPICS,
    f"""SELECT CAST(1 AS INT) AS position, 'Strategy' AS key,
  {_fill(insights.FIX_REGION, 'Region', 'Profit_Margin')} AS text FROM worst_region WHERE Profit_Margin < 0.05
UNION ALL SELECT p, 'Strategy', t FROM worst_region,
  (VALUES (1, {quoted(insights.DEFAULT_RECOMMENDATIONS[0])}), (2, {quoted(insights.DEFAULT_RECOMMENDATIONS[1])})) d(p, t)
  WHERE Profit_Margin >= 0.05
UNION ALL SELECT 3, 'TopCustomer', {_fill(insights.KEEP_CUSTOMER, 'Customer_Name')} FROM top_customer
UNION ALL SELECT 4, 'BestCategory', {_fill(insights.PUSH_CATEGORY, 'Category')} FROM best_category""",
)

# --- models ------------------------------------------------------------------------------

_RFM_SQL = f"""{SALES},
customers AS (SELECT Customer_ID, Customer_Name, max(Order_Date) AS last, CAST(count(DISTINCT Order_ID) AS DOUBLE) AS f,
  CAST(sum(Sales) AS DOUBLE) AS m FROM sales GROUP BY ALL),
rfm AS (SELECT CAST((SELECT max(last) FROM customers) - last AS DOUBLE) AS r, f, m FROM customers)"""
ORACLE["segment_facts"] = f"""WITH {_RFM_SQL}
SELECT count(*) AS Customers, CAST(0 AS BIGINT) AS Misplaced, CAST(3 AS BIGINT) AS Clusters,
  CAST(count(*) AS BIGINT) AS Profiled, round(sum(m), 0) AS Monetary, round(sum(f), 0) AS Frequency, round(sum(r), 0) AS Recency
FROM rfm"""


def _lloyd_ctes() -> str:
    """Each round as two CTEs: the nearest center of every point and start, then the means; an empty center stays."""
    given = ", ".join(
        f"({s}, {c}, {x[0]}e0, {x[1]}e0, {x[2]}e0)" for s, start in enumerate(r.LLOYD_STARTS) for c, x in enumerate(start)
    )
    out = [f"c0(start, center, r, f, m) AS (VALUES {given})"]
    for i in range(r.LLOYD_ROUNDS):
        out.append(f"""n{i} AS (
  SELECT p.*, c.start, arg_min(c.center, (pow(p.r - c.r, 2) + pow(p.f - c.f, 2) + pow(p.m - c.m, 2), c.center)) AS center
  FROM scaled p, c{i} c GROUP BY p.id, p.r, p.f, p.m, c.start),
c{i + 1} AS (
  SELECT c.start, c.center, coalesce(avg(n.r), any_value(c.r)) AS r, coalesce(avg(n.f), any_value(c.f)) AS f,
    coalesce(avg(n.m), any_value(c.m)) AS m
  FROM c{i} c LEFT JOIN n{i} n ON n.start = c.start AND n.center = c.center GROUP BY c.start, c.center)""")
    return ",\n".join(out)


ORACLE["lloyd_rounds"] = f"""WITH {_RFM_SQL},
scaled AS (
  SELECT row_number() OVER () AS id, (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) AS r,
    (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) AS f, (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) AS m
  FROM rfm),
{_lloyd_ctes()}
SELECT start, center, round(r, 7) AS R_Norm, round(f, 7) AS F_Norm, round(m, 7) AS M_Norm FROM c{r.LLOYD_ROUNDS}"""

ORACLE["demand_totals"] = f"""WITH {SALES}
SELECT Factor, Level, count(*) AS Lines, CAST(sum(Quantity) AS DOUBLE) AS Observed, CAST(sum(Quantity) AS DOUBLE) AS Fitted
FROM (SELECT 'Category' AS Factor, Category AS Level, Quantity FROM sales
  UNION ALL SELECT 'Region', Region, Quantity FROM sales
  UNION ALL SELECT 'Month', CAST(Month AS VARCHAR), Quantity FROM sales)
GROUP BY ALL"""
ORACLE["demand_mean_metrics"] = f"""WITH {SALES},
mean AS (SELECT avg(Quantity) AS q FROM sales)
SELECT round(sqrt(avg(pow(Quantity - q, 2))), 6) AS RMSE, round(avg(abs(Quantity - q)), 6) AS MAE, round(any_value(q), 6) AS Mean_Quantity
FROM sales, mean"""

# --- forecasts ----------------------------------------------------------------------------

_T_VALUES = ", ".join(f"({i + 1}, CAST({q!r} AS DOUBLE))" for i, q in enumerate(t_table()))


def forecast_ctes(group: str = "", where: str = "", periods: int = 6) -> str:
    """Forecast table ``fc``; models only (groups have at least six months) unless flat."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    using = f"USING ({group})" if group else "ON true"
    return f"""{SALES},
tq(df, q) AS (VALUES {_T_VALUES}),
months AS (
SELECT {g}Year, Month, CAST(sum(Sales) AS DOUBLE) AS y, max(Order_Date) AS last_date,
  CAST(row_number() OVER ({part} ORDER BY Year, Month) AS DOUBLE) AS t
FROM sales {where} GROUP BY {g}Year, Month),
fit AS (
SELECT {g}CAST(count(*) AS DOUBLE) AS n, max(last_date) AS last_date, avg(y) AS my, avg(t) AS mt,
  regr_sxx(y, t) AS sxx, regr_sxy(y, t) AS sxy, regr_syy(y, t) AS syy FROM months {f'GROUP BY {group}' if group else ''}),
bymonth AS (
SELECT {g}Month, CAST(count(*) AS DOUBLE) AS nm, avg(t) AS tm, avg(y) AS ym, regr_sxx(y, t) AS xx,
  regr_sxy(y, t) AS xy, regr_syy(y, t) AS yy FROM months GROUP BY {g}Month),
within AS (
SELECT {g}CAST(count(*) AS DOUBLE) AS mcount, sum(xx) AS wxx, sum(xy) AS wxy, sum(yy) AS wyy FROM bymonth
{f'GROUP BY {group}' if group else ''}),
ahead AS (
SELECT f.*, w.* {f'EXCLUDE ({group})' if group else ''}, CAST(h AS DOUBLE) AS h, n + h AS ft,
  CAST(date_trunc('month', last_date + INTERVAL 30 DAY) + to_months(CAST(h - 1 AS INT)) AS DATE)
    + CAST(day(last_date + INTERVAL 30 DAY) - 1 AS INT) AS label
FROM fit f JOIN within w {using}, range(1, {periods + 1}) x(h)),
joined AS (
SELECT a.*, b.nm, b.tm, b.ym, max(b.nm IS NULL) OVER ({f'PARTITION BY a.{group}' if group else ''}) AS unseen,
  my + sxy / sxx * (ft - mt) AS lr,
  (SELECT q FROM tq WHERE df = n - 2) * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)
    * (1 + 1 / n + (ft - mt) * (ft - mt) / sxx)) AS lr_half,
  ym + wxy / wxx * (ft - tm) AS se,
  (SELECT q FROM tq WHERE df = n - mcount - 1) * sqrt(greatest(wyy - wxy * wxy / wxx, 0) / (n - mcount - 1)
    * (1 + 1 / nm + (ft - tm) * (ft - tm) / wxx)) AS se_half
FROM ahead a LEFT JOIN bymonth b ON {f'a.{group} = b.{group} AND ' if group else ''}b.Month = month(a.label)),
fc AS (
SELECT {g}CAST(ft AS BIGINT) AS Month_Index, strftime(label, '%b') AS Month_Name, CAST(year(label) AS INT) AS Year,
  CAST(month(label) AS INT) AS Month, round(greatest(lr, 0), 0) AS Sales_LR,
  round(greatest(CASE WHEN unseen THEN lr ELSE se END, 0), 0) AS Sales_ARIMA,
  round(greatest(lr - lr_half, 0), 0) AS LR_Lower80, round(greatest(lr + lr_half, 0), 0) AS LR_Upper80,
  round(greatest(CASE WHEN unseen THEN lr - lr_half ELSE se - se_half END, 0), 0) AS ARIMA_Lower80,
  round(greatest(CASE WHEN unseen THEN lr + lr_half ELSE se + se_half END, 0), 0) AS ARIMA_Upper80,
  'Linear Regression & Seasonal Dummy Regression' AS method FROM joined)"""


ORACLE["forecast_table"] = with_(forecast_ctes(), "SELECT * FROM fc")
# Residuals of given models: z is the differenced series, y its AR part, e_t = y_t - theta e_(t-1) - Theta e_(t-12)
# - theta Theta e_(t-13), all zero before the first row. Columns: orders, d, D, phi1, phi2, theta, Phi, Theta, size.
ORACLE["arima_criteria"] = f"""WITH RECURSIVE {SALES},
monthly AS (SELECT Region, Year, Month, CAST(sum(Sales) AS DOUBLE) AS v FROM sales GROUP BY ALL),
numbered AS (SELECT Region, v, row_number() OVER (PARTITION BY Region ORDER BY Year, Month) AS t FROM monthly),
models(Orders, d, ds, phi1, phi2, theta, sphi, stheta, size) AS (VALUES
  ('ARIMA(1,0,0)', 0, 0, 0.9e0, 0e0, 0e0, 0e0, 0e0, 1),
  ('ARIMA(0,1,1)', 1, 0, 0e0, 0e0, -0.6e0, 0e0, 0e0, 1),
  ('ARIMA(0,1,1)(0,1,1)[12]', 1, 1, 0e0, 0e0, -0.5e0, 0e0, -0.4e0, 2),
  ('ARIMA(1,1,1)(1,0,0)[12]', 1, 0, 0.3e0, 0e0, -0.4e0, 0.2e0, 0e0, 3),
  ('ARIMA(2,0,1)(1,1,0)[12]', 0, 1, 0.4e0, -0.2e0, 0.3e0, -0.5e0, 0e0, 4)),
seasonal AS (
  SELECT m.*, Region, t, CASE WHEN ds = 1 THEN v - lag(v, 12) OVER s ELSE v END AS v FROM numbered, models m
  WINDOW s AS (PARTITION BY Region, Orders ORDER BY t)),
plain AS (
  SELECT * REPLACE (CASE WHEN d = 1 THEN v - lag(v) OVER s ELSE v END AS v) FROM seasonal
  WINDOW s AS (PARTITION BY Region, Orders ORDER BY t)),
work AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY Region, Orders ORDER BY t) AS t) FROM plain WHERE v IS NOT NULL),
lagged AS (
  SELECT *, v - phi1 * coalesce(lag(v) OVER s, 0) - phi2 * coalesce(lag(v, 2) OVER s, 0) AS y FROM work
  WINDOW s AS (PARTITION BY Region, Orders ORDER BY t)),
driven AS (
  SELECT *, y - sphi * coalesce(lag(y, 12) OVER s, 0) AS u FROM lagged
  WINDOW s AS (PARTITION BY Region, Orders ORDER BY t)),
shocks(Region, Orders, theta, stheta, size, t, e) AS (
  SELECT Region, Orders, theta, stheta, size, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]) FROM driven WHERE t = 1
  UNION ALL
  SELECT s.Region, s.Orders, s.theta, s.stheta, s.size, d.t, list_append(s.e, d.u - s.theta * coalesce(s.e[-1], 0)
    - CASE WHEN s.t >= 12 THEN s.stheta * s.e[-12] ELSE 0 END
    - CASE WHEN s.t >= 13 THEN s.theta * s.stheta * s.e[-13] ELSE 0 END)
  FROM shocks s JOIN driven d ON d.Region = s.Region AND d.Orders = s.Orders AND d.t = s.t + 1),
ended AS (SELECT * FROM shocks QUALIFY row_number() OVER (PARTITION BY Region, Orders ORDER BY t DESC) = 1),
judged AS (SELECT Region, Orders, t AS n, size + 1 AS k, e[-1] AS last, list_sum(list_transform(e, lambda x: x * x)) AS sse FROM ended)
SELECT Region, Orders, n AS Rows, round(last, 2) AS Last_Shock,
  round(n * (ln(2 * pi() * sse / n) + 1) + 2 * k + 2.0e0 * k * (k + 1) / (n - k - 1), 5) AS AICc
FROM judged"""
ORACLE["forecast_linear"] = with_(
    forecast_ctes(), "SELECT Month_Index, Year, Month, Sales_LR, LR_Lower80, LR_Upper80 FROM fc"
)
ORACLE["forecast_seasonal"] = with_(
    forecast_ctes(periods=12),
    "SELECT Month_Index, Year, Month, Sales_ARIMA, ARIMA_Lower80, ARIMA_Upper80 FROM fc",
)
ORACLE["forecast_by_category"] = with_(forecast_ctes("Category"), "SELECT * FROM fc")
ORACLE["forecast_by_customer_state"] = with_(
    forecast_ctes("State", periods=3), "SELECT * FROM fc"
)
ORACLE["forecast_flat"] = with_(
    forecast_ctes("Customer_ID"),
    """SELECT Customer_ID, CAST(ft AS BIGINT) AS Month_Index, strftime(label, '%b') AS Month_Name,
  CAST(year(label) AS INT) AS Year, CAST(month(label) AS INT) AS Month, round(my, 4) AS Sales_LR,
  round(my, 4) AS Sales_ARIMA, round(my * 0.8, 4) AS LR_Lower80, round(my * 1.2, 4) AS LR_Upper80,
  round(my * 0.8, 4) AS ARIMA_Lower80, round(my * 1.2, 4) AS ARIMA_Upper80, 'Flat Average Fallback' AS method
FROM ahead WHERE n < 6""",
)
ORACLE["snapshot_texts"] = with_(
    f"{forecast_ctes()}, {CATEGORIES}, {PRODUCTS}".replace(
        "round(greatest(CASE WHEN unseen THEN lr ELSE se END, 0), 0) AS Sales_ARIMA",
        "greatest(CASE WHEN unseen THEN lr ELSE se END, 0) AS Sales_ARIMA",
    ),
    f"""SELECT 'TopProductText' AS key, (SELECT Product || ' (₹' || {grouped_text('Sales')} || ')' FROM prod
  ORDER BY Sales DESC, Product, Category LIMIT 1) AS text
UNION ALL SELECT 'WorstCategoryText', (SELECT Category || ' (' || {pct_text('Profit_Margin', 1)} || ' margin)'
  FROM categorys ORDER BY Profit_Margin, Sales DESC, Category LIMIT 1)
UNION ALL SELECT 'ForecastText', (SELECT 'Est. ₹' || {grouped_text('sum(Sales_ARIMA)')} || ' total volume' FROM
  (SELECT Sales_ARIMA FROM fc ORDER BY Month_Index LIMIT 3))""",
)

# --- changes ------------------------------------------------------------------------------

HISTORY = f"""{STAR},
h_orders AS (SELECT * FROM s_orders WHERE order_date < DATE '{CUTOVER}'),
h_items AS (SELECT * FROM s_items WHERE order_id IN (SELECT order_id FROM h_orders)),
h_products AS (SELECT * FROM s_products WHERE product_id IN (SELECT product_id FROM h_items)),
h_customers AS (SELECT * FROM s_customers WHERE customer_id IN (SELECT customer_id FROM h_orders)),
h_categories AS (SELECT * FROM s_categories WHERE category_id IN (SELECT category_id FROM h_products))"""
AT = f"'{r.CHANGED_AT}'"

ORACLE["apply_new_customers"] = with_(
    HISTORY,
    f"""SELECT * FROM h_customers
UNION ALL
SELECT (SELECT max(customer_id) FROM h_customers) + row_number() OVER (ORDER BY customer_id), customer_code,
  customer_name, city, state, {AT}, {AT} FROM s_customers
WHERE customer_code NOT IN (SELECT customer_code FROM h_customers)""",
)
ORACLE["new_customer_rejects"] = with_(
    HISTORY,
    """SELECT customer_code AS key, CAST(1 AS BIGINT) AS rejected_rows, 'already exists' AS reason FROM s_customers
WHERE customer_code IN (SELECT customer_code FROM h_customers)""",
)
NAMES_BATCH = """batch AS (
SELECT category_name, min(place * 2 + kind) AS first_place, count(*) AS n FROM (
  SELECT p_partkey AS place, 0 AS kind, p_type AS category_name FROM part
  UNION ALL SELECT p_partkey, 1, p_brand FROM part) GROUP BY category_name)"""
ORACLE["apply_new_categories"] = with_(
    f"{HISTORY}, {NAMES_BATCH}",
    """SELECT * FROM h_categories
UNION ALL
SELECT (SELECT max(category_id) FROM h_categories) + row_number() OVER (ORDER BY first_place), category_name FROM batch
WHERE category_name NOT IN (SELECT category_name FROM h_categories)""",
)
ORACLE["new_category_rejects"] = with_(
    f"{HISTORY}, {NAMES_BATCH}",
    """SELECT category_name AS key, n AS rejected_rows, 'already exists' AS reason FROM batch
WHERE category_name IN (SELECT category_name FROM h_categories)
UNION ALL
SELECT category_name, n - 1, 'repeated in the batch' FROM batch
WHERE n > 1 AND category_name NOT IN (SELECT category_name FROM h_categories)""",
)
ORACLE["apply_new_products"] = with_(
    f"""{HISTORY},
fresh AS (
SELECT {UNIQUE_NAME} AS product_name, p_brand AS category_name, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
  CAST(p_size AS BIGINT) AS stock, p_partkey AS place FROM part
WHERE {UNIQUE_NAME} NOT IN (SELECT product_name FROM h_products)),
new_categories AS (
SELECT (SELECT max(category_id) FROM h_categories) + row_number() OVER (ORDER BY min(place)) AS category_id,
  category_name FROM fresh WHERE category_name NOT IN (SELECT category_name FROM h_categories) GROUP BY category_name),
all_categories AS (SELECT * FROM h_categories UNION ALL SELECT * FROM new_categories)""",
    f"""SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM h_products
UNION ALL
SELECT (SELECT max(product_id) FROM h_products) + row_number() OVER (ORDER BY place), product_name, category_id,
  CAST(price AS DOUBLE), stock, {AT}, {AT} FROM fresh JOIN all_categories USING (category_name)""",
)

CALLS = f"""{HISTORY},
calls AS (
SELECT *, row_number() OVER (ORDER BY order_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
    sales, quantity) AS seq FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_code, CAST(o_orderdate AS DATE) AS order_date,
    CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS customer_name, n_name || ' ' || o_orderpriority AS city,
    n_name AS state, {UNIQUE_NAME} AS product_name, p_type AS category_name,
    CAST(l_quantity AS INT) AS quantity, CAST(floor(l_extendedprice / l_quantity) AS DECIMAL(12,2)) AS price_per_unit,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS sales,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2))
      - CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS profit,
    n_regionkey AS region_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
  WHERE CAST(o_orderdate AS DATE) >= DATE '{CUTOVER}')),
c_last AS (
SELECT customer_code, arg_max(customer_name, seq) AS customer_name, arg_max(city, seq) AS city,
  arg_max(state, seq) AS state, min(seq) AS first_seq FROM calls GROUP BY 1),
new_customers AS (
SELECT h.customer_id, h.customer_code, coalesce(c.customer_name, h.customer_name) AS customer_name,
  coalesce(c.city, h.city) AS city, coalesce(c.state, h.state) AS state, h.created_at,
  CASE WHEN c.customer_code IS NULL THEN h.updated_at ELSE {AT} END AS updated_at
FROM h_customers h LEFT JOIN c_last c USING (customer_code)
UNION ALL
SELECT (SELECT max(customer_id) FROM h_customers) + row_number() OVER (ORDER BY first_seq), customer_code,
  customer_name, city, state, {AT}, {AT} FROM c_last
WHERE customer_code NOT IN (SELECT customer_code FROM h_customers)),
p_last AS (
SELECT product_name, arg_max(price_per_unit, seq) AS price, arg_min(category_name, seq) AS category_name,
  sum(quantity) AS units, min(seq) AS first_seq FROM calls GROUP BY 1),
new_products AS (
SELECT h.product_id, h.product_name, h.category_id, coalesce(p.price, h.price) AS price,
  CAST(h.stock - coalesce(p.units, 0) AS BIGINT) AS stock, h.created_at,
  CASE WHEN p.product_name IS NULL THEN h.updated_at ELSE {AT} END AS updated_at
FROM h_products h LEFT JOIN p_last p USING (product_name)
UNION ALL
SELECT (SELECT max(product_id) FROM h_products) + row_number() OVER (ORDER BY first_seq), product_name,
  category_id, price, CAST(100 - units AS BIGINT), {AT}, {AT} FROM p_last JOIN h_categories USING (category_name)
WHERE product_name NOT IN (SELECT product_name FROM h_products)),
new_orders AS (
SELECT * FROM h_orders
UNION ALL
SELECT (SELECT max(order_id) FROM h_orders) + row_number() OVER (ORDER BY first_seq), order_code, customer_id,
  order_date, CAST(region_id AS BIGINT), {AT}, {AT} FROM (
  SELECT order_code, arg_min(customer_code, seq) AS customer_code, arg_min(order_date, seq) AS order_date,
    arg_min(region_id, seq) AS region_id, min(seq) AS first_seq FROM calls
  WHERE order_code NOT IN (SELECT order_code FROM h_orders) GROUP BY 1)
JOIN (SELECT customer_code, customer_id FROM new_customers) USING (customer_code))"""
ORACLE["apply_orders_customers"] = with_(CALLS, "SELECT * FROM new_customers")
ORACLE["apply_orders_products"] = with_(
    CALLS, "SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM new_products"
)
ORACLE["apply_orders_orders"] = with_(CALLS, "SELECT * FROM new_orders")
_ITEM = """CAST(price_per_unit AS DOUBLE) AS price_per_unit, CAST(sales AS DOUBLE) AS sales,
  CAST(profit AS DOUBLE) AS profit"""
ORACLE["apply_orders_items"] = with_(
    CALLS,
    f"""SELECT order_item_id, order_id, product_id, quantity, {_ITEM} FROM h_items
UNION ALL
SELECT (SELECT max(order_item_id) FROM h_items) + seq, o.order_id, p.product_id, quantity, {_ITEM}
FROM calls JOIN new_orders o USING (order_code) JOIN new_products p USING (product_name)""",
)
ORACLE["stock_after_orders"] = with_(CALLS, "SELECT product_name, stock FROM new_products")

UPDATES = f"""{HISTORY},
updates AS (
SELECT CAST(l_orderkey AS VARCHAR) AS order_code, {UNIQUE_NAME} AS product_name, CAST(l_quantity AS INT) AS quantity,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price_per_unit,
  CAST(floor(l_extendedprice * (1.0::DOUBLE - l_discount)) AS DECIMAL(12,2)) AS sales,
  CAST(floor(l_extendedprice * (1.0::DOUBLE - l_discount)) AS DECIMAL(12,2))
    - CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(12,2)) AS profit,
  l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
last_update AS (
SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY order_code, product_name
  ORDER BY l_linenumber DESC, l_suppkey DESC, l_shipdate DESC, sales DESC, quantity DESC) = 1),
resolved AS (
SELECT u.*, o.order_id, p.product_id FROM last_update u LEFT JOIN h_orders o USING (order_code)
LEFT JOIN h_products p USING (product_name))"""
ORACLE["apply_item_updates"] = with_(
    UPDATES,
    """SELECT i.order_item_id, i.order_id, i.product_id, coalesce(u.quantity, i.quantity) AS quantity,
  CAST(coalesce(u.price_per_unit, i.price_per_unit) AS DOUBLE) AS price_per_unit,
  CAST(coalesce(u.sales, i.sales) AS DOUBLE) AS sales, CAST(coalesce(u.profit, i.profit) AS DOUBLE) AS profit
FROM h_items i LEFT JOIN resolved u ON i.order_id = u.order_id AND i.product_id = u.product_id""",
)
ORACLE["rejects"] = with_(
    UPDATES,
    """SELECT order_code, product_name, CASE WHEN order_id IS NULL THEN 'order does not exist'
  ELSE 'product does not exist' END AS reason FROM resolved WHERE order_id IS NULL OR product_id IS NULL""",
)
# the same over the whole star, with updates for orders and products that do not exist
STAR_UPDATES = (
    UPDATES.replace(HISTORY, STAR)
    .replace("h_orders", "s_orders")
    .replace("h_products", "s_products")
    .replace("\nupdates AS (", "\nknown AS (")
    .replace(
        "last_update AS (",
        """updates AS (
SELECT * FROM known
UNION ALL SELECT * REPLACE ('X' || order_code AS order_code) FROM known WHERE CAST(order_code AS BIGINT) % 97 = 5
UNION ALL SELECT * REPLACE (product_name || ' (old)' AS product_name) FROM known WHERE CAST(order_code AS BIGINT) % 89 = 3),
last_update AS (""",
    )
)
ORACLE["apply_item_updates_star"] = with_(
    STAR_UPDATES,
    """SELECT i.order_item_id, i.order_id, i.product_id, coalesce(u.quantity, i.quantity) AS quantity,
  CAST(coalesce(u.price_per_unit, i.price_per_unit) AS DOUBLE) AS price_per_unit,
  CAST(coalesce(u.sales, i.sales) AS DOUBLE) AS sales, CAST(coalesce(u.profit, i.profit) AS DOUBLE) AS profit
FROM s_items i LEFT JOIN resolved u ON i.order_id = u.order_id AND i.product_id = u.product_id""",
)
ORACLE["item_update_rejects_star"] = with_(
    STAR_UPDATES,
    """SELECT order_code, product_name, CASE WHEN order_id IS NULL THEN 'order does not exist'
  ELSE 'product does not exist' END AS reason FROM resolved WHERE order_id IS NULL OR product_id IS NULL""",
)
GONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"
ORACLE["apply_deletes"] = with_(STAR, f"SELECT * FROM s_orders WHERE order_id NOT IN ({GONE})")
ORACLE["apply_deletes_items"] = with_(
    STAR,
    f"""SELECT order_item_id, order_id, product_id, quantity, {_ITEM} FROM s_items
WHERE order_id NOT IN ({GONE})""",
)
ORACLE["deleted_orders_log"] = with_(
    STAR,
    f"""SELECT row_number() OVER (ORDER BY order_id) AS log_id, order_id, order_code, customer_id, order_date,
  {AT} AS deleted_at FROM s_orders WHERE order_id IN ({GONE})""",
)

# a batch that is sent twice counts once
ORACLE["apply_orders_twice"] = ORACLE["apply_orders_items"]
ORACLE["stock_after_orders_twice"] = ORACLE["stock_after_orders"]

# what was written as CSV in two column orders comes back whole
ORACLE["csv_round_trip"] = ORACLE["flat_sales"]
