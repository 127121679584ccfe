"""The star schema: reporting views, building it from flat records, and its constraints.

A star is a mapping of table name to DataFrame with the columns of ``STAR_SCHEMAS``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.ranking import first_by, number_rows
from ledgerline.functions.semantics import asc, desc, month_name
from ledgerline.sources.schemas import DEFAULT_STOCK

Star = Mapping[str, DataFrame]


# --- views --------------------------------------------------------------------------------


def sales_summary(star: Star) -> DataFrame:
    """The flat sales record: region from the order, city and state from the customer."""
    orders = (
        star["orders"]
        .join(star["regions"], "region_id")
        .join(star["customers"], "customer_id")
        .select(
            F.col("order_id").alias("order_key"),
            "order_code",
            "order_date",
            "customer_code",
            "customer_name",
            "city",
            "state",
            "region_name",
        )
    )
    products = star["products"].join(star["categories"], "category_id").select(
        F.col("product_id").alias("product_key"), "product_name", "category_name"
    )
    return (
        star["order_items"]
        .join(orders, F.col("order_id") == F.col("order_key"))
        .join(products, F.col("product_id") == F.col("product_key"))
        .select(
            F.col("order_code").alias("Order_ID"),
            F.col("order_date").alias("Order_Date"),
            F.col("customer_code").alias("Customer_ID"),
            F.col("customer_name").alias("Customer_Name"),
            F.col("product_name").alias("Product"),
            F.col("category_name").alias("Category"),
            F.col("quantity").alias("Quantity"),
            F.col("price_per_unit").alias("Price"),
            F.col("sales").alias("Sales"),
            F.col("profit").alias("Profit"),
            F.col("city").alias("City"),
            F.col("state").alias("State"),
            F.col("region_name").alias("Region"),
        )
    )


def _order_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))


def customer_summary(star: Star) -> DataFrame:
    """Purchase history per customer; customers without orders show zeros.

    Items are summed per order and orders per customer before the customers are joined, so a
    customer with very many orders is one row by then.
    """
    history = (
        star["orders"]
        .join(_order_totals(star["order_items"]), "order_id", "left")
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("sales").alias("sales"),
            F.sum("profit").alias("profit"),
        )
    )
    zero = F.lit(0)
    average = F.try_divide(F.col("sales").cast("double"), F.col("orders").cast("double"))
    return (
        star["customers"]
        .join(history, "customer_id", "left")
        .select(
            F.col("customer_id").alias("id"),
            F.col("customer_code").alias("Customer_ID"),
            F.col("customer_name").alias("Customer_Name"),
            F.col("city").alias("City"),
            F.col("state").alias("State"),
            F.coalesce("orders", zero).alias("Total_Orders"),
            F.coalesce("sales", zero).alias("Total_Sales"),
            F.coalesce("profit", zero).alias("Total_Profit"),
            F.coalesce(average, F.lit(0.0)).alias("Avg_Order_Value"),
        )
    )


def product_summary(star: Star) -> DataFrame:
    """Units, sales and profit per product with price and stock; unsold products show zeros.

    Items are summed per product first: a best-seller reaches the join as one row.
    """
    sold = star["order_items"].groupBy("product_id").agg(
        F.sum("quantity").alias("units"),
        F.sum("sales").alias("sales"),
        F.sum("profit").alias("profit"),
    )
    zero = F.lit(0)
    return (
        star["products"]
        .join(star["categories"], "category_id")
        .join(sold, "product_id", "left")
        .select(
            "product_id",
            F.col("product_name").alias("Product"),
            F.col("category_name").alias("Category"),
            F.col("price").alias("List_Price"),
            F.col("stock").alias("Current_Stock"),
            F.coalesce("units", zero).alias("Total_Units_Sold"),
            F.coalesce("sales", zero).alias("Total_Sales"),
            F.coalesce("profit", zero).alias("Total_Profit"),
        )
    )


def monthly_sales(star: Star) -> DataFrame:
    """Sales, profit and order count per calendar month, newest first.

    Only orders with items count. Items are summed per order, so the count needs no distinct.
    """
    date = F.col("order_date")
    return (
        star["orders"]
        .join(_order_totals(star["order_items"]), "order_id")
        .groupBy(
            F.year(date).alias("Year"),
            F.month(date).alias("Month"),
            month_name(F.month(date)).alias("Month_Name"),
        )
        .agg(
            F.sum("sales").alias("Monthly_Sales"),
            F.sum("profit").alias("Monthly_Profit"),
            F.count(F.lit(1)).alias("Total_Orders"),
        )
        .orderBy(*desc("Year", "Month"))
    )


def yearly_sales(star: Star) -> DataFrame:
    """Sales, profit and order count per year, newest first."""
    return (
        star["orders"]
        .join(_order_totals(star["order_items"]), "order_id")
        .groupBy(F.year("order_date").alias("Year"))
        .agg(
            F.sum("sales").alias("Yearly_Sales"),
            F.sum("profit").alias("Yearly_Profit"),
            F.count(F.lit(1)).alias("Total_Orders"),
        )
        .orderBy(*desc("Year"))
    )


def top_products(star: Star, limit: int = 10) -> DataFrame:
    return (
        product_summary(star)
        .orderBy(*desc("Total_Sales"), *asc("product_id"))
        .limit(limit)
        .drop("product_id")
    )


def top_customers(star: Star, limit: int = 10) -> DataFrame:
    return (
        customer_summary(star)
        .orderBy(*desc("Total_Sales"), *asc("id"))
        .limit(limit)
        .drop("id")
        .withColumnRenamed("Customer_ID", "customer_code")
    )


def register_views(star: Star) -> None:
    """Make the four views available to SQL under their usual names."""
    for name, build in (
        ("vw_sales_summary", sales_summary),
        ("vw_customer_summary", customer_summary),
        ("vw_product_summary", product_summary),
        ("vw_monthly_sales", monthly_sales),
    ):
        build(star).createOrReplaceTempView(name)


# --- building a star from flat records ----------------------------------------------------


def _first_seen(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Distinct non-empty values with the place of their first row."""
    return (
        df.filter(F.col(column) != "")
        .groupBy(F.col(column).alias("name"))
        .agg(F.min(F.struct(*order)).alias("first_place"))
    )


def build_categories(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ids in order of first appearance."""
    seen = _first_seen(df, "Category", order)
    return number_rows(seen, asc("first_place"), "category_id").select(
        "category_id", F.col("name").alias("category_name")
    )


def build_regions(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Ids in order of first appearance."""
    seen = _first_seen(df, "Region", order)
    return number_rows(seen, asc("first_place"), "region_id").select(
        "region_id", F.col("name").alias("region_name")
    )


def build_customers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First name, city and state per customer code; ids in code order."""
    first = first_by(F.struct("Customer_Name", "City", "State"), order)
    per_code = df.groupBy(F.col("Customer_ID").alias("customer_code")).agg(first.alias("f"))
    return number_rows(per_code, asc("customer_code"), "customer_id").select(
        "customer_id",
        "customer_code",
        F.col("f.Customer_Name").alias("customer_name"),
        F.col("f.City").alias("city"),
        F.col("f.State").alias("state"),
    )


def build_products(df: DataFrame, categories: DataFrame, order: Sequence[str]) -> DataFrame:
    """First category and price per product name; ids in name order."""
    first = first_by(F.struct("Category", "Price"), order)
    per_name = df.groupBy(F.col("Product").alias("product_name")).agg(first.alias("f"))
    numbered = number_rows(per_name, asc("product_name"), "product_id").select(
        "product_id",
        "product_name",
        F.col("f.Category").alias("category_name"),
        F.col("f.Price").alias("price"),
        F.lit(DEFAULT_STOCK).cast("long").alias("stock"),
    )
    return numbered.join(categories, "category_name", "left").select(
        "product_id", "product_name", "category_id", "price", "stock"
    )


def build_orders(
    df: DataFrame, customers: DataFrame, regions: DataFrame, order: Sequence[str]
) -> DataFrame:
    """First customer, date and region per order code; ids in code order."""
    first = first_by(F.struct("Customer_ID", "Order_Date", "Region"), order)
    per_code = (
        df.groupBy(F.col("Order_ID").alias("order_code"))
        .agg(first.alias("f"))
        .select(
            "order_code",
            F.col("f.Customer_ID").alias("customer_code"),
            F.col("f.Order_Date").alias("order_date"),
            F.col("f.Region").alias("region_name"),
        )
    )
    numbered = number_rows(per_code, asc("order_code"), "order_id")
    return (
        numbered.join(customers.select("customer_id", "customer_code"), "customer_code", "left")
        .join(regions, "region_name", "left")
        .select("order_id", "order_code", "customer_id", "order_date", "region_id")
    )


def build_items(df: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """One item per flat record; its price is the product's, not the record's."""
    lines = df.select(
        F.col("Order_ID").alias("order_code"),
        F.col("Product").alias("product_name"),
        F.col("Quantity").alias("quantity"),
        F.col("Sales").alias("sales"),
        F.col("Profit").alias("profit"),
    )
    return (
        lines.join(orders.select("order_id", "order_code"), "order_code", "left")
        .join(products.select("product_id", "product_name", "price"), "product_name", "left")
        .select(
            "order_id",
            "product_id",
            "quantity",
            F.col("price").alias("price_per_unit"),
            "sales",
            "profit",
        )
    )


def build_star(df: DataFrame, order: Sequence[str]) -> dict[str, DataFrame]:
    """All six tables from a clean flat table. Pass a stored table: each dimension reads it."""
    categories = build_categories(df, order)
    regions = build_regions(df, order)
    customers = build_customers(df, order)
    products = build_products(df, categories, order)
    orders = build_orders(df, customers, regions, order)
    return {
        "categories": categories,
        "regions": regions,
        "customers": customers,
        "products": products,
        "orders": orders,
        "order_items": build_items(df, orders, products),
    }


# --- constraints --------------------------------------------------------------------------


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Check:
    table: str
    name: str
    holds: str
    key: tuple[str, ...]


# The keys and checks the star declares.
STAR_RULES: tuple[Unique | ForeignKey | Check, ...] = (
    Unique("categories", ("category_id",)),
    Unique("categories", ("category_name",)),
    Unique("regions", ("region_id",)),
    Unique("regions", ("region_name",)),
    Unique("customers", ("customer_id",)),
    Unique("customers", ("customer_code",)),
    Unique("products", ("product_id",)),
    Unique("products", ("product_name",)),
    Unique("orders", ("order_id",)),
    Unique("orders", ("order_code",)),
    Unique("order_items", ("order_item_id",)),
    *(
        Check(table, f"{column} is missing", f"{column} IS NOT NULL", key)
        for table, key, columns in (
            ("categories", ("category_id",), ("category_id", "category_name")),
            ("regions", ("region_id",), ("region_id", "region_name")),
            ("customers", ("customer_id",), ("customer_id", "customer_code", "customer_name")),
            ("products", ("product_id",), ("product_id", "product_name", "category_id", "price", "stock")),
            ("orders", ("order_id",), ("order_id", "order_code", "customer_id", "order_date", "region_id")),
            (
                "order_items",
                ("order_item_id",),
                ("order_item_id", "order_id", "product_id", "quantity", "price_per_unit", "sales", "profit"),
            ),
        )
        for column in columns
    ),
    ForeignKey("products", "category_id", "categories", "category_id"),
    ForeignKey("orders", "customer_id", "customers", "customer_id"),
    ForeignKey("orders", "region_id", "regions", "region_id"),
    ForeignKey("order_items", "order_id", "orders", "order_id"),
    ForeignKey("order_items", "product_id", "products", "product_id"),
    Check("order_items", "quantity > 0", "quantity > 0", ("order_id", "product_id")),
    Check("order_items", "price_per_unit >= 0", "price_per_unit >= 0", ("order_id", "product_id")),
    Check("order_items", "sales >= 0", "sales >= 0", ("order_id", "product_id")),
)


def _violations(star: Star, rule: Unique | ForeignKey) -> DataFrame:
    df = star[rule.table]

    def key_text(columns: Sequence[str]) -> Column:
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])

    if isinstance(rule, Unique):
        name = f"unique({', '.join(rule.columns)})"
        bad = (
            df.groupBy(*rule.columns)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .select(key_text(rule.columns).alias("key"), "n")
        )
    else:
        name = f"{rule.column} -> {rule.parent}.{rule.parent_column}"
        # one row per distinct key before the anti-join, however often a key occurs
        used = df.groupBy(rule.column).agg(F.count(F.lit(1)).alias("n"))
        parent = star[rule.parent].select(F.col(rule.parent_column).alias(rule.column))
        bad = used.join(parent, rule.column, "left_anti").select(key_text((rule.column,)).alias("key"), "n")
    return bad.select(
        F.lit(rule.table).alias("table_name"), F.lit(name).alias("rule_name"), "key", "n"
    )


def _row_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The violations of all row checks of one table, found in one pass over it."""
    failed = [
        F.when(
            ~F.expr(rule.holds),
            F.struct(
                F.lit(rule.name).alias("rule_name"),
                F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in rule.key]).alias("key"),
            ),
        )
        for rule in checks
    ]
    found = df.select(F.explode(F.array_compact(F.array(*failed))).alias("bad"))
    return found.groupBy(F.lit(checks[0].table).alias("table_name"), "bad.rule_name", "bad.key").agg(
        F.count(F.lit(1)).alias("n")
    ).select("table_name", "rule_name", "key", "n")


def check_constraints(
    star: Star, rules: Sequence[Unique | ForeignKey | Check] = STAR_RULES
) -> DataFrame:
    """All violations: table, rule, offending key and number of rows; empty when sound."""
    parts = [_violations(star, r) for r in rules if r.table in star and not isinstance(r, Check)]
    for table in dict.fromkeys(r.table for r in rules if isinstance(r, Check) and r.table in star):
        parts.append(_row_checks(star[table], [r for r in rules if isinstance(r, Check) and r.table == table]))
    return reduce(DataFrame.unionByName, parts)
