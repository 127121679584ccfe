"""The order/line/customer/part tables of the test data as sales records and as a star.

The tables hold no city, product category or profit, so the mapping is ours: the part type
is the category, nation plus market segment is the city, and profit is the extended price
less quantity times retail price.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.cleaning import add_derived
from ledgerline.session import durable_parts, part_of, parts_of
from ledgerline.sources.schemas import DEFAULT_STOCK, MONEY, REQUIRED_COLUMNS

# Row order of a sales line inside its order; ties are exact copies.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "Sales", "Quantity")
# Row order over the whole table.
TABLE_ORDER = ("l_orderkey", *LINE_ORDER)

# Default margins of the six part types.
TYPE_MARGINS = {
    "ECONOMY": 0.05,
    "LARGE": 0.40,
    "MEDIUM": 0.235,
    "PROMO": 0.50,
    "SMALL": 0.30,
    "STANDARD": 0.25,
}

_FROM_ORDERS = {"Order_Date", "Customer_ID"}
_FROM_CUSTOMER = {"Customer_Name", "City", "State"}
_FROM_REGION = {"Region"}
_FROM_PART = {"Product", "Category", "Price", "Profit"}


@dataclass(frozen=True)
class Tables:
    """Lazy handles on one scale factor's parquet tables."""

    spark: SparkSession
    path: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def _lines(tables: Tables) -> DataFrame:
    return tables["lineitem"].select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("l_shipdate"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("Sales"),
    )


def flat_sales(
    tables: Tables,
    columns: Iterable[str] = REQUIRED_COLUMNS,
    line_order: bool = False,
) -> DataFrame:
    """Sales records with the wanted columns (derived date and margin columns included).

    A table is joined only when a wanted column comes from it: every line has one order, one
    part, one customer, nation and region (the declared foreign keys), so a join that adds
    no column changes no row. No join is hinted: dimensions below Spark's broadcast size go
    out whole, larger ones are shuffled, and adaptive execution splits hot keys.
    """
    columns = list(dict.fromkeys(columns))
    derived = {"Year", "Month", "Quarter", "Month_Name"}
    need = set(columns)
    if need & derived:
        need.add("Order_Date")
    if "Profit_Margin" in need:
        need |= {"Sales", "Profit"}
    need_region = bool(need & _FROM_REGION)
    need_nation = need_region or bool(need & {"City", "State"})
    need_customer = need_nation or bool(need & _FROM_CUSTOMER)

    df = _lines(tables)
    if need & _FROM_PART:
        part = tables["part"].select(
            F.col("p_partkey").alias("l_partkey"),
            F.col("p_name").alias("Product"),
            F.col("p_type").alias("Category"),
            F.col("p_retailprice").cast(MONEY).alias("Price"),
        )
        df = df.join(part, "l_partkey")
        df = df.withColumn("Profit", (F.col("Sales") - F.col("Quantity") * F.col("Price")).cast(MONEY))
    if need_customer or need & _FROM_ORDERS:
        header = tables["orders"].select(
            F.col("o_orderkey").alias("l_orderkey"),
            "o_custkey",
            F.col("o_orderdate").cast("date").alias("Order_Date"),
        )
        if need_customer:
            header = header.join(
                _customers(tables, need_nation, need_region), "o_custkey"
            )
        df = df.join(header.withColumn("Customer_ID", F.col("o_custkey").cast("string")), "l_orderkey")
    df = df.withColumn("Order_ID", F.col("l_orderkey").cast("string"))
    if need & derived or "Profit_Margin" in need:
        df = add_derived(df)
    return df.select(*columns, *(c for c in TABLE_ORDER if line_order and c not in columns))


def _customers(tables: Tables, nation: bool, region: bool) -> DataFrame:
    df = tables["customer"].select(
        F.col("c_custkey").alias("o_custkey"),
        F.col("c_name").alias("Customer_Name"),
        "c_nationkey",
        "c_mktsegment",
    )
    if nation:
        nations = tables["nation"].select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("State"), "n_regionkey"
        )
        if region:
            regions = tables["region"].select(
                F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("Region")
            )
            nations = nations.join(regions, "n_regionkey")
        df = df.join(nations, "c_nationkey").withColumn(
            "City", F.concat_ws(" ", "State", "c_mktsegment")
        )
    return df


def dirty_sales(tables: Tables) -> DataFrame:
    """All sales records with faults set by rule, for the cleaning operators."""
    df = flat_sales(tables, line_order=True)

    def hit(expr: str, value) -> F.Column:
        return F.when(F.expr(expr), value)

    free = "l_partkey % 223 = 3"
    zero = F.lit(0).cast(MONEY)
    return df.withColumns(
        {
            "Profit": F.when(~F.expr("(l_orderkey * 7 + l_linenumber) % 67 = 0"), F.col("Profit")),
            "Customer_Name": F.when(~F.expr("l_partkey % 113 = 1"), F.col("Customer_Name")),
            "City": F.when(F.expr("l_suppkey % 97 = 4"), F.lit("")).otherwise(F.col("City")),
            "Quantity": F.when(F.expr("l_partkey % 211 = 2"), F.lit(-1)).otherwise(F.col("Quantity")),
            "Price": hit(free, zero).otherwise(F.col("Price")),
            "Sales": hit(free, zero).otherwise(F.col("Sales")),
        }
    )


# --- the same tables as a star ------------------------------------------------------------

LOADED_AT = "2026-01-01 00:00:00"


def star_tables(tables: Tables) -> dict[str, DataFrame]:
    """The star over all rows. Product names get their key, because the star's are unique;
    a category's id is its smallest part key."""
    stamp = F.lit(LOADED_AT).cast("timestamp")
    part = tables["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string")).alias("product_name"),
        F.col("p_type").alias("category_name"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
    )
    categories = part.groupBy("category_name").agg(F.min("product_id").alias("category_id"))
    nations = tables["nation"]
    customers = tables["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    line = tables["lineitem"].select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("sales"),
    )
    items = line.join(part.select("product_id", F.col("price").alias("price_per_unit")), "product_id")
    return {
        "categories": categories.select("category_id", "category_name"),
        "regions": tables["region"].select(
            F.col("r_regionkey").cast("long").alias("region_id"), F.col("r_name").alias("region_name")
        ),
        "customers": customers.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").cast("string").alias("customer_code"),
            F.col("c_name").alias("customer_name"),
            F.concat_ws(" ", "n_name", "c_mktsegment").alias("city"),
            F.col("n_name").alias("state"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
        ),
        "products": part.join(categories, "category_name").select(
            "product_id",
            "product_name",
            "category_id",
            "price",
            F.lit(DEFAULT_STOCK).cast("long").alias("stock"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
        ),
        "orders": tables["orders"]
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").cast("string").alias("order_code"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("n_regionkey").cast("long").alias("region_id"),
            stamp.alias("created_at"),
            stamp.alias("updated_at"),
        ),
        "order_items": items.select(
            "order_item_id",
            "order_id",
            "product_id",
            "quantity",
            "price_per_unit",
            "sales",
            (F.col("sales") - F.col("quantity") * F.col("price_per_unit")).cast(MONEY).alias("profit"),
        ),
    }


# The change jobs load everything before this day as history and the rest as a batch.
CUTOVER = "1995-07-01"


def history_star(tables: Tables) -> dict[str, DataFrame]:
    """The star as of the cutover: its orders, their items, and the customers, products and
    categories that occur in them. Stored, because a change job reads each table repeatedly."""
    star = star_tables(tables)
    orders = durable_parts(
        [star["orders"].filter(F.col("order_date") < F.lit(CUTOVER).cast("date"))], "history-orders"
    )
    parts = parts_of(tables["lineitem"])
    items = durable_parts(
        (
            star["order_items"]
            .filter(part_of("order_id", i, parts))
            .join(orders.select("order_id").filter(part_of("order_id", i, parts)), "order_id", "left_semi")
            for i in range(parts)
        ),
        "history-items",
    )
    products = durable_parts(
        [star["products"].join(items.select("product_id"), "product_id", "left_semi")], "history-products"
    )
    customers = durable_parts(
        [star["customers"].join(orders.select("customer_id"), "customer_id", "left_semi")],
        "history-customers",
    )
    return {
        "categories": durable_parts(
            [star["categories"].join(products.select("category_id"), "category_id", "left_semi")],
            "history-categories",
        ),
        "regions": star["regions"],
        "customers": customers,
        "products": products,
        "orders": orders,
        "order_items": items,
    }


# Sequence of the order calls: by date, then order, then line.
CALL_ORDER = (
    "order_date",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_shipdate",
    "sales",
    "quantity",
)


def order_calls(tables: Tables) -> DataFrame:
    """One order call per line since the cutover, stored. The call's city carries the order's
    priority and its price is the line's whole-number unit price, so that both change.

    Lines meet their parts first and then whole order headers, so few columns are shuffled with each line,
    and a large table is joined in parts by a hash of the order key."""
    since = tables["orders"].filter(F.col("o_orderdate").cast("date") >= F.lit(CUTOVER).cast("date"))
    nations = tables["nation"].join(
        tables["region"], F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = tables["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    headers = since.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    parts = parts_of(tables["lineitem"])

    def joined(i: int) -> DataFrame:
        lines = tables["lineitem"].filter(part_of("l_orderkey", i, parts))
        return lines.join(tables["part"], F.col("l_partkey") == F.col("p_partkey")).join(
            headers.filter(part_of("o_orderkey", i, parts)), F.col("l_orderkey") == F.col("o_orderkey")
        )

    quantity = F.col("l_quantity").cast("int")
    sales = F.col("l_extendedprice").cast(MONEY)
    return durable_parts(
        (
            joined(i).select(
                F.col("o_orderkey").cast("string").alias("order_code"),
                F.col("o_orderdate").cast("date").alias("order_date"),
                F.col("c_custkey").cast("string").alias("customer_code"),
                F.col("c_name").alias("customer_name"),
                F.concat_ws(" ", "n_name", "o_orderpriority").alias("city"),
                F.col("n_name").alias("state"),
                F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string")).alias("product_name"),
                F.col("p_type").alias("category_name"),
                quantity.alias("quantity"),
                F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast(MONEY).alias("price_per_unit"),
                sales.alias("sales"),
                (sales - quantity * F.col("p_retailprice").cast(MONEY)).cast(MONEY).alias("profit"),
                F.col("r_name").alias("region_name"),
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.col("l_shipdate").cast("date").alias("l_shipdate"),
            )
            for i in range(parts)
        ),
        "order-calls",
    )


def return_updates(tables: Tables) -> DataFrame:
    """Item updates for all returned lines: sales less discount, whole numbers."""
    part = tables["part"].select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string")).alias("product_name"),
        F.col("p_retailprice").cast(MONEY).alias("price_per_unit"),
    )
    sales = F.floor(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).cast(MONEY)
    quantity = F.col("l_quantity").cast("int")
    return (
        tables["lineitem"]
        .filter(F.col("l_returnflag") == "R")
        .join(part, "l_partkey")
        .select(
            F.col("l_orderkey").cast("string").alias("order_code"),
            "product_name",
            quantity.alias("quantity"),
            "price_per_unit",
            sales.alias("sales"),
            (sales - quantity * F.col("price_per_unit")).cast(MONEY).alias("profit"),
            "l_linenumber",
            "l_suppkey",
            F.col("l_shipdate").cast("date").alias("l_shipdate"),
        )
    )


UPDATE_ORDER = ("l_linenumber", "l_suppkey", "l_shipdate", "sales", "quantity")


def updates_with_unknown(tables: Tables) -> DataFrame:
    """All item updates, and again some of them for orders and products that do not exist."""
    updates = return_updates(tables)
    order = F.col("order_code").cast("long")
    return updates.unionByName(
        updates.filter(order % 97 == 5).withColumn("order_code", F.concat(F.lit("X"), "order_code"))
    ).unionByName(
        updates.filter(order % 89 == 3).withColumn("product_name", F.concat("product_name", F.lit(" (old)")))
    )
