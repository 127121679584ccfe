"""Schemas, required columns and fixed business values."""

from __future__ import annotations

from pyspark.sql import types as T

# amounts below 10^14; sums and quotients of it keep at least nine decimals
MONEY = T.DecimalType(16, 2)

# The flat sales record, in order.
REQUIRED_COLUMNS = (
    "Order_ID",
    "Order_Date",
    "Customer_ID",
    "Customer_Name",
    "Product",
    "Category",
    "Quantity",
    "Price",
    "Sales",
    "Profit",
    "City",
    "State",
    "Region",
)

# Columns the pipeline derives.
DERIVED_COLUMNS = ("Year", "Month", "Quarter", "Month_Name", "Profit_Margin", "Is_Outlier")

# Margins used for a category without enough complete rows, and for other categories.
DEFAULT_MARGINS = {
    "Electronics": 0.235,
    "Furniture": 0.05,
    "Clothing": 0.40,
    "Office Supplies": 0.50,
}
UNKNOWN_MARGIN = 0.25
MIN_MARGIN_ROWS = 5

# Dashboard contribution keys.
CONTRIBUTION_KEYS = ("Electronics", "Furniture", "Clothing", "OfficeSupplies")

DEFAULT_STOCK = 100


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampType()

# Column types after typing; names and order as in REQUIRED_COLUMNS.
SALES_TYPES: dict[str, T.DataType] = {
    "Order_ID": _S,
    "Order_Date": _D,
    "Customer_ID": _S,
    "Customer_Name": _S,
    "Product": _S,
    "Category": _S,
    "Quantity": _L,
    "Price": MONEY,
    "Sales": MONEY,
    "Profit": MONEY,
    "City": _S,
    "State": _S,
    "Region": _S,
}

RAW_SCHEMA = T.StructType([T.StructField(c, _S) for c in REQUIRED_COLUMNS])
SALES_SCHEMA = T.StructType([T.StructField(c, t) for c, t in SALES_TYPES.items()])


# Star tables. Ids are 64-bit: order and item counts outgrow 32 bits.
STAR_SCHEMAS: dict[str, T.StructType] = {
    "categories": _schema(("category_id", _L, False), ("category_name", _S, False)),
    "regions": _schema(("region_id", _L, False), ("region_name", _S, False)),
    "customers": _schema(
        ("customer_id", _L, False),
        ("customer_code", _S, False),
        ("customer_name", _S, False),
        ("city", _S, True),
        ("state", _S, True),
        ("created_at", _TS, True),
        ("updated_at", _TS, True),
    ),
    "products": _schema(
        ("product_id", _L, False),
        ("product_name", _S, False),
        ("category_id", _L, False),
        ("price", MONEY, False),
        ("stock", _L, False),
        ("created_at", _TS, True),
        ("updated_at", _TS, True),
    ),
    "orders": _schema(
        ("order_id", _L, False),
        ("order_code", _S, False),
        ("customer_id", _L, False),
        ("order_date", _D, False),
        ("region_id", _L, False),
        ("created_at", _TS, True),
        ("updated_at", _TS, True),
    ),
    "order_items": _schema(
        ("order_item_id", _L, False),
        ("order_id", _L, False),
        ("product_id", _L, False),
        ("quantity", _I, False),
        ("price_per_unit", MONEY, False),
        ("sales", MONEY, False),
        ("profit", MONEY, False),
    ),
}
