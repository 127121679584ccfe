"""Small sales records written out in full."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline.operators.cleaning import add_derived
from ledgerline.sources.schemas import REQUIRED_COLUMNS, SALES_SCHEMA

# One month's report rows.
JUNE_2026 = """
EC-1758|2026-06-13|CUST-107|James Garcia|Running Shoes|Clothing|3|9900|29700|9780.42|Dallas|Texas|West
EC-1587|2026-06-08|CUST-128|Sofia Allen|iPad Air|Electronics|3|49000|147000|49732.97|Seattle|Washington|East
EC-1300|2026-06-13|CUST-148|Nora Parker|LED Desk Lamp|Furniture|1|4000|4000|665.08|Chicago|Illinois|South
EC-1976|2026-06-08|CUST-131|Jack King|LED Desk Lamp|Furniture|3|4000|12000|2138.48|San Francisco|California|Central
EC-1191|2026-06-08|CUST-121|Logan Martin|Dry Erase Whiteboard|Office Supplies|1|3700|3700|2055.61|Seattle|Washington|East
EC-1128|2026-06-01|CUST-120|Evelyn Harris|Heavy Duty Stapler|Office Supplies|2|1800|3600|2220.39|San Francisco|California|East
EC-1255|2026-06-04|CUST-120|Evelyn Harris|Premium Notebook Pack|Office Supplies|1|1200|1200|456.75|San Francisco|California|Central
"""


def parse(line: str) -> tuple:
    f = line.split("|")
    money = [Decimal(x) if x else None for x in f[7:10]]
    return (f[0], dt.date.fromisoformat(f[1]), *f[2:6], int(f[6]), *money, *f[10:13])


def june(spark: SparkSession) -> DataFrame:
    data = [parse(x) for x in JUNE_2026.strip().splitlines()]
    return add_derived(spark.createDataFrame(data, SALES_SCHEMA))


def record(**changes) -> dict:
    base = {
        "Order_ID": "O1",
        "Order_Date": dt.date(2024, 1, 15),
        "Customer_ID": "C1",
        "Customer_Name": "Ann",
        "Product": "Pen",
        "Category": "Office Supplies",
        "Quantity": 1,
        "Price": Decimal("10.00"),
        "Sales": Decimal("10.00"),
        "Profit": Decimal("4.00"),
        "City": "Bonn",
        "State": "NRW",
        "Region": "West",
    }
    return {**base, **changes}


def sales(spark: SparkSession, *records: dict, derive: bool = True) -> DataFrame:
    data = [tuple(r[c] for c in REQUIRED_COLUMNS) for r in records]
    df = spark.createDataFrame(data, SALES_SCHEMA)
    return add_derived(df) if derive else df


def placed(spark: SparkSession, *records: dict) -> DataFrame:
    """Untyped-order records with a ``place`` column."""
    schema = T.StructType([*SALES_SCHEMA.fields, T.StructField("place", T.LongType())])
    data = [(*(r[c] for c in REQUIRED_COLUMNS), i) for i, r in enumerate(records)]
    return spark.createDataFrame(data, schema)
