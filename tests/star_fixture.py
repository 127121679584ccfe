"""A small star and a row-by-row model of its change procedures, for comparison."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline.operators.changes import ORDER_COLUMNS
from ledgerline.sources.schemas import MONEY, STAR_SCHEMAS

LOADED = dt.datetime(2026, 1, 1)
CHANGED = dt.datetime(2026, 6, 26, 12)


def base_rows() -> dict[str, list[tuple]]:
    return {
        "categories": [(1, "Clothing"), (4, "Electronics")],
        "regions": [(1, "East"), (2, "West")],
        "customers": [
            (1, "C1", "Ann", "Bonn", "NRW", LOADED, LOADED),
            (7, "C7", "Bob", "Kiel", "SH", LOADED, LOADED),
        ],
        "products": [
            (3, "Shirt", 1, D("20.00"), 100, LOADED, LOADED),
            (5, "TV", 4, D("400.00"), 2, LOADED, LOADED),
        ],
        "orders": [
            (10, "O10", 1, dt.date(2024, 1, 5), 1, LOADED, LOADED),
            (11, "O11", 1, dt.date(2024, 2, 5), 2, LOADED, LOADED),
            (12, "EMPTY", 1, dt.date(2024, 3, 5), 2, LOADED, LOADED),
        ],
        "order_items": [
            (20, 10, 3, 2, D("20.00"), D("40.00"), D("8.00")),
            (21, 10, 3, 1, D("20.00"), D("20.00"), D("4.00")),
            (22, 11, 3, 1, D("20.00"), D("20.00"), D("-1.00")),
        ],
    }


def make_star(spark: SparkSession, tables: dict[str, list[tuple]] | None = None) -> dict[str, DataFrame]:
    tables = tables or base_rows()
    return {n: spark.createDataFrame(tables[n], STAR_SCHEMAS[n]) for n in tables}


CALL_SCHEMA = T.StructType(
    [
        T.StructField(c, {"order_date": T.DateType(), "quantity": T.IntegerType()}.get(
            c, MONEY if c in ("price_per_unit", "sales", "profit") else T.StringType()
        ))
        for c in ORDER_COLUMNS
    ]
    + [T.StructField("seq", T.LongType())]
)


def call(seq: int, **changes) -> tuple:
    base = {
        "order_code": "N1",
        "order_date": dt.date(2024, 6, 1),
        "customer_code": "C1",
        "customer_name": "Ann",
        "city": "Bonn",
        "state": "NRW",
        "product_name": "Shirt",
        "category_name": "Clothing",
        "quantity": 1,
        "price_per_unit": D("20.00"),
        "sales": D("20.00"),
        "profit": D("5.00"),
        "region_name": "East",
    }
    base.update(changes)
    return (*[base[c] for c in ORDER_COLUMNS], seq)


def calls_frame(spark: SparkSession, calls: list[tuple]) -> DataFrame:
    return spark.createDataFrame(calls, CALL_SCHEMA)


def run_calls(tables: dict[str, list[tuple]], calls: list[tuple]) -> dict[str, list[tuple]]:
    """The order procedure and the stock trigger, one call after the other."""
    t = {n: [list(r) for r in rows] for n, rows in tables.items()}

    def next_id(name):
        return max((r[0] for r in t[name]), default=0) + 1

    def find(name, column, value):
        return next((r for r in t[name] if r[column] == value), None)

    for raw in sorted(calls, key=lambda c: c[-1]):
        c = dict(zip(ORDER_COLUMNS, raw))
        if any(c[k] is None for k in ORDER_COLUMNS if k not in ("city", "state")):
            continue
        if c["quantity"] <= 0 or c["price_per_unit"] < 0 or c["sales"] < 0:
            continue
        region = find("regions", 1, c["region_name"])
        if region is None:
            region = [next_id("regions"), c["region_name"]]
            t["regions"].append(region)
        customer = find("customers", 1, c["customer_code"])
        if customer is None:
            customer = [next_id("customers"), c["customer_code"], None, None, None, CHANGED, None]
            t["customers"].append(customer)
        customer[2:5] = [c["customer_name"], c["city"], c["state"]]
        customer[6] = CHANGED
        category = find("categories", 1, c["category_name"])
        if category is None:
            category = [next_id("categories"), c["category_name"]]
            t["categories"].append(category)
        product = find("products", 1, c["product_name"])
        if product is None:
            product = [next_id("products"), c["product_name"], category[0], None, 100, CHANGED, None]
            t["products"].append(product)
        product[3] = c["price_per_unit"]
        order = find("orders", 1, c["order_code"])
        if order is None:
            order = [
                next_id("orders"), c["order_code"], customer[0], c["order_date"], region[0], CHANGED, CHANGED,
            ]
            t["orders"].append(order)
        t["order_items"].append(
            [next_id("order_items"), order[0], product[0], c["quantity"], c["price_per_unit"], c["sales"], c["profit"]]
        )
        product[4] -= c["quantity"]
        product[6] = CHANGED
    return {n: [tuple(r) for r in rows] for n, rows in t.items()}
