from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import rows
from fixtures import placed, record
from pyspark.sql import functions as F
from star_fixture import base_rows, make_star

from ledgerline.operators import star
from ledgerline.sources.writers import read_star, write_sales, write_star


def test_views_keep_customers_and_products_without_sales(spark):
    tables = make_star(spark)
    people = {r["Customer_ID"]: r for r in star.customer_summary(tables).collect()}
    assert (people["C1"]["Total_Orders"], people["C1"]["Total_Sales"]) == (3, D("80.00"))
    assert people["C1"]["Avg_Order_Value"] == 80 / 3
    assert (people["C7"]["Total_Orders"], people["C7"]["Total_Sales"], people["C7"]["Avg_Order_Value"]) == (0, 0, 0)
    stuff = {r["Product"]: r for r in star.product_summary(tables).collect()}
    assert (stuff["Shirt"]["Total_Units_Sold"], stuff["Shirt"]["Total_Profit"]) == (4, D("11.00"))
    assert (stuff["TV"]["Total_Units_Sold"], stuff["TV"]["Total_Sales"]) == (0, 0)


def test_monthly_and_yearly_views_count_orders_with_items(spark):
    tables = make_star(spark)
    assert [tuple(r) for r in star.monthly_sales(tables).collect()] == [
        (2024, 2, "Feb", D("20.00"), D("-1.00"), 1),
        (2024, 1, "Jan", D("60.00"), D("12.00"), 1),
    ]
    assert [tuple(r) for r in star.yearly_sales(tables).collect()] == [(2024, D("80.00"), D("11.00"), 2)]


def test_top_lists_and_sql_views(spark):
    tables = make_star(spark)
    assert [r["Product"] for r in star.top_products(tables, 1).collect()] == ["Shirt"]
    best = star.top_customers(tables, 1)
    assert best.columns[0] == "customer_code" and best.first()["customer_code"] == "C1"
    star.register_views(tables)
    assert spark.sql("SELECT count(*) FROM vw_sales_summary").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM vw_customer_summary").first()[0] == 2


def test_summary_takes_region_from_the_order(spark):
    got = star.sales_summary(make_star(spark)).collect()
    assert {(r["Order_ID"], r["State"], r["Region"]) for r in got} == {("O10", "NRW", "East"), ("O11", "NRW", "West")}


def test_building_a_star(spark):
    data = [
        record(Order_ID="o2", Customer_ID="c2", Category="B", Product="p2", Price=D(7), Region="West", City="first"),
        record(Order_ID="o1", Customer_ID="c1", Category="A", Product="p1", Price=D(3), Region="East"),
        record(Order_ID="o2", Customer_ID="c9", Category="C", Product="p2", Price=D(9), Region="East", Order_Date=dt.date(2020, 1, 1)),
        record(Order_ID="o3", Customer_ID="c2", Category="", Product="p1", Price=D(4), Region="", City="later"),
    ]
    built = star.build_star(placed(spark, *data), ["place"])
    assert rows(built["categories"]) == [(1, "B"), (2, "A"), (3, "C")]
    assert rows(built["regions"]) == [(1, "West"), (2, "East")]
    assert rows(built["customers"], "customer_id", "customer_code", "city") == [(1, "c1", "Bonn"), (2, "c2", "first"), (3, "c9", "Bonn")]
    assert rows(built["products"], "product_id", "product_name", "category_id", "price", "stock") == [
        (1, "p1", 2, D("3.00"), 100), (2, "p2", 1, D("7.00"), 100),
    ]
    # the header of o2 comes from its first row
    assert rows(built["orders"]) == [
        (1, "o1", 1, dt.date(2024, 1, 15), 2), (2, "o2", 2, dt.date(2024, 1, 15), 1), (3, "o3", 2, dt.date(2024, 1, 15), None),
    ]
    # items take the product's price
    assert rows(built["order_items"], "order_id", "product_id", "price_per_unit") == [
        (1, 1, D("3.00")), (2, 2, D("7.00")), (2, 2, D("7.00")), (3, 1, D("3.00")),
    ]


def test_constraints(spark):
    assert star.check_constraints(make_star(spark)).isEmpty()
    broken = base_rows()
    broken["customers"].append(broken["customers"][0])
    broken["orders"].append((13, "O13", 99, dt.date(2024, 1, 1), 1, None, None))
    broken["order_items"].append((23, 77, 3, -2, D(1), D(-1), D(0)))
    got = {(r["table_name"], r["rule_name"], r["key"]): r["n"] for r in star.check_constraints(make_star(spark, broken)).collect()}
    assert got == {
        ("customers", "unique(customer_id)", "1"): 2,
        ("customers", "unique(customer_code)", "C1"): 2,
        ("orders", "customer_id -> customers.customer_id", "99"): 1,
        ("order_items", "order_id -> orders.order_id", "77"): 1,
        ("order_items", "quantity > 0", "77|3"): 1,
        ("order_items", "sales >= 0", "77|3"): 1,
    }


def test_versions_and_partitioned_sales(spark, tmp_path):
    tables = make_star(spark)
    path = write_star(tables, str(tmp_path / "v1"))
    back = read_star(spark, path, list(tables))
    for name, df in tables.items():
        assert rows(back[name]) == rows(df)
    flat = star.sales_summary(tables).withColumns({"Year": F.year("Order_Date"), "Month": F.month("Order_Date")})
    sales_path = write_sales(flat, str(tmp_path / "sales"))
    february = spark.read.parquet(sales_path).filter("Year = 2024 AND Month = 2")
    assert february.count() == 1
    assert "PartitionFilters: [isnotnull(Year" in february._jdf.queryExecution().executedPlan().toString()
