from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal as D

import pytest
from conftest import rows
from fixtures import june, record, sales

from ledgerline.operators import customers, insights, products, regions
from ledgerline.operators import sales as figures
from ledgerline.plans.facade import SalesAnalytics


@pytest.fixture(scope="module")
def two_years(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        product, category, price = rng.choice(
            [("Pen", "Office Supplies", 2), ("Desk", "Furniture", 90), ("Shirt", "Clothing", 20), ("TV", "Electronics", 400)]
        )
        quantity = rng.randint(1, 5)
        customer = rng.randint(1, 12)
        amount = D(quantity * price)
        data.append(
            record(
                Order_ID=f"O{rng.randint(1, 250)}",
                Order_Date=dt.date(2023, 1, 1) + dt.timedelta(days=rng.randrange(730)),
                Customer_ID=f"C{customer}",
                Customer_Name=f"Name {customer}",
                Product=product,
                Category=category,
                Quantity=quantity,
                Price=D(price),
                Sales=amount,
                Profit=round(amount * D(rng.randint(-20, 60)) / 100, 2),
                Region=rng.choice(["East", "West", "South"]),
                State=rng.choice(["S1", "S2"]),
                City=rng.choice(["A", "B", "C"]),
            )
        )
    return data, sales(spark, *data).cache()


def test_empty_frames_give_zeros(spark):
    empty = sales(spark, record()).limit(0)
    assert tuple(float(v) for v in figures.kpis(empty).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert customers.customer_summary(empty).first()["AverageCLV"] == 0
    assert products.product_ranking(empty).count() == 0
    assert rows(insights.insights(empty), "text") == [("No data available to generate insights.",)]
    assert rows(insights.recommendations(empty), "text") == [("Please ingest data first.",)]


def test_kpis_against_plain_python(two_years):
    data, df = two_years
    got = figures.kpis(df).first()
    revenue = sum(r["Sales"] for r in data)
    orders = {r["Order_ID"] for r in data}
    per_customer = defaultdict(set)
    for r in data:
        per_customer[r["Customer_ID"]].add(r["Order_ID"])
    assert got["Revenue"] == revenue and got["TotalOrders"] == len(orders)
    assert got["AOV"] == pytest.approx(float(revenue) / len(orders))
    assert got["CustomerRetentionRate"] == sum(len(o) > 1 for o in per_customer.values()) / len(per_customer)


def test_a_null_customer_is_a_customer(spark):
    df = sales(spark, record(Customer_ID=None, Order_ID="a"), record(Customer_ID=None, Order_ID="b"), record(Order_ID="c"))
    got = figures.kpis(df).first()
    assert (got["TotalOrders"], got["CustomerRetentionRate"]) == (3, 0.5)


def test_one_id_with_two_names(spark):
    df = sales(spark, record(Order_ID="a"), record(Order_ID="b", Customer_Name="Bea"))
    assert figures.kpis(df).first()["CustomerRetentionRate"] == 1.0
    stats = customers.customer_summary(df).first()
    assert (stats["TotalCustomers"], stats["RepeatCustomersCount"]) == (2, 0)


def test_shares_sum_to_hundred(two_years):
    _, df = two_years
    for table in (products.category_metrics(df), regions.region_metrics(df)):
        collected = table.collect()
        assert sum(r["Share_Pct"] for r in collected) == pytest.approx(100)
        assert [r["Sales"] for r in collected] == sorted((r["Sales"] for r in collected), reverse=True)
    shares = dict(rows(products.category_contribution(df)))
    assert set(shares) == {"Electronics", "Furniture", "Clothing", "OfficeSupplies"}
    only = df.filter("Category = 'Clothing'")
    assert dict(rows(products.category_contribution(only)))["Electronics"] == 0.0


def test_average_price_is_per_line(spark):
    df = sales(spark, record(Price=D(10), Quantity=9), record(Order_ID="b", Price=D(20)))
    assert products.product_metrics(df).first()["Avg_Price"] == 15.0


def test_product_ranking(two_years):
    _, df = two_years
    ranked = products.product_ranking(df).orderBy("Rank").collect()
    assert [r["Rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    scores = [r["Composite_Score"] for r in ranked]
    assert scores == sorted(scores, reverse=True) and 0 <= min(scores) <= max(scores) <= 1


def test_low_performers_and_top_lists(two_years):
    _, df = two_years
    assert rows(products.low_performing_products(df, 2_000), "Product") == [("Pen",)]
    assert products.top_products(df, 2).count() == 2
    by_units = products.top_products(df, 1, by="quantity").first()["Quantity"]
    assert by_units == max(r["Quantity"] for r in products.product_metrics(df).collect())
    spend = [r["Total_Spent"] for r in customers.top_customers(df, 5).collect()]
    assert spend == sorted(spend, reverse=True)
    assert regions.city_revenue(df, 5).count() == 5


def test_growth_rules(spark):
    def in_year(year, sales_, profit, region="West"):
        return record(Order_ID=f"{region}{year}", Order_Date=dt.date(year, 5, 1), Sales=D(sales_), Profit=D(profit), Region=region)

    df = sales(spark, in_year(2020, 100, -10), in_year(2022, 150, 5), in_year(2023, 75, 0), in_year(2022, 10, 1, "East"))
    region = {(r["Region"], r["Year"]): r for r in regions.regional_growth(df).collect()}
    assert region["West", 2022]["Sales_Growth_Pct"] == 50.0  # the missing year is skipped
    assert region["West", 2022]["Profit_Growth_Pct"] == 0.0  # previous not positive
    assert region["East", 2022]["Sales_Growth_Pct"] == 0.0
    yearly = figures.yearly_growth(df).collect()
    assert [r["Year"] for r in yearly] == [2020, 2022, 2023]
    assert yearly[0]["Sales_Growth_Pct"] == 0.0 and yearly[1]["Sales_Growth_Pct"] == pytest.approx(60.0)
    assert yearly[1]["Profit_Growth_Pct"] == pytest.approx(-160.0)  # unguarded


def test_growth_from_zero_is_null(spark):
    df = sales(
        spark,
        record(Order_Date=dt.date(2020, 1, 1), Profit=D(0)),
        record(Order_ID="b", Order_Date=dt.date(2021, 1, 1)),
    )
    assert figures.yearly_growth(df).collect()[1]["Profit_Growth_Pct"] is None
    assert figures.period_growth(figures.monthly_trends(df)).collect()[1]["Profit_Growth_Pct"] == 0.0


def test_rfm(two_years):
    data, df = two_years
    newest = max(r["Order_Date"] for r in data)
    got = {r["Customer_ID"]: r for r in customers.rfm(df).collect()}
    for customer in got:
        mine = [r for r in data if r["Customer_ID"] == customer]
        assert got[customer]["Recency"] == (newest - max(r["Order_Date"] for r in mine)).days >= 0
        assert got[customer]["Frequency"] == len({r["Order_ID"] for r in mine})
        assert got[customer]["Monetary"] == sum(r["Sales"] for r in mine)


def test_filters(two_years):
    data, df = two_years
    assert figures.dashboard_filter(df).count() == len(data)
    some = figures.dashboard_filter(df, "East", "Clothing", "Q1")
    assert some.count() == sum(
        r["Region"] == "East" and r["Category"] == "Clothing" and r["Order_Date"].month <= 3 for r in data
    )
    assert figures.sales_in_category(df, "clothing").count() == 0
    assert figures.sales_in_category(df, "clothing", ignore_case=True).count() > 0
    assert figures.sales_in_region(df, "East").count() == sum(r["Region"] == "East" for r in data)
    between = figures.sales_between(df, "2023-03-01", "2023-03-31")
    assert between.count() == sum(dt.date(2023, 3, 1) <= r["Order_Date"] <= dt.date(2023, 3, 31) for r in data)


def test_insights(spark):
    got = {r["key"]: r["text"] for r in insights.insights(june(spark)).collect()}
    assert got["BestCategory"] == (
        "**Best Performing Category**: **Electronics** is the primary driver of top-line revenue, "
        "generating **₹147,000** with an operational profit margin of **33.8%**."
    )
    assert "**South Region** registered the lowest sales volume of **₹4,000**" in got["WorstRegion"]
    assert "**Sofia Allen** (CUST-128)" in got["TopCustomer"] and "across **1** orders" in got["TopCustomer"]
    assert got["GrowthTrend"].startswith("**Growth Momentum**: Baseline year established.")
    advice = [r["text"] for r in insights.recommendations(june(spark)).collect()]
    assert len(advice) == 4 and advice[0].startswith("Bundle low-margin Furniture")

    poor = sales(spark, record(Region="East", Profit=D("0.30")))
    advice = [r["text"] for r in insights.recommendations(poor).collect()]
    assert len(advice) == 3
    assert advice[0].endswith("**East Region**, which suffers from extremely narrow profit margins (3.0%).")


def test_facade_and_dashboard(two_years):
    _, df = two_years
    view = SalesAnalytics(df, audit_log=df.limit(0))
    assert view.sales_metrics().count() == 1
    assert view.customer_metrics()["customer_table"].count() == 12
    assert view.product_metrics().count() == 4 and view.region_metrics().count() == 3
    panels = view.filtered(region="East").dashboard(horizon=4)
    assert panels["forecast"].count() == 4
    assert set(panels) >= {
        "cleaned_data", "audit_logs", "kpis", "contribution", "forecast", "clusters", "insights", "snapshot",
    }
    texts = dict(rows(panels["snapshot"]))
    assert texts["ForecastText"].startswith("Est. ₹") and texts["WorstCategoryText"].endswith("% margin)")
