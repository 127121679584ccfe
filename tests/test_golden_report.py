"""The June 2026 report: input rows and the printed figures."""

from __future__ import annotations

from fixtures import june

from ledgerline.operators import products, reports, sales


def test_monthly_report_cards_and_tables(spark):
    report = reports.build_report(june(spark), "monthly")
    assert report.label == "Monthly_2026_06"
    parts = reports.text_parts(report)
    card = parts["cards"].first().asDict()
    assert card == {
        "Label": "Monthly_2026_06",
        "Record_Volume": 7,
        "Revenue": "₹201,200",
        "Profit": "₹67,050",
        "ProfitMargin": "33.32%",
        "TotalOrders": "7",
        "AOV": "₹28,743",
        "CustomerRetentionRate": "16.67%",
    }
    assert [tuple(r) for r in parts["regions"].collect()] == [
        ("East", "₹154,300", "₹54,009", "35.0%"),
        ("West", "₹29,700", "₹9,780", "32.9%"),
        ("Central", "₹13,200", "₹2,595", "19.7%"),
        ("South", "₹4,000", "₹665", "16.6%"),
    ]
    assert [tuple(r) for r in parts["products"].collect()] == [
        ("iPad Air", "Electronics", "3 units", "₹147,000", "₹49,733"),
        ("Running Shoes", "Clothing", "3 units", "₹29,700", "₹9,780"),
        ("LED Desk Lamp", "Furniture", "4 units", "₹16,000", "₹2,804"),
        ("Dry Erase Whiteboard", "Office Supplies", "1 units", "₹3,700", "₹2,056"),
        ("Heavy Duty Stapler", "Office Supplies", "2 units", "₹3,600", "₹2,220"),
    ]


def test_derived_columns_match_the_export(spark):
    got = {r["Order_ID"]: r for r in june(spark).collect()}
    margins = {
        "EC-1758": 0.3293,
        "EC-1587": 0.3383,
        "EC-1300": 0.1663,
        "EC-1976": 0.1782,
        "EC-1191": 0.5556,
        "EC-1128": 0.6168,
        "EC-1255": 0.3806,
    }
    for order, margin in margins.items():
        row = got[order]
        assert row["Profit_Margin"] == margin
        assert (row["Year"], row["Month"], row["Quarter"], row["Month_Name"]) == (2026, 6, "Q2", "Jun")


def test_summary_lines(spark):
    lines = reports.summary_lines(sales.kpis(june(spark))).collect()
    assert [(r["KPI"], r["Value"]) for r in lines] == [
        ("Total Revenue", "201200"),
        ("Total Profit", "67049.7"),
        ("Gross Profit Margin", "33.32%"),
        ("Total Orders", "7"),
        ("Average Order Value (AOV)", "28742.86"),
        ("Retention Rate", "16.67%"),
    ]


def test_conversion_rate_is_modelled(spark):
    row = sales.kpis(june(spark)).first()
    assert row["ConversionRate"] == 7 / (7 * 38.5 + 2400)
    extra = sales.extra_kpis(june(spark)).first()
    assert (extra["TotalUnits"], float(extra["HighestOrderValue"])) == (14, 147000.0)


def test_top_five_and_period_choices(spark, tmp_path):
    df = june(spark)
    assert products.top_products(df, 5).count() == 5
    daily, label = reports.select_period(df, "daily", "2026-06-08")
    assert (daily.count(), label) == (3, "Daily_2026-06-08")
    assert reports.select_period(df, "quarterly")[1] == "Quarterly_2026_Q2"
    assert reports.select_period(df, "yearly")[1] == "Yearly_2026"
    everything, label = reports.select_period(df, "monthly", "2020-01-01")
    assert (everything.count(), label) == (7, "Full_Dataset")
    assert reports.select_period(df, "weekly")[0].count() == 7
    assert reports.build_report(df.limit(0)) is None

    report = reports.build_report(df)
    path = reports.write_report(report, str(tmp_path), "csv")
    assert path.endswith("sales_report_Monthly_2026_06")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 7 and back.columns == df.columns
    tables = reports.write_report(report, str(tmp_path / "t"), "tables")
    assert spark.read.parquet(f"{tables}/summary_kpis").count() == 6
    assert spark.read.parquet(f"{tables}/top_products").count() == 5
    assert spark.read.parquet(f"{tables}/regional_analytics").count() == 4
    assert spark.read.parquet(f"{tables}/detailed_transactions").count() == 7
    text = reports.write_report(report, str(tmp_path / "p"), "text")
    assert spark.read.option("header", True).csv(f"{text}/regions").count() == 4
