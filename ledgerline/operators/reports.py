"""Period reports: row selection, summary tables and report texts."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import money, percent
from ledgerline.operators import products, regions, sales
from ledgerline.sources.writers import write_csv, write_parts

FULL_LABEL = "Full_Dataset"

# Summary lines of a report.
SUMMARY_LINES = (
    "Total Revenue",
    "Total Profit",
    "Gross Profit Margin",
    "Total Orders",
    "Average Order Value (AOV)",
    "Retention Rate",
)


@dataclass(frozen=True)
class Report:
    label: str
    rows: DataFrame
    kpis: DataFrame
    top_products: DataFrame
    regions: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        """The four report tables."""
        return {
            "summary_kpis": summary_lines(self.kpis),
            "top_products": self.top_products,
            "regional_analytics": self.regions,
            "detailed_transactions": self.rows,
        }


def _anchor(df: DataFrame, target_date: dt.date | str | None) -> dt.date:
    if isinstance(target_date, str):
        return dt.date.fromisoformat(target_date)
    return target_date or df.agg(F.max("Order_Date")).first()[0]


def select_period(
    df: DataFrame, period: str = "monthly", target_date: dt.date | str | None = None
) -> tuple[DataFrame, str]:
    """Rows of the anchor's day, month, quarter or year, and the report label.

    The anchor is the given date or the newest one. Another period name keeps all rows, and
    so does a period without sales. The period is plain literal predicates, so it prunes
    folders and row groups; the emptiness probe stops at the first row found.
    """
    if df.isEmpty():
        return df, FULL_LABEL
    day = _anchor(df, target_date)
    quarter = (day.month + 2) // 3
    year, month = F.col("Year") == day.year, F.col("Month") == day.month
    choices = {
        "daily": (F.col("Order_Date") == F.lit(day), f"Daily_{day.isoformat()}"),
        "monthly": (year & month, f"Monthly_{day.year:04d}_{day.month:02d}"),
        "quarterly": (
            year & (F.col("Quarter") == f"Q{quarter}"),
            f"Quarterly_{day.year:04d}_Q{quarter}",
        ),
        "yearly": (year, f"Yearly_{day.year:04d}"),
    }
    if period not in choices:
        return df, ""
    condition, label = choices[period]
    chosen = df.filter(condition)
    return (df, FULL_LABEL) if chosen.isEmpty() else (chosen, label)


def build_report(
    df: DataFrame, period: str = "monthly", target_date: dt.date | str | None = None
) -> Report | None:
    """Period rows with KPIs, the five best products and the regions; None without data."""
    if df.isEmpty():
        return None
    rows, label = select_period(df, period, target_date)
    return Report(
        label, rows, sales.kpis(rows), products.top_products(rows, 5), regions.region_metrics(rows)
    )


def summary_lines(kpis: DataFrame) -> DataFrame:
    """KPI and Value texts, six rows from the one KPI row."""
    def plain(name: str):
        return F.regexp_replace(
            F.round(F.col(name).cast("double"), 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", ""
        )

    values = (
        plain("Revenue"),
        plain("Profit"),
        percent(F.col("ProfitMargin"), 2),
        F.col("TotalOrders").cast("string"),
        plain("AOV"),
        percent(F.col("CustomerRetentionRate"), 2),
    )
    lines = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(k).alias("KPI"), v.alias("Value"))
            for i, (k, v) in enumerate(zip(SUMMARY_LINES, values))
        ]
    )
    return kpis.select(F.inline(lines)).orderBy("position")


def region_texts(region_table: DataFrame) -> DataFrame:
    """Region, sales, profit and margin as report texts."""
    return region_table.select(
        "Region",
        money(F.col("Sales")).alias("Sales_Volume"),
        money(F.col("Profit")).alias("Profit_Amount"),
        percent(F.col("Profit_Margin"), 1).alias("Profit_Margin"),
    )


def product_texts(top: DataFrame) -> DataFrame:
    """Product, category, units, revenue and profit as report texts."""
    return top.select(
        "Product",
        "Category",
        F.format_string("%d units", "Quantity").alias("Quantity_Sold"),
        money(F.col("Sales")).alias("Revenue"),
        money(F.col("Profit")).alias("Total_Profit"),
    )


def text_parts(report: Report) -> dict[str, DataFrame]:
    """The printable report: KPI texts, region rows and product rows."""
    count = report.rows.agg(F.count(F.lit(1)).alias("Record_Volume"))
    cards = report.kpis.select(
        F.lit(report.label).alias("Label"),
        count.scalar().alias("Record_Volume"),
        money(F.col("Revenue")).alias("Revenue"),
        money(F.col("Profit")).alias("Profit"),
        percent(F.col("ProfitMargin"), 2).alias("ProfitMargin"),
        F.col("TotalOrders").cast("string").alias("TotalOrders"),
        money(F.col("AOV")).alias("AOV"),
        percent(F.col("CustomerRetentionRate"), 2).alias("CustomerRetentionRate"),
    )
    return {
        "cards": cards,
        "regions": region_texts(report.regions),
        "products": product_texts(report.top_products),
    }


def write_report(report: Report, folder: str, fmt: str = "csv") -> str:
    """Write a report below ``folder`` and return its path.

    csv: the period's rows. tables: the four report tables. text: the printable parts.
    """
    path = f"{folder}/sales_report_{report.label}"
    if fmt == "csv":
        return write_csv(report.rows, path)
    parts = report.parts() if fmt == "tables" else text_parts(report)
    write_parts(parts, path, "csv" if fmt == "text" else "parquet")
    return path
