"""Global KPIs, monthly, quarterly and yearly figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.semantics import asc, desc, growth_pct, n_distinct, nz_sum, ratio

# The modelled visits behind the conversion rate.
VISITS_PER_ORDER = 38.5
BASE_VISITS = 2400.0


def kpis(
    df: DataFrame,
    visits_per_order: float = VISITS_PER_ORDER,
    base_visits: float = BASE_VISITS,
) -> DataFrame:
    """One row: Revenue, Profit, ProfitMargin, TotalOrders, AOV, CustomerRetentionRate and a
    modelled ConversionRate; zeros for an empty frame.

    Lines are first added up by customer and order, before they are shuffled; customers and the
    distinct orders are both counted from those rows, whose exchange they share. NULL counts as one
    customer and as one order.
    """
    pairs = df.groupBy("Customer_ID", "Order_ID").agg(nz_sum("Sales").alias("Sales"), nz_sum("Profit").alias("Profit"))
    per_customer = pairs.groupBy("Customer_ID").agg(
        F.sum("Sales").alias("Sales"), F.sum("Profit").alias("Profit"), F.count(F.lit(1)).alias("Orders")
    )
    orders = pairs.groupBy("Order_ID").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)))
    return (
        per_customer.agg(
            nz_sum("Sales").alias("Revenue"),
            nz_sum("Profit").alias("Profit"),
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col("Orders") > 1).alias("repeaters"),
        )
        .withColumn("TotalOrders", orders.scalar())
        .withColumn("visits", F.col("TotalOrders") * F.lit(visits_per_order) + F.lit(base_visits))
        .select(
            "Revenue",
            "Profit",
            ratio("Profit", "Revenue").alias("ProfitMargin"),
            "TotalOrders",
            ratio("Revenue", "TotalOrders").alias("AOV"),
            ratio("repeaters", "customers").alias("CustomerRetentionRate"),
            ratio("TotalOrders", "visits").alias("ConversionRate"),
        )
    )


def extra_kpis(df: DataFrame) -> DataFrame:
    """One row: TotalUnits, AvgUnitPrice (sales per unit) and the highest line's sales."""
    return df.agg(
        nz_sum("Quantity").alias("TotalUnits"),
        nz_sum("Sales").alias("__sales"),
        F.max("Sales").alias("HighestOrderValue"),
    ).select("TotalUnits", ratio("__sales", "TotalUnits").alias("AvgUnitPrice"), "HighestOrderValue")


def monthly_trends(df: DataFrame) -> DataFrame:
    """Sales figures per calendar month that has sales, in time order."""
    return (
        df.groupBy("Year", "Month", "Month_Name")
        .agg(
            nz_sum("Sales").alias("Sales"),
            nz_sum("Profit").alias("Profit"),
            n_distinct("Order_ID").alias("Orders"),
            nz_sum("Quantity").alias("Quantity"),
        )
        .withColumn("Profit_Margin", ratio("Profit", "Sales"))
        .withColumn("AOV", ratio("Sales", "Orders"))
        .orderBy(*asc("Year", "Month"))
    )


def quarter_analysis(df: DataFrame) -> DataFrame:
    """Sales figures per quarter name, over all years."""
    return (
        df.groupBy("Quarter")
        .agg(
            nz_sum("Sales").alias("Sales"),
            nz_sum("Profit").alias("Profit"),
            n_distinct("Order_ID").alias("Orders"),
            nz_sum("Quantity").alias("Quantity"),
        )
        .withColumn("Profit_Margin", ratio("Profit", "Sales"))
        .orderBy(*asc("Quarter"))
    )


def yearly_growth(df: DataFrame) -> DataFrame:
    """Yearly totals and growth over the previous listed year, 0 in the first year.

    The window has no partition key; its input is one row per year.
    """
    yearly = df.groupBy("Year").agg(
        nz_sum("Sales").alias("Sales"),
        nz_sum("Profit").alias("Profit"),
        n_distinct("Order_ID").alias("Orders"),
    )
    by_year = W.orderBy(*asc("Year"))

    def growth(name: str):
        previous = F.lag(name).over(by_year)
        change = F.try_divide(
            (F.col(name) - previous).cast("double"), previous.cast("double")
        ) * 100
        return F.when(F.row_number().over(by_year) == 1, F.lit(0.0)).otherwise(change)

    return (
        yearly.withColumn("Sales_Growth_Pct", growth("Sales"))
        .withColumn("Profit_Growth_Pct", growth("Profit"))
        .orderBy(*asc("Year"))
    )


def period_growth(monthly: DataFrame) -> DataFrame:
    """Growth of sales, profit and orders over the previous listed month (0 without one).

    ``monthly`` is the monthly trend table: one row per month, so one window is enough.
    """
    by_month = W.orderBy(*asc("Year", "Month"))
    return monthly.select(
        "Year",
        "Month",
        "Sales",
        "Profit",
        "Orders",
        *[
            growth_pct(F.col(c), F.lag(c).over(by_month)).alias(f"{c}_Growth_Pct")
            for c in ("Sales", "Profit", "Orders")
        ],
    ).orderBy(*asc("Year", "Month"))


def seasonality(df: DataFrame) -> DataFrame:
    """Sales per month name over all years, highest first; ties in calendar order."""
    return (
        df.groupBy("Month", "Month_Name")
        .agg(nz_sum("Sales").alias("Sales"))
        .orderBy(*desc("Sales"), *asc("Month"))
        .select("Month_Name", "Sales")
    )


def dashboard_filter(
    df: DataFrame, region: str = "All", category: str = "All", quarter: str = "all"
) -> DataFrame:
    """Region, category and quarter choices; "All" / "all" keep everything."""
    if region != "All":
        df = df.filter(F.col("Region") == region)
    if category != "All":
        df = df.filter(F.col("Category") == category)
    if quarter != "all":
        df = df.filter(F.lower("Quarter") == quarter.lower())
    return df


def sales_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Sales between two dates, both included."""
    return df.filter(F.col("Order_Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _equals(column: str, value: str, ignore_case: bool):
    name = F.collate(F.col(column), "UTF8_LCASE") if ignore_case else F.col(column)
    return name == F.lit(value)


def sales_in_category(df: DataFrame, category: str, ignore_case: bool = False) -> DataFrame:
    return df.filter(_equals("Category", category, ignore_case))


def sales_in_region(df: DataFrame, region: str, ignore_case: bool = False) -> DataFrame:
    return df.filter(_equals("Region", region, ignore_case))
