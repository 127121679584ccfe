"""Customer tables and RFM figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.semantics import asc, desc, mean_of, n_distinct, nz_sum, ratio
from ledgerline.session import durable

CUSTOMER_KEY = ("Customer_ID", "Customer_Name")


def customer_metrics(df: DataFrame) -> DataFrame:
    """One row per (Customer_ID, Customer_Name): an id with two names counts twice."""
    return (
        df.groupBy(*CUSTOMER_KEY)
        .agg(
            nz_sum("Sales").alias("Total_Spent"),
            nz_sum("Profit").alias("Total_Profit"),
            n_distinct("Order_ID").alias("Total_Orders"),
            nz_sum("Quantity").alias("Total_Units"),
            F.max("Order_Date").alias("Last_Purchase"),
        )
        .withColumn("AOV", ratio("Total_Spent", "Total_Orders"))
        .withColumn("Profit_Margin", ratio("Total_Profit", "Total_Spent"))
    )


def customer_summary(df: DataFrame) -> DataFrame:
    """One row over the customer table: counts, repeat rate, mean spend and frequency."""
    per_customer = df.groupBy(*CUSTOMER_KEY).agg(
        nz_sum("Sales").alias("Total_Spent"), n_distinct("Order_ID").alias("Total_Orders")
    )
    return per_customer.agg(
        F.count(F.lit(1)).alias("TotalCustomers"),
        F.count_if(F.col("Total_Orders") > 1).alias("RepeatCustomersCount"),
        F.coalesce(mean_of("Total_Spent"), F.lit(0.0)).alias("AverageCLV"),
        F.coalesce(mean_of("Total_Orders"), F.lit(0.0)).alias("AverageFrequency"),
    ).select(
        "TotalCustomers",
        "RepeatCustomersCount",
        ratio("RepeatCustomersCount", "TotalCustomers").alias("RepeatRate"),
        "AverageCLV",
        "AverageFrequency",
    )


def top_customers(df: DataFrame, n: int = 10, by: str = "sales") -> DataFrame:
    """The n best customers by spend or by profit."""
    measure = "Total_Profit" if by == "profit" else "Total_Spent"
    return customer_metrics(df).orderBy(*desc(measure), *asc(*CUSTOMER_KEY)).limit(n)


def rfm(df: DataFrame) -> DataFrame:
    """Recency in days before the newest order of all, Frequency in orders, Monetary in sales.

    The customer table is stored first and gives the newest date, so the sales are read once.
    """
    per_customer = durable(
        df.groupBy(*CUSTOMER_KEY).agg(
            F.max("Order_Date").alias("last_date"),
            n_distinct("Order_ID").alias("Frequency"),
            nz_sum("Sales").alias("Monetary"),
        ),
        "customers",
    )
    newest = per_customer.agg(F.max("last_date")).scalar()
    return per_customer.select(
        *CUSTOMER_KEY,
        F.date_diff(newest, "last_date").cast("double").alias("Recency"),
        "Frequency",
        "Monetary",
    )
