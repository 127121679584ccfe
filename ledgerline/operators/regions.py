"""Regional, state and city figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.semantics import asc, desc, n_distinct, nz_sum, ratio
from ledgerline.operators.products import with_share


def region_metrics(df: DataFrame) -> DataFrame:
    """Sales figures and share per region, best first."""
    groups = (
        df.groupBy("Region")
        .agg(
            nz_sum("Sales").alias("Sales"),
            nz_sum("Profit").alias("Profit"),
            n_distinct("Order_ID").alias("Orders"),
            nz_sum("Quantity").alias("Quantity"),
        )
        .withColumn("Profit_Margin", ratio("Profit", "Sales"))
    )
    return with_share(groups).orderBy(*desc("Sales"), *asc("Region"))


def _place_sales(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(
            nz_sum("Sales").alias("Sales"),
            nz_sum("Profit").alias("Profit"),
            n_distinct("Order_ID").alias("Orders"),
        )
        .withColumn("Profit_Margin", ratio("Profit", "Sales"))
        .orderBy(*desc("Sales"), *asc(*keys))
    )


def state_sales(df: DataFrame) -> DataFrame:
    """Per (State, Region): an order's region need not be its customer's home region."""
    return _place_sales(df, ("State", "Region"))


def city_revenue(df: DataFrame, n: int = 10) -> DataFrame:
    """The n cities with the highest sales."""
    return _place_sales(df, ("City", "State", "Region")).limit(n)


def regional_growth(df: DataFrame) -> DataFrame:
    """Yearly sales and profit per region with growth over the region's previous listed year
    (0 unless that value is positive)."""
    yearly = df.groupBy("Region", "Year").agg(
        nz_sum("Sales").alias("Sales"), nz_sum("Profit").alias("Profit")
    )
    years = W.partitionBy("Region").orderBy(*asc("Year"))

    def growth(name: str):
        before = F.lag(name).over(years).cast("double")
        change = (F.col(name).cast("double") - before) / before * 100
        return F.when(before > 0, change).otherwise(F.lit(0.0))

    return yearly.select(
        "Region",
        "Year",
        "Sales",
        "Profit",
        growth("Sales").alias("Sales_Growth_Pct"),
        growth("Profit").alias("Profit_Growth_Pct"),
    ).orderBy(*asc("Region", "Year"))
