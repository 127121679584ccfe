"""Rule-based insight sentences, recommendations and snapshot texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import grouped
from ledgerline.operators import customers, products, regions, sales
from ledgerline.functions.semantics import asc

LOW_MARGIN = 0.05

# The sentences.
NO_DATA_INSIGHT = "No data available to generate insights."
NO_DATA_RECOMMENDATION = "Please ingest data first."
BEST_CATEGORY = (
    "**Best Performing Category**: **%s** is the primary driver of top-line revenue, "
    "generating **₹%s** with an operational profit margin of **%.1f%%**."
)
WORST_REGION = (
    "**Weakest Region Performance**: **%s Region** registered the lowest sales volume of "
    "**₹%s**, operating at a profit margin of **%.1f%%**."
)
TOP_CUSTOMER = (
    "**High Value Corporate Partner**: **%s** (%s) is our highest spending customer, "
    "generating **₹%s** in revenue across **%d** orders."
)
TOP_PROFIT_PRODUCT = (
    "**Top Profit Generating Asset**: **%s** is our most profitable product, yielding a total "
    "profit of **₹%s** with an individual profit margin of **%.1f%%**."
)
PEAK_MONTH = (
    "**Seasonal Peak Period**: Transaction logs indicate **%s** represents the "
    "highest-velocity sales month, showing elevated demand peaks."
)
GROWTH = (
    "**Yearly Growth Momentum**: E-Commerce sales grew by **%.1f%%** YoY in **%d**, "
    "reflecting robust demand expansions."
)
NO_GROWTH = (
    "**Growth Momentum**: Baseline year established. Awaiting historical data points to "
    "compile YoY trend lines."
)
FIX_REGION = (
    "Optimize regional pricing strategy or delivery costs in the **%s Region**, which suffers "
    "from extremely narrow profit margins (%.1f%%)."
)
DEFAULT_RECOMMENDATIONS = (
    "Bundle low-margin Furniture products with high-velocity Accessories to improve aggregate "
    "cart margins.",
    "Launch a re-engagement loyalty campaign targeted at the 'At Risk' K-Means customer "
    "cluster to reverse churn trend.",
)
KEEP_CUSTOMER = (
    "Provide premium account benefits and volume discounts to **%s** and other top-tier "
    "accounts to secure long-term Customer Lifetime Value."
)
PUSH_CATEGORY = (
    "Reallocate digital advertising budgets towards the **%s** category to capitalize on its "
    "high conversion rate and profit volumes."
)
SNAPSHOT_PRODUCT = "%s (₹%s)"
SNAPSHOT_CATEGORY = "%s (%.1f%% margin)"
SNAPSHOT_FORECAST = "Est. ₹%s total volume"


def _sentence(df: DataFrame, position: int, key: str, text: Column) -> DataFrame:
    return df.select(F.lit(position).alias("position"), F.lit(key).alias("key"), text.alias("text"))


def _pct(name: str) -> Column:
    return F.col(name).cast("double") * 100


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _fixed(spark: SparkSession, rows: list[tuple[int, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "position int, key string, text string")


def _weakest_region(df: DataFrame) -> DataFrame:
    return regions.region_metrics(df).orderBy(*asc("Sales", "Region")).limit(1)


def insights(df: DataFrame) -> DataFrame:
    """position, key, text: one sentence per topic, from one-row results.

    Pass a stored table; each topic is one narrow aggregation over it.
    """
    if df.isEmpty():
        return _fixed(df.sparkSession, [(1, "NoData", NO_DATA_INSIGHT)])
    category = products.category_metrics(df).limit(1)
    region = _weakest_region(df)
    customer = customers.top_customers(df, 1)
    product = products.top_products(df, 1, by="profit")
    month = sales.seasonality(df).limit(1)
    years = sales.yearly_growth(df).agg(
        F.count(F.lit(1)).alias("years"),
        F.max("Year").alias("Year"),
        F.max_by("Sales_Growth_Pct", "Year").alias("growth"),
    )
    return _union(
        [
            _sentence(
                category,
                1,
                "BestCategory",
                F.format_string(
                    BEST_CATEGORY, "Category", grouped(F.col("Sales")), _pct("Profit_Margin")
                ),
            ),
            _sentence(
                region,
                2,
                "WorstRegion",
                F.format_string(
                    WORST_REGION, "Region", grouped(F.col("Sales")), _pct("Profit_Margin")
                ),
            ),
            _sentence(
                customer,
                3,
                "TopCustomer",
                F.format_string(
                    TOP_CUSTOMER,
                    "Customer_Name",
                    "Customer_ID",
                    grouped(F.col("Total_Spent")),
                    "Total_Orders",
                ),
            ),
            _sentence(
                product,
                4,
                "HighestProfitProduct",
                F.format_string(
                    TOP_PROFIT_PRODUCT, "Product", grouped(F.col("Profit")), _pct("Profit_Margin")
                ),
            ),
            _sentence(month, 5, "SeasonalTrend", F.format_string(PEAK_MONTH, "Month_Name")),
            _sentence(
                years,
                6,
                "GrowthTrend",
                F.when(F.col("years") > 1, F.format_string(GROWTH, "growth", "Year")).otherwise(
                    F.lit(NO_GROWTH)
                ),
            ),
        ]
    ).orderBy("position")


def recommendations(df: DataFrame) -> DataFrame:
    """position, key, text: a low-margin region's advice or two defaults, then two more."""
    spark = df.sparkSession
    if df.isEmpty():
        return _fixed(spark, [(1, "NoData", NO_DATA_RECOMMENDATION)])
    region = _weakest_region(df)
    low = F.col("Profit_Margin") < LOW_MARGIN
    advice = F.when(
        low,
        F.array(F.format_string(FIX_REGION, "Region", _pct("Profit_Margin"))),
    ).otherwise(F.array(*[F.lit(t) for t in DEFAULT_RECOMMENDATIONS]))
    first = region.select(F.posexplode(advice).alias("at", "text")).select(
        (F.col("at") + 1).alias("position"), F.lit("Strategy").alias("key"), "text"
    )
    customer = customers.top_customers(df, 1)
    category = products.category_metrics(df).limit(1)
    return _union(
        [
            first,
            _sentence(customer, 3, "TopCustomer", F.format_string(KEEP_CUSTOMER, "Customer_Name")),
            _sentence(category, 4, "BestCategory", F.format_string(PUSH_CATEGORY, "Category")),
        ]
    ).orderBy("position")


def snapshot_texts(df: DataFrame, forecast: DataFrame) -> DataFrame:
    """key, text: top product, lowest-margin category, sum of the first three forecast months."""
    product = products.top_products(df, 1)
    category = products.category_metrics(df).orderBy(*asc("Profit_Margin"), F.desc("Sales"), F.asc("Category")).limit(1)
    total = (
        forecast.orderBy("Month_Index").limit(3).agg(F.sum("Sales_ARIMA").alias("total"))
    )
    return _union(
        [
            product.select(
                F.lit("TopProductText").alias("key"),
                F.format_string(SNAPSHOT_PRODUCT, "Product", grouped(F.col("Sales"))).alias("text"),
            ),
            category.select(
                F.lit("WorstCategoryText").alias("key"),
                F.format_string(SNAPSHOT_CATEGORY, "Category", _pct("Profit_Margin")).alias("text"),
            ),
            total.select(
                F.lit("ForecastText").alias("key"),
                F.format_string(SNAPSHOT_FORECAST, grouped(F.col("total"))).alias("text"),
            ),
        ]
    )
