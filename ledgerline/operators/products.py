"""Product and category figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.ranking import number_rows
from ledgerline.functions.semantics import asc, desc, mean_of, min_max, n_distinct, nz_sum, only_row, ratio
from ledgerline.session import durable
from ledgerline.sources.schemas import CONTRIBUTION_KEYS

PRODUCT_KEY = ("Product", "Category")
LOW_SALES = 50_000

# Weights of the composite product score.
SCORE_WEIGHTS = {"Sales": 0.40, "Quantity": 0.30, "Profit_Margin": 0.30}


def product_metrics(df: DataFrame) -> DataFrame:
    """One row per (Product, Category); Avg_Price is the plain mean over lines."""
    return (
        df.groupBy(*PRODUCT_KEY)
        .agg(
            nz_sum("Sales").alias("Sales"),
            nz_sum("Profit").alias("Profit"),
            nz_sum("Quantity").alias("Quantity"),
            mean_of("Price").alias("Avg_Price"),
            n_distinct("Order_ID").alias("Orders"),
        )
        .withColumn("Profit_Margin", ratio("Profit", "Sales"))
    )


def top_products(df: DataFrame, n: int = 10, by: str = "sales") -> DataFrame:
    """The n best products by sales, quantity or profit."""
    measure = {"quantity": "Quantity", "profit": "Profit"}.get(by, "Sales")
    return product_metrics(df).orderBy(*desc(measure), *asc(*PRODUCT_KEY)).limit(n)


def low_performing_products(df: DataFrame, threshold_sales: float = LOW_SALES) -> DataFrame:
    """Products whose total sales stay below the threshold, lowest first."""
    return (
        product_metrics(df)
        .filter(F.col("Sales") < threshold_sales)
        .orderBy(*asc("Sales", *PRODUCT_KEY))
    )


def product_ranking(df: DataFrame) -> DataFrame:
    """Products ranked by a weighted score of scaled sales, quantity and margin."""
    sums = df.groupBy(*PRODUCT_KEY).agg(
        nz_sum("Sales").alias("Sales"),
        nz_sum("Profit").alias("Profit"),
        nz_sum("Quantity").alias("Quantity"),
    )
    # stored, so that the limits below do not aggregate the sales a second time
    products = durable(sums.withColumn("Profit_Margin", ratio("Profit", "Sales")), "products")
    limits = products.agg(
        *[F.min(c).alias(f"low_{c}") for c in SCORE_WEIGHTS],
        *[F.max(c).alias(f"high_{c}") for c in SCORE_WEIGHTS],
    )
    parts = [
        min_max(c, f"limits.low_{c}", f"limits.high_{c}") * F.lit(weight)
        for c, weight in SCORE_WEIGHTS.items()
    ]
    scored = products.withColumn("limits", only_row(limits)).select(
        *products.columns, (parts[0] + parts[1] + parts[2]).alias("Composite_Score")
    )
    ranked = number_rows(scored, [*desc("Composite_Score"), *asc(*PRODUCT_KEY)], "Rank")
    return ranked.select(
        "Rank",
        "Product",
        "Category",
        "Sales",
        "Profit",
        "Quantity",
        "Profit_Margin",
        "Composite_Score",
    )


def with_share(groups: DataFrame) -> DataFrame:
    """Add each row's share of total sales in percent.

    ``groups`` is already aggregated to one row per category or region; the window over
    these few rows saves a second pass over the sales.
    """
    total = F.sum("Sales").over(W.partitionBy())
    share = F.try_divide(F.col("Sales").cast("double"), total.cast("double")) * 100
    return groups.withColumn("Share_Pct", share)


def category_metrics(df: DataFrame) -> DataFrame:
    """Sales figures and share per category, best first."""
    groups = (
        df.groupBy("Category")
        .agg(
            nz_sum("Sales").alias("Sales"),
            nz_sum("Profit").alias("Profit"),
            nz_sum("Quantity").alias("Quantity"),
            n_distinct("Order_ID").alias("Orders"),
        )
        .withColumn("Profit_Margin", ratio("Profit", "Sales"))
    )
    return with_share(groups).orderBy(*desc("Sales"), *asc("Category"))


def category_contribution(df: DataFrame, keys: Sequence[str] = CONTRIBUTION_KEYS) -> DataFrame:
    """Share of sales per category name without spaces; listed keys without sales show 0."""
    shares = with_share(
        df.groupBy(F.replace("Category", F.lit(" "), F.lit("")).alias("Key"))
        .agg(nz_sum("Sales").alias("Sales"))
    ).select("Key", F.coalesce("Share_Pct", F.lit(0.0)).alias("Contribution_Pct"))
    listed = df.sparkSession.createDataFrame([(k,) for k in keys], "Key string")
    return shares.join(listed, "Key", "full").select(
        "Key", F.coalesce("Contribution_Pct", F.lit(0.0)).alias("Contribution_Pct")
    )
