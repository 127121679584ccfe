"""The dashboard's questions over one clean sales table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerline.functions.semantics import only_row
from ledgerline.operators import (
    customers,
    demand,
    forecasting,
    insights,
    products,
    regions,
    sales,
    segmentation,
)


class SalesAnalytics:
    """Facade over a clean (stored or persisted) sales table; every answer is a DataFrame."""

    def __init__(self, clean: DataFrame, audit_log: DataFrame | None = None):
        self.clean = clean
        self.audit_log = audit_log

    def filtered(self, region: str = "All", category: str = "All", quarter: str = "all") -> SalesAnalytics:
        rows = sales.dashboard_filter(self.clean, region, category, quarter)
        return SalesAnalytics(rows, self.audit_log)

    def sales_metrics(self) -> DataFrame:
        return sales.kpis(self.clean)

    def customer_metrics(self) -> dict[str, DataFrame]:
        return {
            "customer_table": customers.customer_metrics(self.clean),
            "summary": customers.customer_summary(self.clean),
        }

    def product_metrics(self) -> DataFrame:
        return products.product_metrics(self.clean)

    def region_metrics(self) -> DataFrame:
        return regions.region_metrics(self.clean)

    def forecast_sales(self, periods: int = 6) -> DataFrame:
        return forecasting.forecast(self.clean, periods)

    def segment_customers(self, centers: int = 3) -> segmentation.Segments | None:
        return segmentation.segment_customers(self.clean, centers)

    def generate_insights(self) -> dict[str, DataFrame]:
        return {
            "insights": insights.insights(self.clean),
            "recommendations": insights.recommendations(self.clean),
        }

    def dashboard(self, horizon: int = 6, model: demand.DemandModel | None = None) -> dict[str, DataFrame]:
        """Everything the dashboard shows, one DataFrame per panel."""
        forecast = self.forecast_sales(horizon)
        segments = self.segment_customers()
        panels = {
            "cleaned_data": self.clean,
            "kpis": self.sales_metrics()
            .withColumn("extra", only_row(sales.extra_kpis(self.clean)))
            .select("*", "extra.*")
            .drop("extra"),
            "growth": sales.period_growth(sales.monthly_trends(self.clean)),
            "contribution": products.category_contribution(self.clean),
            "forecast": forecast,
            "historical": sales.monthly_trends(self.clean),
            **self.generate_insights(),
            "snapshot": insights.snapshot_texts(self.clean, forecast),
        }
        if self.audit_log is not None:
            panels["audit_logs"] = self.audit_log
        if segments is not None:
            panels["clusters"] = segments.data
            panels["centroids"] = segments.centroids
        if model is not None:
            panels["importance"] = model.importance
        return panels
