"""Every operator as a query over the whole test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Decimals leave as doubles and model figures are rounded, so that results compare across
engines. Operators that read their input once get the lazy join with just the columns they
use; those that pass over it repeatedly get it stored first, as a user would store the clean
table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.semantics import asc
from ledgerline.operators import (
    changes,
    cleaning,
    customers,
    demand,
    forecasting,
    insights,
    products,
    regions,
    reports,
    sales,
    segmentation,
    star,
)
from ledgerline.operators.customers import rfm as customers_rfm
from ledgerline.plans.pipeline import process_raw_data
from ledgerline.session import durable, stage_folder
from ledgerline.sources import readers, tpch
from ledgerline.sources.schemas import REQUIRED_COLUMNS
from ledgerline.sources.tpch import TABLE_ORDER, TYPE_MARGINS, Tables
from ledgerline.sources.writers import write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHANGED_AT = "2026-06-26 12:00:00"
CLEAN_COLUMNS = (*REQUIRED_COLUMNS, "Year", "Month", "Quarter", "Month_Name", "Profit_Margin")
# Parameters of the filter and report queries.
FILTER_REGION, FILTER_CATEGORY, FILTER_QUARTER = "ASIA", "PROMO", "q2"
DATE_FROM, DATE_TO = "1997-03-01", "1998-02-28"
REPORT_DAY = "1999-08-17"
EMPTY_DAY = "2010-01-01"
LOW_SALES_LIMIT = 3_000_000
CONTRIBUTION_KEYS = (*TYPE_MARGINS, "LUXURY")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, timestamps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, build: Query) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(spark, sf_dir))

    QUERIES[name] = run


def on_sales(name: str, columns: str, op: Callable[[DataFrame], DataFrame]) -> None:
    """An operator over the sales records with these columns."""
    register(name, lambda s, d: op(tpch.flat_sales(Tables(s, d), columns.split())))


def stored_sales(spark: SparkSession, sf_dir: str, columns=CLEAN_COLUMNS) -> DataFrame:
    return durable(tpch.flat_sales(Tables(spark, sf_dir), columns), "sales")


def on_stored_sales(name: str, op: Callable[[DataFrame], DataFrame], columns=CLEAN_COLUMNS) -> None:
    """An operator that passes over the sales records repeatedly."""
    register(name, lambda s, d: op(stored_sales(s, d, columns)))


def on_star(name: str, op: Callable[[star.Star], DataFrame]) -> None:
    register(name, lambda s, d: op(tpch.star_tables(Tables(s, d))))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales records written as CSV, half of the columns first in one folder and last in the other, and read back."""
    records = tpch.flat_sales(Tables(spark, sf_dir), REQUIRED_COLUMNS).withColumn("Order_Date", F.col("Order_Date").cast("string"))
    folder, turned = f"{stage_folder(spark)}/csv-{uuid.uuid4().hex}", [*REQUIRED_COLUMNS[6:], *REQUIRED_COLUMNS[:6]]
    even = F.pmod(F.xxhash64("Order_ID"), F.lit(2)) == 0
    write_csv(records.filter(even), f"{folder}/order=plain")
    write_csv(records.filter(~even).select(*turned), f"{folder}/order=turned")
    back = readers.read_sales_files(spark, f"{folder}/*").data
    types = tpch.flat_sales(Tables(spark, sf_dir), REQUIRED_COLUMNS).schema
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types.fields])


register("csv_round_trip", _csv_round_trip)

# --- sales records and figures ------------------------------------------------------------

on_sales("flat_sales", " ".join(REQUIRED_COLUMNS), lambda df: df)
on_sales(
    "monthly_trends", "Order_ID Sales Profit Quantity Year Month Month_Name", sales.monthly_trends
)
on_sales("kpis", "Order_ID Customer_ID Sales Profit", sales.kpis)
on_sales("extra_kpis", "Quantity Sales", sales.extra_kpis)
on_sales("quarter_analysis", "Order_ID Sales Profit Quantity Quarter", sales.quarter_analysis)
on_sales("yearly_growth", "Order_ID Sales Profit Year", sales.yearly_growth)
on_sales(
    "monthly_growth",
    "Order_ID Sales Profit Quantity Year Month Month_Name",
    lambda df: sales.period_growth(sales.monthly_trends(df)),
)
on_sales("seasonality", "Sales Month Month_Name", sales.seasonality)

_CUSTOMER = "Order_ID Customer_ID Customer_Name Sales Profit Quantity Order_Date"
on_sales("customer_metrics", _CUSTOMER, customers.customer_metrics)
on_sales(
    "customer_summary_stats", "Order_ID Customer_ID Customer_Name Sales", customers.customer_summary
)
on_sales("top_customers_sales", _CUSTOMER, customers.top_customers)
on_sales("top_customers_profit", _CUSTOMER, lambda df: customers.top_customers(df, by="profit"))
on_sales("rfm", "Order_ID Customer_ID Customer_Name Sales Order_Date", customers.rfm)

_PRODUCT = "Order_ID Product Category Price Sales Profit Quantity"
on_sales("product_metrics", _PRODUCT, products.product_metrics)
on_sales("top_products_sales", _PRODUCT, products.top_products)
on_sales("top_products_quantity", _PRODUCT, lambda df: products.top_products(df, by="quantity"))
on_sales("top_products_profit", _PRODUCT, lambda df: products.top_products(df, by="profit"))
on_sales(
    "low_performing_products",
    _PRODUCT,
    lambda df: products.low_performing_products(df, LOW_SALES_LIMIT),
)
on_sales("product_ranking", "Product Category Sales Profit Quantity", products.product_ranking)
on_sales("category_metrics", "Order_ID Category Sales Profit Quantity", products.category_metrics)
on_sales(
    "category_contribution",
    "Category Sales",
    lambda df: products.category_contribution(df, CONTRIBUTION_KEYS),
)

on_sales("region_metrics", "Order_ID Region Sales Profit Quantity", regions.region_metrics)
on_sales("state_sales", "Order_ID State Region Sales Profit", regions.state_sales)
on_sales("city_revenue", "Order_ID City State Region Sales Profit", regions.city_revenue)
on_sales("regional_growth", "Region Year Sales Profit", regions.regional_growth)
on_sales(
    "lowest_region",
    "Order_ID Region Sales Profit Quantity",
    lambda df: regions.region_metrics(df).orderBy(*asc("Sales", "Region")).limit(1),
)
on_sales(
    "dashboard_filter",
    " ".join((*REQUIRED_COLUMNS, "Quarter")),
    lambda df: sales.dashboard_filter(df, FILTER_REGION, FILTER_CATEGORY, FILTER_QUARTER),
)

# --- star ---------------------------------------------------------------------------------

on_star("view_sales_summary", star.sales_summary)
on_star("view_customer_summary", star.customer_summary)
on_star("view_product_summary", star.product_summary)
on_star("view_monthly_sales", star.monthly_sales)
on_star("yearly_sales", star.yearly_sales)
on_star("proc_top_products", star.top_products)
on_star("proc_top_customers", star.top_customers)
on_star("sales_by_date", lambda t: sales.sales_between(star.sales_summary(t), DATE_FROM, DATE_TO))
on_star("sales_by_category", lambda t: sales.sales_in_category(star.sales_summary(t), FILTER_CATEGORY))
on_star("sales_by_region", lambda t: sales.sales_in_region(star.sales_summary(t), FILTER_REGION))
on_star("constraint_violations", star.check_constraints)


def _star_part(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flat = durable(tpch.flat_sales(Tables(spark, sf_dir), line_order=True), "sales")
        if name == "categories":
            return star.build_categories(flat, TABLE_ORDER)
        if name == "regions":
            return star.build_regions(flat, TABLE_ORDER)
        if name == "customers":
            return star.build_customers(flat, TABLE_ORDER)
        if name == "products":
            return star.build_products(flat, star.build_categories(flat, TABLE_ORDER), TABLE_ORDER)
        return star.build_star(flat, TABLE_ORDER)[name]

    return run


for _name in ("categories", "regions", "customers", "products", "orders"):
    register(f"star_{_name}", _star_part(_name))
register("star_items", _star_part("order_items"))

# --- cleaning -----------------------------------------------------------------------------


def on_dirty(name: str, op: Callable[[DataFrame], DataFrame]) -> None:
    """A cleaning operator over the faulty records, stored as the raw table it would read."""
    register(name, lambda s, d: op(durable(tpch.dirty_sales(Tables(s, d)), "raw")))


_KEYS = tuple(c for c in TABLE_ORDER if c not in ("Sales", "Quantity"))


def _pipeline(df: DataFrame):
    return process_raw_data(
        df,
        TABLE_ORDER,
        TYPE_MARGINS,
        at=F.lit(CHANGED_AT).cast("timestamp"),
    )


def _text_raw(df: DataFrame) -> DataFrame:
    """The faulty records as text, as a CSV reader would return them."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in REQUIRED_COLUMNS], *_KEYS)


on_dirty("margins", lambda df: cleaning.learn_margins(df, TYPE_MARGINS))
on_dirty(
    "impute_profit",
    lambda df: cleaning.impute_profit(df, cleaning.learn_margins(df, TYPE_MARGINS)).select(
        *_KEYS, "Category", "Sales", "Profit", "no_profit"
    ),
)
on_dirty(
    "impute_name",
    lambda df: cleaning.impute_names(df, cleaning.learn_names(df, TABLE_ORDER)).select(
        *_KEYS, "Customer_ID", "Customer_Name", "no_name"
    ),
)
on_dirty(
    "impute_city",
    lambda df: cleaning.impute_cities(df, cleaning.learn_cities(df)).select(
        *_KEYS, "City", "State", "no_city"
    ),
)
on_dirty("audit_log", lambda df: _pipeline(df).audit_log)
on_dirty(
    "dedupe",
    lambda df: cleaning.remove_duplicates(df, TABLE_ORDER).select(*_KEYS, "Order_ID", "Sales"),
)
on_dirty(
    "valid_rows",
    lambda df: cleaning.valid_rows(df).select(*_KEYS, "Order_ID", "Quantity", "Price", "Sales"),
)
on_dirty("typed_rows", lambda df: cleaning.convert_types(_text_raw(df)).select(*REQUIRED_COLUMNS))
on_sales(
    "derived_metrics",
    "Order_ID Order_Date Sales Profit Year Month Quarter Month_Name Profit_Margin",
    lambda df: df,
)
on_stored_sales(
    "outliers", cleaning.detect_outliers, ("Order_ID", "Product", "Sales", "Profit")
)
on_stored_sales(
    "normalize",
    lambda df: cleaning.normalize(df, ("Sales", "Profit", "Quantity", "Discount")),
    ("Order_ID", "Product", "Sales", "Profit", "Quantity"),
)
on_dirty("clean_pipeline", lambda df: _pipeline(df).data)
on_dirty("pipeline_stats", lambda df: _pipeline(df).stats)

# --- reports and insights -----------------------------------------------------------------


def _report(period: str, day: str | None, part: Callable[[reports.Report], DataFrame]) -> Callable:
    return lambda df: part(reports.build_report(df, period, day))


for _period, _day in (
    ("daily", REPORT_DAY),
    ("monthly", None),
    ("quarterly", REPORT_DAY),
    ("yearly", REPORT_DAY),
):
    on_stored_sales(
        f"report_{_period}",
        lambda df, p=_period, t=_day: _labelled(*reports.select_period(df, p, t)),
    )
on_stored_sales(
    "report_fallback", lambda df: _labelled(*reports.select_period(df, "monthly", EMPTY_DAY))
)


def _labelled(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("Label", F.lit(label))


on_stored_sales("report_kpis", _report("yearly", REPORT_DAY, lambda r: reports.summary_lines(r.kpis)))
on_stored_sales("report_cards", _report("yearly", REPORT_DAY, lambda r: reports.text_parts(r)["cards"]))
on_stored_sales(
    "report_region_rows", _report("yearly", REPORT_DAY, lambda r: reports.text_parts(r)["regions"])
)
on_stored_sales(
    "report_product_rows", _report("yearly", REPORT_DAY, lambda r: reports.text_parts(r)["products"])
)
on_stored_sales("insights", insights.insights)
on_stored_sales("recommendations", insights.recommendations)
on_stored_sales(
    "snapshot_texts", lambda df: insights.snapshot_texts(df, forecasting.forecast(df))
)

# --- forecasts ----------------------------------------------------------------------------

_FORECAST = "Order_Date Year Month Sales"


def _rounded(df: DataFrame, digits: int = 0) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in names})


on_sales(
    "forecast_linear",
    _FORECAST,
    lambda df: _rounded(
        forecasting.forecast(df).select(
            "Month_Index", "Year", "Month", "Sales_LR", "LR_Lower80", "LR_Upper80"
        )
    ),
)
on_sales(
    "forecast_seasonal",
    _FORECAST,
    lambda df: _rounded(
        forecasting.forecast(df, 12).select(
            "Month_Index", "Year", "Month", "Sales_ARIMA", "ARIMA_Lower80", "ARIMA_Upper80"
        )
    ),
)
on_sales(
    "forecast_flat",
    f"{_FORECAST} Customer_ID",
    # one series per customer; those with fewer than six months get the flat forecast
    lambda df: _rounded(
        forecasting.forecast(df, group_cols=["Customer_ID"]).filter(
            F.col("method") == forecasting.METHOD_FLAT
        ),
        4,
    ),
)
on_sales("forecast_table", _FORECAST, lambda df: _rounded(forecasting.forecast(df)))
on_sales(
    "forecast_by_category",
    f"{_FORECAST} Category",
    lambda df: _rounded(forecasting.forecast(df, group_cols=["Category"])),
)
on_sales(
    "forecast_by_customer_state",
    f"{_FORECAST} State",
    lambda df: _rounded(forecasting.forecast(df, 3, group_cols=["State"])),
)
on_sales(
    "forecast_arima",
    f"{_FORECAST} Region",
    lambda df: forecasting.arima(df, group_cols=["Region"]),
)
# Models with given coefficients, whose residual recursion SQL repeats.
ARIMA_MODELS = (
    ((1, 0, 0, 0, 0, 0), (0.9,)),
    ((0, 1, 1, 0, 0, 0), (-0.6,)),
    ((0, 1, 1, 0, 1, 1), (-0.5, -0.4)),
    ((1, 1, 1, 1, 0, 0), (0.3, -0.4, 0.2)),
    ((2, 0, 1, 1, 1, 0), (0.4, -0.2, 0.3, -0.5)),
)
on_sales(
    "arima_criteria",
    f"{_FORECAST} Region",
    lambda df: forecasting.arima_criteria(df, ARIMA_MODELS, ["Region"]).select(
        "Region", "Orders", "Rows", F.round("Last_Shock", 2).alias("Last_Shock"), F.round("AICc", 5).alias("AICc")
    ),
)

# --- models -------------------------------------------------------------------------------

_RFM_COLUMNS = ("Order_ID", "Customer_ID", "Customer_Name", "Sales", "Order_Date")
_DEMAND_COLUMNS = ("Quantity", "Category", "Price", "Region", "Month")

register(
    "segments",
    lambda s, d: segmentation.segment_customers(
        tpch.flat_sales(Tables(s, d), _RFM_COLUMNS)
    ).data,
)
register(
    "segment_profile",
    lambda s, d: segmentation.segment_customers(
        tpch.flat_sales(Tables(s, d), _RFM_COLUMNS)
    ).centroids,
)


register(
    "segment_facts",
    lambda s, d: segmentation.segment_facts(
        segmentation.segment_customers(tpch.flat_sales(Tables(s, d), _RFM_COLUMNS))
    ).withColumns({c: F.round(c, 0) for c in ("Monetary", "Frequency", "Recency")}),
)

# Rounds of center moves from given centers, which SQL repeats.
LLOYD_STARTS = (
    ((0.2, 0.2, 0.2), (0.5, 0.5, 0.5), (0.8, 0.8, 0.8)),
    ((0.0, 1.0, 1.0), (1.0, 0.0, 0.0), (0.1, 0.3, 0.3)),
)
LLOYD_ROUNDS = 4


def _lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = customers_rfm(tpch.flat_sales(Tables(spark, sf_dir), _RFM_COLUMNS))
    points = durable(segmentation.weighted_points(segmentation.scale_rfm(durable(customers, "rfm"))), "points")
    centers = np.array(LLOYD_STARTS)
    for _ in range(LLOYD_ROUNDS):
        centers, _ = segmentation.move_centers(points, centers)
    rows = [(s, c, *map(float, centers[s, c])) for s in range(centers.shape[0]) for c in range(centers.shape[1])]
    frame = spark.createDataFrame(rows, "start int, center int, R_Norm double, F_Norm double, M_Norm double")
    return frame.withColumns({c: F.round(c, 7) for c in segmentation.SCALED})


register("lloyd_rounds", _lloyd)


def _demand(method: str, part: Callable[[demand.DemandModel, DataFrame], DataFrame]) -> Callable:
    return lambda df: part(demand.train_demand(df, method), df)


def _scenarios(df: DataFrame) -> DataFrame:
    return df.groupBy("Category", "Region", "Month").agg(F.max("Price").alias("Price"))


on_sales("demand_importance", " ".join(_DEMAND_COLUMNS), _demand("forest", lambda m, df: m.importance))
on_sales("demand_metrics", " ".join(_DEMAND_COLUMNS), _demand("forest", lambda m, df: m.metrics))
on_sales(
    "demand_importance_poisson",
    " ".join(_DEMAND_COLUMNS),
    _demand("poisson", lambda m, df: m.importance),
)
# the fitted totals of a log-linear model are the observed ones, level by level
on_stored_sales(
    "demand_totals",
    _demand("poisson", lambda m, df: _rounded(demand.fitted_totals(df, m))),
    _DEMAND_COLUMNS,
)
on_stored_sales(
    "demand_mean_metrics", _demand("mean", lambda m, df: _rounded(m.metrics, 6)), _DEMAND_COLUMNS
)
on_stored_sales(
    "demand_scores",
    _demand("poisson", lambda m, df: demand.score_demand(m, df, _scenarios(df))),
    _DEMAND_COLUMNS,
)

# --- changes ------------------------------------------------------------------------------


def _at():
    return F.lit(CHANGED_AT).cast("timestamp")


def on_history(name: str, op: Callable[[Tables, dict[str, DataFrame]], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(spark, sf_dir)
        return op(tables, tpch.history_star(tables))

    register(name, run)


def _all_customers(t: Tables) -> DataFrame:
    return tpch.star_tables(t)["customers"].withColumn("place", F.col("customer_id"))


def _all_names(t: Tables) -> DataFrame:
    """Part types and brands, one row per part and kind."""
    return t["part"].select(
        F.col("p_partkey").alias("place"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("p_type").alias("category_name")),
                F.struct(F.lit(1).alias("kind"), F.col("p_brand").alias("category_name")),
            )
        ),
    )


def _all_products(t: Tables) -> DataFrame:
    return t["part"].select(
        F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string")).alias("product_name"),
        F.col("p_brand").alias("category_name"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.col("p_size").alias("stock"),
        F.col("p_partkey").alias("place"),
    )


on_history(
    "apply_new_customers",
    lambda t, h: changes.add_customers(h, _all_customers(t), ("place",), _at()).tables["customers"],
)
on_history(
    "new_customer_rejects",
    lambda t, h: changes.add_customers(h, _all_customers(t), ("place",), _at()).rejects,
)
on_history(
    "apply_new_categories",
    lambda t, h: changes.add_categories(h, _all_names(t), ("place", "kind")).tables["categories"],
)
on_history(
    "new_category_rejects",
    lambda t, h: changes.add_categories(h, _all_names(t), ("place", "kind")).rejects,
)
on_history(
    "apply_new_products",
    lambda t, h: changes.add_products(h, _all_products(t), ("place",), _at()).tables["products"],
)


def _orders_applied(t: Tables, h: dict[str, DataFrame], store: bool = False) -> changes.Changed:
    return changes.apply_orders(h, tpch.order_calls(t), tpch.CALL_ORDER, _at(), store)


for _table, _label in (
    ("customers", "customers"),
    ("products", "products"),
    ("orders", "orders"),
    ("order_items", "items"),
):
    on_history(
        f"apply_orders_{_label}", lambda t, h, n=_table: _orders_applied(t, h, n == "order_items").tables[n]
    )
on_history(
    "stock_after_orders",
    lambda t, h: _orders_applied(t, h).tables["products"].select("product_name", "stock"),
)


def _orders_twice(t: Tables, h: dict[str, DataFrame]) -> changes.Changed:
    """The whole batch, and then the whole batch again over what the first time left."""
    calls, at = tpch.order_calls(t), _at()
    ledger = changes.empty_ledger(calls.sparkSession)
    once = changes.apply_orders_once(h, calls, tpch.CALL_ORDER, at, ledger).tables
    # items and ledger are read from stored tables alone
    once = {name: table if name in ("order_items", "order_ledger") else durable(table, name) for name, table in once.items()}
    return changes.apply_orders_once(once, calls, tpch.CALL_ORDER, at, once["order_ledger"])


on_history("apply_orders_twice", lambda t, h: _orders_twice(t, h).tables["order_items"])
on_history(
    "stock_after_orders_twice", lambda t, h: _orders_twice(t, h).tables["products"].select("product_name", "stock")
)


def _returns(t: Tables, h: dict[str, DataFrame]) -> changes.Changed:
    return changes.update_items(h, tpch.return_updates(t), tpch.UPDATE_ORDER)


on_history("apply_item_updates", lambda t, h: _returns(t, h).tables["order_items"])
on_history("rejects", lambda t, h: _returns(t, h).rejects)


def _star_updates(t: Tables) -> changes.Changed:
    return changes.update_items(tpch.star_tables(t), tpch.updates_with_unknown(t), tpch.UPDATE_ORDER)


register("apply_item_updates_star", lambda s, d: _star_updates(Tables(s, d)).tables["order_items"])
register("item_update_rejects_star", lambda s, d: _star_updates(Tables(s, d)).rejects)


def _deleted(t: Tables) -> changes.Changed:
    finished = t["orders"].filter(F.col("o_orderstatus") == "F")
    codes = finished.select(F.col("o_orderkey").cast("string").alias("order_code"))
    return changes.delete_orders(tpch.star_tables(t), codes, _at())


register("apply_deletes", lambda s, d: _deleted(Tables(s, d)).tables["orders"])
register("apply_deletes_items", lambda s, d: _deleted(Tables(s, d)).tables["order_items"])
register("deleted_orders_log", lambda s, d: _deleted(Tables(s, d)).added["deleted_orders_log"])
