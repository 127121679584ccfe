"""Typing, imputation with audit, deduplication, validity, derived columns, outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import text
from ledgerline.functions.quantiles import exact_quantiles
from ledgerline.functions.ranking import first_by, keep_first, number_rows
from ledgerline.functions.semantics import (
    asc,
    is_missing,
    min_max,
    month_name,
    n_distinct,
    only_row,
    ratio,
)
from ledgerline.sources.schemas import (
    DEFAULT_MARGINS,
    MIN_MARGIN_ROWS,
    MONEY,
    SALES_TYPES,
    UNKNOWN_MARGIN,
)

# Date layouts a lenient year-month-day reader takes.
DATE_LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd")

# Imputed texts and audit texts.
UNKNOWN_NAME = "Valued Partner"
UNKNOWN_CITY = "Corporate Headquarters"
ISSUE_PROFIT = "Missing Profit (NA value detected)"
ISSUE_NAME = "Missing Client Identity"
ISSUE_CITY = "Missing City Location"
ACTION_PROFIT = "Imputed profit (₹%s) using %d%% average margin for %s"
ACTION_NAME = "Mapped ID '%s' to database record '%s'"
ACTION_CITY = "Resolved geographic scope to '%s' from State context '%s'"
AUDIT_STATUS = "Resolved"
AUDIT_FIRST_ID = 1000

MARKS = ("no_profit", "no_name", "no_city", "margin")


# --- typing -------------------------------------------------------------------------------


def _typed(name: str, found: T.DataType, wanted: T.DataType) -> Column:
    value = F.col(name)
    if found == wanted:
        return value
    if isinstance(wanted, T.DateType) and isinstance(found, T.StringType):
        return F.coalesce(*[F.try_to_date(value, layout) for layout in DATE_LAYOUTS])
    if isinstance(wanted, T.LongType):
        # text like "3.7" is a number first and loses its fraction second
        return F.coalesce(value.try_cast("long"), value.try_cast("double").try_cast("long"))
    return value.try_cast(wanted)


def unreadable(df: DataFrame) -> DataFrame:
    """The rows of ``convert_types``'s input that hold a value it cannot read, with ``Unread``.

    ``Unread`` names the columns. Such a value becomes NULL and is imputed, or its row leaves with
    the invalid ones; this frame tells those rows from the ones that had no value to begin with.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    typed = [c for c, wanted in SALES_TYPES.items() if c in found and found[c] != wanted]
    if not typed:
        return df.withColumn("Unread", F.lit("")).limit(0)
    lost = [
        F.when(~is_missing(c) & _typed(c, found[c], SALES_TYPES[c]).isNull(), F.lit(c)) for c in typed
    ]
    return df.withColumn("Unread", F.concat_ws(",", *lost)).filter("Unread <> ''")


def convert_types(df: DataFrame) -> DataFrame:
    """Text columns to dates, whole numbers and money; what cannot be read becomes NULL.

    The pipeline types first, so that the validity filter compares numbers.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c: _typed(c, found[c], wanted) for c, wanted in SALES_TYPES.items() if c in found}
    )


# --- imputation ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lookups:
    """What imputation learns from the raw rows (before duplicates and bad rows leave)."""

    margins: DataFrame  # Category, margin: one row per configured category
    names: DataFrame  # Customer_ID, known_name
    cities: DataFrame  # State, usual_city


def learn_margins(df: DataFrame, defaults: Mapping[str, float] = DEFAULT_MARGINS) -> DataFrame:
    """Mean of the row margins per configured category, the default below six complete rows."""
    configured = df.sparkSession.createDataFrame(
        [(c, float(m)) for c, m in defaults.items()], "Category string, default_margin double"
    )
    complete = df.filter(
        F.col("Profit").isNotNull() & (F.col("Sales") > 0) & F.col("Category").isin(*defaults)
    )
    row_margin = F.col("Profit").cast("double") / F.col("Sales").cast("double")
    learned = complete.groupBy("Category").agg(
        F.avg(row_margin).alias("learned_margin"), F.count(F.lit(1)).alias("complete_rows")
    )
    return configured.join(learned, "Category", "left").select(
        "Category",
        F.when(F.col("complete_rows") > MIN_MARGIN_ROWS, F.col("learned_margin"))
        .otherwise(F.col("default_margin"))
        .alias("margin"),
    )


def learn_names(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """First name on record per customer."""
    return (
        df.filter(~is_missing("Customer_Name") & F.col("Customer_ID").isNotNull())
        .groupBy("Customer_ID")
        .agg(first_by(F.col("Customer_Name"), order).alias("known_name"))
    )


def learn_cities(df: DataFrame) -> DataFrame:
    """Most frequent city per state, the alphabetically first among equals.

    Cities are counted per (State, City) first, so a state that holds most rows reaches the
    second step as one row per city.
    """
    counted = (
        df.filter(~is_missing("City") & F.col("State").isNotNull())
        .groupBy("State", "City")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counted.groupBy("State").agg(
        F.min_by("City", F.struct(-F.col("rows"), F.col("City"))).alias("usual_city")
    )


def learn_lookups(
    df: DataFrame, order: Sequence[str], defaults: Mapping[str, float] = DEFAULT_MARGINS
) -> Lookups:
    return Lookups(learn_margins(df, defaults), learn_names(df, order), learn_cities(df))


def impute_profit(df: DataFrame, margins: DataFrame) -> DataFrame:
    """Missing profit = sales times the category's margin, to the cent.

    ``margins`` has one row per configured category, so it is small by construction.
    """
    missing = F.col("Profit").isNull()
    estimate = F.round(F.col("Sales").cast("double") * F.col("margin"), 2).cast(MONEY)
    return (
        df.join(F.broadcast(margins), "Category", "left")
        .withColumn("margin", F.coalesce("margin", F.lit(UNKNOWN_MARGIN)))
        .withColumn("no_profit", missing)
        .withColumn("Profit", F.when(missing, estimate).otherwise(F.col("Profit")))
        .select(*df.columns, "no_profit", "margin")
    )


def _fill(need: DataFrame, lookup: DataFrame, key: str, column: str, fallback: str) -> DataFrame:
    """Fill missing values of ``column`` from a lookup with one row per key."""
    found = lookup.columns[-1]
    resolved = F.when(is_missing(column), F.coalesce(found, F.lit(fallback))).otherwise(F.col(column))
    return (
        need.join(lookup, key, "left").withColumn(column, resolved).select(*need.columns)
    )


def _split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    return df.filter(condition), df.filter(~condition)


def impute_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Missing name = the customer's first name on record, else a fixed text.

    Only rows without a name are joined; complete rows pass without a shuffle.
    """
    marked = df.withColumn("no_name", is_missing("Customer_Name"))
    need, whole = _split(marked, F.col("no_name"))
    return whole.unionByName(_fill(need, names, "Customer_ID", "Customer_Name", UNKNOWN_NAME))


def impute_cities(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Missing city = the state's most frequent city, else a fixed text."""
    marked = df.withColumn("no_city", is_missing("City"))
    need, whole = _split(marked, F.col("no_city"))
    return whole.unionByName(_fill(need, cities, "State", "City", UNKNOWN_CITY))


def impute(df: DataFrame, lookups: Lookups) -> DataFrame:
    """All three imputations, keeping the MARKS columns for the audit."""
    marked = impute_profit(df, lookups.margins).withColumns(
        {"no_name": is_missing("Customer_Name"), "no_city": is_missing("City")}
    )
    need, whole = _split(marked, F.col("no_name") | F.col("no_city"))
    need = _fill(need, lookups.names, "Customer_ID", "Customer_Name", UNKNOWN_NAME)
    need = _fill(need, lookups.cities, "State", "City", UNKNOWN_CITY)
    return whole.unionByName(need)


def audit_entries(imputed: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per corrected value, in one pass over the corrected rows."""

    def entry(mark: str, rank: int, issue: str, action: Column) -> Column:
        return F.when(
            F.col(mark),
            F.struct(F.lit(rank).alias("rank"), F.lit(issue).alias("Issue"), action.alias("Action")),
        )

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("NA"))

    profit = F.format_string(
        ACTION_PROFIT,
        F.coalesce(text.seven_digits(F.col("Profit")), F.lit("NA")),
        F.bround(F.col("margin") * 100, 0).cast("int"),
        shown("Category"),
    )
    name = F.format_string(ACTION_NAME, shown("Customer_ID"), F.col("Customer_Name"))
    city = F.format_string(ACTION_CITY, F.col("City"), shown("State"))
    entries = F.array_compact(
        F.array(
            entry("no_profit", 1, ISSUE_PROFIT, profit),
            entry("no_name", 2, ISSUE_NAME, name),
            entry("no_city", 3, ISSUE_CITY, city),
        )
    )
    return imputed.filter("no_profit OR no_name OR no_city").select(
        "Order_ID", *[c for c in order if c != "Order_ID"], F.inline(entries)
    )


def audit_log(imputed: DataFrame, order: Sequence[str], at: Column) -> DataFrame:
    """The numbered audit log: profit entries, then names, then cities, each in row order."""
    entries = audit_entries(imputed, order)
    numbered = number_rows(entries, asc("rank", *order), "audit_number")
    return numbered.select(
        F.format_string("AUD-%04d", F.col("audit_number") + AUDIT_FIRST_ID).alias("Audit_ID"),
        F.col("Order_ID").cast("string").alias("Order_ID"),
        "Issue",
        "Action",
        F.date_format(at, "HH:mm:ss").alias("Time"),
        F.lit(AUDIT_STATUS).alias("Status"),
    )


# --- rows and derived columns -------------------------------------------------------------


def remove_duplicates(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("Order_ID",)
) -> DataFrame:
    """Keep the first row per key. With the default key an order keeps one of its lines;
    (Order_ID, Product) keeps one line per product."""
    return keep_first(df, keys, order)


def valid_rows(df: DataFrame) -> DataFrame:
    """Positive quantity, price and sales; rows with a NULL among them leave too."""
    return df.filter((F.col("Quantity") > 0) & (F.col("Price") > 0) & (F.col("Sales") > 0))


def add_derived(df: DataFrame) -> DataFrame:
    """Year, Month, Quarter, Month_Name and Profit_Margin (those whose inputs exist)."""
    added: dict[str, Column] = {}
    if "Order_Date" in df.columns:
        date = F.col("Order_Date")
        added["Year"] = F.year(date)
        added["Month"] = F.month(date)
        added["Quarter"] = F.concat(F.lit("Q"), F.quarter(date).cast("string"))
        added["Month_Name"] = month_name(F.month(date))
    if {"Sales", "Profit"} <= set(df.columns):
        # decimal division, so that an exact half rounds the same way everywhere
        exact = F.try_divide(F.col("Profit"), F.col("Sales"))
        added["Profit_Margin"] = F.when(
            F.col("Sales") > 0, F.round(exact, 4).cast("double")
        ).otherwise(F.lit(0.0))
    return df.withColumns(added)


def outlier_bounds(df: DataFrame, columns: Sequence[str] = ("Sales", "Profit")) -> dict[str, tuple[float, float]]:
    """Tukey fences per column from exact quartiles (bucket counts only leave the cluster)."""
    quartiles = exact_quantiles(df, columns)
    out = {}
    for c in columns:
        q1, q3 = quartiles[c][0.25], quartiles[c][0.75]
        out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def detect_outliers(df: DataFrame) -> DataFrame:
    """Flag rows outside the fences of Sales or Profit. Pass a stored table (four scans)."""
    flag = F.lit(False)
    for c, (low, high) in outlier_bounds(df).items():
        value = F.col(c).cast("double")
        flag = flag | (value < F.lit(low)) | (value > F.lit(high))
    return df.withColumn("Is_Outlier", flag)


def normalize(df: DataFrame, columns: Sequence[str] = ("Sales", "Profit", "Quantity")) -> DataFrame:
    """Min-max scaled copies ``<column>_Norm``; columns the frame lacks are skipped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    limits = df.agg(
        *[F.min(c).alias(f"low_{c}") for c in present],
        *[F.max(c).alias(f"high_{c}") for c in present],
    )
    return (
        df.withColumn("__limits", only_row(limits))
        .withColumns(
            {f"{c}_Norm": min_max(c, f"__limits.low_{c}", f"__limits.high_{c}") for c in present}
        )
        .drop("__limits")
    )


def pipeline_stats(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows in, duplicates and invalid rows removed, outliers and their share."""
    before = raw.agg(F.count(F.lit(1)).alias("Raw_Rows"), n_distinct("Order_ID").alias("__ids"))
    after = clean.agg(
        F.count(F.lit(1)).alias("Clean_Rows"), F.count_if("Is_Outlier").alias("Outliers")
    )
    return before.withColumn("__after", only_row(after)).select("*", "__after.*").select(
        "Raw_Rows",
        (F.col("Raw_Rows") - F.col("__ids")).alias("Duplicates_Removed"),
        (F.col("__ids") - F.col("Clean_Rows")).alias("Invalid_Removed"),
        "Clean_Rows",
        "Outliers",
        (ratio("Outliers", "Clean_Rows") * 100).alias("Outlier_Pct"),
    )
