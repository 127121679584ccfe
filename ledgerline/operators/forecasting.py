"""Monthly sales forecasts in closed form, per group or overall.

Everything after the monthly totals is an aggregate over at most one row per month and
group, so one plan forecasts one series or a million.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.quantiles import t_quantile_90_col
from ledgerline.functions.semantics import asc, clamp_at_zero, nz_sum, only_row
from ledgerline.session import durable

MIN_MONTHS = 6
FLAT_SPREAD = 0.2
LABEL_OFFSET_DAYS = 30

# Method labels.
METHOD_FLAT = "Flat Average Fallback"
METHOD_SEASONAL = "Linear Regression & Seasonal Dummy Regression"

FORECAST_COLUMNS = (
    "Month_Index",
    "Month_Name",
    "Year",
    "Month",
    "Sales_LR",
    "Sales_ARIMA",
    "LR_Lower80",
    "LR_Upper80",
    "ARIMA_Lower80",
    "ARIMA_Upper80",
    "method",
)


def monthly_series(df: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Sales per month with sales, numbered 1..n in time order within the group.

    The number is a row number: a month without sales takes none. Without group columns the
    window has one partition with one row per month. The table is stored: the fits below
    read it several times, the sales once. Rows without a date have no month and stay out.
    """
    monthly = df.filter(F.col("Order_Date").isNotNull()).groupBy(*group_cols, "Year", "Month").agg(
        nz_sum("Sales").cast("double").alias("Sales"), F.max("Order_Date").alias("last_date")
    )
    in_time = W.partitionBy(*group_cols).orderBy(*asc("Year", "Month"))
    numbered = monthly.withColumn("t", F.row_number().over(in_time).cast("double"))
    return durable(numbered, "months")


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on the keys in which a NULL group matches itself."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def linear_fit(series: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group: size, last date, mean, and the line Sales ~ t with its sums."""
    return series.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.max("last_date").alias("last_date"),
        F.avg("Sales").alias("mean_sales"),
        F.avg("t").alias("mean_t"),
        F.regr_sxx("Sales", "t").alias("sxx"),
        F.regr_sxy("Sales", "t").alias("sxy"),
        F.regr_syy("Sales", "t").alias("syy"),
    )


def seasonal_fit(series: DataFrame, group_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Sales ~ t + month: per-month means, and per group the slope and its sums.

    Centering within each month removes the month terms, so the slope is a ratio of summed
    within-month products. When no month repeats, the slope runs from the first to the last
    month number, and nothing is left over for a band.
    """
    months = series.groupBy(*group_cols, "Month").agg(
        F.count(F.lit(1)).cast("double").alias("month_n"),
        F.avg("t").alias("month_t"),
        F.avg("Sales").alias("month_sales"),
        F.regr_sxx("Sales", "t").alias("m_sxx"),
        F.regr_sxy("Sales", "t").alias("m_sxy"),
        F.regr_syy("Sales", "t").alias("m_syy"),
    )
    zero = F.lit(0.0)
    totals = months.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("double").alias("n_months"),
        F.sum(F.coalesce("m_sxx", zero)).alias("w_sxx"),
        F.sum(F.coalesce("m_sxy", zero)).alias("w_sxy"),
        F.sum(F.coalesce("m_syy", zero)).alias("w_syy"),
        F.try_divide(
            F.max_by("month_sales", "Month") - F.min_by("month_sales", "Month"),
            F.max_by("month_t", "Month") - F.min_by("month_t", "Month"),
        ).alias("end_slope"),
    )
    slope = F.when(F.col("w_sxx") > 0, F.col("w_sxy") / F.col("w_sxx")).otherwise(F.col("end_slope"))
    return (
        months.select(*group_cols, "Month", "month_n", "month_t", "month_sales"),
        totals.withColumn("w_slope", slope),
    )


def _horizon(fits: DataFrame, periods: int) -> DataFrame:
    """One row per group and future month.

    Values belong to row numbers n+1, n+2, ...; labels count calendar months from 30 days
    after the last sale, a day of month that a short month lacks spilling into the next.
    """
    start = F.date_add("last_date", LABEL_OFFSET_DAYS)
    month_start = F.add_months(F.trunc(start, "month"), F.col("step") - 1)
    label = F.date_add(month_start, F.day(start) - 1)
    return (
        fits.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .withColumn("future_t", F.col("n") + F.col("step"))
        .withColumn("label", label)
        .withColumn("Month_Index", F.col("future_t").cast("long"))
        .withColumn("Month_Name", F.date_format("label", "MMM"))
        .withColumn("Year", F.year("label"))
        .withColumn("Month", F.month("label"))
    )


def _band(fit: Column, df: Column, sse: Column, leverage: Column, sign: int) -> Column:
    """fit plus or minus the half width of an 80 % prediction interval; NULL without spare rows."""
    residual = F.when(df > 0, F.greatest(sse, F.lit(0.0)) / df)
    half = t_quantile_90_col(df) * F.sqrt(residual * (F.lit(1.0) + leverage))
    return fit + F.lit(float(sign)) * half


def forecast(df: DataFrame, periods: int = 6, group_cols: Sequence[str] = ()) -> DataFrame:
    """Forecast table of the sales, see ``forecast_months``."""
    return forecast_months(monthly_series(df, group_cols), periods, group_cols)


def forecast_months(
    series: DataFrame, periods: int = 6, group_cols: Sequence[str] = ()
) -> DataFrame:
    """The forecast table: linear trend and seasonal regression with 80 % bands.

    ``Sales_ARIMA`` holds the seasonal regression; ``arima`` replaces it by a searched model. Groups with fewer than six
    months get their mean plus or minus 20 %. If a future month never occurred in a group,
    the group's seasonal columns repeat the linear trend.
    """
    group_cols = list(group_cols)
    fits = linear_fit(series, group_cols)
    months, totals = seasonal_fit(series, group_cols)
    if group_cols:
        fits = _join_groups(fits, totals, group_cols, "inner")
        rows = _join_groups(_horizon(fits, periods), months, [*group_cols, "Month"], "left")
    else:
        fits = fits.withColumn("season", only_row(totals)).select("*", "season.*").drop("season")
        # at most twelve rows of month means
        rows = _horizon(fits, periods).join(F.broadcast(months), "Month", "left")

    t, n = F.col("future_t"), F.col("n")
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    line = F.col("mean_sales") + slope * (t - F.col("mean_t"))
    line_sse = F.col("syy") - slope * F.col("sxy")
    line_leverage = F.lit(1.0) / n + F.pow(t - F.col("mean_t"), 2) / F.col("sxx")
    line_df = n - 2

    season = F.col("month_sales") + F.col("w_slope") * (t - F.col("month_t"))
    season_sse = F.col("w_syy") - F.try_divide(F.pow("w_sxy", 2), F.col("w_sxx"))
    season_leverage = F.lit(1.0) / F.col("month_n") + F.try_divide(
        F.pow(t - F.col("month_t"), 2), F.col("w_sxx")
    )
    season_df = n - F.col("n_months") - 1

    flat = n < MIN_MONTHS
    horizon = W.partitionBy(*group_cols) if group_cols else W.partitionBy()
    # at most `periods` rows per group
    unseen = F.max(F.col("month_n").isNull()).over(horizon)
    mean = F.col("mean_sales")

    def choose(flat_value: Column, line_value: Column, season_value: Column | None) -> Column:
        line_value = clamp_at_zero(line_value)
        other = line_value
        if season_value is not None:
            other = F.when(F.col("unseen"), line_value).otherwise(clamp_at_zero(season_value))
        return F.when(flat, flat_value).otherwise(other)

    low, high = mean * (1 - FLAT_SPREAD), mean * (1 + FLAT_SPREAD)
    line_low, line_high = (_band(line, line_df, line_sse, line_leverage, s) for s in (-1, 1))
    season_low, season_high = (
        _band(season, season_df, season_sse, season_leverage, s) for s in (-1, 1)
    )
    return (
        rows.withColumn("unseen", unseen)
        .select(
            *group_cols,
            "Month_Index",
            "Month_Name",
            "Year",
            "Month",
            choose(mean, line, None).alias("Sales_LR"),
            choose(mean, line, season).alias("Sales_ARIMA"),
            choose(low, line_low, None).alias("LR_Lower80"),
            choose(high, line_high, None).alias("LR_Upper80"),
            choose(low, line_low, season_low).alias("ARIMA_Lower80"),
            choose(high, line_high, season_high).alias("ARIMA_Upper80"),
            F.when(flat, F.lit(METHOD_FLAT)).otherwise(F.lit(METHOD_SEASONAL)).alias("method"),
        )
        .orderBy(*asc(*group_cols, "Month_Index"))
    )


# Fixed value: method label.
METHOD_ARIMA = "Linear Regression & auto.arima"


def _per_series(series: DataFrame, group_cols: list[str], apply: Callable, columns: str) -> DataFrame:
    """Call ``apply(group's months in order)`` for every series; one task a series, one row a month."""
    import pandas as pd

    keyed = series if group_cols else series.withColumn("__all", F.lit(1))
    keys = group_cols or ["__all"]
    key_types = ", ".join(f"`{k}` {keyed.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        out = apply(pdf)
        for place, k in enumerate(keys):
            out.insert(place, k, pdf[k].iloc[0])
        return out

    found = keyed.groupBy(*keys).applyInPandas(run, f"{key_types}, {columns}")
    return found if group_cols else found.drop("__all")


def arima(df: DataFrame, periods: int = 6, group_cols: Sequence[str] = ()) -> DataFrame:
    """The forecast table with a searched seasonal ARIMA in the ``ARIMA`` columns, and what was found.

    The sales are aggregated first, so a series has one row per month; its orders, coefficients
    (plain AR, plain MA, seasonal AR, seasonal MA, constant) and corrected AIC come along. A series for
    which no order can be fitted keeps the seasonal regression and its label, one of fewer than six
    months the flat forecast; both have no orders.
    """
    import numpy as np
    import pandas as pd

    from ledgerline.functions import seasonal_arima
    from ledgerline.functions.quantiles import Z_90

    group_cols = list(group_cols)
    series = monthly_series(df, group_cols)
    table = forecast_months(series, periods, group_cols)
    columns = ["Month_Index", "mean", "low", "high", "Orders", "Coefficients", "AICc"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["Sales"].to_numpy(dtype=float)
        if len(values) < MIN_MONTHS:
            return pd.DataFrame(columns=columns)
        try:
            found = seasonal_arima.search(values)
            bands = seasonal_arima.forecast(values, found, periods, Z_90)
        except (ValueError, np.linalg.LinAlgError):
            return pd.DataFrame(columns=columns)
        if not np.isfinite(bands).all():
            return pd.DataFrame(columns=columns)
        out = pd.DataFrame(bands, columns=["mean", "low", "high"])
        out.insert(0, "Month_Index", [len(values) + step for step in range(1, periods + 1)])
        out["Orders"] = found.orders.label()
        out["Coefficients"] = [found.coefficients.tolist()] * periods
        out["AICc"] = found.aicc if np.isfinite(found.aicc) else None
        return out

    fitted = _per_series(
        series, group_cols, fit,
        "Month_Index long, mean double, low double, high double, Orders string, Coefficients array<double>, AICc double",
    )
    none = F.col("mean").isNull()

    def pick(old: str, new: str) -> Column:
        return F.when(none, F.col(old)).otherwise(clamp_at_zero(new)).alias(old)

    return (
        _join_groups(table, fitted, [*group_cols, "Month_Index"], "left")
        .select(
            *group_cols,
            "Month_Index",
            "Month_Name",
            "Year",
            "Month",
            "Sales_LR",
            pick("Sales_ARIMA", "mean"),
            "LR_Lower80",
            "LR_Upper80",
            pick("ARIMA_Lower80", "low"),
            pick("ARIMA_Upper80", "high"),
            F.when(none, F.col("method")).otherwise(F.lit(METHOD_ARIMA)).alias("method"),
            "Orders",
            "Coefficients",
            "AICc",
        )
        .orderBy(*asc(*group_cols, "Month_Index"))
    )


def arima_criteria(
    df: DataFrame, models: Sequence[tuple[tuple, Sequence[float]]], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Residuals of given models, not searched ones: rows, sum of squares, last shock and corrected AIC of each.

    ``models`` holds (p, d, q, seasonal p, d, q) with its coefficients, in the order that ``arima``
    returns them, without a constant. A series shorter than the differences gets no row.
    """
    import pandas as pd

    from ledgerline.functions import seasonal_arima

    group_cols = list(group_cols)
    models = [(seasonal_arima.Orders(*orders, False), list(values)) for orders, values in models]
    columns = ["Orders", "Rows", "SSE", "Last_Shock", "AICc"]

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        values, out = pdf["Sales"].to_numpy(dtype=float), []
        for orders, given in models:
            if len(values) <= orders.d + orders.sd * seasonal_arima.SEASON:
                continue
            work = seasonal_arima.differenced(values, orders.d, orders.sd)
            shocks = seasonal_arima.residuals(work, orders, seasonal_arima.np.array(given))
            sse = float(shocks @ shocks)
            aicc = seasonal_arima.corrected_aic(sse, len(work), orders.size)
            out.append((orders.label(), len(work), sse, float(shocks[-1]), aicc))
        return pd.DataFrame(out, columns=columns)

    series = monthly_series(df, group_cols)
    return _per_series(series, group_cols, judge, "Orders string, Rows long, SSE double, Last_Shock double, AICc double")
