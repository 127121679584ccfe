from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import numpy as np
import pytest
from fixtures import record, sales

from ledgerline.functions import seasonal_arima as sa
from ledgerline.functions.quantiles import t_quantile_90
from ledgerline.operators import forecasting


def months(spark, values, start=(2020, 1), skip=(), day=15, **extra):
    data, year, month, done = [], *start, 0
    while done < len(values):
        if (year, month) not in skip:
            data.append(
                record(Order_ID=f"{extra}{done}", Order_Date=dt.date(year, month, day), Sales=D(str(values[done])), **extra)
            )
            done += 1
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return data


def least_squares(design, y, at):
    """Fit, half width of the 80 % prediction interval by dense least squares."""
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    rank = np.linalg.matrix_rank(design)
    df = len(y) - rank
    variance = np.sum((y - design @ beta) ** 2) / df
    leverage = at @ np.linalg.pinv(design.T @ design) @ at
    return at @ beta, t_quantile_90(df) * np.sqrt(variance * (1 + leverage))


def test_models_match_dense_least_squares(spark):
    rng = np.random.default_rng(3)
    y = np.round(1000 + 20 * np.arange(30) + 150 * np.sin(np.arange(30)) + rng.normal(0, 40, 30), 2)
    df = sales(spark, *months(spark, y))
    got = forecasting.forecast(df, 8).collect()
    t = np.arange(1, 31)
    month = (np.arange(30) % 12) + 1
    line = np.column_stack([np.ones(30), t])
    season = np.column_stack([line, *[(month == m).astype(float) for m in range(2, 13)]])
    for step, row in enumerate(got, start=1):
        future = 30 + step
        fit, half = least_squares(line, y, np.array([1.0, future]))
        assert row["Sales_LR"] == pytest.approx(fit, rel=1e-9)
        assert row["LR_Lower80"] == pytest.approx(max(fit - half, 0), rel=1e-8)
        assert row["LR_Upper80"] == pytest.approx(fit + half, rel=1e-8)
        label = row["Month"]
        at = np.array([1.0, future, *[float(label == m) for m in range(2, 13)]])
        fit, half = least_squares(season, y, at)
        assert row["Sales_ARIMA"] == pytest.approx(fit, rel=1e-9)
        assert row["ARIMA_Upper80"] == pytest.approx(fit + half, rel=1e-8)
    assert [r["Month_Index"] for r in got] == list(range(31, 39))
    # the last sale is 2022-06-15, so the first label is 30 days later
    assert [(r["Year"], r["Month"], r["Month_Name"]) for r in got][:2] == [(2022, 7, "Jul"), (2022, 8, "Aug")]


def test_flat_fallback(spark):
    df = sales(spark, *months(spark, [10, 20, 30]))
    got = forecasting.forecast(df, 2).collect()
    assert [tuple(r[4:10]) for r in got] == [(20.0, 20.0, 16.0, 24.0, 16.0, 24.0)] * 2
    assert {r["method"] for r in got} == {"Flat Average Fallback"}
    assert [r["Month_Index"] for r in got] == [4, 5]


def test_unseen_month_falls_back_to_the_line(spark):
    df = sales(spark, *months(spark, [5, 9, 4, 8, 12, 7, 11, 10]))  # January to August
    for row in forecasting.forecast(df, 6).collect():
        assert row["Sales_ARIMA"] == row["Sales_LR"] and row["ARIMA_Lower80"] == row["LR_Lower80"]


def test_no_repeated_month_has_no_band(spark):
    values = [5, 9, 4, 8, 12, 7, 11, 10, 6, 13, 15, 14]
    df = sales(spark, *months(spark, values))  # one full year
    first = forecasting.forecast(df, 3).collect()[0]
    assert first["Month"] == 1 and first["ARIMA_Lower80"] is None
    slope = (values[11] - values[0]) / 11
    assert first["Sales_ARIMA"] == pytest.approx(values[0] + slope * (13 - 1))


def test_missing_months_take_no_row_number(spark):
    y = [3, 5, 4, 6, 8, 7, 9, 10]
    df = sales(spark, *months(spark, y, skip={(2020, 3), (2020, 5)}))
    got = forecasting.forecast(df, 1).first()
    fit, _ = least_squares(np.column_stack([np.ones(8), np.arange(1, 9)]), np.array(y, float), np.array([1.0, 9.0]))
    assert got["Sales_LR"] == pytest.approx(fit) and got["Month_Index"] == 9


def test_forecasts_are_not_negative(spark):
    df = sales(spark, *months(spark, [100, 80, 60, 40, 20, 10, 1]))
    for row in forecasting.forecast(df, 6).collect():
        assert all(row[c] is None or row[c] >= 0 for c in row.asDict() if c.startswith(("Sales", "LR", "ARIMA")))


def test_short_months_spill_over(spark):
    df = sales(spark, *months(spark, [1, 2, 3, 4, 5, 6], start=(2022, 7), day=31 - 1))  # ends 2022-12-30
    labels = [(r["Year"], r["Month"]) for r in forecasting.forecast(df, 3).collect()]
    # starts 2023-01-29; one month later there is no 29 February
    assert labels == [(2023, 1), (2023, 3), (2023, 3)]


def test_groups_are_independent(spark):
    east = months(spark, [5, 9, 4, 8, 12, 7, 11, 10, 6], Region="East")
    west = months(spark, [50, 90], Region="West")
    unknown = months(spark, [1, 2, 3, 4, 5, 6, 7], Region=None)
    every = forecasting.forecast(sales(spark, *east, *west, *unknown), 4, ["Region"]).collect()
    assert len(every) == 12
    alone = forecasting.forecast(sales(spark, *east), 4).collect()
    mine = [r for r in every if r["Region"] == "East"]
    assert [r["Sales_LR"] for r in mine] == pytest.approx([r["Sales_LR"] for r in alone])
    assert {r["method"] for r in every if r["Region"] == "West"} == {"Flat Average Fallback"}


def test_arima_table(spark):
    rng = np.random.default_rng(0)
    y = 500 + np.cumsum(rng.normal(0, 5, 40))
    df = sales(spark, *months(spark, np.round(y, 2), Region="East"), *months(spark, [1, 2], Region="West"))
    got = forecasting.arima(df, 5, ["Region"]).collect()
    assert len(got) == 10
    for row in got:
        assert 0 <= row["ARIMA_Lower80"] <= row["Sales_ARIMA"] <= row["ARIMA_Upper80"]
        assert (row["Orders"] is None) == (row["Region"] == "West")
    east = [r for r in got if r["Region"] == "East"]
    assert {r["method"] for r in east} == {"Linear Regression & auto.arima"}
    assert ",1," in east[0]["Orders"].split(")")[0]
    widths = [r["ARIMA_Upper80"] - r["ARIMA_Lower80"] for r in east]
    assert widths == sorted(widths)
    assert forecasting.arima(df.filter("Region = 'East'"), 5).count() == 5


def test_a_failing_series_keeps_the_seasonal_regression(spark, monkeypatch):
    df = sales(spark, *months(spark, [5, 9, 4, 8, 12, 7, 11, 10, 6, 13, 15, 14, 9, 8]))
    usual = forecasting.forecast(df, 3).collect()
    monkeypatch.setattr(sa, "NEAREST_ROOT", np.inf)  # no model with coefficients passes
    monkeypatch.setattr(sa, "corrected_aic", lambda *_: np.inf)
    with pytest.raises(ValueError):
        sa.search(np.array([5.0, 9, 4, 8, 12, 7, 11]))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sa)
    try:
        got = forecasting.arima(df, 3).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sa)
    assert [tuple(r)[:11] for r in got] == [tuple(r) for r in usual]


def simulated(n, seed, phi=0.0, theta=0.0, sphi=0.0, stheta=0.0, d=0, level=0.0):
    shocks = np.random.default_rng(seed).normal(size=n + 100)
    ar, ma = sa.polynomials(sa.Orders(1, 0, 1, 1, 0, 1, False), np.array([phi, theta, sphi, stheta]))
    z = np.zeros(n + 100)
    for t in range(30, n + 100):
        z[t] = sum(ma[j] * shocks[t - j] for j in range(len(ma))) - sum(ar[j] * z[t - j] for j in range(1, len(ar)))
    z = z[100:] + level
    return np.cumsum(z) if d else z


def test_search_recovers_known_processes():
    y = simulated(400, 5, phi=0.6, level=100)
    found, true = sa.search(y), sa.fit(y, sa.Orders(1, 0, 0, 0, 0, 0, True))
    assert found.orders.d == 0 and found.aicc <= true.aicc
    assert true.coefficients[0] == pytest.approx(0.6, abs=0.1) and true.coefficients[1] == pytest.approx(100, abs=0.6)
    bands = sa.forecast(y, found, 30, 1.2816)
    assert bands[-1, 0] == pytest.approx(100, abs=1.5)
    assert np.all(np.diff(bands[:, 2] - bands[:, 1]) >= -1e-9)
    y = simulated(400, 6, theta=-0.6, stheta=0.5, d=1)
    found, true = sa.search(y), sa.fit(y, sa.Orders(0, 1, 1, 0, 0, 1, False))
    assert found.orders.d == 1 and found.aicc <= true.aicc
    assert true.coefficients == pytest.approx([-0.6, 0.5], abs=0.12)
    season = np.tile([0, 3, 9, 4, 1, -7, -9, 2, 6, 5, -3, 8], 12) + np.random.default_rng(1).normal(size=144) * 0.5
    assert sa.differences(season) == (0, 1) and sa.differences(simulated(200, 2, theta=0.3)) == (0, 0)


def test_residuals_and_criterion_by_hand():
    y = np.random.default_rng(4).normal(size=40)
    orders = sa.Orders(1, 0, 1, 0, 0, 1, False)
    shocks = []
    for t in range(40):
        past = lambda k: shocks[t - k] if t >= k else 0.0
        ar = y[t] - (0.4 * y[t - 1] if t else 0.0)
        shocks.append(ar - 0.3 * past(1) - 0.5 * past(12) - 0.15 * past(13))
    assert sa.residuals(y, orders, np.array([0.4, 0.3, 0.5])) == pytest.approx(shocks)
    sse = float(np.sum(np.square(shocks)))
    like = -20 * (np.log(2 * np.pi * sse / 40) + 1)
    assert sa.corrected_aic(sse, 40, 3) == pytest.approx(-2 * like + 8 + 2 * 4 * 5 / 35)


def test_pure_autoregression_is_least_squares():
    y = simulated(200, 9, phi=0.5)
    fitted = sa.fit(y, sa.Orders(2, 0, 0, 0, 0, 0, False))
    padded = np.concatenate([[0, 0], y])
    design = np.column_stack([padded[1:-1], padded[:-2]])
    assert fitted.coefficients == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0], abs=1e-5)


def test_forecast_of_a_seasonal_walk_repeats_the_year():
    y = np.tile(np.arange(12.0) ** 2, 3)
    fitted = sa.Fit(sa.Orders(0, 0, 0, 0, 1, 0, False), np.empty(0), 24.0, 24, 0.0)
    bands = sa.forecast(y, fitted, 14, 1.0)
    assert bands[:, 0] == pytest.approx(np.tile(np.arange(12.0) ** 2, 2)[:14])
    assert bands[:, 2] - bands[:, 0] == pytest.approx([1.0] * 12 + [2**0.5] * 2)


@pytest.mark.parametrize("values", [[3.0] * 9, list(range(1, 20)), [0.0, 0, 0, 0, 0, 7, 0]])
def test_degenerate_series_have_finite_bands(values):
    found = sa.search(np.array(values, dtype=float))
    assert np.isfinite(sa.forecast(np.array(values, dtype=float), found, 4, 1.28)).all()
