"""Seasonal ARIMA of one monthly series (numpy; called once per series inside tasks).

A model is fitted by the conditional sum of squares: residuals follow from the differenced series by
recursion, with nothing before its first row, so that all orders of the same differences are judged
on the same rows. Levenberg-Marquardt steps find the coefficients, tests choose the differences, and
a stepwise search the orders, by the corrected AIC.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SEASON = 12
# Limits of the search, 5 % point of the level-stationarity test, strength that asks for
# a seasonal difference, nearest that a root may come to the unit circle.
MAX_P, MAX_SEASONAL, MAX_D = 5, 2, 2
LEVEL_5_PERCENT, SEASONAL_STRENGTH, NEAREST_ROOT = 0.463, 0.64, 1.01


class Orders(NamedTuple):
    """Orders of the plain and, with the prefix s, of the seasonal part."""

    p: int
    d: int
    q: int
    sp: int
    sd: int
    sq: int
    constant: bool

    @property
    def size(self) -> int:
        return self.p + self.q + self.sp + self.sq + self.constant

    def label(self) -> str:
        text = f"ARIMA({self.p},{self.d},{self.q})"
        if self.sp or self.sd or self.sq:
            text += f"({self.sp},{self.sd},{self.sq})[{SEASON}]"
        return text + (" with mean" if not self.d + self.sd else " with drift") * self.constant


class Fit(NamedTuple):
    orders: Orders
    coefficients: np.ndarray  # plain AR, plain MA, seasonal AR, seasonal MA, constant
    sse: float
    rows: int
    aicc: float


def difference_polynomial(d: int, sd: int) -> np.ndarray:
    seasonal = np.zeros(SEASON + 1)
    seasonal[[0, -1]] = 1, -1
    out = np.ones(1)
    for factor in [np.array([1.0, -1.0])] * d + [seasonal] * sd:
        out = np.convolve(out, factor)
    return out


def differenced(values: np.ndarray, d: int, sd: int) -> np.ndarray:
    polynomial = difference_polynomial(d, sd)
    return np.convolve(values, polynomial)[len(polynomial) - 1 : len(values)]


def _factors(orders: Orders, coefficients: np.ndarray) -> list[np.ndarray]:
    """The four polynomials: plain and seasonal AR with minus signs, plain and seasonal MA with plus."""
    out, at = [], 0
    for size, step, sign in ((orders.p, 1, -1), (orders.q, 1, 1), (orders.sp, SEASON, -1), (orders.sq, SEASON, 1)):
        polynomial = np.zeros(size * step + 1)
        polynomial[0] = 1
        polynomial[step::step] = sign * coefficients[at : at + size]
        out.append(polynomial)
        at += size
    return out


def polynomials(orders: Orders, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ar, ma, sar, sma = _factors(orders, coefficients)
    return np.convolve(ar, sar), np.convolve(ma, sma)


def residuals(work: np.ndarray, orders: Orders, coefficients: np.ndarray) -> np.ndarray:
    """Shocks of a differenced series; values (less the constant) and shocks before it count as zero."""
    ar, ma = polynomials(orders, coefficients)
    level = coefficients[-1] if orders.constant else 0.0
    driven = np.convolve(work - level, ar)[: len(work)]
    back = ma[:0:-1]
    if not len(back):
        return driven
    shocks = np.zeros(len(work) + len(back))
    for t in range(len(work)):
        shocks[t + len(back)] = driven[t] - back @ shocks[t : t + len(back)]
    return shocks[len(back) :]


def corrected_aic(sse: float, rows: int, size: int) -> float:
    """Of a model with ``size`` coefficients and a variance, Gaussian shocks."""
    k = size + 1
    if rows - k - 1 <= 0 or not np.isfinite(sse):
        return np.inf
    variance = max(sse / rows, float(np.finfo(float).tiny))
    return float(rows * (np.log(2 * np.pi * variance) + 1) + 2 * k + 2 * k * (k + 1) / (rows - k - 1))


def _nearest_root(orders: Orders, coefficients: np.ndarray) -> float:
    least = np.inf
    for polynomial, step in zip(_factors(orders, coefficients), (1, 1, SEASON, SEASON)):
        polynomial = np.trim_zeros(polynomial[::step], "b")
        if len(polynomial) > 1:
            least = min(least, np.abs(np.roots(polynomial[::-1])).min() ** (1 / step))
    return least


def fit(values: np.ndarray, orders: Orders, steps: int = 60) -> Fit:
    """Least conditional squares; a start of zeros and the mean, damped Gauss-Newton steps within the unit circle."""
    raw = differenced(np.asarray(values, dtype=float), orders.d, orders.sd)
    scale = float(raw.std()) or 1.0
    work = raw / scale
    at = np.zeros(orders.size)
    if orders.constant:
        at[-1] = work.mean()
    shocks = residuals(work, orders, at)
    sse, damping = float(shocks @ shocks), 1e-3
    for _ in range(steps if orders.size else 0):
        slopes = np.column_stack([(residuals(work, orders, at + h) - shocks) / 1e-6 for h in np.eye(orders.size) * 1e-6])
        normal, gradient = slopes.T @ slopes, slopes.T @ shocks
        better = False
        while not better and damping < 1e8:
            step = np.linalg.lstsq(normal + np.diag(damping * np.diag(normal) + 1e-12), -gradient, rcond=None)[0]
            trial = at + step
            if _nearest_root(orders, trial) > 1:
                after = residuals(work, orders, trial)
                better = bool(after @ after < sse)
            damping = damping / 10 if better else damping * 10
        if not better:
            break
        gain, at, shocks = sse - float(after @ after), trial, after
        sse -= gain
        if gain <= 1e-10 * sse:
            break
    if orders.constant:
        at[-1] *= scale
    aicc = corrected_aic(sse * scale**2, len(work), orders.size)
    if orders.size and _nearest_root(orders, at) < NEAREST_ROOT:
        aicc = np.inf
    return Fit(orders, at, sse * scale**2, len(work), aicc)


def level_statistic(values: np.ndarray) -> float:
    """KPSS: squared partial sums of the centred series against its long-run variance (Bartlett weights)."""
    n = len(values)
    centred = values - values.mean()
    lags = int(3 * np.sqrt(n) / 13)
    variance = centred @ centred
    for lag in range(1, lags + 1):
        variance += 2 * (1 - lag / (lags + 1)) * (centred[lag:] @ centred[:-lag])
    sums = np.cumsum(centred)
    return float(sums @ sums / (n * variance)) if variance > 0 else 0.0


def seasonal_strength(values: np.ndarray) -> float:
    """Share of the detrended variance that monthly means explain, the trend a centred moving year."""
    if len(values) < 2 * SEASON + 1:
        return 0.0
    weights = np.full(SEASON + 1, 1 / SEASON)
    weights[[0, -1]] /= 2
    half = SEASON // 2
    detrended = values[half:-half] - np.convolve(values, weights, mode="valid")
    month = np.arange(len(detrended)) % SEASON
    means = np.bincount(month, detrended, SEASON) / np.maximum(np.bincount(month, minlength=SEASON), 1)
    spread = detrended.var()
    return float(max(0.0, 1 - (detrended - means[month]).var() / spread)) if spread > 0 else 0.0


def differences(values: np.ndarray) -> tuple[int, int]:
    """How often to difference plainly and over the season."""
    sd = int(seasonal_strength(values) > SEASONAL_STRENGTH)
    work, d = differenced(values, 0, sd), 0
    while d < MAX_D and len(work) > 4 and level_statistic(work) > LEVEL_5_PERCENT:
        work, d = np.diff(work), d + 1
    return d, sd


def search(values: np.ndarray) -> Fit:
    """The fit of least corrected AIC that single changes of the orders lead to; ValueError if there is none."""
    values = np.asarray(values, dtype=float)
    if np.ptp(values) == 0:
        return Fit(Orders(0, 0, 0, 0, 0, 0, True), values[:1].copy(), 0.0, len(values), -np.inf)
    d, sd = differences(values)
    most, most_seasonal = min(MAX_P, len(values) // 3), min(MAX_SEASONAL, len(values) // (3 * SEASON))
    may_shift = d + sd <= 1
    tried: dict[Orders, Fit] = {}

    def attempt(p: int, q: int, sp: int, sq: int, constant: bool) -> Fit | None:
        orders = Orders(p, d, q, sp, sd, sq, constant)
        inside = 0 <= p <= most and 0 <= q <= most and 0 <= sp <= most_seasonal and 0 <= sq <= most_seasonal
        if not inside or constant > may_shift or orders in tried:
            return None
        tried[orders] = fit(values, orders)
        return tried[orders]

    one = min(1, most_seasonal)
    for start in ((2, 2, one, one), (0, 0, 0, 0), (1, 0, one, 0), (0, 1, 0, one)):
        attempt(*(min(x, most) for x in start), may_shift)
    attempt(0, 0, 0, 0, False)
    best = min(tried.values(), key=lambda f: (f.aicc, f.orders))
    moves = [
        (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 1, 1), (1, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0),
    ]
    moved = True
    while moved:
        moved = False
        o = best.orders
        near = [tuple(sign * x for x in move) for move in moves for sign in (1, -1)]
        for step in [*near, None]:
            if step is None:
                found = attempt(o.p, o.q, o.sp, o.sq, not o.constant)
            else:
                found = attempt(o.p + step[0], o.q + step[1], o.sp + step[2], o.sq + step[3], o.constant)
            if found is not None and found.aicc < best.aicc:
                best, moved = found, True
                break
    if not np.isfinite(best.aicc):
        raise ValueError("no order has a finite criterion")
    return best


def forecast(values: np.ndarray, fitted: Fit, periods: int, z: float) -> np.ndarray:
    """Rows (mean, lower, upper) of the months to come; shocks after the last month are zero."""
    values, orders = np.asarray(values, dtype=float), fitted.orders
    ar, ma = polynomials(orders, fitted.coefficients)
    level = fitted.coefficients[-1] if orders.constant else 0.0
    work = differenced(values, orders.d, orders.sd)
    shocks = list(residuals(work, orders, fitted.coefficients))
    centred, history = list(work - level), list(values)
    back = difference_polynomial(orders.d, orders.sd)
    n = len(centred)
    for t in range(n, n + periods):
        driven = -sum(ar[j] * centred[t - j] for j in range(1, min(len(ar), t + 1)))
        centred.append(driven + sum(ma[j] * shocks[t - j] for j in range(t - n + 1, min(len(ma), t + 1))))
        history.append(centred[-1] + level - sum(back[j] * history[-j] for j in range(1, len(back))))
    mean = np.array(history[len(values) :])

    whole, weights = np.convolve(ar, back), np.zeros(periods)
    for j in range(periods):
        weights[j] = (ma[j] if j < len(ma) else 0.0) - sum(whole[i] * weights[j - i] for i in range(1, min(len(whole), j + 1)))
    variance = fitted.sse / max(fitted.rows - orders.size, 1)
    half = z * np.sqrt(variance * np.cumsum(weights**2))
    return np.column_stack([mean, mean - half, mean + half])
