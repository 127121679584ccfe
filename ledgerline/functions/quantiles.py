"""Exact quantiles of money columns and the t quantile for forecast bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Each pass settles four decimal digits of the wanted values.
_STEP = 10_000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.75)
) -> dict[str, dict[float, float]]:
    """Exact interpolated quantiles (rank ``(n - 1) * p``) of decimal columns.

    Values are counted by their leading digits, then the buckets that hold the wanted ranks
    are counted by their next four digits, and so on: three passes for DECIMAL(12,2). A pass
    shuffles and collects bucket counts only, at most 20,000 per column in the first pass
    and 10,000 per wanted rank later, however many rows or distinct values there are.
    Pass a stored table: every pass scans it.
    """
    types = {c: df.schema[c].dataType for c in columns}
    for name, kind in types.items():
        if not isinstance(kind, T.DecimalType):
            raise TypeError(f"{name} must be a decimal column, not {kind.simpleString()}")
    digits = max(t.precision for t in types.values())
    width = _STEP ** (math.ceil(digits / 4) - 1)

    def unscaled(name: str) -> Column:
        return (F.col(name) * F.lit(10 ** types[name].scale)).cast("long")

    values = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("series"), unscaled(c).alias("v")) for c in columns])
        )
    ).filter("v IS NOT NULL")

    def histogram(rows: DataFrame, width: int) -> dict[str, list[tuple[int, int]]]:
        # whole-number floor division, exact beyond 2**53 and for negative amounts
        bucket = F.expr(f"(v - pmod(v, {width}L)) div {width}L")
        counted = rows.groupBy("series", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        out: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
        for row in counted.collect():
            out[row["series"]].append((row["bucket"], row["n"]))
        return {c: sorted(pairs) for c, pairs in out.items()}

    def find(pairs: list[tuple[int, int]], rank: int) -> tuple[int, int]:
        for bucket, n in pairs:
            if rank < n:
                return bucket, rank
            rank -= n
        raise ValueError("rank beyond the data")

    first = histogram(values, width)
    size = {c: sum(n for _, n in first[c]) for c in columns}
    # (column, rank in the whole column) -> (bucket, rank inside the bucket)
    place: dict[tuple[str, int], tuple[int, int]] = {}
    for c in columns:
        for p in probs:
            h = (size[c] - 1) * p
            for rank in {math.floor(h), math.ceil(h)} if size[c] else ():
                place[(c, rank)] = find(first[c], rank)

    while width > 1:
        wanted = {(c, bucket) for (c, _), (bucket, _) in place.items()}
        inside = F.lit(False)
        for c, bucket in sorted(wanted):
            inside = inside | (
                (F.col("series") == c) & F.col("v").between(bucket * width, (bucket + 1) * width - 1)
            )
        narrower = width // _STEP
        counts = histogram(values.filter(inside), narrower)
        for (c, rank), (bucket, local) in list(place.items()):
            span = (bucket * _STEP, (bucket + 1) * _STEP)
            within = [(b, n) for b, n in counts[c] if span[0] <= b < span[1]]
            place[(c, rank)] = find(within, local)
        width = narrower

    result: dict[str, dict[float, float]] = {}
    for c in columns:
        scale = 10 ** types[c].scale
        result[c] = {}
        for p in probs:
            if not size[c]:
                result[c][p] = math.nan
                continue
            h = (size[c] - 1) * p
            low, high = (place[(c, r)][0] / scale for r in (math.floor(h), math.ceil(h)))
            share = h - math.floor(h)
            result[c][p] = (1 - share) * low + share * high
    return result


def _t_cdf(t: float, df: int) -> float:
    """Student's t distribution function for whole degrees of freedom (finite series)."""
    theta = math.atan(t / math.sqrt(df))
    cos2 = math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, df - 1, 2):
            total += term
            term *= cos2 * (k + 1) / (k + 2)
        central = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        term, total = 1.0, 0.0
        for k in range(0, df - 1, 2):
            total += term
            term *= cos2 * (k + 1) / (k + 2)
        central = math.sin(theta) * total
    return 0.5 + central / 2


def t_quantile_90(df: int) -> float:
    """The 0.90 quantile of Student's t, by bisection."""
    low, high = 1.0, 4.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < 0.9 else (low, mid)
    return (low + high) / 2


# Normal 0.90 quantile; fixed value.
Z_90 = 1.2815515655446004
T_TABLE_SIZE = 100


def t_table() -> list[float]:
    """0.90 quantiles for 1..T_TABLE_SIZE degrees of freedom."""
    return [t_quantile_90(df) for df in range(1, T_TABLE_SIZE + 1)]


def t_quantile_90_col(df: Column) -> Column:
    """0.90 quantile as a column: the table, then the normal expansion in 1/df beyond it."""
    table = F.array(*[F.lit(q) for q in t_table()])
    z, n = Z_90, df.cast("double")
    far = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / n
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (n * n)
        + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (n * n * n)
    )
    return F.when((df >= 1) & (df <= T_TABLE_SIZE), F.try_element_at(table, df.cast("int"))).when(
        df > T_TABLE_SIZE, far
    )
