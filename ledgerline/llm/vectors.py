"""Embedding columns as checked arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, usable): the rows with an id; v as doubles or null. Built-in expressions only.

    A vector is usable when it is not null or empty, has only finite components and is not zero.
    """
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return (
        df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL")
        .withColumn("usable", F.coalesce((F.size("v") > 0) & ~bad & some, F.lit(False)))
    )


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; scaled first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.sum(x * x, axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in an order of additions that does not depend on the other rows."""
    return np.clip(np.sum(a * b, axis=1), -1.0, 1.0)
