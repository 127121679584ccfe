"""Column names that cannot clash with those of the caller's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
