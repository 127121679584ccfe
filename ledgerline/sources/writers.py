"""Report sinks and star-table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> str:
    """A directory of CSV part files with headers, written in parallel."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_parts(parts: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """One directory per report part."""
    out = {}
    for name, df in parts.items():
        out[name] = f"{path}/{name}"
        writer = df.write.mode("errorifexists")
        if fmt == "csv":
            writer.option("header", True).csv(out[name])
        else:
            writer.format(fmt).save(out[name])
    return out


def write_sales(df: DataFrame, path: str) -> str:
    """The clean table partitioned by Year and Month, so that date filters prune folders.

    The rebalance hint gathers a month into few files, and adaptive execution splits a month
    that is much larger than the others between writers.
    """
    df.hint("rebalance", "Year", "Month").write.mode("errorifexists").partitionBy(
        "Year", "Month"
    ).parquet(path)
    return path


def write_star(tables: dict[str, DataFrame], path: str) -> str:
    """A new version directory; readers switch to it once it is complete."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def read_star(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
