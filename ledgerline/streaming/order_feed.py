"""Order calls arriving as files, applied to a stored star in micro-batches.

The feed is a convenience around the batch job ``apply_orders``; the star on disk holds
dimensions per version and facts per batch::

    <path>/v<n>/customers ...      regions, categories, customers, products of version n
    <path>/orders/batch=<n>        orders and items added by version n

Batch b reads version b and writes version b + 1. A replayed batch reads the same version
and overwrites the same folders, so a restart neither loses nor repeats an order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.changes import apply_orders

DIMENSIONS = ("regions", "categories", "customers", "products")
FACTS = ("orders", "order_items")


def start_star(star: dict[str, DataFrame], path: str) -> None:
    """Write version 0."""
    for name in DIMENSIONS:
        star[name].write.parquet(f"{path}/v0/{name}")
    for name in FACTS:
        star[name].write.parquet(f"{path}/{name}/batch=0")


def read_star(spark: SparkSession, path: str, version: int) -> dict[str, DataFrame]:
    """The star of one version: its dimensions and the facts added up to it."""
    star = {n: spark.read.parquet(f"{path}/v{version}/{n}") for n in DIMENSIONS}
    for name in FACTS:
        facts = spark.read.parquet(f"{path}/{name}")
        star[name] = facts.filter(F.col("batch") <= version).drop("batch")
    return star


def order_feed(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    seq: Sequence[str],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Apply all files waiting in ``source`` and stop; call again for later files."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        star = read_star(batch.sparkSession, path, batch_id)
        version = batch_id + 1
        changed = apply_orders(star, batch, seq, F.current_timestamp())
        for name in DIMENSIONS:
            changed.tables[name].write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
        for name in FACTS:
            changed.added[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={version}")
        changed.rejects.write.mode("overwrite").parquet(f"{path}/rejects/batch={version}")

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
