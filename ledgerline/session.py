"""Session defaults and stage tables that outlive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of an Arrow batch where whole texts go to Python, which holds several copies of a batch
TEXTS = 4 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DECODED = "spark.sql.parquet.columnarReaderBatchSize"
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: bytes of a table that are shuffled at a time, and the most parts for that
PART_BYTES, PARTS = 16 << 20, 8


def build_session(app_name: str = "ledgerline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC dates."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # hot customers, products or states: split the oversized join partitions even when
        # the split costs one more exchange afterwards
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """The shared folder for stage tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset the tables go beside the session's own tables, below
    ``spark.sql.warehouse.dir``. That default is a folder of the driver's machine, so on anything
    but a local session it must be an address that names its file system.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    master = spark.conf.get("spark.master", "local")
    own_machine = ":" not in warehouse.partition("/")[0] or warehouse.startswith("file:")
    if own_machine and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_stages"


def stage_folder(spark: SparkSession) -> str:
    """The folder that holds this application's stage tables and nothing else."""
    return f"{stage_root(spark)}/ledgerline/{spark.conf.get('spark.app.id')}"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Rows go to Python in batches of so many bytes, or of fewer if the session says so; a longer row goes alone."""
    before = spark.conf.get(BATCH, None)
    known = int(before.removesuffix("b")) if before and before.removesuffix("b").isdigit() else size
    spark.conf.set(BATCH, str(min(known, size) if known > 0 else size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


@contextmanager
def decoded_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """The parquet reader decodes so many rows at once, or fewer if the session says so; a task holds all their texts."""
    before = spark.conf.get(DECODED, None)
    spark.conf.set(DECODED, str(min(int(before), rows) if before else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DECODED)
        else:
            spark.conf.set(DECODED, before)


def durable(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Unlike a cached frame the table survives lost executors, and unlike a checkpoint it is
    columnar: later passes read only the columns they use, and Spark knows its size when it
    picks a join. All tables of one application share one folder; ``discard`` drops one table
    and ``drop_stages`` the rest. ``batch`` bounds the bytes of the batches that its Python
    functions get.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with batches_of(spark, batch) if batch else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame) -> int:
    """In how many parts a job over ``df`` should be done, so that its shuffle files stay small beside the stage tables."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = max((n for n in sizes if n < 1 << 60), default=0)  # Spark has no size of some
    return max(1, min(PARTS, -(-size // PART_BYTES)))


def part_of(key: str, part: int, parts: int) -> Column:
    """Whether a row is in this one of ``parts``, by a hash of ``key``."""
    return F.pmod(F.xxhash64(key), F.lit(parts)) == part


def durable_parts(frames: Iterable[DataFrame], label: str) -> DataFrame:
    """The frames' rows as one table like ``durable``'s, written frame by frame.

    Spark deletes the shuffle files of each frame when it is written, so that at most those of one frame lie
    on the disks beside the stage tables, and the table is packed closer.
    """
    path = ""
    for df in frames:
        spark = df.sparkSession
        path = path or f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
        before = spark.conf.get(TIDY, None)
        spark.conf.set(TIDY, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                spark.conf.unset(TIDY)
            else:
                spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def is_stage(df: DataFrame) -> bool:
    """Whether ``df`` is a stage table as it was written, which another job reads again for nothing."""
    plan, own = df._jdf.queryExecution().analyzed(), f"/ledgerline/{stage_folder(df.sparkSession).rpartition('/')[2]}/"
    return plan.getClass().getSimpleName() == "LogicalRelation" and all(own in f for f in df.inputFiles())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*stages: DataFrame) -> None:
    """Delete stage tables made by ``durable`` that nothing will read again."""
    for df in stages:
        folder = stage_folder(df.sparkSession)
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/ledgerline/{folder.rpartition('/')[2]}/" in path:
                _delete(df.sparkSession, path)


def drop_stages(spark: SparkSession) -> None:
    """Delete every stage table of this application; call it when its results are consumed."""
    _delete(spark, stage_folder(spark))
