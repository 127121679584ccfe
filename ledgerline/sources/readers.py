"""Readers for raw sales records."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import durable
from ledgerline.sources.schemas import RAW_SCHEMA, REQUIRED_COLUMNS, SALES_TYPES

CORRUPT, REASON = "_corrupt_line", "another number of fields than the header"


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """All columns as text (typing is a later step); None when the path cannot be read.

    The header decides the column names, so that validation sees what the file really holds. All
    files of a folder must have the columns in the same order: a file whose header differs fails
    the read instead of being read by position.
    """
    try:
        header = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    except AnalysisException:
        return None


@dataclass(frozen=True)
class SalesFiles:
    data: DataFrame  # the records of all files, as text, columns of all headers
    rejects: DataFrame  # file_path, line, reason


def read_sales_files(spark: SparkSession, path: str) -> SalesFiles | None:
    """CSV files whose headers may differ in order or in columns; None when the path cannot be read.

    One pass over the first lines groups the files by their header; each group is read by its own
    names, and the groups are aligned by name, a column that a file lacks being NULL. Lines with more or
    fewer fields than their file's header leave as rejects, and so do all files whose header names a
    column twice or not at all; the rejects are written as a table. Files without any line hold nothing.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return None
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    first = lines.select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
    # one row per file, as many as Spark's own listing holds
    headers: dict[str, list[str]] = {}
    for file, header in first.groupBy("file").agg(F.min_by("value", "place")).collect():
        headers.setdefault(header, []).append(file)
    kept, lost = [], []
    for header, files in sorted(headers.items()):
        names = [name.strip() for name in next(csv.reader([header.removeprefix("\ufeff")]), [])]
        if not names or "" in names or len({name.lower() for name in names}) < len(names):
            lost += [(file, header, "header names a column twice or not at all") for file in files]
            continue
        fields = [T.StructField(c, T.StringType()) for c in names]
        reader = spark.read.option("header", True).option("columnPruning", False)
        paths = [unquote(file) for file in files]
        sound = reader.option("mode", "DROPMALFORMED").schema(T.StructType(fields)).csv(paths)
        corrupt = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(corrupt).csv(paths)
        kept.append((sound, rows, names[0]))
    data, rejects = None, spark.createDataFrame(lost, "file_path string, line string, reason string")
    for sound, rows, name in kept:
        data = sound if data is None else data.unionByName(sound, allowMissingColumns=True)
        # Spark refuses a query of the line alone, so the reason reads a field (of which it shows nothing)
        reason = F.concat_ws("", F.lit(REASON), F.substring(F.col(f"`{name}`"), 1, 0))
        wrong = rows.filter(F.col(CORRUPT).isNotNull()).select(
            F.col("_metadata.file_path").alias("file_path"), F.col(CORRUPT).alias("line"), reason.alias("reason")
        )
        rejects = rejects.unionByName(wrong)
    return SalesFiles(empty_sales(spark) if data is None else data, durable(rejects, "csv-rejects"))


# Columns that with_file_order adds: the row order of the files.
FILE_ORDER = ("file_path", "file_block", "file_row")


def with_file_order(df: DataFrame) -> DataFrame:
    """Add the row order of a file source, for the steps in which the first row wins.

    To be called on the frame a reader returned. A task reads one block from its start, so
    the increasing id orders the rows of a block.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("file_row"),
    )


def read_sales_table(spark: SparkSession, path: str) -> DataFrame:
    """A flat sales table in parquet."""
    return spark.read.parquet(path)


def read_sales_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "vw_sales_summary",
    partition_column: str = "Order_Date",
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """The flat view of a database, read in parallel date slices when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if lower and upper:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()


def empty_sales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


def load_sales(
    spark: SparkSession,
    primary: Callable[[], DataFrame | None] | None,
    fallback: Callable[[], DataFrame | None] | None,
) -> DataFrame:
    """The primary source if it answers with rows, else the fallback, else an empty frame."""
    for source in (primary, fallback):
        if source is None:
            continue
        try:
            df = source()
            if df is not None and not df.isEmpty():
                return df
        except Exception as problem:  # a source that cannot answer must not stop the start-up
            print(f"sales source skipped: {problem}")
    return empty_sales(spark)


def missing_columns(df: DataFrame) -> list[str]:
    """Required columns the frame lacks, in their defined order."""
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def has_required_columns(df: DataFrame | None) -> bool:
    return df is not None and not missing_columns(df)


def column_type_report(df: DataFrame) -> DataFrame:
    """Per required column: present or not, its type and the type after cleaning."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [
        (c, c in found, found.get(c), SALES_TYPES[c].simpleString()) for c in REQUIRED_COLUMNS
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, present boolean, found_type string, clean_type string"
    )


def null_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn the output null tokens (``""``, ``NA``, ``null``) of text columns into NULL."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(~F.col(c).isin("", "NA", "null"), F.col(c)) for c in names}
    )
