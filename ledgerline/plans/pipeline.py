"""Raw records to clean records with an audit log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import cleaning
from ledgerline.session import durable
from ledgerline.sources import readers
from ledgerline.sources.schemas import DEFAULT_MARGINS, DERIVED_COLUMNS, REQUIRED_COLUMNS


@dataclass(frozen=True)
class CleanSales:
    data: DataFrame  # 13 + 6 columns
    audit_log: DataFrame
    stats: DataFrame  # one row of counters


def _stored(lookups: cleaning.Lookups) -> cleaning.Lookups:
    return cleaning.Lookups(
        durable(lookups.margins, "margins"),
        durable(lookups.names, "names"),
        durable(lookups.cities, "cities"),
    )


def process_raw_data(
    raw: DataFrame,
    order: Sequence[str],
    default_margins: Mapping[str, float] = DEFAULT_MARGINS,
    at: Column | None = None,
    extra_columns: Sequence[str] = (),
) -> CleanSales | None:
    """Validate, type, impute, deduplicate, drop invalid rows, derive, flag outliers.

    ``order`` names columns that put the raw rows in order; in it the first row wins.
    None when a required column is missing. Margins, names and cities are learned from all
    raw rows, duplicates and invalid ones included. The cleaned rows are stored once; the
    outlier fences and the result read the stored table.
    """
    if not readers.has_required_columns(raw):
        return None
    typed = cleaning.convert_types(raw)
    lookups = _stored(cleaning.learn_lookups(typed, order, default_margins))
    imputed = cleaning.impute(typed, lookups)
    kept = dict.fromkeys([*REQUIRED_COLUMNS, *extra_columns])
    clean = (
        imputed.transform(cleaning.remove_duplicates, order)
        .transform(cleaning.valid_rows)
        .select(*kept)
        .transform(cleaning.add_derived)
    )
    clean = cleaning.detect_outliers(durable(clean, "clean")).select(*kept, *DERIVED_COLUMNS)
    audit = cleaning.audit_log(imputed, order, at if at is not None else F.current_timestamp())
    return CleanSales(clean, audit, cleaning.pipeline_stats(typed, clean))


def process_dataset(spark: SparkSession, path: str, **options) -> CleanSales | None:
    """The pipeline on CSV files, in the row order of the files; None when unreadable."""
    raw = readers.read_sales_csv(spark, path)
    if raw is None:
        return None
    return process_raw_data(readers.with_file_order(raw), readers.FILE_ORDER, **options)
