"""First row per key and consecutive numbers over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.semantics import asc
from ledgerline.session import durable_parts, parts_of


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``.

    Spark turns ``row_number() = 1`` into a group limit before the shuffle, so a key that
    holds a third of all rows sends one row per map task, not a third of the table.
    """
    window = W.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    return df.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def first_by(value: Column, order: Sequence[str]) -> Column:
    """Aggregate: ``value`` of the first row in ``order`` (combined before the shuffle)."""
    return F.min_by(value, F.struct(*order))


def last_by(value: Column, order: Sequence[str]) -> Column:
    return F.max_by(value, F.struct(*order))


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    after: DataFrame | None = None,
    keys: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Number all rows 1..n in ``order`` (a total order) without one task seeing them all.

    Rows are range-partitioned and sorted; the stage table fixes each row's place; the
    partition sizes (one row per partition) give every partition its start. ``after`` is a
    one-row frame whose only column is the last number already in use. Where the order is ``asc(*keys)``,
    a large table is sorted in parts that follow each other, one after the other. ``keep`` names the
    columns that are wanted afterwards (all, if none is named).
    """
    def sorted_part(part: DataFrame) -> DataFrame:
        rows = (
            part.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .withColumn("__slot", F.monotonically_increasing_id())
        )
        return rows.select(*keep, "__slot") if keep else rows

    turns = enumerate(_in_turn(df, keys))
    placed = durable_parts((sorted_part(part).withColumn("__turn", F.lit(i)) for i, part in turns), name)
    placed = placed.withColumn("__part", F.shiftright("__slot", 33))
    earlier = W.orderBy("__turn", "__part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__turn", "__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__turn", "__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"))
    )
    base = F.lit(0) if after is None else F.coalesce(after.scalar(), F.lit(0))
    in_part = F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), ["__turn", "__part"])
        .withColumn(name, (base + F.col("__start") + in_part + 1).cast("long"))
        .drop("__slot", "__turn", "__part", "__start")
    )


def _in_turn(df: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """``df`` in parts, each before the next in the order of the keys, NULL last; a few rows place the cuts.

    Which rows are looked at decides how even the parts are, not what any row's number is.
    """
    parts = parts_of(df) if keys else 1
    if parts == 1:
        return [df]
    seen = df.select(*keys).sample(fraction=min(1.0, 200 * parts / max(1, df.count())), seed=1)
    some = seen.orderBy(*asc(*keys)).collect()
    cuts = [some[len(some) * i // parts] for i in range(1, parts)] if some else []
    lows, highs = [df, *[df.filter(_not_before(cut, keys)) for cut in cuts]], [*cuts, None]
    return [low if high is None else low.filter(~_not_before(high, keys)) for low, high in zip(lows, highs, strict=True)]


def _not_before(cut: Sequence, keys: Sequence[str]) -> Column:
    """Whether a row's keys are the cut's or come after them, NULL last."""
    found = F.lit(True)
    for key, value in reversed([*zip(keys, cut, strict=True)]):
        if value is None:
            found = F.col(key).isNull() & found
        else:
            found = F.coalesce(F.col(key) > F.lit(value), F.lit(True)) | (F.col(key).eqNullSafe(F.lit(value)) & found)
    return found
