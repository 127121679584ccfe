"""Groups of rows within tasks, and connected components over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import discard, durable


def by_group(
    df: DataFrame,
    key: str,
    apply: Callable[[pd.DataFrame], pd.DataFrame | None],
    schema: str,
    parts: int | None = None,
) -> DataFrame:
    """Call ``apply`` on the rows of each key and gather the frames that it returns.

    The rows are dealt by the key, sorted, and streamed: unlike a grouped map this costs nothing
    per group but the call, and a task holds one batch and one group. Callers bound the groups,
    and give the number of tasks where the work is longer than its bytes tell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(batch)]))
            out = []
            for i, (start, end) in enumerate(zip(starts, ends)):
                part = batch.iloc[start:end]
                if held and (i or held[0][key].iloc[0] != keys[0]):
                    out.append(apply(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(part)
            out = [x for x in out if x is not None and len(x)]
            if out:
                yield pd.concat(out)
        if held and (last := apply(pd.concat(held))) is not None and len(last):
            yield last

    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInPandas(run, schema)


def forest_edges(ids: np.ndarray, linked: np.ndarray) -> tuple[list, list]:
    """Of a square link matrix: each connected node of more than one with its least id."""
    left, a, b = np.ones(len(ids), dtype=bool), [], []
    for start in np.argsort(ids, kind="stable"):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            found = np.flatnonzero(linked[front].any(axis=0) & left)
            left[found] = False
            a += [ids[start]] * len(found)
            b += list(ids[found])
            front = list(found)
    return a, b


def _hang_on_roots(state: DataFrame) -> bool:
    """Whether every node u of the distinct edges (u, v) has one v, which is no other edge's u."""
    ends = state.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
        state.select(F.col("v").alias("node"), F.lit(None).cast("int").alias("up"))
    )
    seen = ends.groupBy("node").agg(F.count("up").alias("up"), F.count(F.lit(1)).alias("edges"))
    return not seen.filter("up > 0 AND edges > 1").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of an edge (a, b) the least node that edges lead to.

    Large and small stars in turn: every node hands its larger, then its smaller neighbours to
    the least node it knows, until all hang on their root, which may be so from the start. Stars
    are aggregated before they are joined, so a node with very many links is combined in the map
    tasks and its join is split. Each round is a written table; the one before it is dropped.
    """
    state = durable(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while not _hang_on_roots(state):
        around = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # no more rows than edges, repeated ones among them: those leave with the small stars
        large = around.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable(large, "stars")
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            stars.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after = durable(small, "edges")
        discard(state, stars)
        state = after
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
