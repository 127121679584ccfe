"""Customer segments: scaled RFM figures, k-means and named clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.semantics import desc, distance_to, min_max, nearest, only_row
from ledgerline.operators.customers import CUSTOMER_KEY, rfm
from ledgerline.session import durable

MEASURES = ("Recency", "Frequency", "Monetary")
SCALED = ("R_Norm", "F_Norm", "M_Norm")

# Segment names and the clustering seed.
BEST_SEGMENT = "Champions"
LAST_SEGMENT = "At Risk"
OTHER_SEGMENT = "Loyal Customers"
ONLY_SEGMENT = "Valued Partners"
SEED = 123
STARTS = 25
#: rounds that all starts share, rounds of the best one at most, points that seeds are drawn from
ROUNDS, LAST_ROUNDS, SEED_POINTS = 10, 100, 2000
#: rows of a task that are held against all centers at once
BLOCK = 8192


@dataclass(frozen=True)
class Segments:
    data: DataFrame  # RFM rows with Cluster and Segment
    centroids: DataFrame  # Cluster, Size, means, Segment; highest mean spend first
    k: int
    withinss: float | None


def scale_rfm(customers: DataFrame) -> DataFrame:
    limits = customers.agg(
        *[F.min(c).alias(f"low_{c}") for c in MEASURES],
        *[F.max(c).alias(f"high_{c}") for c in MEASURES],
    )
    return (
        customers.withColumn("limits", only_row(limits))
        .withColumns(
            {s: min_max(c, f"limits.low_{c}", f"limits.high_{c}") for c, s in zip(MEASURES, SCALED)}
        )
        .drop("limits")
    )


def profile(clustered: DataFrame) -> DataFrame:
    """Size and mean recency, frequency and spend per cluster."""
    return clustered.groupBy("Cluster").agg(
        F.count(F.lit(1)).alias("Size"),
        *[F.avg(F.col(c).cast("double")).alias(f"Mean_{c}") for c in MEASURES],
    )


def name_segments(centers: DataFrame, k: int) -> DataFrame:
    """Cluster and Segment: the centers (k rows) ranked by frequency + spend - recency."""
    score = F.col("F_Norm") + F.col("M_Norm") - F.col("R_Norm")
    rank = F.row_number().over(W.orderBy(score.desc(), F.col("Cluster")))
    return centers.withColumn("rank", rank).select(
        "Cluster",
        F.when(F.col("rank") == 1, F.lit(BEST_SEGMENT))
        .when(F.col("rank") == k, F.lit(LAST_SEGMENT))
        .otherwise(F.lit(OTHER_SEGMENT))
        .alias("Segment"),
    )


def weighted_points(points: DataFrame) -> DataFrame:
    """The different scaled points with the number of customers at each (``n``)."""
    return points.groupBy(*SCALED).agg(F.count(F.lit(1)).cast("double").alias("n"))


def seeds(points: DataFrame, k: int, starts: int) -> np.ndarray:
    """(starts, k, 3): centers to start from, drawn far apart from ``SEED_POINTS`` different points by hash.

    Each next center of a start is drawn with chance in proportion to its squared distance from those before.
    """
    drawn = points.orderBy(F.xxhash64(*SCALED, F.lit(SEED)), *SCALED).limit(SEED_POINTS).select(*SCALED, "n").collect()
    table = np.array([tuple(r) for r in drawn], dtype=float)
    places, n = table[:, :3], table[:, 3]
    source, out = np.random.default_rng(SEED), []
    for _ in range(starts):
        chosen = [int(source.choice(len(places), p=n / n.sum()))]
        far = np.full(len(places), np.inf)
        while len(chosen) < k:
            far = np.minimum(far, ((places - places[chosen[-1]]) ** 2).sum(axis=1))
            weight = n * far
            chosen.append(int(source.choice(len(places), p=weight / weight.sum())))
        out.append(places[chosen])
    return np.array(out)


def move_centers(points: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centers of all starts moved to the means of their nearest points, and each start's cost before the move.

    One pass and one aggregate for all starts: a task sums up its points by start and center, so only
    starts x k rows leave it. A center without points stays; equal distances go to the first center.
    """
    starts, k, size = centers.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((starts * k, size + 2))
        for batch in batches:
            every = batch[[*SCALED, "n"]].to_numpy(dtype=float)
            for at in range(0, len(every), BLOCK):
                x, n = every[at : at + BLOCK, :size], every[at : at + BLOCK, size]
                for s in range(starts):
                    distance = ((x[:, None, :] - centers[s]) ** 2).sum(axis=2)
                    near = distance.argmin(axis=1)
                    columns = [n, *(n * x[:, j] for j in range(size)), n * distance[np.arange(len(x)), near]]
                    for j, column in enumerate(columns):
                        sums[s * k : (s + 1) * k, j] += np.bincount(near, column, k)
        yield pd.DataFrame(sums, columns=names).assign(place=np.arange(starts * k))

    names = ["n", *SCALED, "cost"]
    parts = points.mapInPandas(run, ", ".join(f"{c} double" for c in names) + ", place int")
    total = np.zeros((starts * k, size + 2))
    for row in parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).collect():
        total[row["place"]] = row[1:]
    n, sums = total[:, :1], total[:, 1 : 1 + size]
    moved = np.where(n > 0, sums / np.maximum(n, 1e-300), centers.reshape(starts * k, size))
    return moved.reshape(centers.shape), total[:, -1].reshape(starts, k).sum(axis=1)


def fit_centers(points: DataFrame, k: int, starts: int) -> tuple[np.ndarray, float]:
    """The centers of the cheapest start, moved until they stay, and their within-cluster sum of squares.

    All starts move together for ``ROUNDS`` rounds, those that stay drop out; then the cheapest goes on.
    """
    centers = seeds(points, k, starts)
    costs, live = np.full(starts, np.inf), np.arange(starts)
    for _ in range(ROUNDS):
        moved, costs[live] = move_centers(points, centers[live])
        stayed = np.abs(moved - centers[live]).max(axis=(1, 2)) < 1e-12
        centers[live] = moved
        live = live[~stayed]
        if not len(live):
            break
    best = centers[[int(costs.argmin())]]
    for _ in range(LAST_ROUNDS):
        moved, cost = move_centers(points, best)
        stayed = np.abs(moved - best).max() < 1e-12
        best = moved
        if stayed:
            break
    return best[0], float(cost[0])


def segment_customers(df: DataFrame, k: int = 3, starts: int = STARTS) -> Segments | None:
    """Cluster the customers of a sales table; None when it is empty.

    k falls to the number of different RFM points when there are fewer than k. The RFM table
    is stored once, its different points with their counts another time. Clusters are numbered by the rank of
    their centers (frequency + spend - recency, best first), whatever order k-means found them in.
    """
    customers = durable(rfm(df), "rfm")
    scaled = scale_rfm(customers)
    points = durable(weighted_points(scaled), "points")
    different = points.limit(k).count()
    if different == 0:
        return None
    k = min(k, different)
    if k <= 1:
        data = customers.withColumn("Cluster", F.lit(1)).withColumn("Segment", F.lit(ONLY_SEGMENT))
        centroids = profile(data).withColumn("Segment", F.lit(ONLY_SEGMENT))
        return Segments(data, centroids, 1, None)

    centers, cost = fit_centers(points, k, starts)
    found = sorted((tuple(map(float, c)) for c in centers), key=lambda c: (c[0] - c[1] - c[2], c))
    clustered = scaled.withColumn("Cluster", nearest(SCALED, found) + 1).select(*CUSTOMER_KEY, *MEASURES, "Cluster")
    centers = df.sparkSession.createDataFrame(
        [(n + 1, *c) for n, c in enumerate(found)], "Cluster int, R_Norm double, F_Norm double, M_Norm double"
    )
    names = F.broadcast(name_segments(centers, k))  # k rows
    data = clustered.join(names, "Cluster").select(*CUSTOMER_KEY, *MEASURES, "Cluster", "Segment")
    centroids = profile(clustered).join(names, "Cluster").orderBy(*desc("Mean_Monetary"))
    return Segments(data, centroids, k, cost)


def segment_facts(found: Segments) -> DataFrame:
    """One row that shows whether the segments hold: customers, clusters, spend and recency of all profiles added up,
    customers that lie nearer to the mean of another cluster, and empty profiles."""
    k = found.k
    scaled = scale_rfm(found.data)
    means = scaled.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in SCALED])
    centers = [tuple(r) for r in means.orderBy("Cluster").select(*SCALED).collect()]  # k rows
    # a point on the border of two clusters may count for either
    own = F.element_at(F.array(*[distance_to(SCALED, c) for c in centers]), F.col("Cluster"))
    least = F.least(*[distance_to(SCALED, c) for c in centers]) if k > 1 else own
    misplaced = scaled.agg(
        F.count(F.lit(1)).alias("Customers"), F.count_if(own > least + 1e-9).alias("Misplaced")
    )
    size = F.col("Size").cast("double")
    profiles = found.centroids.agg(
        F.count(F.lit(1)).alias("Clusters"),
        F.sum("Size").alias("Profiled"),
        F.sum(size * F.col("Mean_Monetary")).alias("Monetary"),
        F.sum(size * F.col("Mean_Frequency")).alias("Frequency"),
        F.sum(size * F.col("Mean_Recency")).alias("Recency"),
    )
    return misplaced.withColumn("p", only_row(profiles)).select("Customers", "Misplaced", "p.*")
