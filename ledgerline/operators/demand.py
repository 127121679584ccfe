"""Demand per transaction from category, price, region and month: a forest, a log-linear model or the mean."""

from __future__ import annotations

import logging
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.semantics import asc, desc
from ledgerline.session import discard, durable, stage_folder

log = logging.getLogger(__name__)
# tasks carry their helpers with them: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACTORS = ("Category", "Region", "Month")
FEATURES = ("Category", "Price", "Region", "Month")

# Model labels, result texts and forest settings.
FOREST_LABEL = "Random Forest Regressor"
POISSON_LABEL = "Linear Regression Model (GLM Fallback)"
MEAN_LABEL = "Mean Quantity"
FAILED_TEXT = "Prediction failed. Verify predictor configuration."
RESULT_TEXT = "Predicted Quantity Demand: %.1f units per transaction (using %s)"
TREES = 100
DEPTH = 30
SEED = 123
LEAF_ROWS = 5
#: variance from which a node can still be parted, as in Spark's trees
EPSILON = 2.220446049250313e-16
#: rows that the trees of one job draw together, and cells from which trees are grown by lines
DRAWN = 4_000_000
#: different prices that the driver counts exactly
PRICES = 50_000
# Newton steps and the relative change of the deviance that ends them, as usual for such fits.
STEPS, CONVERGED = 25, 1e-8
#: levels of the two narrower factors together; the widest factor has no limit
NARROW_LEVELS = 400


@dataclass(frozen=True)
class DemandModel:
    fitted: Any  # ``transform`` adds ``prediction`` to rows with the four features
    label: str
    importance: DataFrame  # Variable, Importance; most important first
    metrics: DataFrame  # one row: RMSE, MAE, Mean_Quantity


def model_lines(df: DataFrame) -> DataFrame:
    """The model's columns as numbers and text, a row for each sold line; rows with a gap cannot train."""
    return df.select(
        F.col("Quantity").cast("double").alias("Quantity"),
        "Category",
        F.col("Price").cast("double").alias("Price"),
        "Region",
        F.col("Month").cast("string").alias("Month"),
    ).na.drop()


def model_rows(df: DataFrame) -> DataFrame:
    """``model_lines`` with equal rows counted in ``weight``; stored.

    There are at most as many rows as combinations of quantity, category, price, region and month,
    so passes over them do not grow with the number of sales once all combinations have occurred.
    """
    lines = model_lines(df)
    counted = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return durable(counted, "demand")


def _fit_metrics(scored: DataFrame) -> DataFrame:
    error, weight = F.col("Quantity") - F.col("prediction"), F.col("weight")
    total = F.sum(weight)
    return scored.agg(
        F.sqrt(F.sum(weight * error * error) / total).alias("RMSE"),
        (F.sum(weight * F.abs(error)) / total).alias("MAE"),
        (F.sum(weight * F.col("Quantity")) / total).alias("Mean_Quantity"),
    )


def _importance(df: DataFrame, pairs: list[tuple[str, float]]) -> DataFrame:
    frame = df.sparkSession.createDataFrame(pairs, "Variable string, Importance double")
    return frame.orderBy(*desc("Importance"), *asc("Variable"))


def train_forest(rows: DataFrame, trees: int = TREES, max_depth: int = DEPTH) -> DemandModel:
    """Random forest on ``model_rows``, each tree on a bootstrap of the single lines.

    Prices are read in at most ``maxBins`` intervals, so lines of one category, region, month and interval
    can never be parted: a tree needs of such a cell only how many of its lines it draws, their sum and their
    sum of squares. A combination of weight w is drawn Poisson(w) times, the law of w lines drawn singly, so
    time follows the number of combinations and cells and not that of lines times trees. Tables with more than
    ``DRAWN`` cells are grown by Spark from single lines.
    """
    indexers = [
        StringIndexer(
            inputCol=c, outputCol=f"{c}_Index", handleInvalid="keep", stringOrderType="alphabetAsc"
        )
        for c in FACTORS
    ]
    inputs = [f"{c}_Index" if c in FACTORS else c for c in FEATURES]
    indexed = Pipeline(stages=[*indexers, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(rows)
    # a level more for those that scenarios may bring
    arity = {c: len(stage.labels) + 1 for c, stage in zip(FACTORS, indexed.stages)}
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol="Quantity",
        numTrees=trees,
        maxDepth=max_depth,
        maxBins=max(32, *arity.values()),
        featureSubsetStrategy="1",  # a third of four, rounded down
        minInstancesPerNode=LEAF_ROWS,
        maxMemoryInMB=1024,
        seed=SEED,
    )
    bins = int(min(forest.getMaxBins(), rows.agg(F.sum("weight")).first()[0]))
    if max(arity.values()) > bins:
        raise ValueError(f"more levels than the {bins} intervals that so few lines allow")
    thresholds = price_thresholds(rows, bins - 1)
    cells = _cells(indexed.transform(rows), thresholds)
    count = cells.count()
    if count > DRAWN:
        lines = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("copy", "weight")
        grown = forest.fit(indexed.transform(lines).select("features", "Quantity"))
    else:
        grown = _grown(forest, cells, count, [arity.get(c, 0) for c in FEATURES], thresholds)
    importance = _importance(rows, [(c, float(w)) for c, w in zip(FEATURES, grown.featureImportances.toArray())])
    fitted = Forest(indexed, grown)
    # all lines of a cell get one prediction
    scored = fitted.transform(cells.drop(*[f"{c}_Index" for c in FACTORS])).select(
        "prediction", F.inline(F.arrays_zip(F.col("quantities").alias("Quantity"), F.col("weights").alias("weight")))
    ).toDF("prediction", "Quantity", "weight")
    return DemandModel(fitted, FOREST_LABEL, importance, _fit_metrics(scored))


def price_thresholds(rows: DataFrame, most: int) -> list[float]:
    """At most ``most`` prices that part the lines evenly, by the rule of Spark's trees; halfway between two prices.

    Where there are more than ``PRICES`` different ones they come from Spark's quantile summaries of all lines.
    """
    counted = rows.groupBy("Price").agg(F.sum("weight").alias("n"))
    if counted.count() > PRICES:
        lines = rows.select("Price", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
        cuts = lines.approxQuantile("Price", [i / (most + 1) for i in range(1, most + 2)], 0.1 / (most + 1))
        return sorted(set(cuts[:-1]) - {max(cuts)})
    prices, counts = np.array(sorted(map(tuple, counted.collect()))).T
    halfway = (prices[:-1] + prices[1:]) / 2
    if len(halfway) <= most:
        return halfway.tolist()
    stride, reached, found = counts.sum() / (most + 1), counts.cumsum(), []
    target = stride
    for i in range(1, len(prices)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            found.append(float(halfway[i - 1]))
            target += stride
    return found[:most]


def _cells(coded: DataFrame, thresholds: list[float]) -> DataFrame:
    """A row for each category, region, month and price interval: its quantities and how often each was sold; stored."""
    bounds = F.array(*[F.lit(t) for t in thresholds]) if thresholds else F.array().cast("array<double>")
    place = F.size(F.filter(bounds, lambda t: t < F.col("Price")))
    keys = [*FACTORS, *[f"{c}_Index" for c in FACTORS], "interval"]
    sold = coded.withColumn("interval", place).groupBy(*keys, "Quantity").agg(
        F.sum("weight").alias("weight"), F.min("Price").alias("Price")
    )
    cells = sold.groupBy(*keys).agg(
        F.min("Price").alias("Price"), F.sort_array(F.collect_list(F.struct("Quantity", "weight"))).alias("sold")
    )
    return durable(
        cells.select(*keys, "Price", F.col("sold.Quantity").alias("quantities"), F.col("sold.weight").alias("weights")),
        "cells",
    )


def _grown(forest: RandomForestRegressor, cells: DataFrame, count: int, arity: list[int], thresholds: list[float]) -> Any:
    """Spark's model of the trees that tasks grow, one task a tree; as many at a time as draw ``DRAWN`` rows."""
    spark, trees, depth = cells.sparkSession, forest.getNumTrees(), forest.getMaxDepth()
    codes = [f"{c}_Index" if c in FACTORS else "interval" for c in FEATURES]
    path = f"{stage_folder(spark)}/forest-{uuid.uuid4().hex}"
    # a model of empty trees, whose nodes are then replaced
    empty = spark.createDataFrame([(Vectors.dense([0.0] * len(FEATURES)), 0.0)], ["features", "Quantity"])
    forest.fit(empty).write().save(path)
    step, mode = max(1, DRAWN // max(count, 1)), "overwrite"
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(min(most, 1 + count // 500), *codes)
    for first in range(0, trees, step):
        some = range(first, min(first + step, trees))
        drawn = cells.select(*codes, "quantities", "weights").mapInPandas(
            lambda batches, some=some: _draw(batches, codes, some), "tree int, " + ", ".join(f"{c} int" for c in codes) + ", n double, total double, squares double"
        )
        nodes = drawn.repartition(min(most, len(some)), "tree").groupBy("tree").applyInPandas(
            lambda part: _grow(part, codes, arity, thresholds, depth),
            "tree int, id int, prediction double, impurity double, stats array<double>, raw long, gain double, "
            "left int, right int, feature int, at array<double>, arity int",
        )
        split = F.struct(
            F.col("feature").alias("featureIndex"), F.col("at").alias("leftCategoriesOrThreshold"), F.col("arity").alias("numCategories")
        )
        nodes.select(
            F.col("tree").alias("treeID"),
            F.struct(
                "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
                F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
            ).alias("nodeData"),
        ).write.mode(mode).parquet(f"{path}/data")
        mode = "append"
    return RandomForestRegressionModel.load(path)


def _draw(batches: Iterator[pd.DataFrame], codes: list[str], some: range) -> Iterator[pd.DataFrame]:
    """How many of each cell's lines each tree draws, their sum and their sum of squares; seeded by cell, so not by layout.

    A cell that a tree draws nothing of still comes, so that every tree has a row.
    """
    for batch in batches:
        out = []
        for *cell, quantities, weights in zip(*[batch[c].astype("int64") for c in codes], batch["quantities"], batch["weights"]):
            source = np.random.default_rng([SEED, some.start, *cell])
            sums = np.zeros((3, len(some)))
            for i in range(0, len(weights), 4096):
                q = np.asarray(quantities[i : i + 4096], dtype=float)
                times = source.poisson(weights[i : i + 4096], (len(some), len(q)))
                sums += np.stack([times.sum(1), times @ q, times @ (q * q)])
            out.append(np.column_stack([np.array(some), np.tile(cell, (len(some), 1)), sums.T]))
        if out:
            table = pd.DataFrame(np.concatenate(out), columns=["tree", *codes, "n", "total", "squares"])
            yield table.astype({c: "int32" for c in ["tree", *codes]})


def _spread(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The variance of n lines with this sum and sum of squares."""
    n = np.maximum(n, 1)
    return np.maximum(squares / n - (total / n) ** 2, 0)


def _grow(part: pd.DataFrame, codes: list[str], arity: list[int], thresholds: list[float], depth: int) -> pd.DataFrame:
    """The nodes of one tree from its drawn cells, all nodes of a depth at once, by the rules of Spark's trees.

    Each node gets one feature by chance. Levels are put in the order of their means, price intervals stay in
    theirs, and the cut of that order that takes away most variance parts the node, unless it takes away none or
    leaves less than ``LEAF_ROWS`` lines on a side.
    """
    tree = int(part["tree"].iloc[0])
    part = part.sort_values(codes)
    bins, sums = part[codes].to_numpy(), part[["n", "total", "squares"]].to_numpy()
    bins, sums = bins[sums[:, 0] > 0], sums[sums[:, 0] > 0]
    source, by_level = np.random.default_rng([SEED, tree]), np.array([a > 0 for a in arity])
    width = int(bins.max(initial=0)) + 1
    stats = [sums.sum(0)]  # by node, like everything that follows
    left, right, feature, gains, at = [-1], [-1], [-1], [-1.0], [[]]
    nodes = np.array([0])
    slot = np.zeros(len(bins), dtype=np.int64)  # where each cell's node is in ``nodes``
    for _ in range(depth):
        if not len(nodes) or not len(bins):
            break
        chosen = source.integers(len(codes), size=len(nodes))
        entries, entry = np.unique(slot * width + bins[np.arange(len(bins)), chosen[slot]], return_inverse=True)
        of, value = entries // width, entries % width
        n, total, squares = (np.bincount(entry, sums[:, k], len(entries)) for k in range(3))
        order = np.lexsort((value, np.where(by_level[chosen[of]], total / n, value), of))
        of, value = of[order], value[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        lows = np.stack([x[order].cumsum() for x in (n, total, squares)])
        ends = np.r_[starts[1:], len(of)] - 1
        before = np.concatenate([np.zeros((3, 1)), lows[:, ends[:-1]]], axis=1)
        whole, lows = lows[:, ends] - before, lows - before[:, of]
        highs = whole[:, of] - lows
        gain = _spread(*whole)[of] - (lows[0] * _spread(*lows) + highs[0] * _spread(*highs)) / whole[0][of]
        gain[(lows[0] < LEAF_ROWS) | (highs[0] < LEAF_ROWS)] = -1
        best = np.maximum.reduceat(gain, starts)
        tops = np.flatnonzero(gain == best[of])
        cut = tops[np.r_[True, of[tops[1:]] != of[tops[:-1]]]]  # the first of equal ones
        parted = best > 0
        follows = np.full((2, len(nodes)), -1)  # places of the children among the next nodes
        following = []
        for k in np.flatnonzero(parted):
            node, f, c = nodes[k], int(chosen[k]), cut[k]
            feature[node], gains[node] = f, float(best[k])
            at[node] = value[starts[k] : c + 1].astype(float).tolist() if by_level[f] else [thresholds[value[c]]]
            for side, child in ((0, lows[:, c]), (1, highs[:, c])):
                (left, right)[side][node] = len(stats)
                if _spread(*child) >= EPSILON:
                    follows[side, k] = len(following)
                    following.append(len(stats))
                stats.append(child)
                for column, none in ((left, -1), (right, -1), (feature, -1), (gains, -1.0), (at, [])):
                    column.append(none)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        slot = follows[(place[entry] > cut[slot]).astype(int), slot]
        bins, sums, slot = bins[slot >= 0], sums[slot >= 0], slot[slot >= 0]
        nodes = np.array(following, dtype=np.int64)
    held = np.array(stats)
    return pd.DataFrame(
        {
            "tree": np.int32(tree),
            "id": np.arange(len(held), dtype=np.int32),
            "prediction": held[:, 1] / np.maximum(held[:, 0], 1),
            "impurity": _spread(*held.T),
            "stats": held.tolist(),
            "raw": held[:, 0].astype("int64"),
            "gain": gains,
            "left": np.array(left, dtype=np.int32),
            "right": np.array(right, dtype=np.int32),
            "feature": np.array(feature, dtype=np.int32),
            "at": at,
            "arity": np.array([arity[f] if f >= 0 and arity[f] else -1 for f in feature], dtype=np.int32),
        }
    )


@dataclass(frozen=True)
class Forest:
    indexed: Any
    grown: Any

    def transform(self, df: DataFrame) -> DataFrame:
        return self.grown.transform(self.indexed.transform(df))


@dataclass(frozen=True)
class LogLinear:
    """exp(effect of the wide factor's level + price * slope + effects of the narrow factors' levels)."""

    wide: str
    effects: DataFrame  # level, effect; one row a level
    slope: float
    narrow: dict[str, dict[str, float]]

    def linear(self, df: DataFrame) -> DataFrame:
        """``df`` with ``eta``; rows with an unknown level of the wide factor leave, of a narrow one get NULL."""
        joined = df.join(self.effects.withColumnRenamed("level", self.wide), self.wide)
        eta = F.col("effect") + F.col("Price") * self.slope
        for factor, effects in self.narrow.items():
            pairs = [F.lit(x) for pair in effects.items() for x in pair]
            eta = eta + F.element_at(F.create_map(*pairs), F.col(factor))
        return joined.withColumn("eta", eta).drop("effect")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear(df).withColumn("prediction", F.exp("eta")).drop("eta").select(*df.columns, "prediction")


def _level_sums(scored: DataFrame, wide: str, columns: list[tuple[str, str | None]]) -> DataFrame:
    """A row for each level of the wide factor: observed and fitted totals and the fitted sums of the narrow columns."""
    sums = [F.sum(F.col("mean") * _indicator(c)).alias(f"a{i}") for i, c in enumerate(columns)]
    level = scored.groupBy(F.col(wide).alias("level")).agg(
        F.sum("y").alias("y"), F.sum("mean").alias("fitted"), F.sum("deviance").alias("deviance"), *sums
    )
    return level.select("level", "y", "fitted", "deviance", F.array(*[f"a{i}" for i in range(len(columns))]).alias("a"))


def _indicator(column: tuple[str, str | None]) -> Column:
    name, level = column
    return F.col("Price") if level is None else F.when(F.col(name) == level, 1.0).otherwise(0.0)


def _narrow_sums(scored: DataFrame, factors: list[str], columns: list[tuple[str, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The narrow columns' block of the information matrix and their score, from one row per pair of narrow levels."""
    cells = scored.groupBy(*factors).agg(
        F.sum(F.col("y") - F.col("mean")).alias("gap"),
        F.sum((F.col("y") - F.col("mean")) * F.col("Price")).alias("gap_price"),
        F.sum("mean").alias("mean"),
        F.sum(F.col("mean") * F.col("Price")).alias("mean_price"),
        F.sum(F.col("mean") * F.col("Price") * F.col("Price")).alias("mean_price2"),
    ).collect()
    size = len(columns)
    matrix, score = np.zeros((size, size)), np.zeros(size)
    place = {column: i for i, column in enumerate(columns)}
    for cell in cells:
        on = [place[f, cell[f]] for f in factors if (f, cell[f]) in place]
        score[0] += cell["gap_price"]
        matrix[0, 0] += cell["mean_price2"]
        for i in on:
            score[i] += cell["gap"]
            matrix[0, i] += cell["mean_price"]
            matrix[i, 0] += cell["mean_price"]
            for j in on:
                matrix[i, j] += cell["mean"]
    return matrix, score


def _eliminated(levels: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What the wide factor's levels take from the narrow block and its score: sums of a a' / fitted and a gap / fitted.

    Each task adds up its levels; only sums of fixed size leave it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * size + size)
        for batch in batches:
            if len(batch):
                a, fitted = np.stack(batch["a"].to_numpy()), batch["fitted"].to_numpy()
                gap = batch["y"].to_numpy() - fitted
                total += np.concatenate([((a / fitted[:, None]).T @ a).ravel(), (a / fitted[:, None]).T @ gap])
        yield pd.DataFrame({"place": np.arange(len(total)), "part": total})

    parts = levels.mapInPandas(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    total = np.zeros(size * size + size)
    for place, part in parts.collect():
        total[place] = part
    return total[: size * size].reshape(size, size), total[size * size :]


def train_poisson(rows: DataFrame) -> DemandModel:
    """Log-linear counts on ``model_rows`` by Newton steps that no number of levels of the widest factor stops.

    The widest factor's block of the information matrix is diagonal, so it is eliminated level by level
    where the levels lie, and the driver solves a system of the price and the two narrower factors only
    (``NARROW_LEVELS`` at most, else ValueError). The alphabetically first level of each factor is the base;
    importance is the absolute z value of each coefficient.
    """
    counts = rows.agg(*[F.count_distinct(c).alias(c) for c in FACTORS]).first().asDict()
    wide = max(FACTORS, key=lambda c: (counts[c], c))
    factors = [c for c in FACTORS if c != wide]
    if sum(counts[c] for c in factors) > NARROW_LEVELS:
        raise ValueError(f"more than {NARROW_LEVELS} levels beside those of {wide}")
    known = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in factors}
    columns: list[tuple[str, str | None]] = [("Price", None)] + [(c, x) for c in factors for x in known[c][1:]]
    data = durable(
        rows.groupBy(*FEATURES).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("Quantity")).alias("y")),
        "counts",
    )
    start = data.groupBy(F.col(wide).alias("level")).agg(
        F.log((F.sum("y") + 0.1) / F.sum("n")).alias("effect")
    )
    beta, effects, before = np.zeros(len(columns)), durable(start, "effects"), None
    for _ in range(STEPS):
        model = LogLinear(wide, effects, float(beta[0]), _narrow_effects(known, columns, beta))
        scored = model.linear(data).withColumn("mean", F.col("n") * F.exp("eta")).withColumn(
            "deviance",
            2 * (F.when(F.col("y") > 0, F.col("y") * F.log(F.col("y") / F.col("mean"))).otherwise(0.0) - (F.col("y") - F.col("mean"))),
        )
        levels = durable(_level_sums(scored, wide, columns), "levels")
        matrix, score = _narrow_sums(scored, factors, columns)
        taken, taken_score = _eliminated(levels, len(columns))
        deviance = levels.agg(F.sum("deviance")).first()[0]
        if deviance is None or not np.isfinite(deviance):
            raise ValueError("the fit diverged")
        inverse = np.linalg.pinv(matrix - taken)
        if before is not None and abs(deviance - before) / (abs(deviance) + 0.1) < CONVERGED:
            break
        before = deviance
        step = inverse @ (score - taken_score)
        beta = beta + step
        moved = F.aggregate(
            F.zip_with("a", F.array(*[F.lit(float(x)) for x in step]), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y
        )
        after = durable(
            effects.join(levels, "level").select(
                "level", (F.col("effect") + (F.col("y") - F.col("fitted") - moved) / F.col("fitted")).alias("effect")
            ),
            "effects",
        )
        discard(effects, levels)
        effects = after
    importance = _z_values(rows, wide, effects, levels, columns, beta, inverse)
    return DemandModel(model, POISSON_LABEL, importance, _fit_metrics(model.transform(rows)))


def _narrow_effects(known: dict[str, list[str]], columns: list, beta: np.ndarray) -> dict[str, dict[str, float]]:
    found = {column: float(b) for column, b in zip(columns, beta)}
    return {c: {x: found.get((c, x), 0.0) for x in levels} for c, levels in known.items()}


def _z_values(
    rows: DataFrame, wide: str, effects: DataFrame, levels: DataFrame, columns: list, beta: np.ndarray, inverse: np.ndarray
) -> DataFrame:
    """Variable and absolute z; those of the wide factor are computed where its levels lie, against its first level."""
    base = effects.join(levels, "level").orderBy("level").first()
    base_u, base_fitted, base_effect = np.array(base["a"]) / base["fitted"], base["fitted"], base["effect"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                fitted = batch["fitted"].to_numpy()
                u = np.stack(batch["a"].to_numpy()) / fitted[:, None] - base_u
                variance = 1 / fitted + 1 / base_fitted + np.einsum("ij,jk,ik->i", u, inverse, u)
                z = np.abs(batch["effect"].to_numpy() - base_effect) / np.sqrt(variance)
                yield pd.DataFrame({"Variable": wide + "_" + batch["level"], "Importance": z})

    others = effects.join(levels, "level").filter(F.col("level") != base["level"])
    of_wide = others.mapInPandas(run, "Variable string, Importance double")
    pairs = [
        (name if level is None else f"{name}_{level}", abs(float(b)) / float(np.sqrt(inverse[i, i])) if inverse[i, i] > 0 else 0.0)
        for i, ((name, level), b) in enumerate(zip(columns, beta))
    ]
    narrow = rows.sparkSession.createDataFrame(pairs, "Variable string, Importance double")
    return of_wide.unionByName(narrow).orderBy(*desc("Importance"), *asc("Variable"))


@dataclass(frozen=True)
class Mean:
    value: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


def train_mean(rows: DataFrame) -> DemandModel:
    """The mean quantity for everything, where no other model could be fitted."""
    total = rows.agg(F.sum(F.col("weight") * F.col("Quantity")), F.sum("weight")).first()
    fitted = Mean(float(total[0] / total[1]))
    return DemandModel(fitted, MEAN_LABEL, _importance(rows, []), _fit_metrics(fitted.transform(rows)))


def train_demand(df: DataFrame, method: str = "forest") -> DemandModel | None:
    """Train on sales records; None when there is no complete one.

    A model that cannot be fitted gives way to the next: forest, log-linear model, mean.
    """
    rows = model_rows(df)
    if rows.isEmpty():
        return None
    chain = {"forest": [train_forest, train_poisson], "poisson": [train_poisson], "mean": []}[method]
    for train in chain:
        try:
            return train(rows)
        except (ValueError, np.linalg.LinAlgError, PySparkException, Py4JJavaError) as problem:
            log.warning("%s failed, the next model follows: %s", train.__name__, problem)
    return train_mean(rows)


def fitted_totals(df: DataFrame, model: DemandModel) -> DataFrame:
    """(Factor, Level, Lines, Observed, Fitted): lines and total quantity of each level, as sold and as fitted."""
    rows = model_rows(df)
    scored = model.fitted.transform(rows)
    level = F.explode(F.array(*[F.struct(F.lit(c).alias("Factor"), F.col(c).alias("Level")) for c in FACTORS]))
    return scored.select(level.alias("at"), "weight", "Quantity", "prediction").groupBy("at.Factor", "at.Level").agg(
        F.sum("weight").cast("long").alias("Lines"),
        F.sum(F.col("weight") * F.col("Quantity")).alias("Observed"),
        F.sum(F.col("weight") * F.col("prediction")).alias("Fitted"),
    )


def score_demand(model: DemandModel, known: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Predicted quantity and result text per scenario (Category, Price, Region, Month).

    Scenarios whose category, region or month never occurred in ``known`` (the training
    sales) get NULL and the failure text; each factor's levels are joined as distinct keys.
    """
    checked = scenarios.withColumns(
        {"Price": F.col("Price").cast("double"), "Month": F.col("Month").cast("string")}
    )
    columns = checked.columns
    is_known = F.col("Price").isNotNull()
    for c in FACTORS:
        levels = known.select(F.col(c).cast("string").alias(c)).na.drop().distinct().withColumn(f"__{c}", F.lit(True))
        checked = checked.join(levels, c, "left")
        is_known = is_known & F.coalesce(F.col(f"__{c}"), F.lit(False))
    checked = durable(checked.withColumn("is_known", is_known).select(*columns, "is_known"), "scenarios")
    ready = checked.filter("is_known").select(*columns).withColumn("Quantity", F.lit(0.0))
    scored = model.fitted.transform(ready).select(*columns, F.col("prediction").alias("Predicted_Quantity"))
    unknown = checked.filter(~F.col("is_known")).select(
        *columns, F.lit(None).cast("double").alias("Predicted_Quantity")
    )
    text = F.when(
        F.col("Predicted_Quantity").isNotNull(),
        F.format_string(RESULT_TEXT, "Predicted_Quantity", F.lit(model.label)),
    ).otherwise(F.lit(FAILED_TEXT))
    return scored.unionByName(unknown).withColumn("Result", text)
