"""Approximate nearest neighbours over learned partitions.

On a bounded sample the k-nearest-neighbour graph is cut into balanced partitions, and a small
network learns the partition of a vector from the partitions of its neighbours. Every row goes to
its most probable partition; a query goes to so many of its most probable ones as the held-out
half of the sample needed to find its neighbours, and is compared exactly with all their rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.vectors import cosines, stacked, unit, with_vectors
from ledgerline.session import durable

SAMPLE = 6000
NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 60
# neighbours found on the sample's held-out half; above the 0.9 asked for, for chance's sake
RECALL = 0.96
BLOCK = 4096
QUERIES = 1024
CLOSE = 1e-9


def neighbour_lists(x: np.ndarray, against: np.ndarray, k: int, own: bool) -> np.ndarray:
    out = []
    for start in range(0, len(x), 512):
        product = x[start : start + 512] @ against.T
        if own:
            product[np.arange(len(product)), start + np.arange(len(product))] = -2
        out.append(np.argpartition(-product, min(k, product.shape[1]) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Partition numbers 0..parts-1 of equal sizes that cut few neighbour edges.

    Halved again and again along the widest direction, then improved by swaps: a node asks for
    the partition that most of its neighbours are in, and the best askers of two partitions
    trade places as long as both moves together cut fewer edges.
    """
    part = np.zeros(len(x), dtype=np.int64)
    width = 1
    while width < parts:
        for p in range(width):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                shifted = x[rows] - x[rows].mean(axis=0)
                axis = np.linalg.svd(shifted.T @ shifted)[0][:, 0]
                upper = rows[np.argsort(shifted @ axis, kind="stable")[len(rows) // 2 :]]
                part[upper] = p + width
        width *= 2
    pairs = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], axis=1)] * 2)
    half = len(pairs) // 2
    pairs[half:] = pairs[half:, ::-1]
    for _ in range(12):
        near = np.zeros((len(x), width), dtype=np.int64)
        np.add.at(near, (pairs[:, 0], part[pairs[:, 1]]), 1)
        gain = near - near[np.arange(len(x)), part][:, None]
        moved = 0
        for p in range(width):
            for q in range(p + 1, width):
                a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
                a, b = a[np.argsort(-gain[a, q], kind="stable")], b[np.argsort(-gain[b, p], kind="stable")]
                n = min(len(a), len(b))
                trade = np.flatnonzero(gain[a[:n], q] + gain[b[:n], p] > 2)
                trade = trade[: max(1, len(trade) // 4)] if len(trade) else trade
                part[a[trade]], part[b[trade]] = q, p
                moved += len(trade)
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer over unit vectors; scores partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, seed: int = 7) -> Router:
    """Cross entropy with the share of a row's neighbours in each partition, by Adam."""
    draw = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    params = [draw.standard_normal((d, HIDDEN)), np.zeros(HIDDEN),
              draw.standard_normal((HIDDEN, p)) / np.sqrt(HIDDEN), np.zeros(p)]
    first, second = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    step = 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            hidden = np.tanh(x[rows] @ params[0] + params[1])
            logits = hidden @ params[2] + params[3]
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (odds / odds.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (error @ params[2].T) * (1 - hidden**2)
            grads = [x[rows].T @ back + 1e-4 * params[0], back.sum(axis=0),
                     hidden.T @ error + 1e-4 * params[2], error.sum(axis=0)]
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (
                    np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
                )
    return Router(*params)


def fit_router(sample: np.ndarray, k: int, partitions: int, recall: float) -> Router:
    """Partition and train on all sampled unit vectors, then settle the number of probes.

    Sampled vectors are routed by the network, so the measured recall is that of the whole way;
    queries of the measurement are vectors the network did not learn from.
    """
    learn, tried = sample[: max(1, len(sample) * 5 // 6)], sample[len(sample) * 5 // 6 :]
    graph = neighbour_lists(learn, learn, min(NEIGHBOURS, max(1, len(learn) - 1)), own=True)
    part = balanced_cut(learn, graph, partitions)
    width = max(partitions, int(part.max()) + 1)
    target = np.zeros((len(learn), width))
    np.add.at(target, (np.repeat(np.arange(len(learn)), graph.shape[1]), part[graph].ravel()), 1)
    target[np.arange(len(learn)), part] += graph.shape[1] / 2
    router = train_router(learn, target / target.sum(axis=1, keepdims=True))
    router.probes = width
    if len(tried) and len(learn) >= k:
        home = router.scores(learn).argmax(axis=1)
        truth = home[neighbour_lists(tried, learn, k, own=False)]
        rank = np.argsort(np.argsort(-router.scores(tried), axis=1, kind="stable"), axis=1, kind="stable")
        needed = np.take_along_axis(rank, truth, axis=1)
        share = [(needed < m).mean() for m in range(1, width + 1)]
        router.probes = 1 + int(np.argmax(np.array(share) >= recall))
    return router


def _best(rows: np.ndarray, vecs: np.ndarray, q: np.ndarray, x: np.ndarray, k: int, qid: np.ndarray) -> pd.DataFrame:
    """The k best of ``vecs`` for each query by exact cosine, then smaller id; never its own id."""
    product = q @ x.T
    product[qid[:, None] == vecs[None, :]] = -3
    keep = min(k, len(vecs))
    floor = np.partition(product, -keep, axis=1)[:, -keep] - CLOSE
    i, j = np.nonzero((product >= floor[:, None]) & (product > -2))
    frame = pd.DataFrame({"query": rows[i], "query_id": qid[i], "vec_id": vecs[j], "score": cosines(q[i], x[j])})
    frame = frame.sort_values(["query", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    frame = frame.drop_duplicates(["query", "vec_id"])
    return frame[frame.groupby("query").cumcount() < k]


def nearest(
    embeddings: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 5,
    recall: float = RECALL,
    sample_rows: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``is_query`` selects.

    ``is_query`` makes a condition of the vec_id column. Nearness is the cosine in doubles, ties go to the
    smaller vec_id, a row's own id is never its neighbour; all candidates are returned if there
    are fewer than k. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without id, take no part; vectors of other lengths are searched apart. Of rows that
    repeat an id the best counts, once. Other columns are not read. An empty table gives no rows.

    Partitions and network are fitted on at most ``sample_rows`` vectors of each length (a hash of
    the id chooses them), or 64 for each partition; there is a partition for every 65,536 rows,
    but at least 16 and at most 256. Every row is indexed. Large partitions are dealt into blocks
    of about 4096 rows and queries into chunks of 1024.
    """
    rows = durable(
        with_vectors(embeddings, "vec_id", "embedding").filter("usable")
        .select("id", "v", F.size("v").alias("dims"), F.coalesce(is_query(F.col("id")), F.lit(False)).alias("asks")),
        "vectors",
    )
    routers = {}
    for dims, count in [tuple(r) for r in rows.groupBy("dims").count().collect()]:
        partitions = min(256, max(16, 1 << math.ceil(math.log2(count / 65_536)) if count > 65_536 else 16))
        wanted = max(sample_rows, 64 * partitions)
        share = int(min(1.0, 1.3 * wanted / count) * (1 << 30))
        spot = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
        sample = rows.filter((F.col("dims") == dims) & (spot <= share)).orderBy(spot, "id").select("v").limit(wanted)
        x = np.unique(unit(stacked(sample.toPandas()["v"])), axis=0)
        routers[dims] = fit_router(np.random.default_rng(3).permutation(x), k, partitions, recall)

    def place(batches):
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                x = unit(stacked(part["v"]))
                scores = routers[dims].scores(x)
                ranked = np.argsort(-scores, axis=1, kind="stable")[:, : routers[dims].probes]
                yield pd.DataFrame(
                    {"id": part["id"], "dims": part["dims"], "asks": part["asks"], "home": ranked[:, 0],
                     "probes": list(ranked), "x": [v.tobytes() for v in x]}
                )

    placed = durable(
        rows.mapInPandas(place, "id long, dims int, asks boolean, home int, probes array<int>, x binary"), "placed"
    )
    sizes = placed.groupBy("dims", F.col("home").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    asked = placed.filter("asks").dropDuplicates(["id", "x"]).select("dims", F.explode("probes").alias("part"), "id", "x")
    loads = asked.groupBy("dims", "part").agg(F.count(F.lit(1)).alias("queries"))
    # both are at most one row per partition of the index
    shape = F.broadcast(sizes.join(loads, ["dims", "part"]).select(
        "dims", "part",
        F.ceil(F.col("rows") / BLOCK).alias("blocks"), F.ceil(F.col("queries") / QUERIES).alias("chunks"),
    ))
    key = F.xxhash64("dims", "part", "block", "chunk").alias("cell")
    left = (
        asked.join(shape, ["dims", "part"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
        .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select(key, F.col("id").alias("query_id"), F.xxhash64("id", "x").alias("query"), F.col("x").alias("q"))
    )
    right = (
        placed.withColumnRenamed("home", "part").join(shape, ["dims", "part"])
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        .withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        .select(key, F.col("id").alias("vec_id"), F.col("x").alias("y"))
    )

    def compare(asks: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(vectors):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})
        q = np.frombuffer(b"".join(asks["q"])).reshape(len(asks), -1)
        x = np.frombuffer(b"".join(vectors["y"])).reshape(len(vectors), -1)
        ids, names, vecs = asks["query_id"].to_numpy(), asks["query"].to_numpy(), vectors["vec_id"].to_numpy()
        return pd.concat(
            [_best(names[s : s + 256], vecs, q[s : s + 256], x, k, ids[s : s + 256]) for s in range(0, len(q), 256)]
        )

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(
        compare, "query long, query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

