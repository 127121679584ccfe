"""Near-duplicate vectors with spherical-cap filters.

Filter directions are structured random product codes: a code rotates the space, cuts the
dimensions into two halves with random codewords each, and every pair of codewords is a
direction. A unit vector belongs to the caps of all directions that exceed its own threshold, its
``LIST``-th largest product in the code; the largest half products give them without trying every
direction. (One threshold for all vectors leaves some without any direction: measured, 6 % of
pairs at a cosine of 0.99 were missed.) Vectors that share a cap are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.grouped import by_group, components, forest_edges
from ledgerline.llm.vectors import cosines, unit, with_vectors
from ledgerline.session import durable

WIDTH = 512
#: at least so many codes; more where a larger codebook makes its caps thinner
CODES = 8
MISSED = 1e-5
TRIED = 512
LIST = 4
TARGET = 64
SEED = 20_117
# products of single floats this near the threshold are decided on the doubles
UNSURE = 2e-6
CLOSE = 1e-9
PAIRS = [(i, j) for i in range(LIST) for j in range(LIST) if (i + 1) * (j + 1) <= LIST]


def code_size(rows: int) -> int:
    """Codewords per half, so that a cap holds about ``TARGET`` unrelated vectors at any size."""
    return max(LIST, math.ceil(math.sqrt(rows * LIST / TARGET)))


def product_codes(dims: int, words: int, count: int = CODES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each code its two lists of codewords over all dimensions, the same in every task."""
    draw = np.random.default_rng([SEED, dims, words])
    codes = []
    for _ in range(count):
        turn, _ = np.linalg.qr(draw.standard_normal((dims, dims)))
        half = (dims + 1) // 2
        codes.append(
            (turn[:, :half] @ draw.standard_normal((half, words)), turn[:, half:] @ draw.standard_normal((dims - half, words)))
        )
    return codes


def list_decode(x: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(rows, codes * LIST): numbers of the directions whose caps hold each row.

    The best sums of two sorted lists come from ranks i and j with (i + 1) (j + 1) <= LIST.
    """
    out = []
    for number, (one, two) in enumerate(codes):
        words, best = one.shape[1], []
        for half in (x @ one, x @ two):
            top = np.argpartition(-half, LIST - 1, axis=1)[:, :LIST]
            value = np.take_along_axis(half, top, axis=1)
            order = np.argsort(-value, axis=1, kind="stable")
            best.append((np.take_along_axis(value, order, axis=1), np.take_along_axis(top, order, axis=1)))
        (v1, w1), (v2, w2) = best
        sums = np.stack([v1[:, i] + v2[:, j] for i, j in PAIRS], axis=1)
        names = np.stack([w1[:, i] * words + w2[:, j] for i, j in PAIRS], axis=1)
        chosen = np.argsort(-sums, axis=1, kind="stable")[:, :LIST]
        out.append(np.take_along_axis(names, chosen, axis=1) + number * words * words)
    return np.concatenate(out, axis=1)


def code_count(dims: int, words: int, cosine: float) -> int:
    """So many codes that a pair just at the threshold shares no cap with chance ``MISSED`` at most.

    The chance to share a cap of a code depends only on the cosine, the dimensions and the
    codebook, and codes are independent; ``TRIED`` random pairs in each of ``CODES`` codes give it,
    less three standard errors. The rarer the caps of a low threshold are shared, the more codes.
    """
    if dims < 2:
        return CODES
    draw, shared, tried = np.random.default_rng([SEED, dims, words, 1]), 0, CODES * TRIED
    for code in product_codes(dims, words):
        for _ in range(0, TRIED, 128):
            x, z = unit(draw.standard_normal((128, dims))), draw.standard_normal((128, dims))
            z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
            y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
            one, two = list_decode(x, [code]), list_decode(y, [code])
            shared += int((one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).sum())
    chance = shared / tried
    chance = min(max(chance - 3 * math.sqrt(chance * (1 - chance) / tried), 1 / tried), 1 - 1 / tried)
    return max(CODES, math.ceil(math.log(MISSED) / math.log1p(-chance)))


def _links(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Matrix of the pairs with at least the cosine; what is too close to call is summed anew."""
    product = x @ y.T
    linked = product >= cosine
    for i, j in zip(*np.nonzero(np.abs(product - cosine) <= CLOSE)):
        linked[i, j] = cosines(x[i : i + 1], y[j : j + 1])[0] >= cosine
    return linked


def _unpacked(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), -1)


def _chunk_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Deal each key's rows into chunks of about WIDTH and every pair of chunks into a block.

    Adds block, part and apart: in a block with apart, part 0 is compared with part 1; in one
    without, its rows with each other. Keys of up to WIDTH rows are one block.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = rows.join(sizes, key)
    chunks = F.ceil(F.col("size") / WIDTH)
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("block", F.xxhash64(key, low, high)).withColumn(
        "part", (F.col("own") > F.col("other")).cast("int")
    ).withColumn("apart", F.col("own") != F.col("other"))


def near_vectors(
    embeddings: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least ``cosine`` link; n_links counts the other rows linked
    directly, component_id is the least id that links lead to. Vectors that are null, empty, zero
    or hold null or non-finite components, and rows without id, link with nothing (no links,
    themselves as component); vectors of other lengths never link. Rows that repeat an id are
    vectors of their own. Other columns are not read. An empty table gives no rows.

    Equal vectors are compared once. The filters find the components; then all vectors of a
    component are compared in blocks, so a link that the filters missed inside one still counts.
    """
    vectors = durable(with_vectors(embeddings, id_column, vector_column), "vectors")

    def normal(batches):
        for batch in batches:
            if len(batch):
                rows = [unit(np.asarray(v, dtype=np.float64)[None])[0].tobytes() for v in batch["v"]]
                yield pd.DataFrame({"vec_id": batch["id"], "dims": [len(r) // 8 for r in rows], "x": rows})

    units = vectors.filter("usable").select("id", "v").mapInPandas(normal, "vec_id long, dims int, x binary")
    units = durable(units.withColumn("id", F.xxhash64("x")), "units")
    classes = durable(
        units.groupBy("id", "x", "dims").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    of_dims = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    words = code_size(sum(of_dims.values()))
    counts = {dims: code_count(dims, words, cosine) if rows > 1 else CODES for dims, rows in of_dims.items()}

    def decode(batches):
        codes: dict[int, list] = {}
        for batch in batches:
            for dims, rows in batch.groupby("dims"):
                if dims not in codes:
                    codes[dims] = product_codes(dims, words, counts[dims])
                x = _unpacked(rows["x"])
                short = [v.tobytes() for v in x.astype(np.float32)]
                caps = list_decode(x, codes[dims])
                yield pd.DataFrame({"id": rows["id"], "dims": rows["dims"], "caps": list(caps), "y": short})

    found = classes.select("id", "dims", "x").mapInPandas(decode, "id long, dims int, caps array<long>, y binary")
    found = durable(found, "caps").withColumn("cap", F.explode("caps")).select(
        F.xxhash64("dims", "cap").alias("cap"), "id", "y"
    )

    def link(rows: pd.DataFrame) -> pd.DataFrame | None:
        y, ids = _unpacked(rows["y"], np.float32), rows["id"].to_numpy()
        product = y @ y.T
        np.fill_diagonal(product, -2.0)
        if product.max() < cosine - UNSURE:
            return None
        a, b = forest_edges(ids, product > cosine + UNSURE)
        i, j = np.nonzero(np.triu(np.abs(product - cosine) <= UNSURE))
        return pd.DataFrame(
            {"a": [*a, *ids[i]], "b": [*b, *ids[j]], "sure": [True] * len(a) + [False] * len(i)}
        )

    blocks = _chunk_pairs(found, "cap").select("block", "id", "y")
    pairs = durable(by_group(blocks, "block", link, "a long, b long, sure boolean").distinct(), "links")

    def settle(batches):
        for batch in batches:
            if len(batch):
                yield batch.loc[cosines(_unpacked(batch["x"]), _unpacked(batch["z"])) >= cosine, ["a", "b"]]

    unsure = (
        pairs.filter("NOT sure").join(classes.select(F.col("id").alias("a"), "x"), "a")
        .join(classes.select(F.col("id").alias("b"), F.col("x").alias("z")), "b")
        .select("a", "b", "x", "z").mapInPandas(settle, "a long, b long")
    )
    roots = durable(components(pairs.filter("sure").select("a", "b").unionByName(unsure)), "roots")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        x, n = _unpacked(rows["x"]), rows["copies"].to_numpy(dtype=np.int64)
        if rows["apart"].iloc[0]:
            one = rows["part"].to_numpy() == 0
            linked = _links(x[one], x[~one], cosine)
            total = np.zeros(len(x), dtype=np.int64)
            total[one], total[~one] = linked @ n[~one], linked.T @ n[one]
        else:
            linked = _links(x, x, cosine)
            np.fill_diagonal(linked, False)
            total = linked @ n
        return pd.DataFrame({"id": rows["id"], "links": total})

    members = roots.select(F.col("node").alias("id"), "root").join(classes, "id")
    pairs = _chunk_pairs(members.select("root", "id", "x", "copies"), "root")
    links = by_group(
        pairs.select("block", "id", "x", "copies", "part", "apart"), "block", count, "id long, links long"
    ).groupBy("id").agg(F.sum("links").alias("links"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.select("id", "root").join(least, "root").join(links, "id").select("id", "component_id", "links")
    of_class = classes.select("id", "least", "copies").join(linked, "id", "left").select(
        "id",
        F.coalesce("component_id", "least").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    whole = units.select("vec_id", "id").join(of_class, "id").select("vec_id", "n_links", "component_id")
    alone = vectors.filter("NOT usable").select(
        F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    nameless = embeddings.filter(F.col(id_column).isNull()).select(
        F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("component_id"),
    )
    out = whole.unionByName(alone).unionByName(nameless)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
