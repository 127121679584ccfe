"""Near-duplicate documents with a MinHash LSH forest.

Each distinct shingle set gets 128 minhashes and takes a place in several trees; a tree orders
the sets by another rotation of the signature. Sets that share a tree's first ``DEPTH`` values
form a region. A region of more than ``WIDTH`` sets is read deeper, each set down to the first
depth at which so few share its prefix; its most central members, those whose deep prefixes most
others share, are also held against every member, which joins most of what the deeper reading parts.
Neighbours that agree in enough of the 128 values are confirmed on their full sets. What is then
still outside a large region's main component is held against the whole region, so that every
pair of a region that could join two components has been compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.bloom import bloom_of, read_bloom
from ledgerline.llm.grouped import by_group, components, forest_edges
from ledgerline.llm.names import fresh
from ledgerline.llm.words import _FOLD, U, digest, mix, shingle_set, word_hashes
from ledgerline.session import TEXTS, discard, durable

VALUES = 128
DEPTH = 4
DEEPER = (6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
WIDTH = 240
CENTRAL = 16
MISSED = 1e-5
LINKABLE = "n > 0 AND doc_id IS NOT NULL"
WORD = r"[^\x20\x09-\x0D]"
_MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=U) * _FOLD) | U(1)


def tree_count(percent: int) -> int:
    """So many trees that a pair just at the threshold shares no region with chance 1e-5; ValueError if too many."""
    wanted = math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** DEPTH)) if percent < 100 else 1
    if wanted > VALUES // DEPTH:
        raise ValueError(f"{VALUES} values cannot find pairs of {percent} % surely enough")
    return wanted


def signature(values: np.ndarray) -> np.ndarray:
    """The upper halves of the least products with 128 odd multipliers."""
    least = np.full(VALUES, ~U(0))
    for start in range(0, len(values), 2048):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * values[None, start : start + 2048]).min(axis=1))
    return (least >> U(32)).astype(np.uint32)


def packed(sig: np.ndarray) -> bytes:
    """Byte planes, the lowest first: the first 128 bytes alone tell nearly all values apart."""
    return sig.view(np.uint8).reshape(VALUES, 4).T.tobytes()


def unpacked(column: pd.Series) -> np.ndarray:
    planes = np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), 4, VALUES)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]


def prefix_keys(signatures: np.ndarray, trees: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
    """(rows, depths): a hash of the first values of each row in its tree's order."""
    rows, out = np.arange(len(signatures)), []
    key = mix(trees.astype(U) + U(1))
    for level in range(max(depths)):
        key = mix(key * _FOLD + signatures[rows, (trees * DEPTH + level) % VALUES])
        if level + 1 in depths:
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def _sketches(docs: DataFrame, words: int, trees: int) -> DataFrame:
    every = np.arange(trees)

    def run(batches):
        for batch in batches:
            rows = []
            for hashes in word_hashes(batch["text"]):
                values = shingle_set(hashes, words)
                if len(values):
                    sig = signature(values)
                    keys = prefix_keys(np.broadcast_to(sig, (trees, VALUES)), every, (DEPTH,))[:, 0]
                    rows.append((len(values), *digest(values), keys, packed(sig)))
                else:
                    rows.append((0, 0, 0, None, None))
            n, d1, d2, keys, sig = zip(*rows) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "d1": d1, "d2": d2, "keys": keys, "sig": sig})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, n long, d1 long, d2 long, keys array<long>, sig binary"
    )


def _members(classes: DataFrame) -> DataFrame:
    """(key, id, n, tree, size): the sets of all regions of more than one."""
    exploded = classes.select("id", "n", F.posexplode("keys").alias("tree", "key"))
    regions = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return durable(exploded.join(regions, "key"), "regions")


def _blocks(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, id, root): at most about WIDTH + CENTRAL sets a block, those of one region or part of it.

    No set is linked yet: each is its own root. With the table that the blocks are read from.
    """
    small = members.filter(F.col("size") <= WIDTH).select(F.col("key").alias("block"), "id")
    large = members.filter(F.col("size") > WIDTH).join(classes.select("id", "sig"), "id")

    def deepen(batches):
        for batch in batches:
            if not len(batch):
                continue
            sig = unpacked(batch["sig"])
            keys = prefix_keys(sig, batch["tree"].to_numpy(dtype=np.int64), DEEPER)
            yield pd.DataFrame(
                {
                    "region": np.repeat(batch["key"].to_numpy(), len(DEEPER)),
                    "id": np.repeat(batch["id"].to_numpy(), len(DEEPER)),
                    "size": np.repeat(batch["size"].to_numpy(), len(DEEPER)),
                    "depth": np.tile(DEEPER, len(batch)),
                    "prefix": keys.ravel(),
                }
            )

    levels = durable(
        large.select("key", "tree", "id", "size", "sig").mapInPandas(
            deepen, "region long, id long, size long, depth int, prefix long"
        ),
        "levels",
    )
    shared = levels.groupBy("prefix").agg(F.count(F.lit(1)).alias("shared"))
    read = levels.join(shared, "prefix").groupBy("region", "id").agg(
        F.first("size").alias("size"),
        F.sum("shared").alias("central"),
        F.min(F.when(F.col("shared") <= WIDTH, F.struct("depth", "prefix"))).alias("at"),
    )
    read = durable(read.withColumn("parts", F.ceil(F.col("size") / WIDTH)), "read")
    # sets whose whole signatures too many share are dealt out; the central ones join the parts
    dealt = F.pmod(F.xxhash64("id"), F.col("parts"))
    deep = read.select(F.coalesce("at.prefix", F.xxhash64("region", F.lit("same"), dealt)).alias("block"), "id")
    spread = read.select(F.xxhash64("region", F.lit("central"), dealt).alias("block"), "id")
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.desc("central"), "id"))
    central = (
        read.withColumn("rank", rank).filter(F.col("rank") <= CENTRAL)
        .withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        .select(F.xxhash64("region", F.lit("central"), "part").alias("block"), "id")
    )
    every = small.unionByName(deep).unionByName(spread).unionByName(central).distinct()
    discard(levels)
    return every.withColumn("root", F.col("id")), read


def _apart(members: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(block, id, root): in each large region the sets outside its main component against all its sets.

    Sets are banded by their number of shingles so that those of bands further apart than one
    cannot link; a set outside meets its own band and both beside it. The two sides of a band are
    dealt into chunks of about WIDTH, and a block holds one chunk of each: two sets of a region
    that may link and have different roots meet in some block. Regions of one root give none.
    """
    known = roots.select(F.col("node").alias("id"), "root")
    width = max(-math.log(percent / 100), 0.01) * 1.0001
    rooted = durable(
        members.filter(F.col("size") > WIDTH).select("key", "id", F.floor(F.log("n") / width).alias("band"))
        .join(known, "id", "left").withColumn("root", F.coalesce("root", "id")),
        "rooted",
    )
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    rows = rooted.join(main.filter("roots > 1"), "key").withColumn("own", F.xxhash64("id"))
    outside = rows.filter("root <> main").withColumn("band", F.explode(F.expr("sequence(band - 1, band + 1)")))
    place = ["key", "band"]
    sides = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / WIDTH).alias("chunks")).join(
        outside.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / WIDTH).alias("others")), place
    )
    sides = durable(sides, "sides")
    whole = rows.join(sides, place).withColumn("other", F.explode(F.expr("sequence(0L, others - 1)"))).select(
        F.xxhash64(*place, F.pmod("own", "chunks"), "other").alias("block"), "id", "root"
    )
    outside = outside.join(sides, place).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(
        F.xxhash64(*place, "chunk", F.pmod("own", "others")).alias("block"), "id", "root"
    )
    return whole.unionByName(outside).distinct(), rooted, sides


def _candidates(blocks: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(part, id): sets of different roots whose signatures agree nearly as much as the threshold, chained per block."""
    spread = math.sqrt(percent / 100 * (1 - percent / 100) / VALUES)
    enough = math.floor(VALUES * (percent / 100 - 5 * spread))

    def agree(rows: pd.DataFrame) -> pd.DataFrame | None:
        if len(rows) < 2:
            return None
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint8).reshape(len(rows), VALUES)
        ids, n, roots = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["root"].to_numpy()
        if len(rows) == 2:
            linked = np.full((2, 2), (sig[0] == sig[1]).sum() >= enough)
        else:
            equal = np.zeros((len(rows), len(rows)), dtype=np.uint8)
            for value in sig.T:
                equal += value[:, None] == value[None, :]
            linked = equal >= enough
        linked &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
        linked &= roots[:, None] != roots[None, :]
        if not linked.any():
            return None
        a, b = forest_edges(ids, linked)
        sets: dict[int, list[int]] = {}
        for x, y in zip(a, b):
            sets.setdefault(x, [x]).append(y)
        return pd.DataFrame(
            [(digest(np.array(sorted(x), dtype=np.int64).view(U))[0], i) for x in sets.values() for i in x],
            columns=["part", "id"],
        )

    # the lowest byte of each value: equal values stay equal, and one in 256 others joins them
    rows = blocks.join(classes.select("id", "n", F.substring("sig", 1, VALUES).alias("sig")), "id")
    return by_group(rows, "block", agree, "part long, id long").distinct()


def _confirmed(parts: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): of each part the pairs that link it, found by comparing all its full sets."""

    def confirm(rows: pd.DataFrame) -> pd.DataFrame | None:
        ids, sets = [], []
        for i, d2, hashes in zip(rows["id"], rows["d2"], word_hashes(rows["text"])):
            values = shingle_set(hashes, words)
            if digest(values) == (i, d2) and i not in ids:  # a repeated doc_id may have other texts
                ids.append(i)
                sets.append(values)
        if len(ids) < 2:
            return None
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(codes.max() + 1, dtype=np.int64)
        linked = np.zeros((len(ids), len(ids)), dtype=bool)
        for x, (start, size) in enumerate(zip(starts, sizes)):
            own = codes[start : start + size]
            mark[own] = 1
            both = np.add.reduceat(mark[codes], starts)
            mark[own] = 0
            linked[x] = 100 * both >= percent * (sizes + size - both)
        a, b = forest_edges(np.array(ids), linked & ~np.eye(len(ids), dtype=bool))
        return pd.DataFrame({"a": a, "b": b})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = durable(parts.join(classes.select("id", "d2", "doc_id"), "id"), "wanted")
    ids = wanted.select(F.col("doc_id").alias("key")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(ids, ids.count()))

    @F.pandas_udf("boolean")
    def may_be_wanted(doc_ids: pd.Series) -> pd.Series:
        return pd.Series(read_bloom(shared).has(doc_ids.fillna(0).to_numpy(dtype=np.int64).view(U)))

    # texts that no part wants stay where they are; the others travel to their parts by the same plan at every size
    texts = texts.filter("doc_id IS NOT NULL").filter(may_be_wanted("doc_id"))
    rows = texts.join(wanted.hint("merge"), "doc_id").drop("doc_id")
    found = durable(by_group(rows, "part", confirm, "a long, b long"), "links", TEXTS)
    discard(wanted)
    return found


def _digests(text: Column, words: int) -> Column:
    """The digest of the shingle set of a text, as in the sketches."""

    @F.pandas_udf("d1 long, d2 long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [digest(shingle_set(hashes, words)) for hashes in word_hashes(texts)]
        return pd.DataFrame(rows, columns=["d1", "d2"], dtype="int64")

    return of(text)


def _groups(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sketches, groups): groups has d1, d2, doc_id, root and component_id of each distinct set.

    doc_id is the least that has the set; sets of one root are near duplicates.
    """
    sketches = durable(_sketches(docs, words, tree_count(percent)), "sketches", TEXTS)
    classes = durable(
        sketches.filter(LINKABLE).groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "keys", "sig"), "doc_id").alias("of"))
        .select(F.col("d1").alias("id"), "d2", "doc_id", "of.n", "of.keys", "of.sig"),
        "classes",
    )
    members = _members(classes)

    def links(blocks: DataFrame, *read: DataFrame) -> DataFrame:
        parts = durable(_candidates(blocks, classes, percent), "parts")
        discard(*read)
        found = _confirmed(parts, classes, docs, words, percent)
        discard(parts)
        return found

    first = links(*_blocks(members, classes))
    roots = durable(components(first), "roots")
    discard(first)
    if not members.filter(F.col("size") > WIDTH).isEmpty():
        more = links(*_apart(members, roots, percent))
        after = durable(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
        discard(roots, more)
        roots = after
    discard(members)
    linked = classes.select("id", "d2", "doc_id").join(roots, F.col("id") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(least, "root").select(F.col("id").alias("d1"), "d2", "root", F.col("component_id").alias("linked_id"))
    groups = classes.select(F.col("id").alias("d1"), "d2", "doc_id").join(linked, ["d1", "d2"], "left").select(
        "d1", "d2", "doc_id", F.coalesce("root", "d1").alias("root"), F.coalesce("linked_id", "doc_id").alias("component_id")
    )
    return sketches, groups


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link whose sets of ``words``-word shingles have at least ``percent`` hundredths of
    their union in common; component_id is the least doc_id that links lead to. A text of fewer
    words is one shingle. Null, empty and blank texts have the empty set and link with nothing,
    nor does a row without doc_id (its component_id is null and it is kept). Rows that repeat a
    doc_id are documents of their own; only equal or linked sets join them. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    sketches, groups = _groups(docs, words, percent)
    out = (
        sketches.filter(LINKABLE).select("doc_id", "n", "d1", "d2").join(groups.drop("doc_id", "root"), ["d1", "d2"])
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(
            sketches.filter(f"NOT ({LINKABLE})")
            .select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        )
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each near-duplicate group, one with the least doc_id.

    All columns stay. Each row is judged by its own set, whatever other rows repeat its doc_id; of
    rows equal in doc_id and set the one with the least text stays. Rows without words and rows
    with a null doc_id are in no group and all stay.
    """
    sketches, groups = _groups(docs, words, percent)
    firsts = groups.groupBy("root").agg(F.min(F.struct("doc_id", "d1", "d2")).alias("first")).select("first.*")
    firsts = durable(firsts, "firsts")
    place = ["doc_id", "d1", "d2"]
    sets = sketches.filter("doc_id IS NOT NULL").groupBy(*place, "n").agg(F.count(F.lit(1)).alias("rows"))
    stay = F.when(F.col("n") == 0, F.col("rows")).when(F.col("first"), 1).otherwise(0)
    ids = sets.join(firsts.withColumn("first", F.lit(True)), place, "left").groupBy("doc_id").agg(
        F.sum("rows").alias("rows"), F.sum(stay).alias("stay")
    )
    # most ids that lose a row lose all; only rows of the others have their sets computed again
    losing = durable(ids.filter("stay < rows").select("doc_id", (F.col("stay") > 0).alias("mixed")), "losing")
    mixed = losing.filter("mixed").select("doc_id")
    row = fresh(docs, "row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    rows = rows.withColumn("doc_id", F.col(f"{row}.doc_id").cast("long")).withColumn("text", F.col(f"{row}.text").cast("string"))
    whole = rows.join(losing.select("doc_id"), "doc_id", "left_anti")
    some = rows.join(mixed, "doc_id")
    worded = F.coalesce("text", F.lit("")).rlike(WORD)
    own = some.filter(worded).withColumn("own", _digests(F.col("text"), words))
    own = own.select(row, "doc_id", "text", "own.d1", "own.d2").join(firsts.join(mixed, "doc_id", "left_semi"), place)
    number = F.row_number().over(W.partitionBy(*place).orderBy("text"))
    own = own.withColumn("number", number).filter("number = 1")
    parts = [x.select(row) for x in (whole, some.filter(~worded), own)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(f"{row}.*")
