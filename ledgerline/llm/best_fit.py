"""Best-fit packing of documents into bins under conflicts.

Documents longer than a bin are cut into full pieces and a rest. Pieces are dealt into shards of
a bounded size; within one, longest first, each goes into the bin with the least room that still
holds it and has no conflict. Bins are kept in the order of their room and carry bitmaps of the
duplicate clusters and of the sources in them; the search starts at the tightest bin that is
large enough and goes on until the bitmaps allow one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import durable

SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
CAPACITY = 4096
PER_SOURCE = 6
SHARD_ROWS = 4096


def items_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, size) of documents: size in words, cluster by the words alone.

    Written once: the text is read here and never again. Texts without words share no cluster.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, SPACE, " "))))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", "source", F.when(size > 0, same).alias("cluster"), size.alias("size"))
    return durable(rows, "items")


class Packer:
    """The bins of one shard. ``put`` gives the number of the bin and the place in it."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        # of each bin, a bitmap for each count up to the limit: the sources that reached it
        self.sources: list[list[int]] = []
        self.held: list[int] = []
        self.bits: dict[str, dict] = {}

    def bit(self, kind: str, value) -> int:
        known = self.bits.setdefault(kind, {})
        return 1 << known.setdefault(value, len(known))

    def put(self, size: int, source, cluster) -> tuple[int, int]:
        alike = 0 if cluster is None else self.bit("cluster", cluster)
        origin = self.bit("source", source)
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not (self.clusters[number] & alike or self.sources[number][-1] & origin):
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.held)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.held.append(0)
        self.clusters[number] |= alike
        for plane, bitmap in enumerate(self.sources[number]):
            if not bitmap & origin:
                self.sources[number][plane] |= origin
                break
        if room > size:  # a bin without room takes only what has no words, and no more is sought
            insort(self.order, (room - size, number))
        place = self.held[number]
        self.held[number] += 1
        return number, place


def pack(
    items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Pack rows (doc_id, source, cluster, size) into bins of ``capacity`` words.

    One row per piece: doc_id, piece (from 0), first_word, words, bin_id, place, source. A bin
    holds no two pieces of one cluster (null clusters never conflict) and at most ``per_source`` of
    one source, null being a source of its own; no bin holds more words than ``capacity``. Null and
    negative sizes count as 0; a document without words is one piece of 0 words. Pieces that fill
    a bin get one of their own. Repeated rows are packed each. Other columns are not read. An empty
    table gives no rows.

    Shards get about ``shard_rows`` documents each by a hash, at any table size; a shard is streamed in
    order of size, so a task holds its bins only.
    """
    count = items.count()
    shards = max(1, -(-count // shard_rows))
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("long").alias("cluster"), size.alias("size"),
    )
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "size"), F.lit(shards)))
    whole = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1).cast("long"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    rows = rows.withColumn("first_word", F.col("piece") * capacity).withColumn(
        "words", F.least(F.col("size") - F.col("first_word"), F.lit(capacity).cast("long"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer = None, None
        for batch in batches:
            bins, places = [], []
            clusters = [None if pd.isna(c) else int(c) for c in batch["cluster"]]
            for own, words, source, cluster in zip(batch["shard"], batch["words"], batch["source"], clusters):
                if own != shard:
                    shard, packer = own, Packer(capacity, per_source)
                number, place = packer.put(int(words), source, cluster)
                bins.append((int(own) << 32) + number)
                places.append(place)
            out = batch[["doc_id", "piece", "first_word", "words", "source"]].copy()
            out["bin_id"], out["place"] = bins, places
            yield out

    longest = [F.desc("words"), "doc_id", "piece", "source", "cluster"]
    dealt = rows.select("shard", "doc_id", "piece", "first_word", "words", "source", "cluster").repartition("shard")
    return dealt.sortWithinPartitions("shard", *longest).mapInPandas(
        run, "doc_id long, piece long, first_word long, words long, source string, bin_id long, place int"
    )
