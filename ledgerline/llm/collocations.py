"""Phrase collocations from counts kept in weighted automata.

Phrases are counted in shards: a task holds the counts of what it has read, sorts them and builds an
automaton for each range of phrases; the automata of a range are united, weights summed. What
occurs too seldom never gets that far. A phrase is not more frequent than its parts, so before
phrases of m words are counted, a pass counts 64-bit hashes of those whose two parts of m - 1 words
were frequent; a Bloom filter of bounded size tells a task which hashes were. Hashes only ever
admit too much: the final counts are those of the words themselves. The counts of a phrase's parts
are read by composing an automaton of the wanted parts with the range that holds them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.bloom import bloom_of, read_bloom
from ledgerline.llm.count_automata import Automaton, Key, build, union
from ledgerline.llm.grouped import by_group
from ledgerline.llm.words import _FOLD, _LOWER, U, mix
from ledgerline.session import batches_of, decoded_at_once, discard, durable

LONGEST = 4
#: lengths of phrases whose hashes one pass counts; those of the last pass share what filters them
LEVELS = ((1,), (2,), (3, 4))
#: bytes of text that are split at once; longer texts are read in parts that overlap by three words
CHUNK = 1 << 19
#: bytes of an Arrow batch and rows that the parquet reader decodes at once: both hold whole texts in the JVM
BATCH, DECODED = 1 << 20, 1024
#: hashes that a task counts, and phrases that it holds, before it hands them on; hashes handed on at once
HELD_HASHES, HELD_PHRASES, HANDED = 1_500_000, 600_000, 50_000
#: phrases of a range, as far as known, and words and phrases sampled to cut the ranges
RANGE, MAX_RANGES, SAMPLE_WORDS, SAMPLE_PHRASES = 10_000, 4096, 2_000_000, 20_000
UNKNOWN = "und"

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_GAP = re.compile(rb"[\x09-\x0D .,;:!?]")
# Words are joined by byte 0; their own bytes 0 to 8 move up by one, as 9 is never theirs. So joined
# phrases sort as lists of words do.
JOINT = b"\x00"
_UP = bytes([*range(1, 10), *range(9, 256)])
_DOWN = bytes([0, *range(9), *range(10, 256)])
_TABLE = bytes(_UP[byte] for byte in _LOWER)
_VALUE = _LOWER.astype(U) + U(1)
_SPACED = bytes(0 if byte == 32 else up for byte, up in enumerate(_UP))
_BASE = 0x100000001B3


def powers(base: int, count: int) -> np.ndarray:
    return np.concatenate((np.ones(1, dtype=U), np.cumprod(np.full(count, base, dtype=U))))


_POWERS = {base: powers(base, CHUNK) for base in (_BASE, pow(_BASE, -1, 1 << 64))}


def power(inverse: bool, count: int) -> np.ndarray:
    """Powers of the base or its inverse modulo 2^64, more of them for a longer text."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    return _POWERS[base] if count < len(_POWERS[base]) else powers(base, count)


class Chunk:
    """Words of some bytes: their hashes, places and pieces; the first ``carried`` were read before."""

    def __init__(self, data: bytes, ends: list[int], langs: list[str], carried: int = 0):
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = _KIND[raw]
        edges = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
        self.starts, self.stops = edges[::2], edges[1::2]
        self.langs, self.carried = langs, carried
        if not len(self.starts):
            return
        # a word's hash is the polynomial of its bytes: a difference of running sums, moved to its start
        sums = _VALUE[raw]
        sums *= power(False, len(raw))[: len(raw)]
        np.cumsum(sums, out=sums)
        before = np.where(self.starts > 0, sums[self.starts - 1], U(0))
        hashes = (sums[self.stops - 1] - before) * power(True, len(raw))[self.starts]
        self.hashes = mix(hashes ^ mix((self.stops - self.starts).astype(U) * _FOLD))
        self.pieces = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.prefixes = [lang.encode().hex().encode() + JOINT for lang in langs]
        self.text = data.translate(_TABLE)
        self.lang = np.searchsorted(np.array(ends), self.starts, side="right")
    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, hashes of the runs of m words that start at each word, whether such a run is to be counted)."""
        if not len(self.starts):
            return
        of_lang = np.array([hash_text(lang) for lang in self.langs], dtype=U)
        key = mix(self.hashes + of_lang[self.lang])
        at = np.arange(len(key))
        yield 1, key, at >= self.carried
        for m in range(2, LONGEST + 1):
            if len(key) < 2:
                return
            key = mix(key[:-1] * _FOLD + self.hashes[m - 1 :] + U(m))
            here = at[: len(key)]
            yield m, key, (self.pieces[here] == self.pieces[m - 1 :]) & (here + m - 1 >= self.carried)

    def phrase(self, at: int, m: int) -> bytes:
        """The lang, in hexadecimal digits, and the words, joined."""
        words = [self.text[a:b] for a, b in zip(self.starts[at : at + m].tolist(), self.stops[at : at + m].tolist())]
        return self.prefixes[self.lang[at]] + JOINT.join(words)

    def phrases(self, rows: np.ndarray, m: int) -> Iterator[bytes]:
        """The phrases of m words that start at these words; most have single spaces between them."""
        ends = self.stops[rows + m - 1]
        for at, start, end, lang in zip(rows.tolist(), self.starts[rows].tolist(), ends.tolist(), self.lang[rows].tolist()):
            cut = self.text[start:end].replace(b" ", JOINT)
            yield self.prefixes[lang] + cut if cut.count(JOINT) == m - 1 and b"\t" not in cut else self.phrase(at, m)


def plain(words: Iterable[bytes]) -> str:
    """Words of a phrase as text, with spaces."""
    return b" ".join(words).translate(_DOWN).decode("utf-8", "replace")


def key_of(lang: str, part: str) -> Key:
    return (lang.encode().hex().encode(), *part.encode().translate(_SPACED).split(JOINT))


def hash_text(text: str) -> int:
    h = 0
    for byte in text.encode():
        h = (h * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def chunks(batch: pd.DataFrame) -> Iterator[Chunk]:
    """The texts of a batch in bounded pieces; a null text is empty, a null lang ``und``."""
    group, ends, langs, held = [], [], [], 0
    for text, lang in zip(batch["text"], batch["lang"]):
        if not isinstance(text, str) or not text:
            continue
        lang = lang if isinstance(lang, str) else UNKNOWN
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > CHUNK:
            yield from _parts(data, lang)
            continue
        group.append(data)
        langs.append(lang)
        held += len(data) + 1
        ends.append(held)
        if held >= CHUNK:
            yield Chunk(b"\n".join(group), ends, langs)
            group, ends, langs, held = [], [], [], 0
    if group:
        yield Chunk(b"\n".join(group), ends, langs)


def _parts(data: bytes, lang: str) -> Iterator[Chunk]:
    at = end = carried = 0
    while end < len(data):
        gap = _GAP.search(data, max(at + CHUNK, end + 1))
        end = gap.start() if gap else len(data)
        chunk = Chunk(data[at:end], [end - at + 1], [lang], carried)
        yield chunk
        carried = min(LONGEST - 1, len(chunk.starts))
        at = at + int(chunk.starts[-carried]) if carried else end


class Held:
    """Hashes waiting to be counted, in one array that is sorted where it stands."""

    def __init__(self, room: int):
        self.keys, self.size = np.empty(room, dtype=U), 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take all of these hashes; what ``counts`` gives whenever the array is full."""
        while len(keys):
            part = keys[: len(self.keys) - self.size]
            self.keys[self.size : self.size + len(part)] = part
            self.size += len(part)
            keys = keys[len(part) :]
            if self.size == len(self.keys):
                yield from self.counts()

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct hashes with their counts, some at once; none is held afterwards."""
        keys, self.size, at = self.keys[: self.size], 0, 0
        keys.sort()
        while at < len(keys):
            last = keys[min(at + HANDED, len(keys)) - 1]
            end = int(np.searchsorted(keys, last, side="right"))
            part = keys[at:end]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            yield part[first], np.diff(first, append=len(part))
            at = end


def _count_hashes(docs: DataFrame, lengths: tuple[int, ...], shorter) -> DataFrame:
    """(key, lang, n): hashes of phrases of these lengths whose parts are frequent; of single words also their number by lang.

    ``shorter`` holds the frequent parts of one word less than the least of the lengths.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = read_bloom(shorter) if shorter is not None else None
        held, totals = Held(HELD_HASHES), {}
        for batch in batches:
            for chunk in chunks(batch):
                good = None
                for length, keys, counted in chunk.keys():
                    if length == lengths[0] - 1:
                        good = bloom.has(keys)
                    if length not in lengths:
                        continue
                    if good is not None:  # both parts, or all of them, are frequent
                        good = good[:-1] & good[1:]
                        counted = counted & good
                    for key, n in held.add(keys[counted]):
                        yield pd.DataFrame({"key": key.view(np.int64), "lang": None, "n": n})
                    if length == 1:
                        words = np.bincount(chunk.lang[counted], minlength=len(chunk.langs))
                        for lang, n in zip(chunk.langs, words.tolist()):
                            totals[lang] = totals.get(lang, 0) + n
                    if length == lengths[-1]:
                        break
        for key, n in held.counts():
            yield pd.DataFrame({"key": key.view(np.int64), "lang": None, "n": n})
        if totals:
            yield pd.DataFrame({"key": None, "lang": list(totals), "n": list(totals.values())}).astype({"key": "Int64"})

    return docs.mapInPandas(run, "key long, lang string, n long")


class Counts:
    """Counts of the phrases that a task has read; each phrase is cut out of its text once.

    Hashes are held in order, each with its count and the place of its phrase.
    """

    def __init__(self):
        self.phrases: list[bytes] = []
        self.keys, self.n, self.place = np.empty(0, dtype=U), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)

    def add(self, chunk: Chunk, found: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The runs of m words that start at some words of a chunk: (m, their hashes, those words)."""
        news = []
        for m, keys, rows in found:
            unique, first, n = np.unique(keys, return_index=True, return_counts=True)
            at = np.searchsorted(self.keys, unique)
            held = at < len(self.keys)
            held[held] = self.keys[at[held]] == unique[held]
            self.n[at[held]] += n[held]
            new = ~held
            place = np.arange(len(self.phrases), len(self.phrases) + new.sum(), dtype=np.int32)
            self.phrases.extend(chunk.phrases(rows[first[new]], m))
            news.append((unique[new], n[new], place))
        if news:
            self._insert(*map(np.concatenate, zip(*news)))

    def _insert(self, keys: np.ndarray, n: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order]) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), dtype=bool)
        old[at] = False
        for name, more in (("keys", keys), ("n", n), ("place", place)):
            held = getattr(self, name)
            both = np.empty(len(old), dtype=held.dtype)
            both[old], both[at] = held, more[order]
            setattr(self, name, both)

    def __len__(self) -> int:
        return len(self.phrases)

    def items(self) -> Iterator[tuple[bytes, int]]:
        """Phrases in order with their counts; nothing is held afterwards."""
        phrases, n = self.phrases, np.empty(len(self.phrases), dtype=np.int64)
        n[self.place] = self.n
        self.__init__()
        for at in sorted(range(len(phrases)), key=phrases.__getitem__):
            yield phrases[at], int(n[at])


def _frequent(chunk: Chunk, filters: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(m, hashes, starts) of the runs to be counted that the filters admit, with all their parts."""
    good = None
    for m, keys, counted in chunk.keys():
        if m > len(filters):
            return
        rows = np.arange(len(keys)) if good is None else np.flatnonzero(good[:-1] & good[1:])
        rows = rows[filters[m - 1].has(keys[rows])]
        good = np.zeros(len(keys), dtype=bool)
        good[rows] = True
        rows = rows[counted[rows]]
        yield m, keys[rows], rows


def _counted(batches: Iterator[pd.DataFrame], blooms: list) -> Iterator[Iterator[tuple[bytes, int]]]:
    """Sorted phrases with the counts of what a task has read, whenever it holds enough."""
    filters, counts = [read_bloom(bloom) for bloom in blooms], Counts()
    for batch in batches:
        for chunk in chunks(batch):
            counts.add(chunk, _frequent(chunk, filters))
            if len(counts) >= HELD_PHRASES:
                yield counts.items()
    if len(counts):
        yield counts.items()


def _shards(docs: DataFrame, blooms: list, bounds: list[bytes]) -> DataFrame:
    """(range, automaton): the counts of what tasks have read, cut at the bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for items in _counted(batches, blooms):
            # a bound belongs to the range that it opens
            for place, part in groupby(items, key=lambda item: bisect_right(bounds, item[0])):
                automaton = build((tuple(key.split(JOINT)), n) for key, n in part)
                yield pd.DataFrame({"range": [place], "automaton": [automaton.to_bytes()]})

    return docs.mapInPandas(run, "range int, automaton binary")


def _bounds(docs: DataFrame, blooms: list, words: int, phrases: int) -> list[bytes]:
    """Phrases that cut the sorted phrases into ranges of about ``RANGE``, from a bounded sample of documents.

    The sample decides how even the ranges are and nothing else.
    """
    ranges = min(max(phrases // RANGE, 1), MAX_RANGES)
    if ranges == 1:
        return []
    limit = int(min(1.0, SAMPLE_WORDS / max(words, 1)) * 2**31)
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(2**31)) < limit)
    keep = max(-(-phrases // SAMPLE_PHRASES), 1)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for items in _counted(batches, blooms):
            yield pd.DataFrame({"phrase": [phrase for phrase, _ in items]})

    found = some.mapInPandas(sample, "phrase binary").distinct()
    found = found.filter(F.pmod(F.xxhash64("phrase"), F.lit(keep)) == 0)
    with batches_of(docs.sparkSession, BATCH):
        keys = sorted(bytes(r[0]) for r in found.collect())
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys
    return sorted(set(cuts))


def _united(group: pd.DataFrame, least: int) -> pd.DataFrame:
    """(range, automaton): the automata of one range united; one at a time is unpacked."""
    automata = map(Automaton.from_bytes, group["automaton"])
    return pd.DataFrame({"range": [group["range"].iloc[0]], "automaton": [union(automata, least, JOINT.join).to_bytes()]})


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, list[bytes]]:
    """Totals (lang, n), the united automata (range, automaton) of phrases of ``least`` or more, and the bounds of ranges."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    blooms, known, totals, words = [], 0, None, 0
    for lengths in LEVELS:
        read = _count_hashes(docs, lengths, blooms[-1] if blooms else None)
        if totals is None:  # read twice: for the words of each lang and for the hashes
            read = durable(read, "words", BATCH)
            totals = durable(read.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            words = totals.agg(F.sum("n")).first()[0] or 0
        # a task has added up its own already: nothing is gained by doing so again before the shuffle
        counted = read.filter("key IS NOT NULL").repartition("key").groupBy("key")
        frequent = durable(counted.agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"), "frequent", BATCH)
        if not blooms:
            discard(read)
        count = frequent.count()
        if count:
            known += count
            blooms += [spark.sparkContext.broadcast(bloom_of(frequent, count))] * len(lengths)
        discard(frequent)
        if not count:
            break
    bounds = _bounds(docs, blooms, words, known)

    shards = _shards(docs, blooms, bounds)
    united = by_group(shards, "range", lambda group: _united(group, least), "range int, automaton binary", len(bounds) + 1)
    return totals, durable(united, "automata", BATCH), bounds


def _listed(automata: DataFrame, bounds: list[bytes]) -> DataFrame:
    """(lang, phrase, words, f, cut, first, rest, first_range, rest_range): phrases of two words and more, a row for each cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["automaton"]:
                out = []
                for (lang, *words), count in Automaton.from_bytes(blob).items():
                    name, phrase = bytes.fromhex(lang.decode()).decode(), plain(words)
                    for cut in range(1, len(words)):
                        ranges = [bisect_right(bounds, JOINT.join((lang, *part))) for part in (words[:cut], words[cut:])]
                        out.append((name, phrase, len(words), count, cut, plain(words[:cut]), plain(words[cut:]), *ranges))
                if out:
                    yield pd.DataFrame(out)

    return automata.mapInPandas(
        run,
        "lang string, phrase string, words int, f long, cut int, first string, rest string, first_range int, rest_range int",
    )


def _part_counts(automata: DataFrame, cuts: DataFrame) -> DataFrame:
    """(lang, part, n): the count of every part, by composing a range's wanted parts with its automaton."""
    sides = [cuts.select(F.col(f"{s}_range").alias("range"), "lang", F.col(s).alias("part")) for s in ("first", "rest")]
    wanted = sides[0].unionByName(sides[1]).distinct().withColumn("automaton", F.lit(None).cast("binary"))
    held = automata.select("range", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("part"), "automaton")

    def look_up(group: pd.DataFrame) -> pd.DataFrame | None:
        blobs = group["automaton"].dropna()
        asked = group[group["automaton"].isna()]
        if not len(blobs) or not len(asked):
            return None
        keys = sorted(key_of(lang, part) for lang, part in zip(asked["lang"], asked["part"]))
        found = list(Automaton.from_bytes(blobs.iloc[0]).compose(build((key, 0) for key in keys)))
        return pd.DataFrame({
            "lang": [bytes.fromhex(key[0].decode()).decode() for key, _ in found],
            "part": [plain(key[1:]) for key, _ in found],
            "n": [count for _, count in found],
        })

    return by_group(wanted.unionByName(held), "range", look_up, "lang string, part string, n long")


def collocations(docs: DataFrame, least: int = 30, contained: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of two to four words.

    Words and pieces are those of whole ``text``s with A-Z lowered; a null text is empty, a null lang
    ``und``, repeated rows count each time. Phrases that occur ``least`` times or more are scored by
    their weakest cut: floor(2,000,000 a / (l + r)), the earlier of equal cuts. One that is part of a
    longer phrase with at least ``contained`` percent of its count is left out. Ties go to the larger
    count, then to the phrase that is first in byte order. An empty table gives no rows.
    """
    with decoded_at_once(docs.sparkSession, DECODED):
        totals, automata, bounds = phrase_counts(docs, least)
    cuts = durable(_listed(automata, bounds), "cuts")
    parts = durable(_part_counts(automata, cuts), "parts")

    def part(side: str, name: str) -> DataFrame:
        return parts.select("lang", F.col("part").alias(side), F.col("n").alias(name))

    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = F.col("f").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    whole = "exact div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    scored = scored.withColumn("exact", exact).withColumn("score", F.expr(whole))
    weakest = scored.groupBy("lang", "phrase", "words", F.col("f").alias("a")).agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("at")
    )

    longer = cuts.filter("cut = 1 AND words > 2").select("lang", "phrase", "words", "f")
    split = F.split("phrase", " ", -1)
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1),"
        " i -> array_join(slice(w, i, m), ' '))))"
    )
    inside = (
        longer.withColumn("w", split).select("lang", "f", F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("f_longer"))
    )
    kept = weakest.join(inside, ["lang", "phrase"], "left").filter(
        F.col("f_longer").isNull()
        | (F.col("f_longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * contained)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    # the best of each of 64 shares of a lang first, so that no task sorts a whole lang
    shared = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    shared = shared.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = shared.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
