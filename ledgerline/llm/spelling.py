"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

One replaced letter moves a word's letter counts by one up and one down, one inserted letter by one
up: an L1 distance of two at most. Words of one length are held in a k-d tree over those counts,
whose leaves are cells of a few thousand words. Each word searches the tree of its own length (one
up and one down allowed) and that of the next (one up), leaving out every box that is farther off,
and travels to the cells that are left. A cell that very many words search is read by several tasks,
each with its points and a share of the searching words. Within a cell a finer tree does the same, and the words of
the last leaves are verified by the order of their letters. A cell hands on, for each of its words,
how many near words it found and the most frequent of them; links are never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.grouped import by_group
from ledgerline.session import discard, durable

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words of a cell, as far as the sample that the cells are cut by tells; and that sample's size
CELL, SAMPLE, PER_CELL = 4096, 50_000, 8
#: words of a cell's last leaves; more only where all have the same letters
LEAF = 32
#: leaves of more pairs than this are searched by equal halves of words
MANY, BLOCK = 1 << 16, 1 << 22
LETTERS = 256
#: words that search a cell in one task, as far as the sample tells
ASKING = 16 * CELL
COPY, POINT, SAME, SHORTER = -1, 0, 1, 2


def count_words(docs: DataFrame, least_length: int, least_n: int, slip: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): the maximal letter runs of all whole texts, A-Z lowered, counted before they travel.

    ``slip(doc_id, word)`` may change a word before it is counted; it may shorten it, never lengthen it.
    Null and empty texts have no words; a null doc_id reads as the empty text.
    """
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0)))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("word"))
    words = words.withColumn("word", F.translate("word", UPPER, LOWER))
    if slip is not None:
        words = words.withColumn("word", slip(F.col("doc_id"), F.col("word")))
    return (
        words.filter(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)
    )


def codes_of(words: list[str], length: int) -> np.ndarray:
    """(words, length): code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """(words, 256): letters by their code point's low byte; others may share one, which only loosens a box."""
    rows = np.arange(len(codes), dtype=np.int64)[:, None] * LETTERS
    return np.bincount((rows + (codes & 0xFF)).ravel(), minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS)


class Tree:
    """A k-d tree over letter counts; node i splits ``letter[i]`` after ``value[i]``, or is a leaf."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.letter, self.value, self.left, self.right = [], [], [], []
        self.members: dict[int, np.ndarray] = {}
        stack = [(np.arange(len(counts)), None, None)]
        while stack:
            rows, parent, side = stack.pop()
            node = len(self.letter)
            if parent is not None:
                side[parent] = node
            for column in (self.letter, self.value, self.left, self.right):
                column.append(-1)
            part = counts[rows]
            if len(rows) > leaf:
                middle = np.floor(part.mean(axis=0))
                share = (part <= middle).mean(axis=0)
                letter = int(np.argmin(np.abs(share - 0.5)))
                if share[letter] < 1:
                    self.letter[node], self.value[node] = letter, int(middle[letter])
                    low = part[:, letter] <= middle[letter]
                    stack += [(rows[~low], node, self.right), (rows[low], node, self.left)]
                    continue
            self.members[node] = rows

    def search(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows): the rows of ``counts`` within so many letters up and down of each leaf's box."""
        zero = np.zeros(len(counts), dtype=np.int64)
        stack = [(0, np.arange(len(counts)), zero, zero, {})]
        while stack:
            node, rows, ups, downs, box = stack.pop()
            if not len(rows):
                continue
            letter, value = self.letter[node], self.value[node]
            if letter < 0:
                yield node, rows
                continue
            have = counts[rows, letter]
            low, high = box.get(letter, (0, None))
            more = ups - np.maximum(low - have, 0) + np.maximum(value + 1 - have, 0)
            before = 0 if high is None else np.maximum(have - high, 0)
            less = downs - before + np.maximum(have - value, 0)
            right, left = more <= up, less <= down
            stack.append((self.right[node], rows[right], more[right], downs[right], box | {letter: (value + 1, high)}))
            stack.append((self.left[node], rows[left], ups[left], less[left], box | {letter: (low, value)}))


def parity(counts: np.ndarray) -> np.ndarray:
    """64 bits, each the parity of the letters that share it: one edit turns two at most."""
    folded = (counts & 1).reshape(len(counts), 4, 64).sum(axis=1) & 1
    return (folded.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` become those of ``b`` by one replacement, or, if ``b`` is longer, one insertion."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :length], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= length


def _equal_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal rows."""
    if not a.shape[1]:
        return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    _, keys = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
    keys = keys.ravel()
    order = np.argsort(keys[len(a) :], kind="stable")
    there = keys[len(a) :][order]
    first, last = np.searchsorted(there, keys[: len(a)]), np.searchsorted(there, keys[: len(a)], side="right")
    sizes = last - first
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(np.arange(len(a)), sizes), order[np.repeat(first, sizes) + within]


class Words:
    """Words of one length, with what a search needs of them."""

    def __init__(self, words: list[str], length: int):
        self.codes = codes_of(words, length)
        self.counts = letter_counts(self.codes)
        self.parity = parity(self.counts)


def _leaf_pairs(asked: Words, rows: np.ndarray, held: Words, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one leaf whose letter counts may be one edit apart."""
    if len(rows) * len(members) <= MANY:
        close = np.bitwise_count(asked.parity[rows][:, None] ^ held.parity[members][None, :]) <= 2
        i, j = np.nonzero(close)
        return rows[i], members[j]
    # one edit leaves the first half of a word or the second as it is
    half, step = asked.codes.shape[1] // 2, held.codes.shape[1] - asked.codes.shape[1]
    i, j = _equal_rows(asked.codes[rows, :half], held.codes[members, :half])
    k, m = _equal_rows(asked.codes[rows, half:], held.codes[members, half + step :])
    both = np.unique(np.stack([np.concatenate([rows[i], rows[k]]), np.concatenate([members[j], members[m]])]), axis=1)
    return both[0], both[1]


def near_pairs(asked: Words, held: Words, tree: Tree, down: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (asked, held) one edit apart; ``within`` one set each pair once."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    block = max(BLOCK // held.codes.shape[1], 1)
    for leaf, rows in tree.search(asked.counts, 1, down):
        members = tree.members[leaf]
        step = max(BLOCK // len(members), 1)
        for at in range(0, len(rows), step):
            i, j = _leaf_pairs(asked, rows[at : at + step], held, members)
            if within:
                i, j = i[i < j], j[i < j]
            for start in range(0, len(i), block):
                a, b = i[start : start + block], j[start : start + block]
                good = one_edit(asked.codes[a], held.codes[b])
                found.append((a[good], b[good]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def _search_cell(cell: pd.DataFrame) -> pd.DataFrame | None:
    """For each word of a cell: how many near ones it has here, and the most frequent, first in order if tied."""
    cell = cell.sort_values(["role", "word"], ignore_index=True)
    roles = cell["role"].to_numpy()
    ends = np.searchsorted(roles, [POINT, SAME, SHORTER], side="right")
    if not ends[0]:
        return None
    words, n = list(cell["word"]), cell["n"].to_numpy()
    length = len(words[0])
    points = Words(words[: ends[0]], length)
    tree = Tree(points.counts, LEAF)
    links = [near_pairs(points, points, tree, 1, True)] if roles[0] == POINT else []
    if ends[1] > ends[0]:
        i, j = near_pairs(Words(words[ends[0] : ends[1]], length), points, tree, 1, False)
        links.append((i + ends[0], j))
    if ends[2] > ends[1]:
        i, j = near_pairs(Words(words[ends[1] :], length - 1), points, tree, 0, False)
        links.append((i + ends[1], j))
    if not links:
        return None
    a, b = (np.concatenate(side) for side in zip(*links))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    if not len(a):
        return None
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.diff(a, prepend=-1))
    return pd.DataFrame({
        "word": [words[x] for x in a[heads]],
        "n_near": np.diff(np.append(heads, len(a))),
        "best_n": n[b[heads]],
        "best": [words[x] for x in b[heads]],
    })


class Cells:
    """The cells of one length: leaves of a tree over sampled words, each read by one task or several."""

    def __init__(self, sampled: np.ndarray, leaf: int, first: int):
        self.tree = Tree(sampled, leaf)
        self.leaves = sorted(self.tree.members)
        self.tree.members = {}
        self.tasks = dict.fromkeys(self.leaves, 1)
        self.first = first

    def deal(self, asking: list[tuple[np.ndarray, int]], share: float) -> int:
        """Set how many tasks read each leaf, by the sampled words that search it; return the next free number."""
        asked = dict.fromkeys(self.leaves, 0)
        for counts, down in asking:
            for leaf, rows in self.tree.search(counts, 1, down):
                asked[leaf] += len(rows)
        self.number, at = {}, self.first
        for leaf in self.leaves:
            self.tasks[leaf] = 1 + int(asked[leaf] / share / ASKING)
            self.number[leaf] = at
            at += self.tasks[leaf]
        return at


def _cells(words: DataFrame, total: int) -> dict[int, Cells]:
    """Cells by length, for every length of the sample and the next one.

    The sample is about ``SAMPLE`` words by hash; it decides where cells are cut and nothing else.
    """
    share = min(1.0, SAMPLE / max(total, 1))
    limit = int(share * 2**31)
    sampled: dict[int, list[str]] = {}
    for (word,) in words.filter(F.pmod(F.xxhash64("word"), F.lit(2**31)) < limit).select("word").collect():
        sampled.setdefault(len(word), []).append(word)
    counts = {length: letter_counts(codes_of(some, length)) for length, some in sampled.items()}
    none = np.empty((0, LETTERS), dtype=np.int64)
    out, first = {}, 0
    for length in sorted(set(counts) | {length + 1 for length in counts}):
        cells = Cells(counts.get(length, none), max(int(CELL * share), PER_CELL), first)
        first = cells.deal([(counts.get(length, none), 1), (counts.get(length - 1, none), 0)], share)
        out[length] = cells
    return out


def _routes(words: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(cell, role, word, n): each word in its own cell and in those that it searches."""

    def leaves(length: int, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, int, np.ndarray]]:
        if length not in cells:  # neither this length nor the one before was sampled: one cell, one task
            yield -length, 1, np.arange(len(counts))
            return
        of = cells[length]
        for leaf, rows in of.tree.search(counts, up, down):
            yield of.number[leaf], of.tasks[leaf], rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["word"].str.len().to_numpy(dtype=np.int64)
            for length in np.unique(lengths):
                part = batch[lengths == length].reset_index(drop=True)
                codes = codes_of(list(part["word"]), int(length))
                counts = letter_counts(codes)
                spread = (codes * (np.arange(length, dtype=np.int64) * 2654435761 % 65521 + 1)).sum(axis=1) % 1_000_003
                own = np.empty(len(part), dtype=np.int64)
                out = []
                for cell, tasks, rows in leaves(length, counts, 0, 0):
                    own[rows] = cell
                    out += [(np.full(len(rows), cell + t), COPY if t else POINT, rows) for t in range(tasks)]
                for cell, tasks, rows in leaves(length, counts, 1, 1):
                    rows = rows[own[rows] < cell]
                    out.append((cell + spread[rows] % tasks, SAME, rows))
                for cell, tasks, rows in leaves(length + 1, counts, 1, 0):
                    out.append((cell + spread[rows] % tasks, SHORTER, rows))
                sent = part.iloc[np.concatenate([rows for *_, rows in out])]
                yield pd.DataFrame({
                    "cell": np.concatenate([cell for cell, *_ in out]),
                    "role": np.repeat([role for _, role, _ in out], [len(rows) for *_, rows in out]),
                    "word": sent["word"].to_numpy(),
                    "n": sent["n"].to_numpy(),
                })

    return words.mapInPandas(run, "cell long, role int, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each word that has near ones, from distinct (word, n) of a stored table."""
    total = words.count()
    cells = _cells(words, total)
    spark = words.sparkSession
    # cells are small in bytes and long in work: as many tasks as there are groups of a few cells
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * CELL))
    found = by_group(
        _routes(words, cells), "cell", _search_cell, "word string, n_near long, best_n long, best string", parts
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best")
    )


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of (word, n), distinct and not null.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near
    word of largest n, ties to the first in code-point order, if its n is ``times`` the word's or more.
    The root is the end of the chain of forms; a chain gains ``times`` at each step, so doubling it
    until nothing changes takes a handful of rounds. An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("chains of forms end only if each is more frequent than the one before")
    words = durable(words.select("word", F.col("n").cast("long").alias("n")), "words")
    joined = durable(
        words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
            F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    chain = durable(joined.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "chain")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = durable(
            chain.join(ahead, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "chain",
        )
        discard(chain)
        chain = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return joined.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
