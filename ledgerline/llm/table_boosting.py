"""Boosted trees over examples that stay in a table: one pass for each level of each tree.

A task adds the gradients of its examples up by node and by interval of each feature, and the
driver, which sees no example, adds the tasks' sums up and splits by the rule of ``trees.grow``.
Gradients are multiples of a power of two, so their sums are exact: neither the order of the
examples nor their tasks change a tree. The table holds blocks of examples: their intervals, a byte
each, their labels and their logits so far, which are brought up to date every ``REFRESH`` trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.trees import BINS, Boosted, Tree
from ledgerline.session import discard, durable

REFRESH = 10
#: sums reach the driver from at most so many tasks a pass
TASKS = 128
UNIT = 2.0**20
#: logits are told apart in steps of 1 / STEPS when a limit is sought, up to EXTREME
STEPS, EXTREME = 256, 40
BLOCK = "held boolean, kinds binary, codes binary, y binary, logits binary"


def table_cut_points(rows: DataFrame, features: int) -> list[np.ndarray]:
    """``trees.cut_points`` of the array column x over all rows, by quantile summaries."""
    at = np.linspace(0, 1, BINS).tolist()
    found = rows.agg(*(F.percentile_approx(F.col("x")[i], at, 10_000).alias(f"q{i}") for i in range(features))).first()
    values = [np.unique(np.array(q, dtype=float)) for q in found]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def coded_blocks(rows: DataFrame, cuts: list[np.ndarray], kinds: int) -> DataFrame:
    """Blocks of (x, y, held): intervals of features, labels, logits of zero; kinds are the first features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_list()).astype(float)
            y, held = batch["y"].to_numpy().astype(np.uint8), batch["held"].to_numpy().astype(bool)
            codes = np.stack([np.searchsorted(c, column, side="left").astype(np.uint8) for c, column in zip(cuts, x.T)]).T
            kind = x[:, :kinds].argmax(axis=1).astype(np.uint8)
            out = [
                (h, kind[own].tobytes(), np.ascontiguousarray(codes[own]).tobytes(), y[own].tobytes(), np.zeros(own.sum()).tobytes())
                for h, own in ((False, ~held), (True, held))
                if own.any()
            ]
            yield pd.DataFrame(out, columns=["held", "kinds", "codes", "y", "logits"])

    return rows.select("x", "y", "held").mapInPandas(run, BLOCK)


def _blocks(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(kinds, codes, y, logits) of each block."""
    for kinds, codes, y, logits in zip(*(batch.column(name) for name in ("kinds", "codes", "y", "logits"))):
        yield (
            np.frombuffer(kinds.as_buffer(), dtype=np.uint8),
            np.frombuffer(codes.as_buffer(), dtype=np.uint8).reshape(-1, features),
            np.frombuffer(y.as_buffer(), dtype=np.uint8),
            np.frombuffer(logits.as_buffer(), dtype=float),
        )


def _chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -EXTREME, EXTREME)))


def _moved(codes: np.ndarray, logits: np.ndarray, base: float, trees: list[Tree]) -> np.ndarray:
    return base + sum((t.predict(codes) for t in trees), logits)


def block_sums(codes: np.ndarray, y: np.ndarray, logits: np.ndarray, tree: Tree, level: list[int], offsets: np.ndarray) -> np.ndarray:
    """Number, gradient and curvature, by node of the level and interval of each feature."""
    total, features = int(offsets[-1]), codes.shape[1]
    place = np.full(len(tree.feature), -1)
    place[level] = np.arange(len(level))
    at = place[tree.places(codes)]
    here = at >= 0
    chance = _chance(logits[here])
    flat = (codes[here] + (offsets[:-1] + at[here, None] * total)).ravel()
    weights = (None, np.rint((chance - y[here]) * UNIT), np.rint(chance * (1 - chance) * UNIT))
    size = len(level) * total
    return np.stack([np.bincount(flat, None if w is None else np.repeat(w, features), size)[:size].astype(float) for w in weights])


def split_level(tree: Tree, level: list[int], sums: np.ndarray, offsets: np.ndarray, least: int, rate: float) -> list[int]:
    """Splits the nodes of a level in place by their sums; the new nodes."""
    out = []
    for number, node in enumerate(level):
        n, g, h = sums[:, number, : offsets[1]].sum(axis=1)
        if node == 0:
            tree.value[0] = -rate * g / (h + 1.0)
        best = (1e-6, -1, 0, 0.0, 0.0)
        if n >= 2 * least:
            for f in range(len(offsets) - 1):
                size, gl, hl = np.cumsum(sums[:, number, offsets[f] : offsets[f + 1]], axis=1)[:, :-1]
                if not len(size):
                    continue
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(size < least) | (n - size < least)] = 0
                if gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], f, k, gl[k], hl[k])
        if best[1] >= 0:
            _, tree.feature[node], k, gl, hl = best
            tree.threshold[node] = float(k)
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            tree.value[tree.left[node]] = -rate * gl / (hl + 1.0)
            tree.value[tree.right[node]] = -rate * (g - gl) / (h - hl + 1.0)
            out += [tree.left[node], tree.right[node]]
    return out


def _pass(blocks: DataFrame, known: object, one: Callable, schema: str) -> DataFrame:
    """``one`` on the iterator of a task's batches and on ``known``, which is small."""
    return blocks.mapInArrow(lambda batches: one(batches, known), schema)


def _task_sums(batches: Iterator[pa.RecordBatch], known: tuple) -> Iterator[pa.RecordBatch]:
    base, trees, tree, level, offsets = known
    out = np.zeros((3, len(level) * int(offsets[-1])))
    for batch in batches:
        for _, codes, y, logits in _blocks(batch, len(offsets) - 1):
            out += block_sums(codes, y, _moved(codes, logits, base, trees), tree, level, offsets)
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], type=pa.binary())], names=["sums"])


def _task_moved(batches: Iterator[pa.RecordBatch], known: tuple) -> Iterator[pa.RecordBatch]:
    base, trees, features = known
    for batch in batches:
        new = [_moved(codes, logits, base, trees).tobytes() for _, codes, _, logits in _blocks(batch, features)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, type=pa.binary())], names=batch.schema.names)


def _task_hits(batches: Iterator[pa.RecordBatch], known: tuple) -> Iterator[pa.RecordBatch]:
    base, trees, features, kinds = known
    top = 2 * STEPS * EXTREME + 1
    n, hits = np.zeros(kinds * top), np.zeros(kinds * top)
    for batch in batches:
        for kind, codes, y, logits in _blocks(batch, features):
            step = np.floor((np.clip(_moved(codes, logits, base, trees), -EXTREME, EXTREME) + EXTREME) * STEPS).astype(int)
            slot = kind.astype(int) * top + step
            n += np.bincount(slot, minlength=len(n))
            hits += np.bincount(slot, y, len(hits))
    slot = np.flatnonzero(n)
    columns = [slot // top, slot % top, n[slot].astype(int), hits[slot].astype(int)]
    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["kind", "step", "n", "hits"])


def boost_table(blocks: DataFrame, cuts: list[np.ndarray], rounds: int, depth: int, rate: float, least: int) -> tuple[Boosted, Boosted]:
    """``trees.boost`` over the blocks that are not held out: trees over intervals, and over features."""
    offsets = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    learned = blocks.filter(~F.col("held"))
    n, positive = 0, 0
    for row in _pass(learned.coalesce(TASKS), None, _task_labels, "n long, positive long").collect():
        n, positive = n + row.n, positive + row.positive
    mean = np.clip(positive / n, 1e-3, 1 - 1e-3)
    start = base = float(np.log(mean / (1 - mean)))
    model, since, own = [], [], None
    for number in range(rounds):
        tree = Tree()
        level = [tree.add()]
        for _ in range(depth):
            parts = _pass(learned.coalesce(TASKS), (base, since, tree, level, offsets), _task_sums, "sums binary").collect()
            sums = sum(np.frombuffer(row.sums, dtype=float) for row in parts).reshape(3, len(level), -1)
            sums = np.stack([sums[0], sums[1] / UNIT, sums[2] / UNIT])
            level = split_level(tree, level, sums, offsets, least, rate)
            if not level:
                break
        model.append(tree)
        since.append(tree)
        if len(since) == REFRESH and number + 1 < rounds:
            before, own = own, durable(_pass(learned, (base, since, len(cuts)), _task_moved, BLOCK), "boosting")
            learned, base, since = own, 0.0, []
            if before is not None:
                discard(before)
    if own is not None:
        discard(own)
    plain = [
        Tree(t.feature, [float(cuts[f][int(k)]) if f >= 0 else 0.0 for f, k in zip(t.feature, t.threshold)], t.left, t.right, t.value)
        for t in model
    ]
    return Boosted(start, model), Boosted(start, plain)


def _task_labels(batches: Iterator[pa.RecordBatch], _: None) -> Iterator[pa.RecordBatch]:
    labels = [np.frombuffer(y.as_buffer(), dtype=np.uint8) for batch in batches for y in batch.column("y")]
    counts = [sum(len(y) for y in labels), sum(int(y.sum()) for y in labels)]
    yield pa.RecordBatch.from_arrays([pa.array([c], type=pa.int64()) for c in counts], names=["n", "positive"])


def precise_limits(blocks: DataFrame, coded: Boosted, features: int, kinds: int, precision: float) -> list[float]:
    """For each kind the least chance, one half at least, at which the held-out examples are precise; else 2."""
    held = blocks.filter("held")
    found = _pass(held, (coded.base, coded.trees, features, kinds), _task_hits, "kind long, step long, n long, hits long")
    counts = found.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas()
    out = []
    for kind in range(kinds):
        own = counts[counts["kind"] == kind].sort_values("step", ascending=False)
        precise = np.flatnonzero(own["hits"].cumsum().to_numpy() >= precision * own["n"].cumsum().to_numpy())
        out.append(max(0.5, float(_chance(own["step"].to_numpy()[precise[-1]] / STEPS - EXTREME))) if len(precise) else 2.0)
    return out
