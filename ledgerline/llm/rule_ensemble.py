"""Quality scores from a sparse ensemble of rules.

Boosted trees on text statistics propose rules, each the conjunction of the conditions on a tree
path; a lasso logistic regression weighs them and drops most. What is left is compiled into one
column expression over the statistics, which are column expressions over the text themselves, so
scoring runs inside the executors' compiled code without Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.names import fresh
from ledgerline.llm.trees import boost

SAMPLE = 8_000
ROUNDS = 40
PENALTY = 0.001
THRESHOLD = 0.3
#: fixed values: what separates words, and what counts as a symbol or a mark
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#$%&*|!<>{}\[\]=_~^\\@+/]"
MARK = r"[.,;:?]"


def statistics(text: Column) -> dict[str, Column]:
    """Counts over a whole text by name; never null, whatever the text is."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.split(text, SPACE)
    counts = {
        "chars": F.length(text),
        "words": F.size(words),
        "distinct": F.size(F.array_distinct(words)),
        "lines": F.size(F.split(text, "\n")),
    }
    for name, pattern in (("symbols", SYMBOL), ("marks", MARK), ("upper", r"\p{Lu}"), ("digits", "[0-9]")):
        counts[name] = F.regexp_count(text, F.lit(pattern))
    return {name: value.cast("double") for name, value in counts.items()}


def features(s: dict[str, Column]) -> dict[str, Column]:
    """What the rules look at: ratios and logarithms of the counts. Words are at least 1."""
    return {
        "log_chars": F.log1p(s["chars"]),
        "log_words": F.log(s["words"]),
        "word_length": s["chars"] / s["words"],
        "distinct_share": s["distinct"] / s["words"],
        "distinct_growth": F.log1p(s["distinct"]) / F.log1p(s["words"]),
        "symbol_share": s["symbols"] / (s["chars"] + 1),
        "symbols_per_word": s["symbols"] / s["words"],
        "marks_per_word": s["marks"] / s["words"],
        "upper_share": s["upper"] / (s["chars"] + 1),
        "upper_per_word": s["upper"] / s["words"],
        "digit_share": s["digits"] / (s["chars"] + 1),
        "line_length": s["words"] / s["lines"],
    }


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with the features added under unused names, which are returned in order.

    The counts come out of a generator of one row, so a filter on the score is not rewritten into
    one that counts the text again for every rule.
    """
    stats = statistics(F.col(f"`{text}`"))
    names = {name: fresh(docs, f"stat_{name}") for name in stats}
    counted = docs.select("*", F.inline(F.array(F.struct(*[v.alias(names[n]) for n, v in stats.items()]))))
    made = features({name: F.col(own) for name, own in names.items()})
    columns = [fresh(docs, f"rule_{name}") for name in made]
    added = [value.alias(own) for own, value in zip(columns, made.values())]
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], *added), columns


@dataclass
class Rules:
    """Weights of conjunctions (feature, upper side, threshold)..., and the constant term."""

    constant: float
    weighted: list[tuple[float, tuple[tuple[int, bool, float], ...]]]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.stack([rule_holds(path, x) for _, path in self.weighted], axis=1) if self.weighted else np.empty((len(x), 0))

    def chances(self, x: np.ndarray) -> np.ndarray:
        weights = np.array([w for w, _ in self.weighted])
        return 1 / (1 + np.exp(-(self.constant + self.holds(x) @ weights)))

    def column(self, names: Sequence[str]) -> Column:
        """The score as one expression over feature columns."""
        total = F.lit(self.constant)
        for weight, path in self.weighted:
            tests = [F.col(f"`{names[f]}`") > F.lit(t) if upper else F.col(f"`{names[f]}`") <= F.lit(t) for f, upper, t in path]
            total = total + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def rule_holds(path: tuple[tuple[int, bool, float], ...], x: np.ndarray) -> np.ndarray:
    sides = [x[:, f] > t if upper else x[:, f] <= t for f, upper, t in path]
    return np.logical_and.reduce(sides).astype(float)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """(constant, weights) of the L1-penalised logistic fit, by accelerated proximal steps."""
    n, p = x.shape
    step = 4 * n / (np.linalg.norm(x, 2) ** 2 + n) if p else 1.0
    b, w = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(p)
    bb, ww, t = b, w, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(bb + x @ ww, -40, 40))) - y
        b1 = bb - step * error.mean()
        w1 = ww - step * (x.T @ error) / n
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - step * penalty, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        bb, ww = b1 + (t - 1) / t1 * (b1 - b), w1 + (t - 1) / t1 * (w1 - w)
        b, w, t = b1, w1, t1
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Rules:
    """Rules from tree paths, rare and equivalent ones left out, weighed by the lasso."""
    if not len(y):
        return Rules(0.0, [])
    known: dict[bytes, tuple] = {}
    if 0 < y.mean() < 1:
        for tree in boost(x, y, rounds, depth=3, rate=0.15, least=max(2, min(20, len(y) // 20)), share=0.6).trees:
            for path in tree.paths():
                holds = rule_holds(path, x)
                if 0.002 * len(y) <= holds.sum() <= 0.998 * len(y):
                    known.setdefault(min(holds.tobytes(), (1 - holds).tobytes()), path)
    paths = list(known.values())
    columns = np.stack([rule_holds(p, x) for p in paths], axis=1) if paths else np.empty((len(y), 0))
    constant, weights = lasso_logistic(columns, y, penalty)
    return Rules(float(constant), [(float(w), p) for w, p in zip(weights, paths) if abs(w) > 1e-6])


def learn_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_rows: int = SAMPLE) -> Rules:
    """Rules for ``quality`` = 1, from at most about ``sample_rows`` labelled documents.

    ``may_learn`` is a condition on the label's doc_id. A hash of doc_id chooses the sample; only
    its rows' texts are counted. Labels whose quality or doc_id is null are not learned from, and
    of a document with several labels the greatest counts.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .filter(may_learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    count = usable.count()
    share = int(min(1.0, sample_rows / max(count, 1)) * (1 << 30))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) <= share)
    # about sample_rows rows of two numbers: a bound that does not grow with the table
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    counted, names = with_features(texts)
    rows = counted.select("doc_id", "quality", *names).orderBy("doc_id", *names).toPandas()
    return fit_rules(rows[names].to_numpy(dtype=float), (rows["quality"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, rules: Rules, text: str = "text") -> tuple[DataFrame, str]:
    """The rows with their score under an unused name, which is returned."""
    counted, names = with_features(docs, text)
    score = fresh(docs, "quality_score")
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], rules.column(names).alias(score)), score


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    ``held_out`` is a condition on doc_id; labels are learned only where it is false, and a null
    doc_id is held out. The score comes from the text alone, a null text counting as empty; with
    no label to learn from every score is 0.5. Every row is scored, repeated ones each; other
    columns are not read. An empty table gives no rows.
    """
    held_out = F.coalesce(held_out, F.lit(True))
    rules = learn_quality(docs, labels, ~held_out)
    rows, score = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rules)
    return rows.select(
        "doc_id", held_out.alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is at least ``threshold``, with all their columns."""
    rows, score = scored(docs, learn_quality(docs, labels, ~F.coalesce(held_out, F.lit(True))))
    return rows.filter(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
