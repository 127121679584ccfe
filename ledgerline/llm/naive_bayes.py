"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from a bounded, documented sample of labelled texts and are summed by Spark; the
log-probability matrix, whose size is fixed, is broadcast, and batches of texts are scored as the
sparse product of their n-gram counts with it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
MATRIX_CELLS = 1 << 23
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SAMPLE = 12_000
#: of a language with more texts at least about so many are learned from
EACH = 100
PIECE = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")
_U = np.uint32
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def grams(codes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each code point."""
    out = []
    for order in ORDERS:
        if len(codes) < order:
            break
        mixed = codes[: len(codes) - order + 1] * _FACTORS[0] + _U(order)
        for j in range(1, order):
            mixed = (mixed ^ (mixed >> _U(15))) * _FACTORS[j % 3] + codes[j : len(codes) - order + 1 + j] * _FACTORS[1]
        mixed = (mixed ^ (mixed >> _U(13))) * _FACTORS[2]
        out.append((mixed >> _U(7)) % _U(buckets))
    return out


def pieces(text: str):
    """Lower-cased code points of a text, a bounded piece at a time; pieces share two characters."""
    for start in range(0, max(1, len(text)), PIECE):
        part = text[max(0, start - max(ORDERS) + 1) : start + PIECE].lower()
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def has_letter(text) -> bool:
    """Whether some character is a letter; raised digits, fractions and number forms are none."""
    return isinstance(text, str) and any(any(map(str.isalpha, run[0])) for run in _WORD.finditer(text))


def text_scores(text: str, matrix: np.ndarray) -> np.ndarray:
    """Summed log probabilities of a text's n-grams for each language."""
    total = np.zeros(matrix.shape[1])
    for codes in pieces(text):
        counts = np.bincount(np.concatenate(grams(codes, len(matrix))), minlength=len(matrix)) if len(codes) else None
        if counts is not None:
            seen = np.flatnonzero(counts)
            total += counts[seen] @ matrix[seen]
    return total


def quota(counts: list[int], sample_rows: int) -> int:
    """The most texts of one language, so that those of all together are ``sample_rows`` if there are as many."""
    left = sample_rows
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) > left:
            return max(EACH, left // (len(counts) - i))
        left -= n
    return max(EACH, *counts)


def fit(docs: DataFrame, may_learn: Column, sample_rows: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probability matrix) from rows that ``may_learn`` selects.

    Learned from are about ``sample_rows`` texts, chosen by a hash of their id: all of a rare
    language, of the others about the same number each, and never less than about ``EACH``; so every
    language is known. Priors are the shares of all rows. The matrix has at most 2^23 cells, so more
    languages share fewer buckets.
    """
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    priors = sorted(tuple(r) for r in rows.groupBy("lang").count().collect())
    names = [lang for lang, _ in priors]
    if not names:
        return [], np.empty(0), np.empty((BUCKETS, 0))
    most = quota([n for _, n in priors], sample_rows)
    shares = [(lang, int(min(1.0, most / n) * (1 << 30))) for lang, n in priors]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    spot = F.pmod(F.xxhash64("doc_id", F.lit("lid")), F.lit(1 << 30))
    sample = rows.join(F.broadcast(shares), "lang").filter(spot <= F.col("share")).select("lang", "text")
    buckets = max(256, min(BUCKETS, 1 << ((MATRIX_CELLS // len(names)).bit_length() - 1)))

    def count_grams(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = totals.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                for codes in pieces(text):
                    for found in grams(codes, buckets):
                        own += np.bincount(found, minlength=buckets)
        for lang, own in totals.items():
            seen = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": own[seen]})

    counted = (
        sample.mapInPandas(count_grams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.full((buckets, len(names)), SMOOTHING)
    counts[counted["bucket"], counted["lang"].map({n: i for i, n in enumerate(names)})] += counted["n"]
    prior = np.log([n for _, n in priors]) - np.log(sum(n for _, n in priors))
    return names, prior, np.log(counts) - np.log(counts.sum(axis=0))


def identify(docs: DataFrame, held_out: Column, sample_rows: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of rows where ``held_out`` is not true; predicts from text
    alone. score is the posterior probability of lang_pred. A text that is null or has no letter
    is ``und`` with score 1 (nothing is left to decide), and so is every text, with score 0, when
    there is nothing to learn from. Ties go to the first language by code point. Rows with a null
    doc_id are scored too and are held out; repeated rows are scored each; other columns are not
    read. An empty table gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    names, prior, matrix = fit(docs, ~F.col("held_out"), sample_rows)
    model = docs.sparkSession.sparkContext.broadcast((names, prior, matrix))

    def run(batches):
        langs, log_prior, table = model.value
        for batch in batches:
            preds, scores = [], []
            for text in batch["text"]:
                if not has_letter(text) or not langs:
                    preds.append("und")
                    scores.append(0.0 if has_letter(text) else 1.0)
                    continue
                logs = log_prior + text_scores(text, table)
                odds = np.exp(logs - logs.max())
                preds.append(langs[int(odds.argmax())])
                scores.append(float(odds.max() / odds.sum()))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": preds, "score": scores}
            )

    return docs.select("doc_id", "held_out", "text").mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
