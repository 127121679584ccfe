"""Spelling variants against a comparison of all pairs, with cells and leaves of every size."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import spelling


def edits(word: str, letters: str) -> set[str]:
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    swap = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (cut | put | swap) - {word}


def brute(counts: dict[str, int], times: int) -> set[tuple]:
    letters = "".join({c for w in counts for c in w})
    near = {w: [x for x in edits(w, letters) if x in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def invented(count: int, seed: int) -> dict[str, int]:
    source, out = random.Random(seed), {}
    for _ in range(count):
        word = "".join(source.choice(("an", "in", "t", "e", "ré", "ß")) for _ in range(source.randint(3, 5)))
        for w in (word, *source.sample(sorted(edits(word, "aetß")), 2)):
            out[w] = source.choice((1, 2, 3, 40, 700, 9000))
    return out


def run(spark, counts: dict[str, int], times: int = 10) -> set[tuple]:
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return {tuple(r) for r in spelling.group_variants(words, times).collect()}


@pytest.mark.parametrize("cell, sample, asking", [(4096, 50_000, 10**6), (40, 50_000, 25), (40, 60, 25)])
def test_matches_all_pairs(spark, monkeypatch, cell, sample, asking):
    """One cell a length; many cells, read by several tasks each; cells cut by few words, lengths without a sample."""
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "SAMPLE", sample)
    monkeypatch.setattr(spelling, "ASKING", asking)
    counts = invented(300, cell + sample)
    assert run(spark, counts) == brute(counts, 10)


def test_anagrams_are_searched_by_halves(spark, monkeypatch):
    """Hundreds of words with the same letters fill one leaf."""
    monkeypatch.setattr(spelling, "MANY", 50)
    source, counts = random.Random(3), {}
    for _ in range(150):
        word = "".join(source.sample("abcdefg", 7))
        counts[word] = 3
        counts[word[:3] + "z" + word[4:]] = 50
        counts[word + "q"] = 900
    assert run(spark, counts) == brute(counts, 10)


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=7), st.text("abé", min_size=1, max_size=8))
def test_one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) < 2:
        near = spelling.one_edit(spelling.codes_of([a], len(a)), spelling.codes_of([b], len(b)))[0]
        assert near == (b in edits(a, "abé"))


def test_chains_ties_and_long_words(spark):
    base = "x" * 3000
    counts = {
        "aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000,  # a chain of forms
        "ccccccc": 2, "ccccccd": 20, "bcccccc": 20,  # a tie goes to the first in order
        base: 2, base + "y": 30, "日本語": 1, "日本": 10,
    }
    out = run(spark, counts)
    assert out == brute(counts, 10)
    assert ("aaaaaaa", "aaaaaab", "aaaabbb", 1, 1, 10) in out
    with pytest.raises(ValueError):
        run(spark, counts, 1)


def test_counts_of_awkward_rows(spark):
    rows = [(None, "Straße STRASSE", "w"), (1, None, "w"), (2, "", "w"), (3, "abc-abc abc", "w"), (3, "abc-abc abc", "w")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, word string")
    assert {tuple(r) for r in spelling.count_words(docs, 3, 1).collect()} == {("straße", 1), ("strasse", 1), ("abc", 6)}
    assert {tuple(r) for r in spelling.count_words(docs, 3, 2).collect()} == {("abc", 6)}
    assert spelling.count_words(docs.limit(0), 3, 1).count() == 0
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.group_variants(empty).count() == 0
